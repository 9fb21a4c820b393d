"""Files in and out: image folders, ground truth, class maps, JSON records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliospark.functions import texts as x

SUMMARY = "stem string, fname string, predicted_text string, texts array<string>, splits array<struct<strip_stem:string,predicted_text:string,cer:double,wer:double,error:string>>, crop_images array<string>, generated_at timestamp, error string"


def image_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """path, name, stem, ext of image files below a folder, by path; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path")
    named = files.withColumn("name", x.base_name(F.col("path"))).withColumn("stem", x.stem(F.col("name"))).withColumn("ext", x.ext(F.col("name")))
    return named.filter(F.col("ext").isin(*x.IMAGE_SUFFIXES)).orderBy("path")


def read_images(spark: SparkSession, folder: str, on_error: str = "skip", side: int = 384) -> DataFrame:
    """origin, height, width, nChannels, mode, data. Unreadable files are skipped, or white squares with on_error='white'."""
    raw = spark.read.format("image").option("recursiveFileLookup", True).load(folder).select("image.*")
    if on_error == "skip":
        return raw.filter("height > 0")
    white = {"height": F.lit(side), "width": F.lit(side), "nChannels": F.lit(3), "mode": F.lit(16), "data": F.lit(bytes([255]) * (side * side * 3))}
    return raw.select("origin", *(F.when(F.col("height") > 0, F.col(c)).otherwise(v).alias(c) for c, v in white.items()))


def read_class_folders(spark: SparkSession, folder: str) -> DataFrame:
    """path, class_name (the parent folder), class_idx."""
    from foliospark.operators.training import class_indices

    return class_indices(image_manifest(spark, folder).withColumn("class_name", F.element_at(F.split("path", "/"), -2)))


def changed_images(spark: SparkSession, folder: str, state: str) -> DataFrame:
    """What changed below a folder since the last run: path, name, stem, ext, status (added, changed, removed). ``state`` is a folder of listings, one a run.

    A listing holds path, length and modification time; a run meets the last one by a full join on the path, so only what is added or changed has
    to be decoded. The new listing counts once it is written whole: a run that fails before leaves the old one, and its changes come again.
    """
    columns = ["path", "length", "modificationTime"]
    fs, place = _hadoop(spark, state)
    runs = sorted(int(s.getPath().getName().partition("=")[2]) for s in fs.listStatus(place) if s.getPath().getName().startswith("run=") and fs.exists(_path(spark, f"{state}/{s.getPath().getName()}/_SUCCESS"))) if fs.exists(place) else []
    now = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select(*columns)
    this = f"{state}/run={runs[-1] + 1 if runs else 0}"
    now.filter(x.ext(x.base_name(F.col("path"))).isin(*x.IMAGE_SUFFIXES)).write.mode("overwrite").parquet(this)
    own = spark.read.parquet(this)
    was = spark.read.schema(own.schema).parquet(f"{state}/run={runs[-1]}") if runs else own.limit(0)
    met = own.withColumn("_now", F.lit(True)).join(was.select("path", *(F.col(c).alias(f"_{c}") for c in columns[1:]), F.lit(True).alias("_was")), "path", "full")
    same = F.col("length").eqNullSafe(F.col("_length")) & F.col("modificationTime").eqNullSafe(F.col("_modificationTime"))
    status = F.when(F.col("_was").isNull(), "added").when(F.col("_now").isNull(), "removed").when(~same, "changed")
    name = x.base_name(F.col("path"))
    return met.withColumn("status", status).filter("status is not null").select("path", name.alias("name"), x.stem(name).alias("stem"), x.ext(name).alias("ext"), "status")


def _path(spark: SparkSession, path: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)


def _hadoop(spark: SparkSession, path: str):
    place = _path(spark, path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def read_quoted_csv(spark: SparkSession, path: str, schema: str, header: bool = True) -> DataFrame:
    """Records of CSV files whose quoted fields may hold line breaks, with _file and _record (from 1) in the order of the file.

    A file is read by many tasks, a line a row. Whether a line starts inside quotes follows from how many quotes stand before it: each block of a
    file is counted first (a row a block), and within a block a running sum goes on from there. A line that starts outside begins a record; only lines
    of records of several lines meet in a shuffle of their own. Quotes inside fields are doubled.
    """
    raw = spark.read.option("lineSep", "\n").text(path).select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_line"))
    lines = raw.withColumn("_quotes", F.length("value") - F.length(F.replace(F.col("value"), F.lit('"'), F.lit(""))))
    inside = Window.partitionBy("_file", "_block").orderBy("_line")
    earlier = Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = lines.groupBy("_file", "_block").agg(F.sum("_quotes").alias("_n")).withColumn("_open", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    before = F.coalesce(F.sum("_quotes").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    marked = lines.join(blocks.select("_file", "_block", "_open"), ["_file", "_block"]).withColumn("_starts", (F.pmod(F.col("_open") + before, F.lit(2)) == 0).cast("int"))
    counted = marked.groupBy("_file", "_block").agg(F.sum("_starts").alias("_n")).withColumn("_base", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    numbered = marked.join(counted.select("_file", "_block", "_base"), ["_file", "_block"]).withColumn("_record", F.col("_base") + F.sum("_starts").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    alone = (F.col("_starts") == 1) & (F.col("_quotes") % 2 == 0)
    several = numbered.filter(~alone).groupBy("_file", "_record").agg(F.array_sort(F.collect_list(F.struct("_block", "_line", "value"))).alias("ls")).select("_file", "_record", F.array_join(F.transform("ls", lambda e: e["value"]), "\n").alias("value"))
    records = numbered.filter(alone).select("_file", "_record", "value").unionByName(several).withColumn("value", F.regexp_replace("value", "\r$", ""))
    records = records.filter("value <> ''" + (" and _record > 1" if header else ""))
    return records.withColumn("r", F.from_csv("value", F.lit(schema), {"escape": '"'})).select("_file", "_record", "r.*")


def read_ground_truth(spark: SparkSession, path: str) -> DataFrame:
    """file_name, text; of a repeated name the last row counts, files in order of their names. Large files are read by many tasks."""
    rows = read_quoted_csv(spark, path, "file_name string, text string")
    last = rows.groupBy(F.trim("file_name").alias("file_name")).agg(F.max_by(F.struct("text"), F.struct("_file", "_record")).alias("t"))
    return last.select("file_name", "t.text")


def read_class_map(spark: SparkSession, path: str) -> DataFrame:
    """One JSON object of index to label -> class_idx, folder."""
    return parsed_class_map(spark.read.text(path, wholetext=True), "value")


def parsed_class_map(maps: DataFrame, column: str) -> DataFrame:
    """The same from a column of such objects, as ``class_map_json`` makes them."""
    each = maps.select(F.explode(F.from_json(column, "map<string,string>")).alias("k", "folder"))
    return each.select(F.col("k").cast("int").alias("class_idx"), "folder")


def read_summaries(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(SUMMARY).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").option("multiLine", True).json(folder).filter("stem is not null").orderBy("stem")


def with_bucket(df: DataFrame, buckets: int) -> DataFrame:
    """A folder for each page would be a billion folders; a hash deals pages to a fixed number."""
    return df.withColumn("bucket", F.pmod(F.xxhash64("page_id"), F.lit(buckets)).cast("int"))


def write_page_meta(pages: DataFrame, path: str, buckets: int = 64) -> None:
    """A JSON record a page, in folders bucket=0..; the record holds its page_id."""
    with_bucket(pages, buckets).repartition("bucket").write.mode("overwrite").partitionBy("bucket").json(path)


def write_block_meta(blocks: DataFrame, path: str, buckets: int = 64) -> None:
    """A JSON record a block, in folders as those of pages."""
    with_bucket(blocks, buckets).repartition("bucket").write.mode("overwrite").partitionBy("bucket").json(path)


def write_summaries(pages: DataFrame, path: str) -> None:
    """One JSON record a page; UTF-8 as it is, no key for a null error. Each file is a line a record."""
    pages.withColumn("generated_at", F.current_timestamp()).write.mode("overwrite").json(path)


def write_labels(labels: DataFrame, *paths: str) -> None:
    """file_name, text as CSV with header, to each path (one for raw and one for processed images)."""
    kept = labels.select("file_name", "text").cache()
    for path in paths:
        kept.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
    kept.unpersist()


def class_map_json(classes: DataFrame) -> DataFrame:
    """class_idx, folder -> one JSON object in order of index; a class list is small."""
    pairs = F.transform(F.array_sort(F.collect_list(F.struct("class_idx", "folder"))), lambda e: F.struct(e.class_idx.cast("string"), e.folder))
    return classes.agg(F.to_json(F.map_from_entries(pairs)).alias("json"))

