"""Page reports: texts of strips and pages, artefact look-ups, job logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliospark.functions import texts as x

NO_STRIPS, NO_OUTPUT = "No preprocessed strips found", "No output generated"
TERMINAL = ("done", "failed")


def strip_texts(words: DataFrame) -> DataFrame:
    """words: stem, block_id, word_idx, word_mat, word_raw. Text per strip, words in string order of their numbers."""
    name = F.format_string("%s_word_%03d_strip.png", "block_id", "word_idx")
    said = lambda c: F.array_join(F.filter(F.transform(F.array_sort(F.collect_list(F.struct(name.alias("k"), x.strip_text(F.col(c)).alias("t")))), lambda w: w.t), lambda t: t != ""), " ")
    return words.groupBy("stem", "block_id").agg(said("word_mat").alias("text"), said("word_raw").alias("text_raw"), F.count("*").alias("n_words"))


def page_texts(strips: DataFrame) -> DataFrame:
    """strips: stem, block_id, text, error (or null). Failed strips are splits, but no texts; empty ones are left out of the joined text."""
    one = F.struct("block_id", "text", "error")
    pages = strips.groupBy("stem").agg(F.array_sort(F.collect_list(one)).alias("splits"))
    texts = F.transform(F.filter("splits", lambda s: s.error.isNull()), lambda s: s.text)
    return pages.withColumn("texts", texts).withColumn("predicted_text", x.strip_text(F.array_join(F.filter("texts", lambda t: t != ""), " "))).withColumn("crop_images", F.transform("splits", lambda s: F.concat(s.block_id, F.lit("_strip.png"))))


def summaries(pages: DataFrame) -> DataFrame:
    failed = F.exists("splits", lambda s: s.error.isNotNull())
    split = F.transform("splits", lambda s: F.struct(s.block_id.alias("strip_stem"), s.text.alias("predicted_text"), *(F.when(s.error.isNotNull(), 100.0).otherwise(0.0).alias(m) for m in ("cer", "wer")), s.error.alias("error")))
    return pages.select("stem", F.concat("stem", F.lit(".png")).alias("fname"), "predicted_text", "texts", split.alias("splits"), "crop_images", failed.alias("any_failed"))


def attach_artefacts(strips: DataFrame, artefacts: DataFrame) -> DataFrame:
    """strips: stem, name; artefacts: stem, kind, name, path. Adds binarized, original, block, craft and debug of the strip, page (layout image) and page_image (original) of its page; "" where missing.

    Both are dealt out by page once, a row each; tables that are dealt out so already are not moved. There, a strip meets the artefacts of its
    block, of its name's stem and of its original's name by a sort for each of the three, and takes the first path of each kind, so the work is linear in both. Repeated strips stay as often as they come.
    """
    name, kind, path = F.col("name"), F.col("kind"), F.col("path")
    less = lambda suffix: F.when(name.endswith(suffix), F.substring(name, F.lit(1), F.length(name) - len(suffix)))
    #: What a strip is found by, and what its artefacts of each kind are.
    shared = (
        (x.block_of(name), {"block": less("_block.png"), "craft": less("_craft.png")}),
        (x.stem(name), {"binarized": less("_binarized.png"), "debug": less("_mat_debug.png")}),
        (x.original_name(name), {"original": name}),
    )
    of_page = {"layout": "page", "page": "page_image"}
    none = F.lit(None).cast("string")
    held = artefacts.filter(kind.isin(*(k for _, kinds in shared for k in kinds)))
    rows = strips.select("stem", "name", none.alias("kind"), none.alias("path")).unionByName(held.select("stem", "name", "kind", "path"))
    for own, kinds in shared:
        key = F.coalesce(F.when(kind.isNull(), own), *(F.when(kind == k, of) for k, of in kinds.items()))
        alike = Window.partitionBy("stem").orderBy("_key").rangeBetween(Window.currentRow, Window.currentRow)
        keyed = rows.withColumn("_key", key).filter(kind.isNull() | ~kind.isin(*kinds) | F.col("_key").isNotNull())
        rows = keyed.withColumns({k: F.min(F.when((kind == k) & F.col("stem").isNotNull(), path)).over(alike) for k in kinds}).filter(kind.isNull() | ~kind.isin(*kinds)).drop("_key")
    for k, out in of_page.items():
        rows = rows.join(artefacts.filter(kind == k).groupBy("stem").agg(F.min("path").alias(out)), "stem", "left")
    return rows.select("stem", "name", *(F.coalesce(c, F.lit("")).alias(c) for c in ("binarized", "original", "block", "craft", "debug", *of_page.values())))


def collect_results(requested: DataFrame, done: DataFrame) -> DataFrame:
    """requested: name; done: stem, predicted_text. Names without a summary get an error row."""
    r = requested.withColumn("stem", x.stem(F.col("name")))
    joined = r.join(done.select("stem", "predicted_text", F.lit(True).alias("_has")), "stem", "left")
    return joined.select("stem", F.col("name").alias("fname"), F.coalesce("predicted_text", F.lit("")).alias("predicted_text"), F.when(F.col("_has").isNull(), NO_OUTPUT).alias("error"))


def requested_images(manifest: DataFrame, requested: DataFrame | None = None) -> DataFrame:
    """Requested names (ord, name) that exist, in the order asked, repeats kept; with nothing asked all."""
    if requested is None:
        return manifest.orderBy("name")
    return requested.join(manifest, "name").orderBy("ord")


def pages_without_strips(pages: DataFrame, strips: DataFrame) -> DataFrame:
    return pages.join(strips.select("stem").distinct(), "stem", "left_anti").select("stem", F.lit("").alias("predicted_text"), F.lit(NO_STRIPS).alias("error"))


def strip_source(pages: DataFrame, per_stem: DataFrame, flat: DataFrame) -> DataFrame:
    """Strips of a page's own folder, or from the flat folder by prefix if it has none. per_stem: stem, name; flat: name."""
    lacking = pages.select("stem").join(per_stem.select("stem").distinct(), "stem", "left_anti")
    stems = F.explode(F.transform(F.sequence(F.lit(1), F.size(F.split("name", "_")) - 1), lambda i: F.array_join(F.slice(F.split("name", "_"), F.lit(1), i), "_")))
    by_prefix = flat.filter(x.is_strip_file(F.col("name")) & F.col("name").contains("_")).select("name", stems.alias("stem"))
    return per_stem.filter(x.is_strip_file(F.col("name"))).select("stem", "name").unionByName(by_prefix.join(lacking, "stem").select("stem", "name"))


def first_uploads(queue: DataFrame) -> DataFrame:
    """queue: name, seq. The first upload of each name."""
    return queue.groupBy("name").agg(F.min("seq").alias("seq"))


def run_statistics(results: DataFrame) -> DataFrame:
    ok = F.col("error").isNull() & (F.col("predicted_text") != "")
    return results.agg(F.count("*").alias("images"), F.count_if(ok).alias("successful"), F.count_if(~ok).alias("issues"))


def job_status(events: DataFrame) -> DataFrame:
    """events: job_id, seq_id, ts, status, msg. The latest status of each job and its log's length. Batch or stream."""
    last = F.max_by("status", F.struct("ts", "seq_id"))
    return events.groupBy("job_id").agg(last.alias("status"), F.count("*").alias("n_log"))


def until_terminal(events: DataFrame) -> DataFrame:
    """The events of each job up to its first terminal state."""
    before = Window.partitionBy("job_id").orderBy("ts", "seq_id").rowsBetween(Window.unboundedPreceding, -1)
    over = F.coalesce(F.max(F.col("status").isin(*TERMINAL).cast("int")).over(before), F.lit(0))
    return events.withColumn("_over", over).filter("_over = 0").drop("_over")


def log_tail(events: DataFrame, offset: int) -> DataFrame:
    own = Window.partitionBy("job_id").orderBy("ts", "seq_id")
    return events.withColumn("line_no", F.row_number().over(own).cast("bigint")).filter(F.col("line_no") > offset)

