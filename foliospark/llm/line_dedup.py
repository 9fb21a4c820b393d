"""Line dedup over a corpus: hashes of lines are range-partitioned and sorted, documents get keep bitmaps.

Every line of a text (cut at ``\\n``) is known by its key, the line stripped of
ASCII white space at both ends with A-Z lower-cased. Two 64-bit hashes of the key
are dealt out by ranges and sorted by document and position, so one pass over a
partition sees each key's first occurrence and counts its documents as they come.
What goes back to a document is the keep bitmap of its lines, compressed to the
runs that are dropped; text never takes part in the sort.

Scale: a line is 40 bytes in the shuffle, whatever its length. A key that many
documents share (a third of all, say) is found beforehand by a histogram of
leading hash bits, some 64 for each partition; lines under a crowded pattern are
dealt to blocks of documents and only the blocks' counts meet. How crowded a
pattern must be changes where lines go, never the result.

Defined cases: a null or empty text is one empty line. Keys under ``min_chars``
code points never go. Documents are told apart by doc_id, so rows that repeat an
id count once; a text without an id is a document of its own. Rows of the same id
and text get the same bitmap. Other columns don't matter and pass ``drop_lines``,
whatever their names. An empty table gives an empty result. Of ties in the order
(a key twice in one text) the earlier line is first.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliospark.llm.shared import let, lower_ascii, stored, unused

#: The white space that keys are stripped of.
_SPACE = " \t\n\x0b\x0c\r"
#: Leading hash patterns for each partition of the sort, and the fewest lines that make a block.
_PATTERNS, _LEAST = 64, 1000


def text_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    return lower_ascii(F.btrim(line, F.lit(_SPACE)))


def row_hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def line_hashes(docs: DataFrame, min_chars: int = 1) -> DataFrame:
    """docs: doc_id, text. A row a line: doc_id, row (the text's hash), anon (row where there is no doc_id, else 0), pos from 0, h1, h2."""
    row = row_hash(F.col("text"))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("row", row).withColumn("anon", F.when(F.col("doc_id").isNull(), F.col("row")).otherwise(F.lit(0)))
    each = own.select("doc_id", "row", "anon", F.posexplode(text_lines(F.col("text"))).alias("pos", "line")).withColumn("key", line_key(F.col("line")))
    return each.filter(F.length("key") >= max(min_chars, 0)).select("doc_id", "row", "anon", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))


def hot_keys(lines: DataFrame) -> DataFrame:
    """(h1, h2, blocks) of the keys with so many lines that they are dealt to blocks: at most four for each partition of the sort.

    A histogram of leading hash bits first tells the few patterns that may hold such a key; only their lines are counted by key.
    """
    parts = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    head = F.shiftrightunsigned("h1", 64 - max(10, (_PATTERNS * parts - 1).bit_length())).alias("head")
    counts = stored(lines.groupBy(head).agg(F.count("*").alias("n")), "line-heads")
    block = max(_LEAST, (counts.agg(F.sum("n")).first()[0] or 0) // (4 * parts))
    crowded = counts.filter(F.col("n") > block).select("head")  # four for each partition at most, too
    keys = lines.withColumn("head", head).join(F.broadcast(crowded), "head", "left_semi").groupBy("h1", "h2").agg(F.count("*").alias("n"))
    return stored(keys.filter(F.col("n") > block).select("h1", "h2", F.ceil(F.col("n") / block).cast("long").alias("blocks")), "hot-lines")


def shared_lines(docs: DataFrame, min_chars: int = 1, min_docs: int = 10, keep_first: bool = False) -> DataFrame:
    """The lines to drop (doc_id, row, pos): those whose key stands in ``min_docs`` documents or more; with ``keep_first`` all of them but the first by doc_id and position."""
    lines = stored(line_hashes(docs, min_chars), "lines")
    placed = lines.join(F.broadcast(hot_keys(lines)), ["h1", "h2"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    placed = placed.withColumn("block", F.when(F.col("blocks") == 1, F.lit(0)).otherwise(F.pmod(F.xxhash64("doc_id", "anon"), "blocks")))
    key = ["h1", "h2", "block"]
    order = ["doc_id", "anon", "row", "pos"]
    group = Window.partitionBy(*key)
    stream = group.orderBy(*order)
    before = F.lag(F.struct("doc_id", "anon")).over(stream)
    starts = ~before.eqNullSafe(F.struct("doc_id", "anon"))
    seen = placed.repartitionByRange(*key).withColumn("starts", starts.cast("long")).withColumn("at", F.row_number().over(stream)).withColumn("n", F.sum("starts").over(group))
    found = stored(seen.filter((F.col("blocks") > 1) | (F.col("n") >= min_docs)).select("h1", "h2", "blocks", "at", "n", *order), "shared-lines")
    plain, dealt = found.filter("blocks = 1"), found.filter("blocks > 1")
    place = F.struct(*order)
    totals = dealt.filter("at = 1").groupBy("h1", "h2").agg(F.sum("n").alias("total"), F.min(place).alias("first")).filter(F.col("total") >= min_docs)
    dealt = dealt.join(F.broadcast(totals), ["h1", "h2"])  # a row a hot key
    if keep_first:
        plain, dealt = plain.filter("at > 1"), dealt.filter(~place.eqNullSafe(F.col("first")))
    return plain.select("doc_id", "row", "pos").unionByName(dealt.select("doc_id", "row", "pos"))


def _runs(places: Column) -> Column:
    """Sorted positions as runs (start, length)."""
    starts = F.filter(places, lambda p, i: (i == 0) | (F.get(places, i - 1) != p - 1))
    ends = F.filter(places, lambda p, i: (i == F.size(places) - 1) | (F.get(places, i + 1) != p + 1))
    return F.zip_with(starts, ends, lambda s, e: F.struct(s.alias("start"), (e - s + 1).alias("length")))


def keep_bitmaps(docs: DataFrame, min_chars: int = 1, min_docs: int = 10, keep_first: bool = False) -> DataFrame:
    """doc_id, row (hash of the text), n_dropped, dropped (runs of line numbers from 0: start, length) for each text that loses a line; the others keep all."""
    gone = shared_lines(docs, min_chars, min_docs, keep_first).groupBy("doc_id", "row").agg(F.sort_array(F.collect_set("pos")).alias("places"))
    return gone.select("doc_id", "row", F.size("places").cast("long").alias("n_dropped"), let(F.col("places"), _runs).alias("dropped"))


def kept_text(lines: Column, dropped: Column) -> Column:
    """The lines outside the runs, joined again; all of them if ``dropped`` is null."""
    end = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.get(dropped, i - 1).start + F.get(dropped, i - 1).length)
    upto = lambda i: F.when(i == F.size(dropped), F.size(lines)).otherwise(F.get(dropped, i).start)
    pieces = F.transform(F.sequence(F.lit(0), F.size(dropped)), lambda i: F.slice(lines, end(i) + 1, upto(i) - end(i)))
    return F.array_join(F.when(dropped.isNull(), lines).otherwise(F.flatten(pieces)), "\n")


def drop_lines(docs: DataFrame, min_chars: int = 1, min_docs: int = 10, keep_first: bool = False) -> DataFrame:
    """docs with texts without the lines that many documents share, and n_lines and n_dropped (named with underscores in front where docs has such columns). The bitmaps meet the texts by a join."""
    maps = keep_bitmaps(docs, min_chars, min_docs, keep_first)
    names = {c: unused(c, docs) for c in ("doc_id", "row", "dropped", "n_dropped", "n_lines")}
    maps = reduce(lambda df, c: df.withColumnRenamed(c, names[c]), maps.columns, maps)
    own = docs.withColumn(names["row"] + "_", row_hash(F.col("text")))
    joined = own.join(maps, own["doc_id"].cast("long").eqNullSafe(maps[names["doc_id"]]) & (own[names["row"] + "_"] == maps[names["row"]]), "left")
    text = let(text_lines(F.col("text")), lambda x: F.struct(F.size(x).cast("long").alias("n"), kept_text(x, F.col(names["dropped"])).alias("text")))
    kept = unused("_kept", joined)
    out = joined.withColumn(kept, text)
    others = [F.col(f"`{c}`") if c != "text" else F.col(kept).getField("text").alias("text") for c in docs.columns]
    return out.select(*others, F.col(kept).getField("n").alias(names["n_lines"]), F.coalesce(names["n_dropped"], F.lit(0)).alias(names["n_dropped"]))
