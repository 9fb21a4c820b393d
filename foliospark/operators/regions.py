"""Layout regions of pages: filters, title-or-fallback, overlap suppression, reading order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliospark.functions import geometry as g


def explode_detections(df: DataFrame) -> DataFrame:
    """page_id, boxes (JSON array of {label, score, coordinate[4]}) -> a row a detection, with its place and whole coordinates."""
    boxes = F.from_json("boxes", "array<struct<label:string,score:double,coordinate:array<double>>>")
    e = df.select("page_id", F.posexplode(boxes).alias("det_idx", "b"))
    corner = [F.element_at("b.coordinate", i + 1).cast("bigint").alias(n) for i, n in enumerate(("x1", "y1", "x2", "y2"))]
    return e.select("page_id", F.col("det_idx").cast("bigint").alias("det_idx"), "b.label", F.coalesce("b.score", F.lit(0.0)).alias("score"), *corner)


def text_detections(detections: DataFrame, least: float = g.LEAST_SCORE) -> DataFrame:
    kept = detections.filter(_read_later(least))
    return kept.withColumn("category", g.label_to_category(F.col("label"))).withColumn("box_id", g.box_id(F.col("category"), F.col("det_idx")))


def title_or_fallback(boxes: DataFrame, most: int = 3) -> DataFrame:
    """Pages with a title keep their titles; others their largest bodies. ``rank`` is the order by area."""
    page, size = Window.partitionBy("page_id"), g.area(_cols())
    ranked = boxes.withColumn("has_title", F.max((F.col("category") == "title").cast("int")).over(page) == 1)
    ranked = ranked.filter(~F.col("has_title") | (F.col("category") == "title"))
    ranked = ranked.withColumn("rank", F.row_number().over(page.orderBy(size.desc(), "det_idx")))
    return ranked.filter(F.col("has_title") | (F.col("rank") <= most))


class _cols:
    """The current row's box."""

    def __getattr__(self, name: str) -> Column:
        return F.col(name)


def suppress_overlaps(boxes: DataFrame, most: float = g.MOST_OVERLAP) -> DataFrame:
    """By page, in order of rank: a box goes if it overlaps one that stayed. A fold over the page's few boxes, inside Catalyst."""
    names = ("rank", "det_idx", "label", "category", "box_id", "score", "x1", "y1", "x2", "y2")
    pages = boxes.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct(*names))).alias("boxes"))
    start = F.slice("boxes", 1, 0)
    kept = F.aggregate("boxes", start, lambda acc, b: F.when(F.exists(acc, lambda k: g.io_min(b, k) > most), acc).otherwise(F.concat(acc, F.array(b))))
    return pages.select("page_id", F.explode(kept).alias("b")).select("page_id", "b.*")


def reading_order(boxes: DataFrame) -> DataFrame:
    order = Window.partitionBy("page_id").orderBy(F.floor(F.col("y1") / 100), "x1", "rank")
    return boxes.withColumn("position", F.row_number().over(order).cast("bigint"))


def title_regions(detections: DataFrame) -> DataFrame:
    return reading_order(suppress_overlaps(title_or_fallback(text_detections(detections))))


def overlap_pairs(boxes: DataFrame, most: float = g.MOST_OVERLAP) -> DataFrame:
    """Pairs of a page's boxes that overlap by more than ``most``; pages hold few boxes."""
    a, b = boxes.alias("a"), boxes.alias("b")
    ratio = g.io_min(_Side("a"), _Side("b"))
    return a.join(b, (F.col("a.page_id") == F.col("b.page_id")) & (F.col("a.det_idx") < F.col("b.det_idx"))).filter(ratio > most).select(F.col("a.page_id").alias("page_id"), F.col("a.det_idx").alias("a_idx"), F.col("b.det_idx").alias("b_idx"), F.round(ratio, 9).alias("overlap"))


class _Side(_cols):
    def __init__(self, side: str):
        self.side = side

    def __getattr__(self, name: str) -> Column:
        return F.col(f"{self.side}.{name}")


def _read_later(least: float = g.LEAST_SCORE) -> Column:
    """Whether later steps read a detection; null scores count 0, null labels are no text."""
    return (F.coalesce("score", F.lit(0.0)) >= least) & F.coalesce(F.col("label").isin(*g.TEXT_LABELS), F.lit(False))


def region_counts(detections: DataFrame) -> DataFrame:
    kept = title_regions(detections).groupBy("page_id").agg(F.count("*").alias("n_kept"))
    raw = detections.groupBy("page_id").agg(F.count("*").alias("n_raw"), F.count_if(_read_later()).alias("n_text"))
    return raw.join(kept, "page_id", "left").withColumn("n_kept", F.coalesce("n_kept", F.lit(0)))


def rejected_warnings(detections: DataFrame) -> DataFrame:
    """Regions that no later step sees, as warnings a page in order of detection."""
    gone = detections.filter(~_read_later())
    why = F.when(F.coalesce("score", F.lit(0.0)) < g.LEAST_SCORE, "low score").otherwise("not text")
    said = F.format_string("%03d %s: %s", "det_idx", F.coalesce("label", F.lit("no label")), why)
    return gone.groupBy("page_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("det_idx", said.alias("s")))), lambda x: x.s), "; ").alias("warnings"), F.count("*").alias("n_rejected"))


def crop_windows(boxes: DataFrame, width: int, height: int, pad: int = 10) -> DataFrame:
    return boxes.select("page_id", "det_idx", *(c.cast("bigint").alias(n) for n, c in zip(("cx1", "cy1", "cx2", "cy2"), g.padded_window(_cols(), width, height, pad), strict=True)))


def page_metadata(boxes: DataFrame, width: int, height: int) -> DataFrame:
    """Nested page records: image_size and boxes in reading order."""
    box = F.struct("position", F.col("box_id").alias("label"), F.col("score").alias("confidence"), "x1", "y1", "x2", "y2", g.box_polygon(_cols()).alias("polygon"))
    rows = boxes.groupBy("page_id").agg(F.array_sort(F.collect_list(box)).alias("boxes"))
    return rows.select("page_id", F.struct(F.lit(width).alias("width"), F.lit(height).alias("height")).alias("image_size"), "boxes")
