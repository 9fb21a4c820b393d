"""Text lines and words inside blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliospark.functions import geometry as g

XS, YS = ["x0", "x1", "x2", "x3"], ["y0", "y1", "y2", "y3"]


def _points():
    return [F.col(c) for c in XS], [F.col(c) for c in YS]


def polygon_geometry(polygons: DataFrame) -> DataFrame:
    """Adds box, centre, height, edge sizes (w, h) and crop sizes (cw, ch)."""
    xs, ys = _points()
    (bx1, by1, bx2, by2), (cx, cy) = g.polygon_bbox(xs, ys), g.polygon_centre(xs, ys)
    (w, h), (cw, ch) = g.quad_size(xs, ys), g.crop_size(xs, ys)
    made = dict(bx1=bx1, by1=by1, bx2=bx2, by2=by2, cx=cx, cy=cy, height=g.polygon_height(ys), w=w, h=h, cw=cw, ch=ch)
    return polygons.withColumns(made)


def group_lines(polygons: DataFrame) -> DataFrame:
    """Line numbers and reading positions from 1 in each block. A line starts where the centre is half the mean height below the one before."""
    block = Window.partitionBy("page_id", "block_no")
    by_y = block.orderBy("cy", "poly_idx")
    p = polygon_geometry(polygons).withColumn("avg_h", F.avg("height").over(block))
    jump = F.abs(F.col("cy") - F.lag("cy").over(by_y)) >= 0.5 * F.col("avg_h")
    p = p.withColumn("jump", F.coalesce(jump.cast("int"), F.lit(0))).withColumn("y_rank", F.row_number().over(by_y))
    p = p.withColumn("line_no", F.sum("jump").over(by_y.rowsBetween(Window.unboundedPreceding, 0)).cast("bigint"))
    return p.withColumn("word_no", F.row_number().over(block.orderBy("line_no", "cx", "y_rank")).cast("bigint")).drop("jump")


def keep_words(lines: DataFrame) -> DataFrame:
    """Drops vertical words and crops that are too small; numbers stay as they were."""
    return lines.filter((F.col("w") >= F.col("h")) & (F.col("ch") >= g.LEAST_LINE_H) & (F.col("cw") >= g.LEAST_LINE_W))


def block_words(blocks: DataFrame, polygons: DataFrame) -> DataFrame:
    """blocks: page_id, block_no, bx, by. Blocks without polygons go; those whose words were all dropped stay with none."""
    words = keep_words(group_lines(polygons)).withColumn("word_id", g.word_id(F.format_string("block_%03d", "block_no"), F.col("word_no")))
    seen = polygons.select("page_id", "block_no").distinct()
    box = g.absolute_bbox(F.col("bx"), F.col("by"), [F.col(c) for c in ("bx1", "by1", "bx2", "by2")])
    joined = blocks.join(seen, ["page_id", "block_no"]).join(words, ["page_id", "block_no"], "left")
    return joined.select("page_id", "block_no", "word_no", "word_id", *(c.alias(n) for n, c in zip(("ax1", "ay1", "ax2", "ay2"), box, strict=True)))


def block_metadata(words: DataFrame) -> DataFrame:
    word = F.when(F.col("word_id").isNotNull(), F.struct("word_no", "word_id", F.array("ax1", "ay1", "ax2", "ay2").alias("bbox_in_full_image")))
    return words.groupBy("page_id", "block_no").agg(F.array_sort(F.collect_list(word)).alias("words"))


def strip_plan(sizes: DataFrame) -> DataFrame:
    """sizes: page_id, block_no, word_idx, w, h. Scaled widths, offsets and totals; strips that are too wide go."""
    block = Window.partitionBy("page_id", "block_no")
    s = sizes.withColumn("sw", g.scaled_width(F.col("w"), F.col("h"))).withColumn("resample", g.resample_choice(F.col("h")))
    before = F.sum(F.col("sw") + g.STRIP_GAP).over(block.orderBy("word_idx").rowsBetween(Window.unboundedPreceding, -1))
    s = s.withColumn("x_offset", F.coalesce(before, F.lit(0)).cast("bigint")).withColumn("total", (F.sum("sw").over(block) + g.STRIP_GAP * (F.count("*").over(block) - 1)).cast("bigint"))
    return s.filter(F.col("total") <= g.MOST_STRIP)


def usable_frames(frames: DataFrame, least: int = 22) -> DataFrame:
    """frames: page_id, frame, glyph_h, sharpness. The sharpest frame of a page whose glyphs are high enough, with its OCR scale."""
    best = Window.partitionBy("page_id").orderBy(F.col("sharpness").desc(), "frame")
    return frames.filter(F.col("glyph_h") >= least).withColumn("scale", g.ocr_scale(F.col("glyph_h"))).withColumn("_n", F.row_number().over(best)).filter("_n = 1").drop("_n")
