"""Box, polygon and size arithmetic as Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Which detector labels are text, and their categories.
TEXT_LABELS = ("text", "document_title", "paragraph_title", "image_caption", "aside_text")
TITLE_LABELS, HEADER_LABELS = ("document_title", "paragraph_title"), ("header", "page_number")
#: Thresholds and sizes of the page steps.
LEAST_SCORE, MOST_OVERLAP, STRIP_HEIGHT, STRIP_GAP, MOST_STRIP = 0.20, 0.6, 384, 40, 15_000
LEAST_LINE_H, LEAST_LINE_W = 8, 20


def label_to_category(label: Column) -> Column:
    return F.when(label.isin(*HEADER_LABELS), "header").when(label == "footer", "footer").when(label.isin(*TITLE_LABELS), "title").otherwise("body")


def box_id(category: Column, index: Column) -> Column:
    return F.format_string("%s_%03d", category, index)


def word_id(block: Column, number: Column) -> Column:
    return F.format_string("%s_word_%03d", block, number)


def area(b: Column) -> Column:
    return (b.x2 - b.x1) * (b.y2 - b.y1)


def io_min(a: Column, b: Column) -> Column:
    """Intersection over the smaller area; 0 if disjoint, touching or without area."""
    w, h = F.least(a.x2, b.x2) - F.greatest(a.x1, b.x1), F.least(a.y2, b.y2) - F.greatest(a.y1, b.y1)
    least = F.least(area(a), area(b))
    return F.when((w > 0) & (h > 0) & (least > 0), w * h / least).otherwise(F.lit(0.0))


def box_polygon(b: Column) -> Column:
    return F.array(F.array(b.x1, b.y1), F.array(b.x2, b.y1), F.array(b.x2, b.y2), F.array(b.x1, b.y2))


def polygon_bbox(xs: list[Column], ys: list[Column]) -> tuple[Column, Column, Column, Column]:
    return F.least(*xs).cast("bigint"), F.least(*ys).cast("bigint"), F.greatest(*xs).cast("bigint"), F.greatest(*ys).cast("bigint")


def polygon_centre(xs: list[Column], ys: list[Column]) -> tuple[Column, Column]:
    return sum(xs[1:], xs[0]) / len(xs), sum(ys[1:], ys[0]) / len(ys)


def polygon_height(ys: list[Column]) -> Column:
    return F.greatest(*ys) - F.least(*ys)


def _edge(xs, ys, i, j):
    dx, dy = xs[i] - xs[j], ys[i] - ys[j]
    return F.sqrt((dx * dx + dy * dy).cast("double"))


def quad_size(xs: list[Column], ys: list[Column], grow: float = 1.0) -> tuple[Column, Column]:
    """(w, h) of a TL, TR, BR, BL quad: the longer of opposite edges, truncated. grow 1.02 is the crop's two per cent."""
    whole = lambda v: F.floor(F.round(v * grow, 6)) if grow != 1.0 else F.floor(v)
    return whole(F.greatest(_edge(xs, ys, 0, 1), _edge(xs, ys, 3, 2))), whole(F.greatest(_edge(xs, ys, 0, 3), _edge(xs, ys, 1, 2)))


def crop_size(xs: list[Column], ys: list[Column]) -> tuple[Column, Column]:
    w, h = quad_size(xs, ys, 1.02)
    return F.greatest(w, F.lit(1)), F.greatest(h, F.lit(1))


def padded_window(b: Column, width, height, pad: int = 10) -> tuple[Column, Column, Column, Column]:
    return F.greatest(F.lit(0), b.x1 - pad), F.greatest(F.lit(0), b.y1 - pad), F.least(F.lit(width), b.x2 + pad), F.least(F.lit(height), b.y2 + pad)


def absolute_bbox(box_x, box_y, bbox, fix_pad: bool = False, pad: int = 10):
    """Block origin plus a box inside the block's crop; the crop's pad is ignored unless fix_pad."""
    off = pad if fix_pad else 0
    return box_x + bbox[0] - off, box_y + bbox[1] - off, box_x + bbox[2] - off, box_y + bbox[3] - off


def scaled_width(w: Column, h: Column, height: int = STRIP_HEIGHT, half_even: bool = False) -> Column:
    v = w * (F.lit(float(height)) / h)
    return F.greatest(F.lit(1).cast("bigint"), F.bround(v).cast("bigint") if half_even else F.floor(v))


def resample_choice(h: Column, height: int = STRIP_HEIGHT) -> Column:
    return F.when(F.lit(float(height)) / h < 1.0, "area").otherwise("cubic")


def ocr_scale(glyph_h: Column) -> Column:
    return F.least(F.lit(1.0), 24.0 / glyph_h)
