"""Names, paths, labels and small text helpers as Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Suffixes of image files, and names of edge stages.
IMAGE_SUFFIXES = (".jpg", ".jpeg", ".png", ".bmp", ".tiff", ".tif", ".webp")
EDGE_STAGE, EDGE_LAST = "_Edges_Stg", "_Edges_Stg5-Denoise.png"
#: Folder names that stand for punctuation.
FOLDER_REMAP = {"punct_exclaim_0305": "punct_!_0305", "punct_question_0306": "punct_?_0306", "punct_slash_0307": "punct_/_0307", "punct_openCurly_0308": "punct_{_0308", "punct_closeCurly_0309": "punct_}_0309"}


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def stem(name: Column) -> Column:
    return F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")


def ext(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r".(\.[^.]+)$", 1))


def relative(path: Column, root: str) -> Column:
    return F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), f"^{root.rstrip('/')}/", "")


def block_of(strip: Column) -> Column:
    return F.split(F.replace(strip, F.lit("_strip.png"), F.lit("")), "_word_")[0]


def binarized_name(strip: Column) -> Column:
    return F.concat(stem(strip), F.lit("_binarized.png"))


def original_name(strip: Column) -> Column:
    return F.when(strip.contains("_word_"), F.replace(strip, F.lit("_strip.png"), F.lit(".png"))).otherwise(strip)


def is_strip_file(name: Column, prefix: Column | None = None) -> Column:
    kept = ext(name).isin(".png", ".jpg", ".jpeg") & ~name.rlike(r"(_preMAT|_binarized|_mat_debug)\.png$")
    return kept & name.startswith(F.concat(prefix, F.lit("_"))) if prefix is not None else kept


def is_edge_input(name: Column) -> Column:
    """Images that no edge stage has made."""
    return ext(name).isin(*IMAGE_SUFFIXES) & ~name.contains(EDGE_STAGE)


def is_axis_input(name: Column) -> Column:
    """What the last edge stage has made."""
    return name.endswith(EDGE_LAST)


def axis_stem(name: Column) -> Column:
    return F.replace(name, F.lit(EDGE_LAST), F.lit(""))


def strip_text(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def preview(text: Column, n: int = 60) -> Column:
    return F.substring(strip_text(text), 1, n)


def class_parts(label: Column) -> tuple[Column, Column, Column]:
    part = lambda i: F.regexp_extract(label, r"^([A-Za-z]+)_(.+)_(\d{4})$", i)
    return part(1), part(2), part(3)


def remap_folder(name: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in FOLDER_REMAP.items() for x in kv)), name), name)


def format_eta(seconds: Column) -> Column:
    s = F.floor(seconds)
    h, m = F.floor(s / 3600), F.floor(F.pmod(s, F.lit(3600)) / 60)
    said = F.when(h > 0, F.format_string("%dh %02dm %02ds", h, m, F.pmod(s, F.lit(60)))).when(m > 0, F.format_string("%dm %02ds", m, F.pmod(s, F.lit(60)))).otherwise(F.format_string("%ds", s))
    return F.when(seconds.isNull() | F.isnan(seconds) | (seconds < 0), "calculating...").otherwise(said)


def repeats_ngram(text: Column, n: int = 6) -> Column:
    """Whether some run of n words occurs twice."""
    words = F.split(text, " ")
    return F.get(F.transform(F.array(words), lambda w: F.when(F.size(w) > n, F.get(F.transform(F.array(F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), lambda i: F.array_join(F.slice(w, i, n), " "))), lambda g: F.size(F.array_distinct(g)) < F.size(g)), F.lit(0))).otherwise(F.lit(False))), F.lit(0))
