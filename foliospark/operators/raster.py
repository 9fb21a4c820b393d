"""Grey values of images, as pixel rows: histograms, thresholds, polarity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def histogram(px: DataFrame) -> DataFrame:
    return px.groupBy("img_id", "v").agg(F.count("*").alias("n"))


def otsu(px: DataFrame) -> DataFrame:
    """img_id, t: the smallest level of greatest between-class variance. Only occupied levels can be it."""
    up = Window.partitionBy("img_id").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("img_id")
    s = histogram(px).withColumns({"w0": F.sum("n").over(up), "m0": F.sum(F.col("n") * F.col("v")).over(up), "total": F.sum("n").over(whole), "mass": F.sum(F.col("n") * F.col("v")).over(whole)})
    num = (F.col("mass") * F.col("w0") - F.col("total") * F.col("m0")).cast("double")
    var = F.when(F.col("w0") < F.col("total"), num * num / (F.col("w0") * (F.col("total") - F.col("w0"))).cast("double")).otherwise(F.lit(0.0))
    return s.withColumn("var", var).groupBy("img_id").agg(F.max_by("v", F.struct("var", -F.col("v"))).alias("t"))


def foreground(px: DataFrame) -> DataFrame:
    """img_id, t, white, black, inverted: the minority is foreground."""
    c = px.join(otsu(px), "img_id").groupBy("img_id", "t").agg(F.count_if(F.col("v") > F.col("t")).alias("white"), F.count_if(F.col("v") <= F.col("t")).alias("black"))
    return c.withColumn("inverted", F.col("white") > F.col("black"))


def smoothed_histogram(px: DataFrame, taps: int = 15) -> DataFrame:
    """Dense 256 levels with a moving mean, zero beyond the ends."""
    dense = px.select("img_id").distinct().select("img_id", F.explode(F.sequence(F.lit(0), F.lit(255))).alias("v"))
    near = Window.partitionBy("img_id").orderBy("v").rowsBetween(-(taps // 2), taps // 2)
    return dense.join(histogram(px), ["img_id", "v"], "left").withColumn("n", F.coalesce("n", F.lit(0))).withColumn("window", F.sum("n").over(near)).withColumn("smooth", F.col("window") / float(taps))


def polarity_vote(px: DataFrame, patch: int | None = None) -> DataFrame:
    """Dark background when two of three agree: corners, border strips (corners twice), smoothed histogram. The patch is a twentieth of the smaller side, five at least, if not given."""
    size = px.groupBy("img_id").agg((F.max("r") + 1).alias("h"), (F.max("c") + 1).alias("w"))
    p = px.join(size, "img_id")
    patch = F.greatest(F.lit(5), F.floor(0.05 * F.least("h", "w"))) if patch is None else F.lit(patch)
    top, bottom, left, right = F.col("r") < patch, F.col("r") >= F.col("h") - patch, F.col("c") < patch, F.col("c") >= F.col("w") - patch
    mean = lambda zone: F.avg(F.when(zone, F.col("v")))
    corners = sum((mean(x & y) for x in (top, bottom) for y in (left, right)), F.lit(0.0)) / 4
    times = sum((z.cast("int") for z in (top, bottom, left, right)), F.lit(0))
    zones = p.groupBy("img_id").agg(corners.alias("corner_mean"), (F.sum(F.col("v") * times) / F.sum(times)).alias("border_mean"))
    masses = smoothed_histogram(px).groupBy("img_id").agg(F.sum(F.when(F.col("v") < 128, F.col("window")).otherwise(0)).alias("low"), F.sum(F.when(F.col("v") >= 128, F.col("window")).otherwise(0)).alias("high"))
    votes = (F.col("corner_mean") < 128).cast("int") + (F.col("border_mean") < 128).cast("int") + (F.col("low") > F.col("high")).cast("int")
    return zones.join(masses, "img_id").select("img_id", F.round("corner_mean", 6).alias("corner_mean"), F.round("border_mean", 6).alias("border_mean"), votes.cast("bigint").alias("votes"), (votes >= 2).alias("is_dark"))


def _border() -> Column:
    return (F.col("r") == 0).cast("int") + (F.col("r") == F.col("h") - 1).cast("int") + (F.col("c") == 0).cast("int") + (F.col("c") == F.col("w") - 1).cast("int")


def heat_polarity(px: DataFrame) -> DataFrame:
    """Polarity by heat where there are enough pixels, else centre against border after the threshold; with the pad colour."""
    size = px.groupBy("img_id").agg((F.max("r") + 1).alias("h"), (F.max("c") + 1).alias("w"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    p = px.join(size, "img_id").join(otsu(px), "img_id")
    text, back = F.col("heat") > 127, F.col("heat") < 64
    level = F.when(F.col("hi") > F.col("lo"), F.when(F.col("v") > F.col("t"), 255).otherwise(0)).otherwise(F.col("v"))
    quarter = lambda n, k: F.floor(k * F.col(n) / 4)
    centre = (F.col("r") >= quarter("h", 1)) & (F.col("r") < quarter("h", 3)) & (F.col("c") >= quarter("w", 1)) & (F.col("c") < quarter("w", 3))
    # border pixels count once for each side they lie on
    weighted = p.withColumns({"times": _border(), "level": level})
    s = weighted.groupBy("img_id").agg(
        F.count_if(text).alias("n_text"), F.count_if(back).alias("n_back"),
        F.percentile(F.when(text, F.col("v")), 0.5).alias("text_median"), F.percentile(F.when(back, F.col("v")), 0.5).alias("back_median"),
        F.coalesce(F.avg(F.when(centre, F.col("level"))), F.lit(127.0)).alias("centre_mean"), (F.sum(F.col("level") * F.col("times")) / F.sum("times")).alias("border_mean"),
        F.expr("percentile(v, 0.5, times)").alias("border_median"),
    )
    enough = (F.col("n_text") > 10) & (F.col("n_back") > 10)
    dark = F.when(enough, F.col("text_median") > F.col("back_median")).otherwise(F.col("centre_mean") > F.col("border_mean"))
    pad = F.when(~enough, F.floor("border_median")).when(F.col("n_back") > 10, F.floor("back_median")).otherwise(F.when(dark, 0).otherwise(255))
    return s.select("img_id", "n_text", "n_back", enough.alias("by_heat"), dark.alias("is_dark"), pad.cast("bigint").alias("pad"))


def pad_colour(px: DataFrame, channels: list[str]) -> DataFrame:
    """px: img_id, r, c, v (grey), heat and the channels. By image the pad of each channel: its truncated median over the background, over the border if heat does not decide, or black or white."""
    size = px.groupBy("img_id").agg((F.max("r") + 1).alias("h"), (F.max("c") + 1).alias("w"))
    back = F.col("heat") < 64
    medians = [m for c in channels for m in (F.percentile(F.when(back, F.col(c)), 0.5).alias(f"{c}_back"), F.expr(f"percentile({c}, 0.5, times)").alias(f"{c}_border"))]
    m = px.join(size, "img_id").withColumn("times", _border()).groupBy("img_id").agg(*medians)
    p = m.join(heat_polarity(px), "img_id")
    pad = lambda c: F.when(~F.col("by_heat"), F.floor(f"{c}_border")).when(F.col("n_back") > 10, F.floor(f"{c}_back")).otherwise(F.when(F.col("is_dark"), 0).otherwise(255))
    return p.select("img_id", *(pad(c).cast("bigint").alias(f"pad_{c}") for c in channels))


def sticky_fallback(words: DataFrame) -> DataFrame:
    """words: block, word, by_heat. Once a word falls back, all later words of its block do."""
    so_far = Window.partitionBy("block").orderBy("word").rowsBetween(Window.unboundedPreceding, 0)
    return words.withColumn("falls_back", F.max((~F.col("by_heat")).cast("int")).over(so_far) == 1)


def thin_points(points: DataFrame, cell: int = 10) -> DataFrame:
    """The first point of each grid cell in row-major order. points: img_id, r, c."""
    at = F.min(F.struct("r", "c")).alias("p")
    return points.groupBy("img_id", F.floor(F.col("r") / cell).alias("gr"), F.floor(F.col("c") / cell).alias("gc")).agg(at).select("img_id", "gr", "gc", "p.r", "p.c")


def normalise(values: Column, mean: float, std: float) -> Column:
    return F.transform(values, lambda v: (v / 255.0 - mean) / std)


def image_thresholds(images: DataFrame) -> DataFrame:
    """images: img_id, data, nChannels (as the image source decodes them). img_id, threshold, ink, paper, inverted: the grey histogram's threshold and whether paper is the larger part, without rows of pixels or a shuffle."""
    from foliospark.functions.models import image_threshold

    found = images.select("img_id", image_threshold("data", "nChannels").alias("t")).filter("t.threshold is not null")
    return found.select("img_id", "t.threshold", "t.ink", "t.paper", (F.col("t.paper") > F.col("t.ink")).alias("inverted"))
