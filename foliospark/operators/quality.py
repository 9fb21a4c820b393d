"""Recogniser quality: character and word error rates of whole texts, agreement of two recognisers. A rate over an empty truth is null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.functions.distance import edit_operations, text_distance, word_distance


def cer(truth: Column, said: Column) -> Column:
    return F.try_divide(text_distance(truth, said), F.length(truth))


def n_tokens(text: Column) -> Column:
    return F.size(F.split(text, r"[ \t\n\x0b\f\r]+", -1))


def wer(truth: Column, said: Column) -> Column:
    """Over white-space tokens; the truth has at least one."""
    return word_distance(truth, said) / n_tokens(truth)


def distances(pairs: DataFrame, measure=text_distance) -> DataFrame:
    """pairs: truth, mat, raw. Adds d_mat and d_raw, how far both are from the truth; each is computed once and by one batch of Arrow for both."""
    return pairs.withColumns({f"d_{c}": measure("truth", c) for c in ("mat", "raw")})


def _rates(size: Column, kind: str) -> list[Column]:
    return [F.round(F.try_divide(F.sum(f"d_{c}"), F.sum(size)), 9).alias(f"{kind}_{c}") for c in ("mat", "raw")]


def error_rates(pairs: DataFrame) -> DataFrame:
    """pairs: doc_id, truth, mat, raw. Character error rate of both by document."""
    return distances(pairs).groupBy("doc_id").agg(*_rates(F.length("truth"), "cer"))


def word_error_rates(pairs: DataFrame) -> DataFrame:
    """Word error rate of both by document."""
    return distances(pairs, word_distance).groupBy("doc_id").agg(*_rates(n_tokens(F.col("truth")), "wer"))


def pooled_error_rates(pairs: DataFrame) -> DataFrame:
    """pairs: source, truth, mat, raw. Distances over lengths, both summed by source."""
    return distances(pairs).groupBy("source").agg(*_rates(F.length("truth"), "cer"), F.count("*").alias("n"))


def operation_counts(pairs: DataFrame) -> DataFrame:
    """pairs: doc_id, truth, mat, raw. Insertions, deletions and substitutions of a shortest script from the truth to each."""
    found = pairs.select("doc_id", *(edit_operations("truth", c).alias(c) for c in ("mat", "raw")))
    return found.select("doc_id", *(F.col(f"{c}.{k}").alias(f"{c}_{k}") for c in ("mat", "raw") for k in ("ins", "del", "sub")))


def agreement(pairs: DataFrame) -> DataFrame:
    """pairs: source, truth, mat, raw, a row a strip. How often two recognisers agree, how far apart they are, and which is nearer to the truth."""
    d = distances(pairs).withColumn("d_both", text_distance("mat", "raw"))
    m, r = F.col("d_mat"), F.col("d_raw")
    return d.groupBy("source").agg(F.round(F.avg((F.col("mat") == F.col("raw")).cast("double")), 9).alias("equal_rate"), F.round(F.avg("d_both"), 9).alias("mean_distance"), F.count_if(m < r).alias("mat_nearer"), F.count_if(r < m).alias("raw_nearer"), F.count_if(r == m).alias("ties"))
