"""A corpus from raw documents to token ids, in five stages that each work on all the one before kept.

Defined cases: every stage goes by rows, so ids may be null or repeated. Null and empty
texts fail the quality rules' plain counts and go; a null language is the language "". Of exact and near copies
the row of the smallest id stays, of a row that is wholly repeated one. All stages but the last return all columns of
documents, whatever further ones there are and whatever their names (n_chars is counted anew where texts change);
the last returns doc_id, n_tokens, ids_sha256, decoded_sha256, ids. An empty table gives an empty result. Texts of any length are
read whole. Each stage's result is a table in the shared folder, so executors may be lost at any time; what a stage
stored on the way, and the table before, are deleted once its result is written.
A stage's tasks hand texts to their workers in batches of BATCH_BYTES, unless the session sets a bound of its own, and
a worker drops what the stage before kept in it; the heap of an executor's JVM stays as large as an earlier stage made it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from foliospark.llm import bpe, decontamination, pii, quality_rules, simhash
from foliospark.llm.queries import DEMO_KEY, vocabulary
from foliospark.llm.shared import delete, fresh_path, scratch

#: Bytes of texts in an Arrow batch. Spark's own bounds (64 MB, 10,000 rows) make most tasks' whole input one batch, held several times over by task and worker.
BATCH_BYTES = "4m"


def bounded(spark: SparkSession) -> None:
    """For the session, as a stage's result is worked out after the stage returns."""
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bounded(spark)
    return quality_rules.keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bounded(spark)
    return simhash.one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bounded(spark)
    return decontamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def surrogates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bounded(spark)
    made, entities = pii.checked_surrogates(docs, DEMO_KEY)
    return made.drop(entities)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bounded(spark)
    return bpe.encode_documents(docs, vocabulary(), keep_ids=True)


STAGES = [("quality rules", quality), ("near dedup", near_dedup), ("decontamination", decontaminate), ("pii surrogates", surrogates), ("bpe", encode)]
#: SQL can express neither the language model nor the fingerprints; tests/llm holds the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = fresh_path(spark, name.replace(" ", "-"))
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        if last:
            delete(spark, last)
        docs, last = spark.read.parquet(path), path
    return docs
