"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.llm import bpe, chat_formatting, decontamination, license_scans, line_dedup, pii, quality_rules, ranked_search, secret_scans, simhash, token_alignment, url_filters, warc
from foliospark.llm.oracles import ORACLES  # noqa: F401

#: A key for these made-up tables, so that results repeat. For real data pass a secret one.
DEMO_KEY = b"key of the made-up tables"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_url_filters(spark, sf_dir):
    return url_filters.judge_pages(_table(spark, sf_dir, "pages"), _table(spark, sf_dir, "labels"))


def op2_chat_formatting(spark, sf_dir):
    """A conversation is chosen; rejected is the same with its last assistant turn borrowed from the next one, so a pair shares the turns before."""
    return chat_formatting.borrowed_endings(_table(spark, sf_dir, "conversations"), F.col("conv_id") + 1)


def op3_license_scans(spark, sf_dir):
    return license_scans.license_digest(license_scans.scan_licenses(_table(spark, sf_dir, "documents")))


def op4_benchmark_decontamination(spark, sf_dir):
    found = decontamination.contaminated_pairs(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.withColumn("containment", F.round(F.col("n_shared") / F.col("n_item"), 6))


def op5_warc(spark, sf_dir):
    return warc.archive_and_read(_table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_quality_rules(spark, sf_dir):
    return quality_rules.judge(_table(spark, sf_dir, "documents"))


def op7_simhash_near_dedup(spark, sf_dir):
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.as_hex(F.col("fp")).alias("fingerprint"), "component_id")


def op8_secret_scans(spark, sf_dir):
    return secret_scans.secret_digest(secret_scans.scan_secrets(_table(spark, sf_dir, "documents")))


def op9_pii(spark, sf_dir):
    made, entities = pii.checked_surrogates(_table(spark, sf_dir, "documents").select("doc_id", "text"), DEMO_KEY)
    kinds = F.array_join(F.array_sort(F.array_distinct(F.transform(entities, lambda e: e.kind))), ",")
    return made.select("doc_id", "text", F.size(entities).cast("long").alias("n_entities"), kinds.alias("kinds"))


def op10_bpe(spark, sf_dir):
    return bpe.encode_documents(_table(spark, sf_dir, "documents"), vocabulary())


def op11_ranked_search(spark, sf_dir):
    return ranked_search.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op12_line_dedup(spark, sf_dir):
    kept = line_dedup.drop_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op13_token_alignment(spark, sf_dir):
    return token_alignment.align_documents(_table(spark, sf_dir, "documents"), vocabulary(), vocabulary("piece_bpe_32k.model"))


QUERIES = {f.__name__: f for f in (op1_url_filters, op2_chat_formatting, op3_license_scans, op4_benchmark_decontamination, op5_warc, op6_quality_rules, op7_simhash_near_dedup, op8_secret_scans, op9_pii, op10_bpe, op11_ranked_search, op12_line_dedup, op13_token_alignment)}
