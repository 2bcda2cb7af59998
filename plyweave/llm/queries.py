"""The queries op1_ to op10_ over whole tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import credentials, decontam, neardup, oracles, packing, piecewise, repeats, sharding, token_counts, toxicity, urls
from .common import table

#: Fixed by the task.
URL_RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = credentials.scan(table(spark, sf_dir, "documents"))
    both = F.concat("base", "linked")
    return found.select(
        "doc_id",
        *(credentials.counted(F.col("base"), k).alias(f"n_{k}") for k in credentials.KINDS),
        F.sha2(F.encode(credentials.joined(F.col("base")), "UTF-8"), 256).alias("base_sha256"),
        credentials.joined(credentials.in_order(both)).alias("spans"),
        F.size("linked").cast("long").alias("n_linked"),
    )


def op2_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piecewise.compare_in_turn(table(spark, sf_dir, "documents"))


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), 3, 85).drop("th")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = toxicity.fitted(docs, table(spark, sf_dir, "labels"))
    found = toxicity.scored(docs, model)
    predicted = (F.col("score") >= toxicity.CUT).cast("int")
    return found.select("doc_id", (toxicity.fold(F.col("doc_id")) == 1).alias("held_out"), "score", predicted.alias("predicted"), "flagged")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.encode(F.array_join("items", ","), "UTF-8"), 256)
    return found.select("doc_id", "n_words", "n_hit", "n_items", digest.alias("items_sha256"), decontam.contaminated().alias("contaminated"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), 1024)


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.histogram_sort_shards(table(spark, sf_dir, "documents"), 40)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.removed(table(spark, sf_dir, "documents")).drop("kept")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.limits(token_counts.histogram(token_counts.lengths(table(spark, sf_dir, "documents"))))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = urls.filter_urls(table(spark, sf_dir, "pages"), URL_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict", "template", F.round("purity", 6).alias("purity"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_secret_scan, op2_document_fingerprints, op3_near_duplicates, op4_toxicity, op5_decontamination, op6_best_fit_packing, op7_sharding, op8_suffix_dedup, op9_token_counts, op10_url_filter)}


def oracle_sql() -> dict[str, str]:
    return dict(oracles.SQL)
