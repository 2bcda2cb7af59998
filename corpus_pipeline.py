"""The corpus pipeline: STAGES in order, each over all that its predecessor kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, written as Parquet before the next one reads it. All
but the last return the columns of documents, whatever else docs has. Null texts are empty: they are scored like empty
ones, are no one's duplicate, hold no benchmark words and no secrets, and are packed as an end id alone. Null ids are
ids like others; repeated rows are duplicates of each other unless they have no words. Empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plyweave.llm import credentials, decontam, neardup, packing, toxicity
from plyweave.llm.common import settle, small_enough, table, without, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects what reaches its language's threshold. The model learns from the labelled rows of the input tables."""
    settle(spark)
    docs = docs.select(*COLUMNS)
    model = toxicity.fitted(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return toxicity.scored(docs, model).filter(~F.col("flagged")).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, the one of the least id: shingles of five words, similarity 0.8 or more."""
    settle(spark)
    docs = docs.select(*COLUMNS)
    found = written(neardup.near_duplicates(docs, 5, 80), "near")
    left = without(docs, found.filter("not kept"))
    again = written(found.filter("kept and n_shingles > 0").groupBy("doc_id", "th").count().filter("count > 1"), "again")
    if small_enough(again, 0):
        return left
    # Rows of one id and text: one of them stays.
    told = left.withColumn("th", F.xxhash64(F.coalesce("text", F.lit(""))))
    twice = again.select(F.col("doc_id").alias("d"), F.col("th").alias("t"))
    hit = told["doc_id"].eqNullSafe(twice["d"]) & (told["th"] == twice["t"])
    one = told.join(twice, hit, "left_semi").dropDuplicates(["doc_id", "th"])
    return told.join(twice, hit, "left_anti").unionByName(one).select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents of which benchmark windows cover a twentieth of the words."""
    settle(spark)
    docs = docs.select(*COLUMNS)
    found = decontam.contamination(docs, table(spark, sf_dir, "benchmark"))
    return without(docs, found.filter(decontam.contaminated()))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces the secrets in the texts; every document stays."""
    settle(spark)
    return credentials.redact(docs.select(*COLUMNS))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 1024 tokens."""
    settle(spark)
    return packing.pack(docs.select(*COLUMNS), 1024)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secret_scan", redact_secrets),
    ("packing", pack_sequences),
]

#: A trained model and near-duplicate search are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
