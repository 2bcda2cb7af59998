"""Exact length histogram: totals, quantiles and truncated totals for every context limit."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded, portions, written
from .tokens import encoder, vocabulary

BLOCK = 1024


def lengths(docs: DataFrame, path: str | None = None, text_col: str = "text") -> DataFrame:
    """length, one row per row of docs: its number of ids, 0 for null and empty texts."""
    path = path or vocabulary("byte_bpe_50k.json")

    def count(batches):
        encode = encoder(path)
        for b in portions(batches):
            yield pa.record_batch([pa.array(encode.counts(b.column(0)), pa.int64())], ["length"])

    return bounded(docs).select(F.col(text_col).alias("text")).mapInArrow(count, "length long")


def histogram(lens: DataFrame) -> DataFrame:
    """length, n_docs; written, as limits reads it twice and the texts should be encoded once."""
    return written(lens.groupBy("length").agg(F.count("*").alias("n_docs")), "histogram")


def limits(hist: DataFrame) -> DataFrame:
    """For every distinct length as the context limit, from prefix and suffix sums over the histogram alone.

    n_docs of that length; docs_within and tokens_within (no longer than the limit); docs_over; truncated_total, the
    tokens left if longer documents are cut at the limit; quantile, the share of documents within. Between two rows
    all of them follow from the lower one: truncated_total grows by docs_over a token. Sums are made in blocks of
    lengths, then over the blocks. An empty table gives no rows.
    """
    h = hist.withColumn("block", F.expr(f"length div {BLOCK}")).withColumn("tokens", F.col("length") * F.col("n_docs"))
    h = h.withColumn("in_docs", F.sum("n_docs").over(Window.partitionBy("block").orderBy("length")))
    h = h.withColumn("in_tokens", F.sum("tokens").over(Window.partitionBy("block").orderBy("length")))
    blocks = h.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t"))
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # a row for each 1024 lengths
    whole = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    blocks = blocks.select(
        "block",
        F.coalesce(F.sum("d").over(before), F.lit(0)).alias("base_docs"),
        F.coalesce(F.sum("t").over(before), F.lit(0)).alias("base_tokens"),
        F.sum("d").over(whole).alias("all_docs"),
    )
    s = h.join(blocks, "block")
    within, tokens = F.col("base_docs") + F.col("in_docs"), F.col("base_tokens") + F.col("in_tokens")
    return s.select(
        F.col("length").alias("context_limit"),
        "n_docs",
        within.alias("docs_within"),
        (F.col("all_docs") - within).alias("docs_over"),
        tokens.alias("tokens_within"),
        (tokens + F.col("length") * (F.col("all_docs") - within)).alias("truncated_total"),
        F.round(within / F.col("all_docs"), 9).alias("quantile"),
    )


def at_limits(hist: DataFrame, wanted: list[int]) -> DataFrame:
    """context_limit, docs_within, docs_over, tokens_within, truncated_total for any limits, whether a document has that
    length or not: one pass over the histogram for each row of the result. An empty histogram gives zeros."""
    asked = F.broadcast(hist.sparkSession.createDataFrame([(int(c),) for c in wanted], "context_limit long"))
    fits = F.col("length") <= F.col("context_limit")
    tokens = F.col("length") * F.col("n_docs")
    both = asked.join(hist, F.lit(True), "left").groupBy("context_limit")  # as many rows as limits and lengths
    count = lambda x: F.coalesce(F.sum(x), F.lit(0)).cast("long")
    return both.agg(
        count(F.when(fits, F.col("n_docs"))).alias("docs_within"), count(F.when(~fits, F.col("n_docs"))).alias("docs_over"),
        count(F.when(fits, tokens)).alias("tokens_within"), count(F.least("length", "context_limit") * F.col("n_docs")).alias("truncated_total"),
    )


def quantiles(hist: DataFrame, wanted: list[float]) -> DataFrame:
    """quantile, length: the least length that at least that share of the documents doesn't exceed; none without rows."""
    asked = F.explode(F.array(*(F.lit(float(q)) for q in wanted))).alias("share")
    rows = limits(hist).filter(F.col("docs_within") > 0).select("context_limit", "docs_within", (F.col("docs_within") + F.col("docs_over")).alias("n"), asked)
    return rows.filter(F.col("docs_within") >= F.col("share") * F.col("n")).groupBy(F.col("share").alias("quantile")).agg(F.min("context_limit").alias("length"))
