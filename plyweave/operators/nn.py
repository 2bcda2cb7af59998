"""Normalisation, activation, lookup, rotary embedding, attention and greedy sampling over rows of seq, k, x."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import bits as B


def rms_norm(x: DataFrame, weight: DataFrame | None = None, eps: float = 1e-5) -> DataFrame:
    """seq, k, y: x over the root of its mean square; weight: k, w (1 without)."""
    own = Window.partitionBy("seq")
    y = F.col("x") / F.sqrt(F.sum(F.col("x") * F.col("x")).over(own) / F.count("*").over(own) + eps)
    if weight is None:
        return x.select("seq", "k", y.alias("y"))
    return x.select("seq", "k", y.alias("y")).join(weight, "k").select("seq", "k", (F.col("y") * F.col("w")).alias("y"))


def add_rms_norm(x: DataFrame, residual: DataFrame, eps: float = 1e-5) -> DataFrame:
    """seq, k, total, y: the sum, and its norm."""
    both = x.join(residual.withColumnRenamed("x", "b"), ["seq", "k"]).select("seq", "k", (F.col("x") + F.col("b")).alias("x"))
    own = Window.partitionBy("seq")
    y = F.col("x") / F.sqrt(F.sum(F.col("x") * F.col("x")).over(own) / F.count("*").over(own) + eps)
    return both.select("seq", "k", F.col("x").alias("total"), y.alias("y"))


def swiglu(gate: DataFrame, up: DataFrame) -> DataFrame:
    y = F.col("x") / (1 + F.exp(-F.col("x"))) * F.col("u")
    return gate.join(up.withColumnRenamed("x", "u"), ["seq", "k"]).select("seq", "k", y.alias("y"))


def swiglu_bf16(gate: DataFrame, up: DataFrame) -> DataFrame:
    """seq, k, bits: swiglu, rounded to bfloat16."""
    return swiglu(gate, up).select("seq", "k", B.to_bf16(F.col("y")).alias("bits"))


def embed_lookup(tokens: DataFrame, table: DataFrame, width: int) -> DataFrame:
    """seq, pos, k, x: the table's row (id, k, x) of each token; zeros for ids that it lacks."""
    wide = tokens.select("*", F.explode(F.sequence(F.lit(0), F.lit(width - 1))).alias("k"))
    return wide.join(table.withColumnRenamed("id", "token_id"), ["token_id", "k"], "left").select("seq", "pos", "k", F.coalesce("x", F.lit(0.0)).alias("x"))


def rope_frequency(d, head_dim: int, theta: float = 10000.0):
    return F.pow(F.lit(theta), -2.0 * d / head_dim)


def rope(x: DataFrame, head_dim: int, theta: float = 10000.0) -> DataFrame:
    """seq, pos, k, y: rotates d with d + head_dim / 2 of each head by pos times the frequency."""
    half = head_dim // 2
    cells = x.withColumn("head", F.expr(f"k div {head_dim}")).withColumn("d", F.col("k") % head_dim)
    pairs = cells.groupBy("seq", "pos", "head", (F.col("d") % half).alias("d")).agg(
        F.max(F.when(F.col("d") < half, F.col("x"))).alias("a"), F.max(F.when(F.col("d") >= half, F.col("x"))).alias("b")
    )
    angle = F.col("pos") * rope_frequency(F.col("d"), head_dim, theta)
    turned = pairs.withColumn("c", F.cos(angle)).withColumn("s", F.sin(angle))
    at = F.col("head") * head_dim + F.col("d")
    both = F.array(F.struct(at.alias("k"), F.expr("a * c - b * s").alias("y")), F.struct((at + half).alias("k"), F.expr("a * s + b * c").alias("y")))
    return turned.select("seq", "pos", F.explode(both).alias("p")).select("seq", "pos", F.col("p.k").alias("k"), F.col("p.y").alias("y"))


def scores(q: DataFrame, keys: DataFrame, head_dim: int, share: int) -> DataFrame:
    """session, head, t, s: q (session, pos, head, d, x) against keys (session, t, kv_head, d, x) up to its position.

    share: heads to each key head.
    """
    q = q.withColumn("kv_head", F.expr(f"head div {share}"))
    both = q.join(keys.withColumnRenamed("x", "kx"), ["session", "kv_head", "d"]).filter("t <= pos")
    return both.groupBy("session", "head", "kv_head", "t").agg((F.sum(F.col("x") * F.col("kx")) / math.sqrt(head_dim)).alias("s"))


def attention(q: DataFrame, keys: DataFrame, values: DataFrame, head_dim: int, share: int) -> DataFrame:
    """session, head, d, o: softmax over the whole of each head's scores."""
    own = Window.partitionBy("session", "head")
    s = scores(q, keys, head_dim, share).withColumn("p", F.exp(F.col("s") - F.max("s").over(own)))
    s = s.withColumn("p", F.col("p") / F.sum("p").over(own))
    return s.join(values, ["session", "kv_head", "t"]).groupBy("session", "head", "d").agg(F.sum(F.col("p") * F.col("x")).alias("o"))


def flash_attention(q: DataFrame, keys: DataFrame, values: DataFrame, head_dim: int, share: int, tile: int = 128) -> DataFrame:
    """attention by tiles of positions: each gives its maximum, sum and output, and those are merged. No long row of scores
    meets in one task."""
    s = scores(q, keys, head_dim, share).withColumn("tile", F.expr(f"t div {tile}"))
    top = s.groupBy("session", "head", "tile").agg(F.max("s").alias("m"))
    p = s.join(top, ["session", "head", "tile"]).withColumn("p", F.exp(F.col("s") - F.col("m")))
    part = p.join(values, ["session", "kv_head", "t"]).groupBy("session", "head", "tile", "m", "d").agg(F.sum(F.col("p") * F.col("x")).alias("o"), F.sum("p").alias("l"))
    best = top.groupBy("session", "head").agg(F.max("m").alias("best"))
    scale = F.exp(F.col("m") - F.col("best"))
    return part.join(best, ["session", "head"]).groupBy("session", "head", "d").agg((F.sum(F.col("o") * scale) / F.sum(F.col("l") * scale)).alias("o"))


def argmax(logits: DataFrame) -> DataFrame:
    """seq, idx: the largest logit, the lowest index of equals; NaN is never chosen, and 0 is where nothing can be."""
    fit = F.when(~F.isnan("x") & (F.col("x") > float("-inf")), F.struct("x", (-F.col("k")).alias("k")))
    return logits.groupBy("seq").agg(F.coalesce(-F.max(fit)["k"], F.lit(0)).cast("long").alias("idx"))


def argmax_lanes(logits: DataFrame, lane_bits: int = 8) -> DataFrame:
    """argmax whose ties go as in a tree of pairs over 2^lane_bits lanes: to the lane with the least reversed bits, then to the
    lowest index."""
    lane = F.pmod(F.col("k"), F.lit(1 << lane_bits))
    reversed_ = F.conv(F.reverse(F.lpad(F.bin(lane), lane_bits, "0")), 2, 10).cast("long")
    fit = F.when(~F.isnan("x") & (F.col("x") > float("-inf")), F.struct("x", (-reversed_).alias("lane"), (-F.col("k")).alias("k")))
    return logits.groupBy("seq").agg(F.coalesce(-F.max(fit)["k"], F.lit(0)).cast("long").alias("idx"))
