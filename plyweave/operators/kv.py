"""Key and value cache: INT8 quantisation, positions, context shift and capacity."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import nn


def quantise(x: DataFrame) -> DataFrame:
    """session (if x has it), pos, kv_head, d, x, q, scale: by the largest magnitude of each (session, pos, kv_head), halves
    to even; all zeros give 0, 0. Sessions never share a row of the cache."""
    own = [c for c in ("session", "pos", "kv_head") if c in x.columns]
    top = F.max(F.abs("x")).over(Window.partitionBy(*own))
    q = F.when(F.col("top") == 0, 0.0).otherwise(F.rint(F.col("x") * 127.0 / F.col("top")))
    return x.withColumn("top", top).select(*own, "d", "x", F.least(F.greatest(q, F.lit(-127.0)), F.lit(127.0)).cast("int").alias("q"), (F.col("top") / 127.0).alias("scale"))


def rotated_store(k: DataFrame, head_dim: int, theta: float = 10000.0) -> DataFrame:
    """quantise of keys (session, pos, k, x) after their rotation by position."""
    turned = nn.rope(k.select(F.col("session").alias("seq"), "pos", "k", "x"), head_dim, theta)
    at = turned.select(F.col("seq").alias("session"), "pos", F.expr(f"k div {head_dim}").alias("kv_head"), (F.col("k") % head_dim).alias("d"), F.col("y").alias("x"))
    return quantise(at)


def dequantised(q: DataFrame) -> DataFrame:
    return q.withColumn("y", F.col("q") * F.col("scale"))


def turn_positions(turns: DataFrame) -> DataFrame:
    """conv_id, turn, start_pos, end_pos: tokens (n) laid end to end in order of turn."""
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum("n").over(w)
    return turns.select("conv_id", "turn", (end - F.col("n")).alias("start_pos"), end.alias("end_pos"))


def shifted(pos: int, n: int, max_seq: int, max_tokens: int, far: int = 1024) -> tuple[int, int]:
    """Position after a turn of n tokens, and how many of the oldest were discarded before it: half, if it would not fit."""
    drop = pos // 2 if pos + n + max_tokens + 64 > max_seq or pos > far else 0
    return pos - drop + n, drop


def context_shift(turns: DataFrame, max_seq: int = 8192, max_tokens: int = 256, far: int = 1024) -> DataFrame:
    """conv_id, turn, pos_after, discarded: shifted() folded over each conversation's turns in order."""

    def fold(batches):
        held, pos = object(), 0
        for b in batches:
            rows = []
            for conv, turn, n in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                if conv != held:
                    held, pos = conv, 0
                pos, drop = shifted(pos, n, max_seq, max_tokens, far)
                rows.append((pos, drop))
            cols = [pa.array([r[i] for r in rows], pa.int64()) for i in range(2)]
            yield pa.record_batch([b.column(0), b.column(1), *cols], ["conv_id", "turn", "pos_after", "discarded"])

    # In order of turn, with one number held: a conversation's turns are never gathered.
    kind = turns.schema["conv_id"].dataType.simpleString()
    dealt = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), F.col("n").cast("long").alias("n"))
    dealt = dealt.repartition("conv_id").sortWithinPartitions("conv_id", "turn")
    return dealt.mapInArrow(fold, f"conv_id {kind}, turn long, pos_after long, discarded long")


def capacity(config: DataFrame, budget: int) -> DataFrame:
    """bytes_per_token and max_seq (128 to 8192) of a model's cache: n_layer, n_head_kv, head_dim."""
    size = F.col("n_layer") * F.col("n_head_kv") * F.col("head_dim") * 2 + F.col("n_layer") * F.col("n_head_kv") * 8
    fits = F.floor(F.lit(budget) / size)
    return config.select(size.cast("long").alias("bytes_per_token"), F.greatest(F.lit(128), F.least(F.lit(8192), fits)).cast("long").alias("max_seq"))
