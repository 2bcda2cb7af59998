"""Matrix products as joins on k with grouped sums, in doubles (a product of two bfloat16 values is exact in one)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Elements of an activation up to which it is broadcast: 16 bytes each and the join's overhead.
FEW = 500_000
#: Batches from which blocks pay, and the least row length for them.
BLOCKED_BATCH, BLOCKED_K = 16, 64


def small(x: DataFrame) -> DataFrame:
    """x, to be broadcast if its counted rows are few; else as it is."""
    return F.broadcast(x) if x.limit(FEW + 1).count() <= FEW else x


def matvec(w: DataFrame, x: DataFrame, counted: bool = True) -> DataFrame:
    """w: tensor, r, k, v; x: seq, k, x. Gives seq, tensor, r, y; any number of tensors and sequences in one job.

    Sums are made where the elements of w are, before anything is shuffled; an x of too many rows to broadcast is
    shuffled with w by k. Without counted the join is left to the optimizer: for an x that is costly to count.
    """
    return w.join(small(x) if counted else x, "k").groupBy("seq", "tensor", "r").agg(F.sum(F.col("v") * F.col("x")).alias("y"))


def patch_correction(patches: DataFrame, x: DataFrame, value) -> DataFrame:
    """seq, tensor, r, correction: what patches add to unpatched products; rows without patches don't appear. Any number of
    tensors and sequences in one job."""
    gap = value(F.col("correct")) - value(F.col("wrong"))
    return patches.join(small(x), "k").groupBy("seq", "tensor", "r").agg(F.sum(gap * F.col("x")).alias("correction"))


def patched(products: DataFrame, corrections: DataFrame) -> DataFrame:
    on = ["seq", "tensor", "r"]
    return products.join(corrections, on, "left").select(*on, (F.col("y") + F.coalesce("correction", F.lit(0.0))).alias("y"))


def gemm_blocked(w: DataFrame, x: DataFrame, block: int = 64) -> DataFrame:
    """matvec by blocks: cells meet in (rows, k) blocks as arrays, are multiplied there by numpy, a batch's products are one
    frame, and block sums are added up. Cells that a block lacks are zeros; rows without any don't appear."""
    cut = lambda c: F.expr(f"{c} div {block}").alias(f"{c}b")
    lists = lambda *names: [F.collect_list(c).alias(f"{c}s") for c in names]
    blocks = w.groupBy("tensor", cut("r"), cut("k")).agg(*lists("r", "k", "v"))
    xs = x.groupBy(cut("k")).agg(F.collect_list("seq").alias("seqs"), F.collect_list("k").alias("xk"), F.collect_list("x").alias("xs"))

    def multiply(batches):
        for b in batches:
            parts = []
            for i in range(b.num_rows):
                get = lambda c: b.column(b.schema.get_field_index(c))[i].values.to_numpy(zero_copy_only=False)  # noqa: B023, E731
                t, rb, kb = (b.column(b.schema.get_field_index(c))[i].as_py() for c in ("tensor", "rb", "kb"))
                rows, seqs = get("rs") - rb * block, get("seqs")
                ids, at = np.unique(seqs, return_inverse=True)
                a, v = np.zeros((block, block)), np.zeros((block, len(ids)))
                a[rows, get("ks") - kb * block] = get("vs")
                v[get("xk") - kb * block, at] = get("xs")
                have = np.unique(rows)
                y = (a @ v)[have]
                parts.append((np.tile(ids, len(have)), np.full(y.size, t, object), np.repeat(have + rb * block, len(ids)), y.ravel()))
            if parts:
                yield pa.record_batch([pa.array(np.concatenate(c)) for c in zip(*parts, strict=True)], ["seq", "tensor", "r", "part"])

    parts = blocks.join(small(xs), "kb").mapInArrow(multiply, "seq long, tensor string, r long, part double")
    return parts.groupBy("seq", "tensor", "r").agg(F.sum("part").alias("y"))


def product(w: DataFrame, x: DataFrame, batch: int, k: int, mode: str = "auto") -> DataFrame:
    """w times x by the plan that the shape asks for: a join of elements for small batches or short rows, blocks from
    BLOCKED_BATCH sequences and rows of BLOCKED_K on; mode 'join' or 'blocked' decides itself."""
    if mode not in ("auto", "join", "blocked"):
        raise ValueError(f"mode {mode!r}")
    blocked = mode == "blocked" or mode == "auto" and batch >= BLOCKED_BATCH and k >= BLOCKED_K
    return gemm_blocked(w, x) if blocked else matvec(w, x)


def residual_add(a: DataFrame, b: DataFrame) -> DataFrame:
    """seq, k, y of two frames of seq, k, x."""
    return a.join(b.withColumnRenamed("x", "b"), ["seq", "k"]).select("seq", "k", (F.col("x") + F.col("b")).alias("y"))
