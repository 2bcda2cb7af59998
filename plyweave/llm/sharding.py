"""Sharding by histogram sort, in DataFrame operations only.

Rows are ordered by the key (hash of text, doc_id), so equal texts are neighbours and a hot group of copies may
still be cut between documents. Splitters come from rounds of exact counts: each round counts the bytes between
candidate boundaries (probes) inside those key intervals that still hold a target, and narrows each interval to the
one between two probes that holds it, until the interval is within the tolerance. Then rows move once.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import slots, written

LOW, BITS = -(2**63), 12
#: Shifts that make the probes of each round, from coarse to exact.
SHIFTS = [64 - BITS * k for k in range(1, 64 // BITS + 1)] + [0]


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size (UTF-8 bytes, none for null, plus 16), text_crc32, and the sort key (kh, kd). Null ids sort first."""
    text = F.col(text_col)
    return docs.select(
        F.col(id_col).alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 16).alias("size"),
        F.crc32(F.encode(F.coalesce(text, F.lit("")), "UTF-8")).alias("text_crc32"),
        F.xxhash64(F.coalesce(text, F.lit(""))).alias("kh"),
        F.coalesce(F.col(id_col).cast("long"), F.lit(LOW)).alias("kd"),
    )


def splitters(keys: DataFrame, shards: int, tolerance: float = 0.001) -> list[tuple[int, int] | None]:
    """The first key of each shard but the first; None: after every key.

    keys: kh, kd, size. tolerance: of the mean shard, in bytes; a single key is never cut. What a round brings to the
    driver is at most (shards - 1) * 4096 counts, whatever the input.
    """
    total = keys.agg(F.sum("size")).first()[0] or 0
    slack = tolerance * total / shards
    done: dict[int, tuple[int, int] | None] = {}
    # Of each interval with targets: its prefix, the bytes below it, the targets in it.
    active: dict[tuple[int, ...], tuple[int, list[int]]] = {(): (0, list(range(1, shards)) if total else [])}
    done.update({j: None for j in range(1, shards) if not total})
    steps = [("kh", s) for s in SHIFTS] + [("kd", s) for s in SHIFTS]
    for n, (col, shift) in enumerate(steps):
        if not any(js for _, js in active.values()):
            break
        probe = F.shiftright(col, shift).alias("probe")
        if n == 0:
            inside = keys.select(F.lit(0).alias("owner"), probe, "size")
        else:
            before, cut = steps[n - 1]
            within = None
            for i, prefix in enumerate(active):
                hit = F.shiftright(before, cut) == prefix[-1]
                if before == "kd" or col == "kd":
                    hit = (F.col("kh") == prefix[0]) & (hit if before == "kd" else F.lit(True))
                within = F.when(hit, i) if within is None else within.when(hit, i)
            inside = keys.select(within.alias("owner"), probe, "size").filter("owner is not null")
        counts: dict[int, list] = {}
        for r in inside.groupBy("owner", "probe").agg(F.sum("size").alias("b")).collect():
            counts.setdefault(r.owner, []).append((r.probe, r.b))
        following: dict[tuple[int, ...], tuple[int, list[int]]] = {}
        for i, (prefix, (below, targets)) in enumerate(list(active.items())):
            todo = list(targets)
            for value, b in sorted(counts.get(i, [])):
                own = [j for j in todo if total * j / shards < below + b]
                todo = todo[len(own):]
                last = n == len(steps) - 1
                deeper = (*(prefix[:1] if col == "kd" else ()), value)
                for j in own:
                    if b <= slack or last:
                        left = total * j / shards - below <= b / 2
                        done[j] = _edge(prefix, col, shift, value if left else value + 1)
                    else:
                        following.setdefault(deeper, (below, []))[1].append(j)
                below += b
            done.update({j: None for j in todo})
        active = following
    return [done[j] for j in range(1, shards)]


def _edge(prefix: tuple[int, ...], col: str, shift: int, value: int) -> tuple[int, int] | None:
    at = value << shift
    if at < 2**63:
        return (at, LOW) if col == "kh" else (prefix[0], at)
    return None if col == "kh" or prefix[0] + 1 >= 2**63 else (prefix[0] + 1, LOW)


def shard_of(marks: list[tuple[int, int] | None]) -> Column:
    """The number of splitters at or below the key, as a balanced tree of comparisons."""
    real = [m for m in marks if m is not None]

    def tree(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        h, d = real[mid]
        right = (F.col("kh") > h) | ((F.col("kh") == h) & (F.col("kd") >= d))
        return F.when(right, tree(mid + 1, hi)).otherwise(tree(lo, mid))

    return tree(0, len(real)).cast("int")


def histogram_sort_shards(docs: DataFrame, shards: int = 40, tolerance: float = 0.001, rows_per_task: int = 250_000) -> DataFrame:
    """Every row of docs in one of the shards, sizes near equal: doc_id, size, text_crc32, shard, slot.

    Slots number a shard's rows from 0 without gaps, in the order of the key. The exchange puts ranges of the key, of
    some rows_per_task rows, into tasks; a row's slot is its place in its task, and what the tasks before have of its
    shard. Null texts count as empty, null ids sort first, repeated rows get slots of their own, an empty table gives
    no rows; other columns are ignored.
    """
    keys = written(keyed(docs), "keys")
    marks = splitters(keys, shards, tolerance)
    tasks = max(slots(docs.sparkSession), math.ceil(keys.count() / rows_per_task))
    ranges = keys.withColumn("shard", shard_of(marks)).repartitionByRange(tasks, "kh", "kd").sortWithinPartitions("kh", "kd", "size")
    # Of a task, then the place in it; written, so that both stay what they are.
    ranked = written(ranges.select("doc_id", "size", "text_crc32", "shard", F.monotonically_increasing_id().alias("at")), "ranked")
    runs = ranked.groupBy("shard", F.shiftright("at", 33).alias("task")).agg(F.count("*").alias("rows"), F.min("at").alias("first"))
    # A task holds neighbours, so there are at most as many runs as tasks and shards together.
    before = Window.partitionBy("shard").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("shard", "task", (F.coalesce(F.sum("rows").over(before), F.lit(0)) - F.col("first")).alias("shift"))
    placed = ranked.withColumn("task", F.shiftright("at", 33)).join(F.broadcast(runs), ["shard", "task"])
    return placed.select("doc_id", "size", "text_crc32", "shard", (F.col("at") + F.col("shift")).alias("slot"))
