"""Best-fit packing of documents into sequences, in bulk-synchronous rounds.

Documents and gaps are ordered by size, in ranges of equal width. Sizes are whole tokens of at most the capacity, so
what is kept of either is runs: a run of documents is a size and a range of ranks among the documents of that size, a
run of gaps a room and a range of sequences. A round sweeps all ranges at once (sweep): every gap takes the largest
document that fits, which is the same as every document taking the least gap that it fits, its successor. Where gaps
want documents of one size, the documents' ranks decide: each gap takes the next ranks of the run. Gaps are updated by
what they took. Documents that found no gap in their range look in the next range that has gaps; if no gap anywhere has
room for any of them, sequences are opened, as many as their tokens need at least. Documents come in classes from the
largest (CLASSES: parts of the capacity), so that small ones are left for the gaps at the end.

The runs are a table that every round writes anew; they number some thousands at any input. The driver sees a row for
each range and kind. Ranks come from counts by partition, and every document finds its place in the runs by itself.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded, discard, fresh, portions, small_enough, written
from .tokens import encoder, vocabulary

END = 2
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part long, nth long"
#: Documents above these parts of the capacity are packed before any smaller ones; and the number of ranges.
CLASSES, RANGES = (2, 3), 4
DOCUMENT, GAP, PLACED = 0, 1, 2
RUNS = "kind int, size long, first long, number long, sequence long, offset long, range int"
NAMES = [c.split()[0] for c in RUNS.split(", ")]
#: Runs up to which the final join broadcasts them.
FEW = 200_000


def pieces(docs: DataFrame, capacity: int = 1024, path: str | None = None, end: int = END) -> DataFrame:
    """Each document's ids and the end id, cut from the back into pieces of capacity: only the first may be shorter.

    part and nth: the partition, and the place among its pieces of that length.
    """
    path = path or vocabulary("byte_bpe_50k.json")
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"]

    def cut(batches):
        from pyspark import TaskContext

        encode, part = encoder(path), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, "i8")
        for b in portions(batches, 1):
            ids, bounds = encode.ids(b.column(1))
            n = np.diff(bounds) + 1
            stops = np.cumsum(n)
            data = np.full(len(ids) + len(n), end, "<u4")
            own = np.ones(len(data), bool)
            own[stops - 1] = False
            data[own] = ids
            count = -(-n // capacity)
            doc = np.repeat(np.arange(len(n)), count)
            k = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
            first = (n - (count - 1) * capacity)[doc]
            start = np.where(k == 0, 0, first + (k - 1) * capacity)
            size = np.where(k == 0, first, capacity)
            at = (stops - n)[doc] + start
            view = memoryview(data).cast("B")
            crc = [zlib.crc32(view[4 * a : 4 * z]) for a, z in zip(at.tolist(), (at + size).tolist(), strict=True)]
            order = np.argsort(size, kind="stable")
            by = np.bincount(size, minlength=capacity + 1)
            nth = np.empty_like(size)
            nth[order] = np.arange(len(size)) - (np.cumsum(by) - by)[size[order]] + seen[size[order]]
            seen += by
            cols = [b.column(0).take(pa.array(doc)), pa.array(k, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, size, crc, np.full(len(doc), part), nth))]
            yield pa.record_batch(cols, names)

    return bounded(docs).select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, PIECES)


def sweep(documents: list[tuple[int, int, int]], gaps: list[tuple[int, int, int]], capacity: int):
    """Placed runs, documents left and gaps left of one range: (size, first rank, number), (room, first sequence, number).

    In ascending order, documents before gaps of their size: the last document that hasn't found a gap is the largest
    that fits the next one. A gap takes as many of one size as it holds.
    """
    waiting: list[tuple[int, int, int]] = []
    placed, left = [], []
    for size, is_gap, first, number in sorted([(d[0], 0, *d[1:]) for d in documents] + [(g[0], 1, *g[1:]) for g in gaps]):
        if not is_gap:
            waiting.append((size, first, number))
            continue
        while number and waiting:
            own, rank, n = waiting.pop()
            each = size // own
            full = min(number, n // each)
            for k in range(each if full else 0):
                placed.append((own, rank, full, first, capacity - size + k * own))
                rank += full
            if full:
                left.append((size - each * own, first, full))
                first, number, n = first + full, number - full, n - each * full
            if number and n:  # the last documents of the run share one gap
                placed += [(own, rank + k, 1, first, capacity - size + k * own) for k in range(n)]
                left.append((size - n * own, first, 1))
                first, number, n = first + 1, number - 1, 0
            if n:
                waiting.append((own, rank, n))
        if number:
            left.append((size, first, number))
    return placed, waiting, [g for g in left if g[0]]


def range_of(size: Column, capacity: int) -> Column:
    return F.floor((size - 1) * RANGES / capacity).cast("int")


def swept(rows: pa.Table, capacity: int) -> pa.Table:
    """sweep of one range's rows (RUNS and range)."""
    own = list(zip(*(rows.column(c).to_pylist() for c in NAMES[:4]), strict=True))
    placed, documents, gaps = sweep([r[1:] for r in own if r[0] == DOCUMENT], [r[1:] for r in own if r[0] == GAP], capacity)
    at = rows.column("range")[0].as_py()
    out = [(DOCUMENT, *d, None, None, at) for d in documents] + [(GAP, *g, None, None, at) for g in gaps] + [(PLACED, *p, at) for p in placed]
    return pa.table([pa.array([r[i] for r in out], kind) for i, kind in enumerate([pa.int32(), *[pa.int64()] * 5, pa.int32()])], NAMES)


def best_fit(sizes: DataFrame, capacity: int) -> DataFrame:
    """size, first, number, sequence, offset: the documents of that size whose rank is first + i, for i below number, are
    placed at offset of sequence + i. sizes: length, n; written, as every class reads it."""
    spark, base = sizes.sparkSession, fresh(sizes.sparkSession, "rounds")
    state = spark.createDataFrame([], RUNS)
    state.write.parquet(f"{base}/round=0")
    own, none, opened, turn = range_of(F.col("size"), capacity), F.lit(None).cast("long"), 0, 0
    edges = [capacity, *(capacity // c for c in CLASSES), 0]
    for high, low in zip(edges, edges[1:], strict=False):
        begun = sizes.filter((F.col("length") > low) & (F.col("length") <= high)).select(
            F.lit(DOCUMENT).alias("kind"), F.col("length").alias("size"), F.lit(0).cast("long").alias("first"), F.col("n").alias("number"),
            none.alias("sequence"), none.alias("offset"), F.lit(None).cast("int").alias("range"),
        )
        state = begun.unionByName(state.filter(F.col("kind") == GAP))
        while True:
            told = state.filter(F.col("kind") != PLACED).groupBy("kind", own.alias("at")).agg(
                F.min("size").alias("least"), F.max("size").alias("most"), F.sum("number").alias("n"), F.sum(F.col("size") * F.col("number")).alias("tokens")
            ).collect()  # fmt: skip  # a row for each kind and range
            documents, gaps = ([r for r in told if r.kind == k] for k in (DOCUMENT, GAP))
            if not documents:
                break
            room, live = max((r.most for r in gaps), default=0), state.filter(F.col("kind") != PLACED)
            if min(r.least for r in documents) > room:
                # Nothing fits anywhere: open what the tokens need at least, or one a document if no two share one.
                n, tokens = sum(r.n for r in documents), sum(r.tokens for r in documents)
                number = n if 2 * max(r.most for r in documents) > capacity else -(-tokens // capacity)
                live = live.unionByName(spark.createDataFrame([(GAP, capacity, opened, number, None, None, None)], RUNS))
                opened += number
                looks = F.lit(RANGES - 1)
            else:
                # In its own range first, then in the next one up that has gaps, and again from its own.
                looks = own
                for r in sorted((r.at for r in gaps), reverse=True):
                    looks = F.when(F.col("range") < r, r).otherwise(looks)
            live = live.withColumn("range", F.when(F.col("kind") == DOCUMENT, looks).otherwise(own))
            turn += 1
            live.groupBy("range").applyInArrow(lambda rows: swept(rows, capacity), RUNS).write.parquet(f"{base}/round={turn}")
            state = spark.read.schema(RUNS).parquet(f"{base}/round={turn}")
    return spark.read.schema(RUNS).parquet(base).filter(F.col("kind") == PLACED).drop("kind", "range")


def pack(docs: DataFrame, capacity: int = 1024, path: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: one row per piece of every row of docs.

    Null texts are empty: their only id is the end id. Repeated rows are packed each; an empty table gives no rows;
    other columns are ignored.
    """
    cut = written(pieces(docs, capacity, path), "pieces")
    local = written(cut.groupBy("length", "part").agg(F.count("*").alias("n")), "counts")
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = local.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = cut.join(bases, ["length", "part"]).withColumn("rank", F.col("base") + F.col("nth"))
    sizes = written(local.groupBy("length").agg(F.sum("n").alias("n")), "sizes")  # at most capacity rows
    runs = written(best_fit(sizes, capacity), "runs")
    discard(docs.sparkSession, sizes)
    here = (F.col("length") == F.col("size")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("first") + F.col("number"))
    placed = ranked.join(F.broadcast(runs) if small_enough(runs, FEW) else runs, here)
    return placed.select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("sequence") + F.col("rank") - F.col("first")).alias("sequence_id"), "offset"
    )
