"""Removal of repeated byte strings, by deep-shallow sorting of the contexts of anchors.

An anchor is the least GRAM-byte hash among the starts inside a window of SPAN bytes (the leftmost of equals), so
windows of equal content have anchors at the same place in them. Anchors whose gram occurs once are dropped. In each
group of equal grams the right contexts and the reversed left contexts are sorted (suffixes.deep_shallow); two windows
at distance d before their anchors are equal if their anchors share d bytes to the left and SPAN - d to the right. The
classes of the two orders change at few depths only, so each group is decided by a few sweeps.

Texts are told apart by two hashes of 64 bits; grams and contexts by one of 64 bits each, contexts within their gram
only. Contexts that are equal as a whole are one kind, by their hashes: a kind found twice is repeated throughout, and only
one context of each kind is sorted, in groups where a kind occurs once. Groups of more than WIDE kinds are decided
without bringing them together: the windows of each context are cut into cells of WIDTHS starts, by their distance to
the anchor. A cell whose bytes occur twice is repeated as a whole, one whose common bytes occur once is not repeated at
all, and the others are cut into smaller cells, down to single windows.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, discard, portions, small_enough, slots, written
from .neardup import mixed, stream
from .suffixes import deep_shallow

SPAN, GRAM, WIDE = 400, 128, 2048
#: Broadcast bound, in rows of one long.
FEW = 200_000
#: Starts in a cell, from level to level.
WIDTHS = (64, 16, 4, 1)


@lru_cache(4)
def powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    base, inverse = 0xD6E8FEB86659FD93, pow(0xD6E8FEB86659FD93, -1, 2**64)
    make = lambda x: np.concatenate([[np.uint64(1)], np.cumprod(np.full((1 << bits) - 1, x, "u8"))])
    return make(base), make(inverse)


def prefix_sums(raw: bytes) -> np.ndarray:
    x = np.frombuffer(raw, "u1")
    up, _ = powers(max(12, len(x).bit_length()))
    sums = np.zeros(len(x) + 1, "u8")
    np.cumsum(stream(11, 256)[x] * up[: len(x)], out=sums[1:])
    return sums


def hashes(sums: np.ndarray, start, end) -> np.ndarray:
    """Of the substrings from start to end."""
    _, down = powers(max(12, (len(sums) - 1).bit_length()))
    return mixed((sums[end] - sums[start]) * down[start])


def anchors(raw: bytes, span: int = SPAN, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """h, x, q, lo, hi: each anchor's hash, its context's, its place, and the first and last start of its own windows."""
    sums = prefix_sums(raw)
    starts = np.arange(len(raw) - gram + 1)
    h = hashes(sums, starts, starts + gram)
    wide = span - gram + 1
    bits = np.uint64(len(h).bit_length())
    keys = (h >> bits << bits) | np.arange(len(h), dtype="u8")
    n = len(keys) - wide + 1
    pad = np.full(-len(keys) % wide, 2**64 - 1, "u8")
    blocks = np.concatenate([keys, pad]).reshape(-1, wide)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    at = (np.minimum(back[:n], ahead[wide - 1 : wide - 1 + n]) & ((np.uint64(1) << bits) - np.uint64(1))).astype("i8")
    first = np.flatnonzero(np.diff(at, prepend=-1))
    last = np.append(first[1:], n) - 1
    return h[at[first]].view("i8"), hashes(sums, first, last + span).view("i8"), at[first], first, last


def first_of_kind(h: np.ndarray, x: np.ndarray) -> np.ndarray:
    """1 where (h, x) occurs for the first time."""
    out = np.zeros(len(h), "i8")
    order = np.lexsort((np.arange(len(h)), x, h))
    out[order] = np.concatenate([[True], (np.diff(h[order]) != 0) | (np.diff(x[order]) != 0)])
    return out


def cells(ctx: bytes, q: int, lo: int, hi: int, width: int, parents: list[int] | None) -> tuple[np.ndarray, ...]:
    """j, core, whole, a, b of the cells of a context: the starts from a to b are those at a distance of j to j + 1
    widths before the anchor; core is the hash of what all windows of a full cell share, whole that of all their bytes.
    parents: the cells of four such widths that are looked into, all if None."""
    j = np.arange((q - hi) // width, (q - lo) // width + 1)
    if parents is not None:
        j = j[np.isin(j // 4, parents)]
    sums = prefix_sums(ctx)
    top = q - width * j
    a, b = np.maximum(top - width + 1, lo), np.minimum(top, hi)
    core = hashes(sums, top - lo, top - lo - width + 1 + SPAN)
    whole = hashes(sums, a - lo, b - lo + SPAN) + (q - a).astype("u8") * np.uint64(0x9E3779B97F4A7C15)
    return j, core.view("i8"), whole.view("i8"), a, b


def merged(spans) -> list[tuple[int, int]]:
    """Sorted, with those that touch or overlap joined."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def repeated_windows(group: list[tuple[bytes, int, int, int, int]], span: int = SPAN) -> list[list[tuple[int, int]]]:
    """For each anchor (context, anchor's place in it, q, lo, hi) the ranges of window starts whose windows are repeated."""
    n = len(group)
    rights, lefts = [c[r:] for c, r, *_ in group], [c[:r][::-1] for c, r, *_ in group]
    (by_r, lcp_r), (by_l, lcp_l) = deep_shallow(rights), deep_shallow(lefts)
    cuts = sorted({0, *(x + 1 for x in lcp_l[1:] if x < span), *(span - x for x in lcp_r[1:] if 0 < x <= span)})
    found: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    by_r_, lcp_r_, by_l_, lcp_l_ = (np.array(x) for x in (by_r, lcp_r, by_l, lcp_l))
    q, lo, hi = (np.array([g[i] for g in group]) for i in (2, 3, 4))
    for d, end in zip(cuts, [*cuts[1:], span + 1], strict=True):
        right, left = np.empty(n, "i8"), np.empty(n, "i8")
        right[by_r_] = np.cumsum(lcp_r_ < span - d)
        left[by_l_] = np.cumsum(lcp_l_ < d)
        _, which, count = np.unique(right * (n + 1) + left, return_inverse=True, return_counts=True)
        a, b = np.maximum(q - end + 1, lo), np.minimum(q - d, hi)
        for i in np.flatnonzero((count[which] > 1) & (a <= b)):
            found[i].append((int(a[i]), int(b[i])))
    return found


def in_cells(contexts: DataFrame) -> list[DataFrame]:
    """cid, a, b of what is repeated within groups of contexts (h, cid, q, lo, hi, ctx), level by level."""
    found, looked = [], contexts.withColumn("parents", F.lit(None).cast("array<long>"))
    for width in WIDTHS:

        def split(batches, width=width):
            for batch in batches:
                parts = []
                for h, cid, q, lo, hi, ctx, parents in zip(*(batch.column(i).to_pylist() for i in range(7)), strict=True):
                    j, *rest = cells(ctx, q, lo, hi, width, parents)
                    parts.append([np.full(len(j), h), np.full(len(j), cid), np.full(len(j), q), j, *rest])
                if parts:
                    yield pa.record_batch([pa.array(np.concatenate(c).astype("i8")) for c in zip(*parts, strict=True)], ["h", "cid", "q", "j", "core", "whole", "a", "b"])

        level = written(looked.mapInArrow(split, "h long, cid long, q long, j long, core long, whole long, a long, b long"), "cells")
        same = ["h", "j", "core", "whole"]
        counts = level.groupBy(*same).agg(F.count("*").alias("n"), F.min(F.struct("cid", "q")).alias("one"))
        counts = written(counts, "counts")
        found.append(level.join(counts.filter("n > 1").select(*same), same).select("cid", "a", (F.col("b") + SPAN).alias("b")))
        open_ = counts.groupBy(*same[:3]).agg(F.count("*").alias("m"), F.min("n").alias("least")).filter("m > 1 and least = 1").select(*same[:3])
        if width == 1 or small_enough(open_, 0):
            break
        next_ = counts.join(open_, same[:3]).select("one.cid", "one.q", "j").groupBy("cid", "q").agg(F.collect_list("j").alias("parents"))
        looked = contexts.join(next_, ["cid", "q"]).select("h", "cid", "q", "lo", "hi", "ctx", "parents")
    return found


def removals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", wide: int = WIDE) -> DataFrame:
    """doc_id, text, spans (array of start, end in bytes): what to remove from every row of docs.

    Rows of equal text are one text with copies, and wholly removed if it has SPAN bytes. Null texts are empty; repeated
    rows are copies; other columns are ignored.
    """
    spark = docs.sparkSession
    own = bounded(docs).select(F.col(id_col).alias("doc_id"), F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8").alias("raw"))
    own = own.withColumn("cid", F.xxhash64("raw"))

    def counted(own: DataFrame) -> DataFrame:
        other = F.xxhash64(F.lit(1), "raw")
        texts = own.filter(F.length("raw") >= SPAN).groupBy("cid")
        return written(texts.agg(F.count("*").alias("copies"), F.min("doc_id").alias("rep"), F.min(other).alias("least"), F.max(other).alias("most")), "sizes")

    sizes = counted(own)
    # A key that different texts share, as their second hashes tell, is replaced by that second hash.
    shared_keys = written(sizes.filter("least <> most").select(F.col("cid").alias("clash")), "clash")
    if not small_enough(shared_keys, 0):
        told = own.join(F.broadcast(shared_keys) if small_enough(shared_keys, FEW) else shared_keys, own["cid"] == shared_keys["clash"], "left")
        own = told.withColumn("cid", F.when(F.col("clash").isNull(), F.col("cid")).otherwise(F.xxhash64(F.lit(1), "raw"))).drop("clash")
        discard(spark, sizes)
        sizes = counted(own)
    large = own.filter(F.length("raw") >= SPAN)

    def find(batches):
        for b in portions(batches, 1):
            parts = []
            for cid, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                a = anchors(raw)
                parts.append([np.full(len(a[0]), cid), *a, first_of_kind(*a[:2])])
            if parts:
                yield pa.record_batch([pa.array(np.concatenate(c).astype("i8")) for c in zip(*parts, strict=True)], ["cid", "h", "x", "q", "lo", "hi", "first"])

    places = written(large.select("cid", "raw").mapInArrow(find, "cid long, h long, x long, q long, lo long, hi long, first long"), "anchors")
    uses = places.groupBy("h").agg(F.min("cid").alias("c0"), F.max("cid").alias("c1"), F.min("q").alias("q0"), F.max("q").alias("q1"))
    # Written, so that the join deals out a gram of very many anchors to several tasks.
    grams = written(uses.filter("c0 <> c1 or q0 <> q1").select("h"), "grams")
    shared = written(places.join(grams, "h"), "shared")
    kinds = shared.groupBy("h", "x").agg(F.min("cid").alias("c0"), F.max("cid").alias("c1"), F.min("first").alias("f0"))
    kinds = written(kinds.select("h", "x", F.col("c0").alias("cid"), F.expr("c0 <> c1 or f0 = 0").alias("twice")), "kinds")
    whole = shared.join(kinds.filter("twice").select("h", "x"), ["h", "x"]).select("cid", F.col("lo").alias("a"), (F.col("hi") + SPAN).alias("b"))
    # One context of each kind is compared with the other kinds of its group, where any of them occurs once.
    groups = kinds.groupBy("h").agg(F.count("*").alias("m"), F.min("twice").alias("all_twice")).filter("m > 1 and not all_twice")
    groups = written(groups.select("h", (F.col("m") > wide).alias("big")), "groups")
    many = bool(groups.filter("big").limit(1).count())
    compared = shared.filter("first = 1").join(kinds.select("h", "x", "cid").join(groups, "h"), ["h", "x", "cid"])
    listed = compared.groupBy("cid").agg(F.collect_set(F.struct("h", "q", "lo", "hi", "big")).alias("at"))
    listed = listed.join(sizes.select("cid", "rep"), "cid")
    texts = large.select("cid", F.col("doc_id").alias("rep0"), "raw")
    chosen = texts.join(listed, "cid").filter(F.col("rep").eqNullSafe(F.col("rep0"))).select("cid", "raw", "at")
    names = ["h", "cid", "q", "lo", "hi", "ctx", "big"]

    def contexts(batches):
        def table(rows):
            kinds_ = {5: pa.binary(), 6: pa.bool_()}
            return pa.record_batch([pa.array([r[i] for r in rows], kinds_.get(i, pa.int64())) for i in range(7)], names)

        for b in batches:
            out: list[tuple] = []
            for cid, raw, at in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                for x in sorted(at, key=lambda x: x["q"]):
                    out.append((x["h"], cid, x["q"], x["lo"], x["hi"], raw[x["lo"] : x["hi"] + SPAN], x["big"]))
                    if len(out) == 4000:
                        yield table(out)
                        out = []
            if out:
                yield table(out)

    # Each anchor once: rows of one id and text say the same.
    cut = written(chosen.mapInArrow(contexts, "h long, cid long, q long, lo long, hi long, ctx binary, big boolean"), "contexts")

    def decide(batches):
        held, group, out = None, {}, []

        def close():
            rows = list(group.items())
            if len(rows) > 1:
                items = [v for _, v in rows]
                for (key, _), spans in zip(rows, repeated_windows(items), strict=True):
                    out.extend((key[0], a, e + SPAN) for a, e in spans)

        def flush():
            return pa.record_batch([pa.array([r[i] for r in out], pa.int64()) for i in range(3)], ["cid", "a", "b"])

        for b in batches:
            for h, cid, q, lo, hi, ctx in zip(*(b.column(i).to_pylist() for i in range(6)), strict=True):
                if h != held:
                    close()
                    held, group = h, {}
                group[cid, q] = (ctx, q - lo, q, lo, hi)
            if len(out) > 10_000:
                yield flush()
                out.clear()
        close()
        yield flush()

    dealt = cut.filter("not big").select(*names[:6]).repartition(slots(spark), "h").sortWithinPartitions("h")
    spans = whole.union(dealt.mapInArrow(decide, "cid long, a long, b long"))
    if many:
        for part in in_cells(cut.filter("big").select(*names[:6])):
            spans = spans.union(part)
    by_text = spans.groupBy("cid").agg(F.collect_set(F.struct("a", "b")).alias("spans"))
    info = by_text.join(sizes.filter("copies > 1").select("cid", "copies"), "cid", "full")
    info = written(info.select("cid", F.coalesce("copies", F.lit(1)).alias("copies"), "spans"), "spans")
    discard(spark, places, grams, shared, kinds, groups, cut, sizes)
    out = own.join(info, "cid", "left")
    everything = F.array(F.struct(F.lit(0).cast("long").alias("a"), F.length("raw").cast("long").alias("b")))
    return out.select("doc_id", "raw", F.when(F.col("copies") > 1, everything).otherwise(F.col("spans")).alias("spans"))


def removed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", wide: int = WIDE) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (binary): every row of docs without its repeated strings."""
    found = removals(docs, id_col, text_col, wide)
    kind = found.schema["doc_id"].dataType.simpleString()

    def cut(batches):
        for b in portions(batches, 1):
            rows = []
            for raw, spans in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                runs = merged((s["a"], s["b"]) for s in spans or ())
                edges = [0, *(x for r in runs for x in r), len(raw)]
                kept = b"".join(raw[x:y] for x, y in zip(edges[::2], edges[1::2], strict=True)) if runs else raw
                rows.append((len(raw), len(raw) - len(kept), len(runs), hashlib.sha256(kept).hexdigest(), kept))
            cols = [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()))]
            yield pa.record_batch([b.column(0), *cols], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return found.mapInArrow(cut, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
