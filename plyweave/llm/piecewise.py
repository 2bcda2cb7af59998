"""Context-triggered piecewise hashing: chunk signatures at rolling-hash boundaries, compared by edit distance.

The rolling hash of the last SPAN bytes cuts a chunk wherever its low bits are all zero; with sizes that double, the
cuts at one block size are among those at the size below. The block size is the least at which a text has at most MOST
chunks. A fingerprint has the chunks' symbols at that size and at twice and four times it, so texts whose block sizes
differ are still compared where the sizes meet.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, portions, slots

SPAN, LEAST_BITS, MOST, LEVELS = 7, 2, 64, 3
ALPHABET = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", "u1")
WEIGHTS = [pow(0x9E3779B1, k + 1, 2**32) for k in range(SPAN)]
#: Bytes of text in a range.
PART = 32 << 20
KIND = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def rolled(data: bytes) -> np.ndarray:
    """For every byte the mixed hash of it and the SPAN - 1 bytes before it (fewer at the start)."""
    x = np.frombuffer(data, "u1").astype("u4") + np.uint32(1)
    h = x * np.uint32(WEIGHTS[0])
    for k in range(1, min(SPAN, len(x))):
        h[k:] += x[:-k] * np.uint32(WEIGHTS[k])
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x85EBCA6B)
    h ^= h >> np.uint32(13)
    h *= np.uint32(0xC2B2AE35)
    h ^= h >> np.uint32(16)
    return h


def symbols(h: np.ndarray) -> tuple[int, list[np.ndarray]]:
    """The block size's bits, and the chunks' 12-bit symbols at it and the next sizes."""
    if not len(h):
        return LEAST_BITS, [np.empty(0, "u4")] * LEVELS
    ends = np.flatnonzero((h & np.uint32((1 << LEAST_BITS) - 1)) == 0)
    tz = h[ends]
    bits = LEAST_BITS
    while len(ends) >= MOST and bits < 31:
        bits += 1
        keep = (tz & np.uint32((1 << bits) - 1)) == 0
        ends, tz = ends[keep], tz[keep]
    sums = np.cumsum(h >> np.uint32(3), dtype="u8")
    out = []
    for k in range(LEVELS):
        at = ends if not k else ends[(tz & np.uint32((1 << min(bits + k, 31)) - 1)) == 0]
        if not len(at) or at[-1] != len(h) - 1:
            at = np.append(at, len(h) - 1)
        chunk = np.diff(sums[at], prepend=np.uint64(0)) * np.uint64(0x9E3779B97F4A7C15)
        out.append((chunk >> np.uint64(52)).astype("u4"))
    return bits, out


def shown(bits: int, levels: list[np.ndarray]) -> str:
    """size:signature:signature:signature, two characters a chunk."""
    return ":".join([str(1 << bits), *(ALPHABET[np.stack([s >> 6, s & 63], 1)].tobytes().decode() for s in levels)])


def alike(a: np.ndarray, b: np.ndarray) -> float:
    """1 - distance / (both lengths), the distance counting insertions and deletions; by bit-parallel subsequences."""
    a, b = a.tolist(), b.tolist()
    if not a or not b:
        return 0.0
    where: dict[int, int] = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for x in b:
        if m := where.get(x):
            u = row & m
            row = (row + u | row - u) & full
    return 2 * (len(a) - row.bit_count()) / (len(a) + len(b))


def likeness(x: tuple[int, list[np.ndarray]], y: tuple[int, list[np.ndarray]]) -> float:
    """The best over block sizes that both have; 1 for equal fingerprints, 0 where no size meets."""
    if x[0] == y[0] and all(np.array_equal(a, b) for a, b in zip(x[1], y[1], strict=True)):
        return 1.0
    pairs = [(x[1][i], y[1][j]) for i in range(LEVELS) for j in range(LEVELS) if x[0] + i == y[0] + j]
    return max((alike(a, b) for a, b in pairs), default=0.0)


def fingerprint(text: str) -> str:
    return shown(*symbols(rolled(text.encode())))


def edited(text: str, other: str) -> tuple[str, int]:
    """The last quarter (rounded down) replaced by the other's first as many code points; the length of what stays."""
    n = len(text) // 4
    return text[: len(text) - n] + other[:n], len(text) - n


def dealing(spark: SparkSession, parts: int) -> list[int]:
    """For each partition a number that hash partitioning puts there, so that no two ranges share one."""
    at = F.pmod(F.hash(F.col("id").cast("int")), F.lit(parts)).alias("at")
    found = spark.range(40 * parts, numPartitions=1).select(at, F.col("id").cast("int").alias("id")).groupBy("at").agg(F.min("id").alias("id"))
    keys = {r.at: r.id for r in found.collect()}  # one for each partition
    return [keys.get(k, k) for k in range(parts)]


def in_turn(docs: DataFrame, most: int = PART) -> tuple[DataFrame, int]:
    """deal, part, ghost, k, h, doc_id, text: rows by ranges of doc_id, of some `most` bytes of text; each range's first
    row goes to the range before as ghost, too. And how many ranges there are.

    The bounds are quantiles of the ids; the first rows are one per range.
    """
    spark = docs.sparkSession
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    total = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(slots(spark), -(-total // most))
    key = F.coalesce("doc_id", F.lit(-(2**63)))
    cuts = own.agg(F.percentile_approx(key, [k / parts for k in range(1, parts)], 10_000)).first()[0] or [] if parts > 1 else []
    cuts = sorted(set(cuts))
    part = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c <= key)) if cuts else F.lit(0)
    keyed = own.select(part.alias("part"), key.alias("k"), "doc_id", "text", F.xxhash64("text").alias("h"))
    firsts = keyed.groupBy("part").agg(F.min(F.struct("k", "h")).alias("f")).orderBy("part").collect()  # one per range
    marks = [(firsts[i - 1].part, r.part, r.f.k, r.f.h) for i, r in enumerate(firsts)]
    heads = F.broadcast(spark.createDataFrame(marks, "before int, part int, k long, h long"))  # of the ranges' number
    known = keyed.join(heads, ["part", "k", "h"], "left")
    to = F.array(F.struct(F.col("part").alias("to"), F.lit(False).alias("ghost")), F.struct(F.col("before").alias("to"), F.lit(True).alias("ghost")))
    told = known.select("*", F.explode(F.filter(to, lambda x: x["to"].isNotNull())).alias("x"))
    deals = F.array(*map(F.lit, dealing(spark, parts)))
    return told.select(F.get(deals, F.col("x.to")).alias("deal"), F.col("x.to").alias("part"), F.col("x.ghost").alias("ghost"), "k", "h", "doc_id", "text"), parts


def compare_in_turn(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for every row of docs.

    The next document is the one that follows by doc_id (ties by the text's hash; null ids first), after the last the
    first. Null texts are empty; equal texts have equal fingerprints, empty ones too; other columns are ignored.
    """
    found, parts = in_turn(bounded(docs))
    dealt = found.repartition(parts, "deal").sortWithinPartitions("part", "ghost", "k", "h")

    def run(batches):
        prev = None  # part, doc_id, text, its hashes and symbols
        for b in portions(batches, 3):
            out = []
            for part, ghost, d, t in zip(*(b.column(n).to_pylist() for n in ("part", "ghost", "doc_id", "text")), strict=True):
                raw = t.encode()
                h = rolled(raw)
                own = symbols(h)
                if prev and prev[0] == part:
                    out.append(result(prev, t, own))
                prev = None if ghost else (part, d, t, raw, h, own)
            yield pa.record_batch([pa.array([r[i] for r in out], kind) for i, kind in enumerate(KINDS)], NAMES)

    KINDS = [pa.int64(), pa.int64(), *[pa.string()] * 3, *[pa.float64()] * 2]
    NAMES = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def result(prev, following, theirs):
        _, d, t, raw, h, own = prev
        text, stays = edited(t, following)
        data = text.encode()
        keep = len(t[:stays].encode())
        tail = rolled(data[max(0, keep - SPAN + 1) :])[min(keep, SPAN - 1) :]
        changed = symbols(np.concatenate([h[:keep], tail]))
        return d, len(t), hashlib.sha256(data).hexdigest(), shown(*own), shown(*changed), likeness(own, changed), likeness(own, theirs)

    return dealt.select("part", "ghost", "doc_id", "text").mapInArrow(run, f"doc_id long, {KIND}")
