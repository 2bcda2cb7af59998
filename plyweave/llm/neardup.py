"""Near-duplicate classes by b-bit MinHash.

Documents with equal shingle sets are one class from the start. Each class has the minima of HASHES hash functions;
BANDS keys of four minima each choose candidates, and the low BITS bits of all minima, packed into longs, estimate the
similarity with the chance of equal low bits taken out. Pairs that may reach the threshold are confirmed on the full
sets. Within a band's bucket every class is first compared with the bucket's pivots; what that leaves in different
components is compared throughout, so no link is lost to a large bucket and no bucket's pairs are written out.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded, discard, portions, small_enough, written
from .graph import components

HASHES, BANDS, BITS = 80, 20, 4
ROWS, LONGS = HASHES // BANDS, HASHES * BITS // 64
#: What the estimate of a pair at the threshold may miss: five standard errors.
MARGIN = 0.2
GROUP = 1 << 20
FEW = 400_000


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def stream(seed: int, n: int) -> np.ndarray:
    return mixed(np.arange(1, n + 1, dtype="u8") * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


@lru_cache(1)
def tables():
    of_byte = stream(1, 256)
    of_byte[65:91] = of_byte[97:123]
    gap = np.zeros(256, bool)
    gap[[0x20, *range(0x09, 0x0E)]] = True
    of_byte[gap] = 0
    return of_byte, gap, stream(2, HASHES) | np.uint64(1)


@lru_cache(4)
def powers(bits: int) -> np.ndarray:
    return np.concatenate([[np.uint64(1)], np.cumprod(np.full((1 << bits) - 1, 0xD6E8FEB86659FD93, "u8"))])


def shingles(raws: list[bytes], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of k words of all texts, in order, and where each text's begin (one more at the end)."""
    of_byte, gap, _ = tables()
    data = np.frombuffer(b"\n".join(raws) + b"\n", "u1")
    off = gap[data]
    starts = np.flatnonzero(~off & np.concatenate([[True], off[:-1]]))
    at = np.cumsum([0, *(len(r) + 1 for r in raws)])
    word_at = np.searchsorted(starts, at)
    if not len(starts):
        return np.empty(0, "u8"), np.zeros(len(raws) + 1, int)
    lens = np.diff(starts, append=len(data))
    place = np.arange(starts[0], len(data)) - np.repeat(starts, lens)
    terms = of_byte[data[starts[0] :]] * powers(max(1, int(lens.max()).bit_length()))[place]
    words = mixed(np.add.reduceat(terms, starts - starts[0]) + np.uint64(1))
    weights = stream(3, k) | np.uint64(1)
    full = np.zeros(len(words), "u8")
    for j in range(min(k, len(words))):
        full[: len(words) - j] += words[j:] * weights[j]
    out, bounds = [], [0]
    for a, b in zip(word_at[:-1].tolist(), word_at[1:].tolist(), strict=True):
        n = b - a
        if n >= k:
            out.append(full[a : b - k + 1])
        elif n:
            out.append((words[a:b] * weights[:n]).sum(keepdims=True) + np.uint64(n))
        bounds.append(bounds[-1] + (max(1, n - k + 1) if n else 0))
    return mixed(np.concatenate(out)) if out else np.empty(0, "u8"), np.array(bounds)


def minima(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """One row a text that has shingles, one column a hash function."""
    starts = bounds[:-1][np.diff(bounds) > 0]
    out = np.empty((len(starts), HASHES), "u4")
    x = np.empty_like(hashes)
    for j, a in enumerate(tables()[2]):
        np.multiply(hashes, a, out=x)
        x >>= np.uint64(32)
        out[:, j] = np.minimum.reduceat(x, starts)
    return out


def in_groups(texts: list):
    """Texts as bytes, some GROUP bytes at a time."""
    group, size = [], 0
    for t in texts:
        raw = (t or "").encode()
        group.append(raw)
        size += len(raw)
        if size >= GROUP:
            yield group
            group, size = [], 0
    if group:
        yield group


def signed(a) -> pa.Array:
    return pa.array(np.asarray(a, "u8").view("i8"))


def signatures(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, th (from docs), n (size of the set), h1, h2 (of the set), bands, s0..: for every row of docs."""

    def sign(batches):
        for b in portions(batches, 2):
            ids, parts = b.column(0), []
            for raws in in_groups(b.column(2).to_pylist()):
                hashes, bounds = shingles(raws, k)
                sets = [np.unique(hashes[a:z]) for a, z in zip(bounds[:-1], bounds[1:], strict=True)]
                n = np.array([len(s) for s in sets])
                sums = np.array([[int(mixed(s).sum()), int(mixed(s * np.uint64(0xA0761D6478BD642F)).sum())] for s in sets], "u8")
                some = n > 0
                bands, packed = np.zeros((len(raws), BANDS), "u8"), np.zeros((len(raws), LONGS), "u8")
                if some.any():
                    low = minima(hashes, bounds).astype("u8")
                    key = np.arange(1, BANDS + 1, dtype="u8") * np.uint64(0x9E3779B97F4A7C15)
                    for r in range(ROWS):
                        key = mixed(key + low[:, r::ROWS])
                    bands[some] = key
                    lanes = (low & np.uint64((1 << BITS) - 1)).reshape(-1, LONGS, 64 // BITS)
                    packed[some] = (lanes << (np.arange(64 // BITS, dtype="u8") * np.uint64(BITS))).sum(2, dtype="u8")
                parts.append((n, sums, bands, packed))
            if not parts:
                continue
            n, sums, bands, packed = (np.concatenate(x) for x in zip(*parts, strict=True))
            lists = pa.FixedSizeListArray.from_arrays(signed(bands.ravel()), BANDS).cast(pa.list_(pa.int64()))
            cols = [ids, b.column(1), pa.array(n), signed(sums[:, 0]), signed(sums[:, 1]), lists, *(signed(np.ascontiguousarray(packed[:, i])) for i in range(LONGS))]
            yield pa.record_batch(cols, ["doc_id", "th", "n", "h1", "h2", "bands", *(f"s{i}" for i in range(LONGS))])

    longs = ", ".join(f"s{i} long" for i in range(LONGS))
    return docs.mapInArrow(sign, f"doc_id long, th long, n long, h1 long, h2 long, bands array<long>, {longs}")


def estimate(a: str, b: str) -> Column:
    """Similarity from the counts of equal lanes, less those equal by chance."""
    differing = F.lit(0)
    ones = int("1" * (64 // BITS), 16)
    for i in range(LONGS):
        x = F.col(f"{a}.s{i}").bitwiseXOR(F.col(f"{b}.s{i}"))
        any_ = x
        for s in range(1, BITS):
            any_ = any_.bitwiseOR(F.shiftrightunsigned(x, s))
        differing = differing + F.bit_count(any_.bitwiseAND(F.lit(ones)))
    chance = 1 / 2**BITS
    return (1 - differing / HASHES - chance) / (1 - chance)


def likely(a: str, b: str, num: int) -> Column:
    """Both the sizes and the estimate allow num percent."""
    lo, hi = F.least(F.col(f"{a}.n"), F.col(f"{b}.n")), F.greatest(F.col(f"{a}.n"), F.col(f"{b}.n"))
    return (lo * 100 >= hi * num) & (estimate(a, b) >= num / 100 - MARGIN)


def full_sets(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """cid, hashes: the sorted set of each class in wanted (cid, rep, rep_th), from a row with that id and text hash."""
    same = docs["doc_id"].eqNullSafe(wanted["rep"]) & (docs["th"] == wanted["rep_th"])
    own = docs.join(F.broadcast(wanted) if small_enough(wanted, FEW) else wanted, same).select("cid", "text")

    def make(batches):
        for b in portions(batches, 1):
            cids, sets = b.column(0), []
            for raws in in_groups(b.column(1).to_pylist()):
                hashes, bounds = shingles(raws, k)
                sets += [np.unique(hashes[a:z]).view("i8") for a, z in zip(bounds[:-1], bounds[1:], strict=True)]
            flat = np.concatenate(sets) if sets else np.empty(0, "i8")
            lists = pa.ListArray.from_arrays(np.cumsum([0, *map(len, sets)]).astype("i4"), pa.array(flat))
            yield pa.record_batch([cids, lists], ["cid", "hashes"])

    return own.mapInArrow(make, "cid long, hashes array<long>").dropDuplicates(["cid"])


def alike(a: str, b: str, num: int) -> Column:
    """Whether two sets reach num percent."""
    both = F.size(F.array_intersect(a, b))
    return both * 100 >= (F.size(a) + F.size(b) - both) * num


def confirmed(pairs: DataFrame, sets: DataFrame, num: int) -> DataFrame:
    """Those pairs (a, b) whose sets reach num percent."""
    x, y = sets.select(F.col("cid").alias("a"), F.col("hashes").alias("ha")), sets.select(F.col("cid").alias("b"), F.col("hashes").alias("hb"))
    return pairs.join(x, "a").join(y, "b").filter(alike("ha", "hb", num)).select("a", "b")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept, th (hash of the text) for every row of docs.

    Words are what lies between ASCII white space, A-Z in lower case; texts of fewer than k words are one shingle. Null
    and empty texts and those without words are linked with nothing, and stay. component_id: the least doc_id reachable
    over links of at least percent. Rows of null id take part, but don't name a component unless nothing else is in it;
    rows that share an id are judged by their own texts. Other columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    told = F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("th")
    own = bounded(docs).select(F.col(id_col).cast("long").alias("doc_id"), told, F.col(text_col).alias("text"))
    signs = written(signatures(own, k), "signatures").withColumn("cid", F.when(F.col("n") > 0, F.xxhash64("n", "h1", "h2")))
    # Sets are equal by their number and two sums of 64 bits. A key of one hash that several sets share is replaced by
    # another hash's, for those sets.
    clash = signs.filter("n > 0").groupBy("cid").agg(*(f(c).alias(f"{f.__name__}_{c}") for c in ("n", "h1", "h2") for f in (F.min, F.max)))
    clash = written(clash.filter("min_n <> max_n or min_h1 <> max_h1 or min_h2 <> max_h2").select(F.col("cid").alias("shared")), "clash")
    if not small_enough(clash, 0):
        kept = signs.join(F.broadcast(clash) if small_enough(clash, FEW) else clash, signs["cid"] == clash["shared"], "left")
        signs = kept.withColumn("cid", F.when(F.col("shared").isNull(), F.col("cid")).otherwise(F.xxhash64("h2", "h1", "n"))).drop("shared")
    longs = [f"s{i}" for i in range(LONGS)]
    least_row = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th"))
    classes = signs.filter("n > 0").groupBy("cid").agg(least_row.alias("first"), F.first("n").alias("n"), F.first("bands").alias("bands"), *(F.first(s).alias(s) for s in longs))
    classes = written(classes.select("cid", F.col("first.doc_id").alias("rep"), F.col("first.th").alias("rep_th"), "n", "bands", *longs), "classes")
    short = classes.select("cid", "n", *longs)
    keys = classes.select("cid", F.explode("bands").alias("key"))
    shared = keys.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1")
    members = written(keys.join(shared, "key"), "members")
    # A bucket's pivot is its class with the most company: the text that the others were made from has all of theirs.
    weight = members.groupBy("cid").agg(F.sum("size").alias("weight"))
    pivots = members.join(weight, "cid").groupBy("key").agg(F.max(F.struct("weight", "cid"))["cid"].alias("pivot"))
    starred = members.join(pivots, "key")

    def signed_pairs(pairs: DataFrame) -> DataFrame:
        return pairs.join(short.select(F.col("cid").alias("a"), F.struct("n", *longs).alias("x")), "a").join(short.select(F.col("cid").alias("b"), F.struct("n", *longs).alias("y")), "b")

    stars = signed_pairs(starred.filter("cid <> pivot").select(F.col("cid").alias("a"), F.col("pivot").alias("b")).distinct())
    stars = stars.filter(likely("x", "y", percent)).groupBy("a").agg(F.max_by("b", estimate("x", "y")).alias("b"))
    stars = written(stars, "stars")
    # Sets are needed of every class that has company in a bucket; the others are never compared.
    linked = members.select("cid").distinct().join(classes.select("cid", "rep", "rep_th"), "cid")
    sets = written(full_sets(own, written(linked, "linked"), k), "sets")
    links = written(confirmed(stars, sets, percent), "links")
    first = components(links)
    # What is still in different components of one bucket, compared by signature within the join.
    lab = members.join(first.withColumnRenamed("v", "cid"), "cid", "left") if first is not None else members.withColumn("root", F.lit(None).cast("long"))
    lab = written(lab.select("key", "cid", F.coalesce("root", "cid").alias("root")), "labelled")
    split = lab.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi").select("key")
    rest = lab.join(split, "key").join(short, "cid").join(classes.select("cid", "bands"), "cid").join(sets, "cid")
    x, y = rest.alias("x"), rest.alias("y")
    # In their first common bucket only; the full sets are read within the join, so it makes links and not candidates.
    once = F.array_min(F.array_intersect("x.bands", "y.bands")) == F.col("x.key")
    same = (F.col("x.key") == F.col("y.key")) & (F.col("x.root") < F.col("y.root")) & likely("x", "y", percent)
    cross = x.join(y, same & once & alike("x.hashes", "y.hashes", percent))
    more = written(cross.select(F.col("x.cid").alias("a"), F.col("y.cid").alias("b")), "more")
    all_ = components(links.union(more)) if more.limit(1).count() else first
    groups = classes.select("cid", "rep")
    if all_ is not None:
        named = groups.join(all_.withColumnRenamed("v", "cid"), "cid", "left").withColumn("root", F.coalesce("root", "cid"))
        least = named.groupBy("root").agg(F.min("rep").alias("component_id"))
        groups = named.join(least, "root").select("cid", "component_id")
    else:
        groups = groups.select("cid", F.col("rep").alias("component_id"))
    groups = written(groups, "groups")
    discard(spark, classes, members, stars, sets, links, lab, more)
    both = signs.select("doc_id", "th", "n", "cid").join(groups, "cid", "left")
    name = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return both.select("doc_id", F.col("n").alias("n_shingles"), name.alias("component_id"), F.col("doc_id").eqNullSafe(name).alias("kept"), "th")
