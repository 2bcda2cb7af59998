"""Benchmark decontamination by winnowing, in DataFrame operations only.

A fingerprint is the least hash of GRAM-word grams within BAND neighbouring grams, so each window of GRAM + BAND - 1 =
13 words has one, and texts that share such a window share its fingerprint. Test and training texts are winnowed alike
and their fingerprints joined. Each hit is then extended: the windows of 13 words that have the fingerprint, which are
those around its gram, are compared with the benchmark's as texts. Items of fewer words are one window, found by their
longest word instead, and extended from there in the same way.

The generators are the outer kind throughout: the optimizer adds a filter below the others, and pushing it down
repeats the whole expression that makes the array.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, small_enough, written

WINDOW, GRAM, BAND = 13, 6, 8
#: Fixed by the task: what lies between words, and what words are made of.
GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD = r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"
#: Broadcast bounds, in rows (of some 20 bytes each).
FEW = 200_000


def words(text: Column) -> Column:
    return F.filter(F.split(text, GAPS), lambda w: w != "")


def pairwise(a: Column, step: int, merge) -> Column:
    """merge(a[i], a[i + step]) for every i that has both."""
    return F.zip_with(F.slice(a, 1, F.greatest(F.size(a) - step, F.lit(0))), F.slice(a, step + 1, F.greatest(F.size(a) - step, F.lit(0))), merge)


def _hashes(df: DataFrame) -> DataFrame:
    """Adds g, the hashes of the grams of `ws`, a column at a time so that nothing is computed twice."""
    df = df.withColumn("g", F.transform("ws", lambda w: F.xxhash64(w)))
    for step in (1, 2, 2):  # 2, 4, then 6 words
        df = df.withColumn("g", pairwise(F.col("g"), step, lambda a, b: F.xxhash64(a, b)))
    return df


def window_fingerprints(df: DataFrame) -> DataFrame:
    """Adds g, the fingerprint of every window of `ws`: of its BAND grams the least."""
    df = _hashes(df)
    for step in (1, 2, 4):
        df = df.withColumn("g", pairwise(F.col("g"), step, lambda a, b: F.least(a, b)))
    return df


def benchmark_windows(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item_id, len, win: each window of each item as a text of words with spaces between."""
    ws = items.select(F.col(id_col).alias("item_id"), words(ascii_lower(F.col(text_col))).alias("ws")).filter(F.size("ws") > 0)
    length = F.least(F.size("ws"), F.lit(WINDOW))
    starts = F.sequence(F.lit(1), F.size("ws") - length + 1)
    wins = F.transform(starts, lambda s: F.array_join(F.slice("ws", s, length), " "))
    return ws.select("item_id", length.alias("len"), F.explode_outer(F.array_distinct(wins)).alias("win"))


def _near(big: DataFrame, small: DataFrame, keys: list[str]) -> DataFrame:
    """An inner join that broadcasts small only where its counted rows are few."""
    return big.join(F.broadcast(small) if small_enough(small, FEW) else small, keys)


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, th (hash of the text), n_words, n_hit, n_items, items (sorted ids as strings): one row per row of docs.

    A word is hit if an occurrence of a window of an item covers it. Null texts have no words; repeated rows and rows
    that share an id are judged by their own texts; empty tables give no rows or no hits; other columns are ignored.
    """
    told = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    own = docs.select(F.col(id_col).alias("doc_id"), told.alias("th"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    wins = written(benchmark_windows(items), "windows")

    # Where a document may hold a window: (doc, start of the window from 1, its length).
    long_ = wins.filter(F.col("len") == WINDOW).select(F.split("win", " ").alias("ws"))
    test = written(window_fingerprints(long_).select(F.explode_outer("g").alias("gram")).distinct(), "fingerprints")
    low = own.select("doc_id", "th", words(ascii_lower(F.col("text"))).alias("ws"))
    hits = None
    if small_enough(test, 0) is False:
        found = window_fingerprints(low).select("doc_id", "th", F.explode_outer(F.array_distinct("g")).alias("gram"))
        hits = _near(found, test, ["gram"]).select("doc_id", "th").distinct()
    short = wins.filter(F.col("len") < WINDOW).select("len", "win", F.split("win", " ").alias("ws"))
    anchors = None
    if small_enough(short, 0) is False:
        longest = F.array_max(F.transform("ws", lambda w, i: F.struct(F.length(w).alias("n"), w.alias("w"), (-i).alias("i"))))
        # The word, its place in the item, and the item's length.
        anchors = written(short.select(longest["w"].alias("w"), (-longest["i"]).alias("q"), "len").distinct(), "anchors")
        each = low.select("doc_id", "th", F.explode_outer(F.array_distinct("ws")).alias("w"))
        few = _near(each, anchors.select("w").distinct(), ["w"]).select("doc_id", "th").distinct()
        hits = few if hits is None else hits.union(few).distinct()
    counted = own.select("doc_id", "th", F.regexp_count("text", F.lit(WORD)).cast("long").alias("n_words"))
    if hits is None:
        return counted.select("doc_id", "th", "n_words", F.lit(0).cast("long").alias("n_hit"), F.lit(0).cast("long").alias("n_items"), F.array().cast("array<string>").alias("items"))
    hits = written(hits, "hits")
    few_docs = small_enough(hits, FEW)

    # Extension, in documents with a hit: at = first word of a window (from 0), win = its text.
    same = own["doc_id"].eqNullSafe(hits["doc_id"]) & (own["th"] == hits["th"])
    chosen = own.join(F.broadcast(hits) if few_docs else hits, same, "left_semi").dropDuplicates(["doc_id", "th"])
    chosen = chosen.select("doc_id", "th", words(ascii_lower(F.col("text"))).alias("ws"))
    text_at = lambda at, n: F.array_join(F.slice("ws", at + 1, n), " ")

    def extended(places: DataFrame, start: Column, size: Column, side: DataFrame, keys: list[str]) -> DataFrame:
        """Windows of the places (doc_id, th, ws, keys) that join with side. Their texts are made behind a broadcast, or
        before a shuffle, so that no row carries a whole document."""
        if small_enough(side, FEW):
            met = places.join(F.broadcast(side), keys)
            return met.filter((start >= 0) & (start + size <= F.size("ws"))).select("doc_id", "th", start.alias("at"), text_at(start, size).alias("win"), size.alias("len"))
        around = F.array_join(F.slice("ws", F.greatest(F.col("p") - WINDOW, F.lit(0)) + 1, 2 * WINDOW), " ")
        lean = places.select("doc_id", "th", "p", *keys, F.size("ws").alias("n"), F.split(around, " ").alias("near"), F.least(F.col("p"), F.lit(WINDOW)).alias("back")).join(side, keys)
        met = lean.filter((start >= 0) & (start + size <= F.col("n")))
        return met.select("doc_id", "th", start.alias("at"), F.array_join(F.slice("near", start - F.col("p") + F.col("back") + 1, size), " ").alias("win"), size.alias("len"))

    spans = None
    if small_enough(test, 0) is False:
        places = window_fingerprints(chosen).select("doc_id", "th", "ws", F.posexplode_outer("g").alias("p", "gram"))
        spans = extended(places, F.col("p"), F.lit(WINDOW), test, ["gram"])
    if anchors is not None:
        places = chosen.select("doc_id", "th", "ws", F.posexplode_outer("ws").alias("p", "w"))
        more = extended(places, F.col("p") - F.col("q"), F.col("len"), anchors, ["w"])
        spans = more if spans is None else spans.union(more)
    known = wins.select("win").distinct()
    spans = written(_near(spans.distinct(), known, ["win"]), "spans")
    covered = F.array_distinct(F.flatten(F.collect_set(F.sequence(F.col("at"), F.col("at") + F.col("len") - 1))))
    n_hit = spans.groupBy("doc_id", "th").agg(F.size(covered).cast("long").alias("n_hit"))
    by_item = spans.select("doc_id", "th", "win").distinct().join(wins.select("win", "item_id"), "win").select("doc_id", "th", "item_id").distinct()
    listed = by_item.groupBy("doc_id", "th").agg(F.sort_array(F.collect_list(F.col("item_id").cast("string"))).alias("items"))
    result = written(n_hit.join(listed, n_hit["doc_id"].eqNullSafe(listed["doc_id"]) & (n_hit["th"] == listed["th"])).select(n_hit["doc_id"].alias("d"), n_hit["th"].alias("t"), "n_hit", "items"), "result")
    both = counted.join(F.broadcast(result) if few_docs else result, counted["doc_id"].eqNullSafe(result["d"]) & (counted["th"] == result["t"]), "left")
    items_ = F.coalesce("items", F.array().cast("array<string>"))
    return both.select("doc_id", "th", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.size(items_).cast("long").alias("n_items"), items_.alias("items"))


def contaminated() -> Column:
    """The contract's rule: at least a twentieth of the words are hit."""
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))
