"""Dictionaries of a tokenizer: from its JSON file, from binary files, and as tables."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Begin and end of text, by the special tokens that may name them (the last that is there counts), and without.
BEGIN, END = (("<|begin_of_text|>", "<s>"), 128000), (("<|end_of_text|>", "</s>"), 128001)


def vocab_of(raw: DataFrame) -> DataFrame:
    """id, token of a tokenizer.json's text (value)."""
    by = F.from_json(F.get_json_object("value", "$.model.vocab"), "map<string,int>")
    return raw.select(F.explode(by).alias("token", "id")).select("id", "token")


def merges_of(raw: DataFrame) -> DataFrame:
    """rank, left, right: merges are pairs, or strings with a space between the two."""
    text = F.get_json_object("value", "$.model.merges")
    pairs = F.from_json(text, "array<array<string>>")
    strings = F.transform(F.from_json(text, "array<string>"), lambda m: F.split(m, " ", 2))
    is_pair = F.substring(F.regexp_replace(text, r"\s", ""), 2, 1) == "["
    at = raw.select(F.posexplode(F.when(is_pair, pairs).otherwise(strings)).alias("rank", "m"))
    return at.select("rank", F.col("m")[0].alias("left"), F.col("m")[1].alias("right"))


def added_of(raw: DataFrame) -> DataFrame:
    """id, content, special of the added tokens."""
    kind = "array<struct<id:int,content:string,special:boolean>>"
    own = raw.select(F.explode(F.from_json(F.get_json_object("value", "$.added_tokens"), kind)).alias("t"))
    return own.select("t.id", "t.content", F.coalesce("t.special", F.lit(False)).alias("special"))


def special_tokens(added: DataFrame) -> DataFrame:
    """id, text: special ones of id 3 or more and of more than one byte, to be tried from the longest on."""
    return added.filter("special and id > 2 and octet_length(content) > 1").select("id", F.col("content").alias("text"))


def ends_of(added: DataFrame) -> DataFrame:
    """bos_id, eos_id: one row."""
    pick = lambda names, rest: F.coalesce(*(F.max(F.when(F.col("content") == n, F.col("id"))) for n in reversed(names)), F.lit(rest))
    return added.agg(pick(*BEGIN).cast("int").alias("bos_id"), pick(*END).cast("int").alias("eos_id"))


def extract(spark: SparkSession, source: str, target: str) -> None:
    """A tokenizer.json as tables: vocab, merges, special, ends."""
    raw = spark.read.text(source, wholetext=True)
    added = added_of(raw)
    for name, df in (("vocab", vocab_of(raw)), ("merges", merges_of(raw)), ("special", special_tokens(added)), ("ends", ends_of(added))):
        df.write.mode("overwrite").parquet(f"{target}/{name}")


def from_binary(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """vocab (id, token), merges (rank, left, right) and ends (bos_id, eos_id) of vocab.bin and merges.bin: counts and ids as
    little-endian int32, each string after its length as uint16."""

    def strings(batches):
        for b in batches:
            for at, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                merges = at.endswith("merges.bin")
                n, place, out = int.from_bytes(raw[:4], "little"), 4 if merges else 12, []
                ends = (None, None) if merges else tuple(int.from_bytes(raw[i : i + 4], "little", signed=True) for i in (4, 8))
                for i in range(n):
                    sizes = [int.from_bytes(raw[place + 2 * j : place + 2 * j + 2], "little") for j in range(1 + merges)]
                    place += 2 * len(sizes)
                    parts = []
                    for size in sizes:
                        parts.append(raw[place : place + size].decode())
                        place += size
                    out.append((merges, i, *(parts + [None])[:2], *ends))
                kinds = [pa.bool_(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.int32()]
                yield pa.record_batch([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], ["merge", "id", "a", "b", "bos_id", "eos_id"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "{vocab,merges}.bin").load(path).select("path", "content")
    found = files.mapInArrow(strings, "merge boolean, id int, a string, b string, bos_id int, eos_id int")
    vocab = found.filter("not merge")
    return vocab.select("id", F.col("a").alias("token")), found.filter("merge").select(F.col("id").alias("rank"), F.col("a").alias("left"), F.col("b").alias("right")), vocab.select("bos_id", "eos_id").distinct()


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def load(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """vocab and merges of a model's folder: tables if there are any, then binary files, then the tokenizer.json."""
    if exists(spark, f"{path}/vocab") and exists(spark, f"{path}/merges"):
        return spark.read.parquet(f"{path}/vocab"), spark.read.parquet(f"{path}/merges")
    if exists(spark, f"{path}/vocab.bin") and exists(spark, f"{path}/merges.bin"):
        return from_binary(spark, path)[:2]
    if exists(spark, f"{path}/tokenizer.json"):
        raw = spark.read.text(f"{path}/tokenizer.json", wholetext=True)
        return vocab_of(raw), merges_of(raw)
    raise FileNotFoundError(f"no dictionary in {path}")
