"""Byte-level tokens: byte table, merges in rank order, special tokens, templates."""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@lru_cache(1)
def byte_table() -> dict[int, str]:
    """Printable bytes stand for themselves, the others for the characters from 256 on, in order."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(256, 512))
    return {b: chr(b if b in plain else next(rest)) for b in range(256)}


def byte_rows(docs: DataFrame) -> DataFrame:
    """doc_id, pos, byte of each text's UTF-8."""
    pairs = F.regexp_extract_all(F.hex(F.encode(F.coalesce("text", F.lit("")), "UTF-8")), F.lit("(..)"), F.lit(1))
    return docs.select("doc_id", F.posexplode(pairs).alias("pos", "h")).select("doc_id", "pos", F.conv("h", 16, 10).cast("int").alias("byte"))


def merged(pieces: list[str], merges: list[tuple[str, str]]) -> list[str]:
    """One pass over the merges in order of rank, each applied from left to right."""
    for left, right in merges:
        if left not in pieces:
            continue
        out: list[str] = []
        for p in pieces:
            if p == right and out and out[-1] == left:
                out[-1] = left + right
            else:
                out.append(p)
        pieces = out
    return pieces


def joinable(merges: list[tuple[str, str]]) -> np.ndarray:
    """For every two bytes, whether some merge joins pieces of which one ends and the other begins with them."""
    back = {c: b for b, c in byte_table().items()}
    out = np.zeros((256, 256), bool)
    for left, right in merges:
        if left and right and left[-1] in back and right[0] in back:
            out[back[left[-1]], back[right[0]]] = True
    return out


class Encoder:
    """Ids of the texts of a column. No merge crosses a place between two bytes that no merge joins, so the column's bytes
    are cut there; single bytes are looked up, and the different longer pieces are merged once each."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], bos: int | None = None):
        table = byte_table()
        self.vocab, self.merges, self.table = vocab, merges, table
        self.single = np.array([vocab.get(table[b], 0) for b in range(256)], "i4")
        self.pairs, self.first = joinable(merges), [] if bos is None else [bos]

    def piece(self, raw: bytes) -> list[int]:
        return [self.vocab.get(p, 0) for p in merged([self.table[b] for b in raw], self.merges)]

    def __call__(self, texts: pa.Array) -> pa.Array:
        raws = [(t or "").encode() for t in texts.to_pylist()]
        data = np.frombuffer(b"".join(raws), "u1")
        ends = np.cumsum([len(r) for r in raws])
        head = np.ones(len(data), bool)
        head[1:] = ~self.pairs[data[:-1], data[1:]]
        head[ends[:-1][ends[:-1] < len(data)]] = True
        starts = np.flatnonzero(head)
        lens = np.diff(starts, append=len(data))
        ids, counts = self.single[data[starts]] if len(data) else np.empty(0, "i4"), np.ones(len(starts), "i8")
        many = np.flatnonzero(lens > 1)
        if len(many):
            found: dict[bytes, int] = {}
            view = data.tobytes()
            kinds = np.array([found.setdefault(view[a : a + n], len(found)) for a, n in zip(starts[many].tolist(), lens[many].tolist(), strict=True)])
            pieces = [np.array(self.piece(p), "i4") for p in found]
            sizes = np.array([len(p) for p in pieces])
            counts[many] = sizes[kinds]
            out = np.empty(int(counts.sum()), "i4")
            at = np.cumsum(counts) - counts
            one = np.ones(len(starts), bool)
            one[many] = False
            out[at[one]] = ids[one]
            n = sizes[kinds]
            begin = np.cumsum(sizes) - sizes
            step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            out[np.repeat(at[many], n) + step] = np.concatenate(pieces)[np.repeat(begin[kinds], n) + step]
            ids = out
        # Where each text's ids begin: after those of the pieces before its first byte.
        before = np.concatenate([[0], np.cumsum(counts)])
        bounds = before[np.searchsorted(starts, np.concatenate([[0], ends]))]
        if self.first:
            ids = np.insert(ids, bounds[:-1], self.first[0])
            bounds = bounds + np.arange(len(bounds))
        return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int32()))


def encode_udf(vocab: dict[str, int], merges: list[tuple[str, str]], bos: int | None = None):
    """An Arrow UDF from texts to ids, bos before them; unknown pieces are 0, null texts are empty."""

    @F.arrow_udf("array<int>")
    def encode(texts: pa.Array) -> pa.Array:
        return encoder(texts)

    encoder = Encoder(vocab, merges, bos)
    return encode


def with_ids(pieces: DataFrame, vocab: DataFrame) -> DataFrame:
    """pieces with token_id by their token, from vocab (id, token); 0 for those that it lacks."""
    return pieces.join(vocab.withColumnRenamed("id", "token_id"), "token", "left").withColumn("token_id", F.coalesce("token_id", F.lit(0)))


def detokenize(tokens: DataFrame, vocab: DataFrame) -> DataFrame:
    """doc_id, text: pieces (id, token) of tokens (doc_id, pos, token_id), in order."""
    own = tokens.join(vocab.withColumnRenamed("id", "token_id"), "token_id")
    pieces = F.transform(F.array_sort(F.collect_list(F.struct("pos", "token"))), lambda x: x["token"])
    return own.groupBy("doc_id").agg(F.array_join(pieces, "").alias("text"))


def joined(ids: Column, vocab: dict[str, int]) -> Column:
    """The text of an array of ids, whose pieces are joined in place: rows without ids have an empty one."""
    by_id = {i: t for t, i in vocab.items()}
    pieces = F.array(*(F.lit(by_id.get(i)) for i in range(max(by_id) + 1)))
    return F.array_join(F.transform(ids, lambda i: F.get(pieces, i)), "")


def token_bytes(token: str) -> bytes:
    """A byte-level token's bytes: the byte table backwards; other characters stay as they are."""
    back = {c: b for b, c in byte_table().items()}
    return b"".join(bytes([back[c]]) if c in back else c.encode() for c in token)


def decoded(ids: Column, vocab: dict[str, int], specials: dict[int, str] | None = None) -> Column:
    """The text of an array of ids: special tokens by their text, the others by their bytes; unknown ids are empty."""
    by_id = {i: token_bytes(t) for t, i in vocab.items()} | {i: t.encode() for i, t in (specials or {}).items()}
    table = F.array(*(F.lit(by_id.get(i, b"").hex()) for i in range(max(by_id) + 1)))
    return F.decode(F.unhex(F.array_join(F.transform(ids, lambda i: F.coalesce(F.get(table, i), F.lit(""))), "")), "UTF-8")


def piece_bytes(piece: Column) -> Column:
    """A sentencepiece piece's bytes: U+2581 is a space, <0xNN> one byte, and all else stays as it is."""
    part = lambda x: F.when(x.rlike("^<0x[0-9A-Fa-f]{1,2}>$"), F.lpad(F.regexp_extract(x, "^<0x([0-9A-Fa-f]{1,2})>$", 1), 2, "0")).when(x == "\u2581", "20").otherwise(F.hex(F.encode(x, "UTF-8")))
    return F.unhex(F.array_join(F.transform(F.regexp_extract_all(piece, F.lit("(?s)<0x[0-9A-Fa-f]{1,2}>|."), F.lit(0)), part), ""))


def special_split(text: Column, specials: list[str]) -> Column:
    """The text's parts in order: special tokens (the longest that fits first) and what is between them."""
    either = "|".join(re.escape(s) for s in sorted(specials, key=lambda s: (-len(s), s)))
    return F.regexp_extract_all(text, F.lit(f"(?s)(?:{either})|(?:(?!{either}).)+"), F.lit(0))


def prompt_template(text: Column) -> Column:
    marked = text.contains("[INST]") | text.contains("<|")
    return F.when(marked, text).otherwise(F.concat(F.lit("[INST] "), text, F.lit(" [/INST]")))


def strip_markers(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"\[/?INST\]", ""), r"^[ \t\r\n]+", "")


def stats_of(text: Column) -> dict[str, Column]:
    """The numbers of a run's printed statistics; null where a line is missing."""
    get = lambda p, kind: F.nullif(F.regexp_extract(text, p, 1), F.lit("")).cast(kind)
    return {
        "n_prompt": get(r"Prompt tokens: (\d+)", "long"), "n_gen": get(r"Generated tokens: (\d+)", "long"), "context": get(r"Context: (\d+) /", "long"),
        "max_context": get(r"Context: \d+ / (\d+)", "long"), "seconds": get(r"Total time: ([0-9.]+)", "double"), "speed": get(r"Decode speed: ([0-9.]+)", "double"),
    }
