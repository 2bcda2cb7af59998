"""Token ids of whole texts by a public byte-level BPE vocabulary."""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: White space as the pretokenizer knows it, and some more.
SPACE = r"\s\x{0b}\x{1c}-\x{1f}\x{85}\pZ"
#: A space inside or at the end of a run of white space: the pretokenizer may join it with what stands before it.
RUNS = rf"[{SPACE}] (?:[{SPACE}]|\z)"


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Ids of a column of texts.

    The pretokenizer begins a new piece at every space that has no white space before it. So texts are cut there by
    column operations, their different words are encoded once, in one call, and ids are put together by index. Texts
    with runs of white space are encoded whole; those that hold a special token's string by the `tokenizers` library,
    which is only loaded for them. Nothing is kept from one call to the next.
    """

    def __init__(self, path: str):
        import json

        import tiktoken

        import public_tokenizers

        self.path = path
        with open(path, encoding="utf-8") as f:
            self.special = [t["content"] for t in json.load(f)["added_tokens"]]
        with open(path.removesuffix(".json") + ".tiktoken", "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.widths = np.zeros(max(ranks.values()) + 1, "i8")
        for token, i in ranks.items():
            self.widths[i] = len(token)
        self.bpe = tiktoken.Encoding("pieces", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.whole = None

    def _one(self, text: str) -> np.ndarray:
        return self.bpe.encode_to_numpy(text, disallowed_special=())

    def _special(self, text: str) -> np.ndarray:
        if self.whole is None:
            from tokenizers import Tokenizer

            self.whole = Tokenizer.from_file(self.path)
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, "u4")

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of different words, each with a space before it, and each word's number of ids."""
        odd = pc.match_substring_regex(words, rf"\A[{SPACE}]|[{SPACE}]\z|\A\z").to_numpy(zero_copy_only=False)
        plain = words.filter(pa.array(~odd))
        parts = pa.ListArray.from_arrays(pa.array([0, len(plain)], pa.int32()), plain.cast(pa.string()))
        ids = self._one(" " + pc.binary_join(parts, " ")[0].as_py() if len(plain) else "")
        # No token holds bytes of two words, so a word's tokens begin where its bytes do.
        at = np.cumsum(pc.binary_length(plain).to_numpy().astype("i8") + 1)
        ends = np.searchsorted(np.cumsum(self.widths[ids]), at) + 1
        sizes = np.zeros(len(words), "i8")
        sizes[~odd] = np.diff(ends, prepend=0)
        if odd.any():
            more = [self._one(" " + w) for w in words.filter(pa.array(odd)).to_pylist()]
            sizes[odd] = [len(x) for x in more]
            starts = np.cumsum(sizes) - sizes
            out = np.empty(int(sizes.sum()), "u4")
            taken = np.zeros(len(out), bool)
            for a, x in zip(starts[odd].tolist(), more, strict=True):
                out[a : a + len(x)] = x
                taken[a : a + len(x)] = True
            out[~taken] = ids
            ids = out
        return ids, sizes

    def _coded(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of each text, where its pieces begin (one more at the end); each piece's code; all codes' ids, and their numbers."""
        texts = texts.cast(pa.large_string()).fill_null("")
        special = np.zeros(len(texts), bool)
        for s in self.special:
            special |= pc.match_substring(texts, s).to_numpy(zero_copy_only=False)
        whole = special | pc.match_substring_regex(texts, RUNS).to_numpy(zero_copy_only=False)
        alone: list[np.ndarray] = []
        if whole.any():
            odd = texts.filter(pa.array(whole)).to_pylist()
            alone = [self._special(t) if s else self._one(t) for t, s in zip(odd, special[whole].tolist(), strict=True)]
            texts = pc.if_else(pa.array(whole), "", texts)
        words = pc.split_pattern(texts, " ")
        bounds = words.offsets.to_numpy()
        words = words.flatten()
        first = words.take(pa.array(bounds[:-1])).dictionary_encode()
        rest = words.dictionary_encode()
        begun = len(alone)
        alone += [self._one(w) for w in first.dictionary.to_pylist()]
        codes = rest.indices.to_numpy() + np.int32(len(alone))
        codes[bounds[:-1]] = first.indices.to_numpy() + begun
        codes[bounds[:-1][whole]] = np.arange(begun, dtype=codes.dtype)
        ids, sizes = self._words(rest.dictionary)
        return bounds, codes, np.concatenate([*alone, ids]), np.concatenate([np.array([len(x) for x in alone], "i8"), sizes])

    def counts(self, texts: pa.Array) -> np.ndarray:
        """The number of ids of each text; nulls are empty."""
        if not len(texts):
            return np.empty(0, "i8")
        bounds, codes, _, sizes = self._coded(texts)
        return np.add.reduceat(sizes[codes], bounds[:-1])

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of all texts, and where each text's begin (one more at the end)."""
        if not len(texts):
            return np.empty(0, "u4"), np.zeros(1, "i8")
        bounds, codes, ids, sizes = self._coded(texts)
        starts, n = np.cumsum(sizes) - sizes, sizes[codes]
        ends = np.cumsum(n)
        at = np.repeat(starts[codes] - (ends - n), n)
        at += np.arange(len(at))
        return ids[at], np.concatenate([[0], ends])[bounds]


@lru_cache(1)
def encoder(path: str) -> Encoder:
    """One a worker process and file."""
    return Encoder(path)
