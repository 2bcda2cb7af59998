"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy.

A word's embedding is the sum of four hashed ones: two of the whole word (so that a collision of one alone tells
little) and one each of its first five and four bytes, for languages that inflect. Filters of WIDTHS words run over
them, each is pooled by its maximum over the whole text, and a logistic layer joins them. It is trained on at most
SAMPLE labelled rows, and its output scaled so that a score of CUT is the best threshold of a set-aside part. Each
language's threshold, which never enters the score, is set on all labelled rows outside the held-out fold, by counts of
their scores from models that haven't seen them.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded, portions, trim
from .neardup import in_groups, mixed, powers, stream

BUCKETS, SUBS, DIM, EACH, WIDTHS = 1 << 16, 4, 8, 4, (1, 2, 3)
SAMPLE, EPOCHS, BATCH, CUT = 6_000, 6, 64, 0.7
#: Rows of either label that a language's own threshold needs, and bins of one logit.
ENOUGH, BINS = 20, 64
#: Models that score the sample's rows for the thresholds, each trained without the rows that it scores.
PARTS = 4
#: Labels up to which they are broadcast, in rows of an id and two flags.
FEW = 400_000
OFFSETS = [(w, k) for w in WIDTHS for k in range(w)]
#: Of each column of the filters, its pooled output and its place in the window.
FILTER = np.array([WIDTHS.index(w) * EACH + f for w, _ in OFFSETS for f in range(EACH)])
PLACE = np.repeat([k for _, k in OFFSETS], EACH)


@lru_cache(1)
def letters() -> tuple[np.ndarray, np.ndarray]:
    of_byte = stream(21, 256)
    of_byte[65:91] = of_byte[97:123]
    word = np.zeros(256, bool)
    word[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
    of_byte[~word] = 0
    return of_byte, word


def hashed(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The four buckets of every word, and where each text's words begin (one more at the end)."""
    of_byte, word = letters()
    data = np.frombuffer(b"\n".join(raws) + b"\n", "u1")
    on = word[data]
    starts = np.flatnonzero(on & ~np.concatenate([[False], on[:-1]]))
    bounds = np.searchsorted(starts, np.cumsum([0, *(len(r) + 1 for r in raws)]))
    if not len(starts):
        return np.empty((0, SUBS), "i4"), bounds
    lens = np.diff(starts, append=len(data))
    place = np.arange(starts[0], len(data)) - np.repeat(starts, lens)
    terms = of_byte[data[starts[0] :]] * powers(max(1, int(lens.max()).bit_length()))[place]
    at = starts - starts[0]
    whole = mixed(np.add.reduceat(terms, at))
    out = np.empty((len(starts), SUBS), "i4")
    out[:, 0], out[:, 1] = whole & np.uint64(BUCKETS - 1), (whole >> np.uint64(32)) & np.uint64(BUCKETS - 1)
    for i, size in ((2, 5), (3, 4)):
        terms[place >= size] = 0
        out[:, i] = mixed(np.add.reduceat(terms, at) + np.uint64(i)) & np.uint64(BUCKETS - 1)
    return out, bounds


class Model:
    """emb (SUBS, BUCKETS, DIM), filters (DIM, EACH for each width and place in it), bias, top, base; then scaling."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.emb = rng.normal(0, 0.02, (SUBS, BUCKETS, DIM)).astype("f4")
        self.filters = rng.normal(0, 0.2, (DIM, len(OFFSETS) * EACH)).astype("f4")
        self.bias = np.zeros(len(WIDTHS) * EACH, "f4")
        self.top = np.full(len(WIDTHS) * EACH, 0.1, "f4")
        self.base, self.scale, self.shift = np.float32(-2), 1.0, 0.0
        self.by_lang: dict[str, float] = {}

    def convolved(self, parts: np.ndarray) -> np.ndarray:
        """parts: for each word what it adds at each width and place. Per word the filters' values, windows past the end included."""
        n = len(parts)
        out = np.zeros((n, len(WIDTHS) * EACH), "f4")
        for j, (w, k) in enumerate(OFFSETS):
            i = WIDTHS.index(w) * EACH
            if n > k:
                out[: n - k, i : i + EACH] += parts[k:, j * EACH : (j + 1) * EACH]
        return out

    def tables(self) -> np.ndarray:
        return self.emb @ self.filters

    def logits(self, tables: np.ndarray, raws: list[bytes]) -> np.ndarray:
        """Of whole texts; a window never holds words of two."""
        ids, bounds = hashed(raws)
        pooled = np.zeros((len(raws), len(self.bias)), "f4")
        some = np.diff(bounds) > 0
        if some.any():
            parts = tables[0][ids[:, 0]]
            for s in range(1, SUBS):
                parts += tables[s][ids[:, s]]
            conv = self.convolved(parts)
            for w in WIDTHS[1:]:  # those that reach into the next text
                i = WIDTHS.index(w) * EACH
                for a, b in zip(bounds[:-1][some], bounds[1:][some], strict=True):
                    if b - a >= w:
                        conv[b - w + 1 : b, i : i + EACH] = -np.inf
                    else:
                        conv[a:b, i : i + EACH] = self._short(parts[a:b], w)
            pooled[some] = np.maximum.reduceat(conv, bounds[:-1][some])
        return np.maximum(pooled + self.bias, 0) @ self.top + self.base

    def _short(self, parts: np.ndarray, w: int) -> np.ndarray:
        """The one window of a text of fewer words than the filter, in every row."""
        js = [j for j, (v, _) in enumerate(OFFSETS) if v == w]
        total = sum(parts[k, js[k] * EACH : (js[k] + 1) * EACH] for k in range(len(parts)))
        return np.broadcast_to(total, (len(parts), EACH))

    def scores(self, logits: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * logits + self.shift, -30, 30)))


def ends_masked(conv: np.ndarray) -> None:
    """Of one text: takes out the windows that reach past its end, all but the first if the text is shorter than a filter."""
    for w in WIDTHS[1:]:
        i = WIDTHS.index(w) * EACH
        conv[max(1, len(conv) - w + 1) :, i : i + EACH] = -np.inf


def started(model: Model, docs: list[np.ndarray], y: np.ndarray) -> None:
    """Puts each bucket's smoothed log-odds into one dimension, and filters that read them into every width."""
    base = y.mean()
    for s in range(SUBS):
        pos, n = np.zeros(BUCKETS), np.zeros(BUCKETS)
        for ids, t in zip(docs, y, strict=True):
            u = np.unique(ids[:, s])
            n[u] += 1
            pos[u] += t
        p = (pos + 10 * base) / (n + 10)
        model.emb[s, :, s] = np.log(p / (1 - p)) - np.log(base / (1 - base))
    for j, (w, k) in enumerate(OFFSETS):
        if k == 0:
            model.filters[:SUBS, j * EACH] += 0.5
            model.filters[:2, j * EACH + 1] += 1.0
            model.filters[2:SUBS, j * EACH + 2] += 1.0


def trained(texts: list[str], y: np.ndarray, seed: int = 7) -> Model:
    """A model of those rows: nine tenths train it, the rest set its scale."""
    model, rng = Model(seed), np.random.default_rng(seed)
    if not len(y) or y.min() == y.max():
        rate = float(np.clip(y.mean() if len(y) else 0.0, 1e-3, 0.5))
        model.scale, model.shift = 0.0, float(np.log(rate / (1 - rate)))
        return model
    docs = [hashed([(t or "").encode()])[0] for t in texts]
    turn = rng.permutation(len(y))
    held, own = turn[: max(1, len(y) // 10)], turn[max(1, len(y) // 10) :]
    if y[own].min() == y[own].max():
        held, own = turn, turn
    started(model, [docs[i] for i in own], y[own])
    model.base = np.float32(np.log(y[own].mean() / (1 - y[own].mean())))
    rate, eps, memory = 0.05, 1e-6, {k: np.zeros_like(getattr(model, k)) for k in ("filters", "bias", "top")}
    emb_memory = np.full((SUBS, BUCKETS), 0.1, "f4")
    for _ in range(EPOCHS):
        own = rng.permutation(own)
        for at in range(0, len(own), BATCH):
            grads = {k: np.zeros_like(v) for k, v in memory.items()}
            rows, steps, err_sum = [], [], 0.0
            batch = own[at : at + BATCH]
            for i in batch:
                ids = docs[i]
                if not len(ids):
                    continue
                e = sum(model.emb[s][ids[:, s]] for s in range(SUBS))
                conv = model.convolved(e @ model.filters)
                ends_masked(conv)
                best = conv.argmax(0)
                raw = conv[best, np.arange(conv.shape[1])] + model.bias
                act = np.maximum(raw, 0)
                err = 1 / (1 + np.exp(-np.clip(act @ model.top + model.base, -30, 30))) - y[i]
                err_sum += err
                grads["top"] += err * act
                down = err * model.top * (raw > 0)
                grads["bias"] += down
                at_word, gap = best[FILTER] + PLACE, down[FILTER]
                cols = np.flatnonzero((gap != 0) & (at_word < len(ids)))
                grads["filters"][:, cols] += (gap[cols, None] * e[at_word[cols]]).T
                rows.append(ids[at_word[cols]])
                steps.append(gap[cols, None] * model.filters[:, cols].T)
            for k, g in grads.items():
                g = g / len(batch)
                memory[k] += g * g
                setattr(model, k, getattr(model, k) - rate * g / (np.sqrt(memory[k]) + eps))
            model.base -= np.float32(0.05 * err_sum / len(batch))
            if rows:
                r, d = np.concatenate(rows), np.concatenate(steps).astype("f4") / len(batch)
                for s in range(SUBS):
                    np.add.at(emb_memory[s], r[:, s], (d * d).mean(1))
                    np.add.at(model.emb[s], r[:, s], -rate * d / np.sqrt(emb_memory[s][r[:, s]])[:, None])
    tables = model.tables()
    z = np.concatenate([model.logits(tables, raws) for raws in in_groups([texts[i] for i in held])])
    scaled(model, z, y[held])
    return model


def best_cut(z: np.ndarray, y: np.ndarray) -> float:
    """The logit whose threshold has the best F1, midway between the rows on its sides."""
    order = np.argsort(-z, kind="stable")
    hits = np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(z) + 1) + max(1, y.sum()))
    k = int(f1.argmax())
    return float((z[order[k]] + (z[order[k + 1]] if k + 1 < len(z) else z[order[k]] - 1)) / 2)


def scaled(model: Model, z: np.ndarray, y: np.ndarray) -> None:
    """The best cut becomes the score CUT."""
    cut = best_cut(z, y) if y.any() else float(z.max()) + 1
    model.shift = float(np.log(CUT / (1 - CUT)) - model.scale * cut)


def bins(model: Model, logits: np.ndarray) -> np.ndarray:
    return np.floor(np.clip(model.scale * logits + model.shift, -30, 30) * BINS).astype("i4")


def crossed(texts: list[str], y: np.ndarray) -> np.ndarray:
    """Each row's bin by a model of the other PARTS - 1 parts of the rows, scaled so that the best cut of its own part is CUT."""
    out, part = np.zeros(len(y), "i4"), np.arange(len(y)) % PARTS
    for k in range(PARTS):
        own = np.flatnonzero(part == k)
        model = trained([t for t, p in zip(texts, part, strict=True) if p != k], y[part != k])
        tables = model.tables()
        z = np.concatenate([model.logits(tables, raws) for raws in in_groups([texts[i] for i in own])])
        scaled(model, z, y[own])
        out[own] = bins(model, z)
    return out


def counted_bins(rows: DataFrame, model: Model, held=None) -> DataFrame:
    """lang, toxic, bin, n: how many of rows (text, lang, toxic) have a score in that bin. held: the model, if it is
    broadcast already."""
    held = held or rows.sparkSession.sparkContext.broadcast(model)

    def binned(batches):
        m = held.value
        tables = m.tables()
        for b in portions(batches):
            z = [m.logits(tables, raws) for raws in in_groups(b.column("text").to_pylist())]
            if z:
                yield pa.RecordBatch.from_arrays([b.column("lang"), b.column("toxic"), pa.array(bins(m, np.concatenate(z)))], names=["lang", "toxic", "bin"])

    own = rows.select("text", F.coalesce("lang", F.lit("")).alias("lang"), (F.col("toxic") > 0).alias("toxic"))
    return bounded(own).mapInArrow(binned, "lang string, toxic boolean, bin int").groupBy("lang", "toxic", "bin").agg(F.count("*").alias("n"))


def histogram_cut(pos: Counter, neg: Counter) -> float:
    """As best_cut, of counts by bin: the logit between the last bin above it and the first below."""
    at = np.array(sorted({*pos, *neg}, reverse=True))
    hits, n = np.cumsum([pos[b] for b in at]), np.cumsum([pos[b] + neg[b] for b in at])
    k = int((2 * hits / (n + max(1, hits[-1]))).argmax())
    return float((at[k] + (at[k + 1] + 1 if k + 1 < len(at) else at[k])) / 2 / BINS)


def thresholds(counts) -> dict[str, float]:
    """Scores from (lang, toxic, bin, n); languages with fewer than ENOUGH rows of either label have none."""
    by: dict[str, tuple[Counter, Counter]] = defaultdict(lambda: (Counter(), Counter()))
    for lang, toxic, b, n in counts:
        by[lang][bool(toxic)][b] += n
    return {lang: float(1 / (1 + np.exp(-histogram_cut(pos, neg)))) for lang, (neg, pos) in by.items() if min(pos.total(), neg.total()) >= ENOUGH}


def fold(doc_id):
    """crc32 of the id as text, mod 3; the rows of 1 are held out."""
    return F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "UTF-8")) % 3


def fitted(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Trains on a sample of the rows labelled outside the held-out fold: at most some `sample` of them, chosen by hash of
    the id (all, if there are no more). Rows without a label, an id or a text are left out; of an id's labels the highest
    counts, of its texts the first in order, so that the same tables give the same model. Without such rows, or with one
    label alone, every score is the labels' share (0.001 at least, 0.5 at most). Other columns are ignored.
    The languages' thresholds are set on the sample (by models of its other parts) and all the other such rows (by the
    model); a null language is one by itself."""
    own = labels.filter("toxic is not null and doc_id is not null").filter(fold(F.col("doc_id")) != 1)
    own = own.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = own.count()
    drawn = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1_000_000 * sample / n) if n > sample else F.lit(True)
    texts = docs.select("doc_id", "text", "lang").filter("text is not null")
    rows = texts.join(F.broadcast(own.filter(drawn)), "doc_id")  # the sample
    first: dict[int, tuple] = {}
    for r in rows.select("doc_id", "text", "lang", "toxic").collect():
        key = (r.text, r.lang or "")
        if r.doc_id not in first or key < first[r.doc_id][0]:
            first[r.doc_id] = (key, r)
    got = [r for _, r in sorted(first.values(), key=lambda x: (zlib.crc32(str(x[1].doc_id).encode()), x[1].doc_id))]
    y = np.array([float(r.toxic > 0) for r in got])
    model = trained([r.text for r in got], y)
    counts = []
    trim()
    if min(y.sum(), (1 - y).sum()) >= ENOUGH:
        counts += [(r.lang or "", t, int(b), 1) for r, t, b in zip(got, y, crossed([r.text for r in got], y), strict=True)]
    if n > sample:
        rest = own.filter(~drawn)
        held = docs.sparkSession.sparkContext.broadcast(model)
        found = counted_bins(texts.filter(fold(F.col("doc_id")) != 1).join(F.broadcast(rest) if n <= FEW else rest, "doc_id"), model, held)
        counts += [tuple(r) for r in found.collect()]  # at most 60 * BINS for each language and label
        held.destroy()
    model.by_lang = thresholds(counts)
    del got, first
    trim()
    return model


def scored(docs: DataFrame, model: Model, id_col: str = "doc_id") -> DataFrame:
    """Every row of docs with score, and flagged: whether it reaches its language's threshold (CUT without one).

    Null texts are empty; repeated rows get a score each; an empty table gives no rows. The score depends on the text
    alone. Columns of the input named score or flagged are replaced, all others come back as they were.
    """
    names, held = [c for c in docs.columns if c not in ("score", "flagged")], docs.sparkSession.sparkContext.broadcast(model)
    kept = docs.select(*names)

    def score(batches):
        m = held.value
        tables = m.tables()
        at = names.index("text")
        for b in portions(batches, at):
            texts = b.column(at).to_pylist()
            langs = b.column(b.schema.get_field_index("lang")).to_pylist()
            z = [m.logits(tables, raws) for raws in in_groups(texts)]
            s = m.scores(np.concatenate(z)) if z else np.empty(0)
            flagged = [x >= m.by_lang.get(g or "", CUT) for x, g in zip(s.tolist(), langs, strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s.astype("f8")), pa.array(flagged, pa.bool_())], names=[*names, "score", "flagged"])

    schema = T.StructType([*kept.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("flagged", T.BooleanType())])
    return bounded(kept).mapInArrow(score, schema)
