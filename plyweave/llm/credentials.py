"""Secret scan with multipart linking.

Strong parts (assignments, access keys, long hex) are reported by themselves. Weak ones (identifiers, mixed tokens,
endpoints) are candidates: an interval join within the document puts each next to the parts of other kinds in its scope
(a paragraph) and reach, and only those with complementary parts are reported: a weak secret needs an identifier, an
identifier a secret, an endpoint both.
"""

from __future__ import annotations

import re
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded, portions

#: Fixed by the task: the base patterns and their least lengths.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
KINDS = ("assign", "access", "hex")

IDENT = re.compile(r"""(?:access_key_id|key_id|client_id|user(?:_?name)?|login|account)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._-]{3,}""", re.I | re.A)
IDENT_WORDS = ("key_id", "client_id", "user", "login", "account")
MIXED = re.compile(r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])(?=[0-9+/_-]*[A-Za-z])[A-Za-z0-9+/_-]{16,}", re.A)
ENDPOINT = re.compile(r"(?:https?|ftp|ssh|jdbc:[a-z]+|postgres|mysql|redis)://[A-Za-z0-9.-]+(?::[0-9]+)?|(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?::[0-9]+)?(?![0-9.])", re.A)
REACH = 256
SPAN = "array<struct<kind:string,start:int,end:int>>"


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, rank of kind, kind, end), leftmost and non-overlapping by kind."""
    found = []
    low = text.lower()
    if any(w in low for w in ASSIGN_WORDS):
        found += [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, "access", m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, "hex", m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def reached(others: list[tuple], reach: int):
    """Of spans sorted by start, a test whether any but the given one lies within reach of a span.

    An interval join by bisection: among those that begin early enough, the one that ends last decides. Beside it the
    last end of another one is kept, so that a span is never its own complement.
    """
    starts, last = [o[0] for o in others], [(-1, -1, -1)]
    for i, o in enumerate(others):
        end, at, second = last[-1]
        last.append((o[3], i, end) if o[3] > end else (end, at, max(second, o[3])))
    index = {id(o): i for i, o in enumerate(others)}

    def close(part: tuple) -> bool:
        end, at, second = last[bisect_right(starts, part[3] + reach)]
        return (second if index.get(id(part)) == at else end) >= max(part[0] - reach, 0)

    return close


def linked_spans(text: str, base: list[tuple], reach: int = REACH) -> list[tuple]:
    """The weak parts that have their complements."""
    low = text.lower()
    ident = [(m.start(), 3, "identifier", m.end()) for m in IDENT.finditer(text)] if any(w in low for w in IDENT_WORDS) else []
    keys = [s for s in base if s[2] == "access"]
    if not ident and not keys:
        return []
    strong = reached(base, 0)
    free = lambda m: not strong((m.start() + 1, 0, "", m.end() - 1))  # noqa: E731  no byte in common
    mixed = [(m.start(), 4, "weak", m.end()) for m in MIXED.finditer(text) if free(m)]
    ends = [(m.start(), 5, "endpoint", m.end()) for m in ENDPOINT.finditer(text)]
    secret = [s for s in base if s[2] != "access"]
    cuts = [m.end() for m in re.finditer(r"\n\s*\n", text)]
    scopes: dict[int, tuple[list, ...]] = {}
    for i, spans in enumerate((ident + keys, secret + mixed, mixed, ends)):
        for s in spans:
            scopes.setdefault(bisect_right(cuts, s[0]), ([], [], [], []))[i].append(s)
    out: list[tuple] = []
    for names, secrets, weak, hosts in scopes.values():
        if names and (secrets or hosts):
            by_name, by_secret = reached(sorted(names), reach), reached(sorted(secrets), reach)
            out += [s for s in names if s[2] == "identifier" and by_secret(s)]
            out += [s for s in weak if by_name(s)]
            out += [s for s in hosts if by_name(s) and by_secret(s)]
    return out


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int = REACH) -> DataFrame:
    """doc_id, base, linked: arrays of (kind, start, end) in code points, sorted by start, then kind.

    One row per row of docs. Null and empty texts have no spans; other columns are ignored.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def find(batches):
        shape = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        tell = lambda spans: [{"kind": k, "start": s, "end": e} for s, _, k, e in spans]
        for b in portions(batches, 1):
            texts = b.column(1).to_pylist()
            base = [base_spans(t) if t else [] for t in texts]
            more = [sorted(linked_spans(t, s, reach)) if t else [] for t, s in zip(texts, base, strict=True)]
            yield pa.record_batch([b.column(0), pa.array(map(tell, base), shape), pa.array(map(tell, more), shape)], ["doc_id", "base", "linked"])

    return bounded(docs).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(find, f"doc_id {kind}, base {SPAN}, linked {SPAN}")


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def in_order(spans: Column) -> Column:
    """By start, then kind as listed."""
    rank = lambda s: F.array_position(F.array(*map(F.lit, (*KINDS, "identifier", "weak", "endpoint"))), s["kind"])
    keyed = F.transform(spans, lambda s: F.struct(s["start"].alias("a"), rank(s).alias("r"), s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return F.array_sort(keyed)


def counted(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def redacted(text: str, spans: list[tuple[int, int]], mark: str = "[SECRET]") -> str:
    """text with overlapping spans merged and each replaced by the mark."""
    out, at = [], 0
    for a, b in sorted(spans):
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """docs with every span replaced by the mark in text, and n_chars its new length where the text changed.

    Every row comes back, repeated ones too, with its other columns as they were; null and empty texts have no spans.
    """
    names = docs.columns
    at, size = names.index("text"), names.index("n_chars")

    def clean(batches):
        for b in portions(batches, at):
            texts, counts = b.column(at).to_pylist(), b.column(size).to_pylist()
            for i, t in enumerate(texts):
                if t and (spans := [*(base := base_spans(t)), *linked_spans(t, base)]):
                    texts[i] = redacted(t, [(s[0], s[3]) for s in spans], mark)
                    counts[i] = len(texts[i])
            cols = list(b.columns)
            cols[at], cols[size] = pa.array(texts, pa.string()), pa.array(counts, b.schema.field(size).type)
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return bounded(docs).mapInArrow(clean, docs.schema)
