"""Every catalogue query against its DuckDB twin at the smallest size."""

import duckdb
import pytest

from plyweave.plans import catalogue

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in ("lineitem", "embeddings", "documents", "conversations", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    return con


#: Queries without SQL that run the model; test_goldens holds their results.
MODEL = {"forward_one_layer", "forward_two_layers", "generate_k", "generate_eos", "chat_turns"}


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - MODEL))
def test_query(spark, db, name):
    df = catalogue.queries()[name](spark, D)
    got = [tuple(map(str, r)) for r in df.collect()]
    assert got
    if name in catalogue.oracle_sql():
        rel = db.sql(catalogue.oracle_sql()[name])
        assert sorted(rel.columns) == sorted(df.columns)
        at = [list(rel.columns).index(c) for c in df.columns]
        num = lambda v: float(v) if v.replace(".", "", 1).lstrip("-").replace("e-", "", 1).replace("E-", "", 1).isdigit() else v
        assert sorted(tuple(map(num, r)) for r in got) == sorted(tuple(num(str(r[i])) for i in at) for r in rel.fetchall())


def test_whole_tables(spark, tmp_path):
    """Accents, controls, null and empty texts, and texts that hold special tokens, against plain versions."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_map = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in plain)}
    texts = [None, "", "the thing", "é the Éa 漢字 \U0001f600\t\r\n\x7f", "<|end|> a <|e b <|en", "<<|end|><|end|>", "x" * 50_000, "a<b>c\nd é"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    turns = [(i, 0, "user", t) for i, t in enumerate(texts)]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.doc_id: r.text for r in catalogue.queries()["detokenize_all"](spark, str(tmp_path)).collect()}
    assert got == {i: "".join(byte_map[b] for b in (t or "").encode()) for i, t in enumerate(texts)}

    def parts(t):
        out, at, own = [], 0, ""
        while at < len(t):
            if s := next((s for s in ("<|end|>", "<|e") if t.startswith(s, at)), ""):
                out, own = [*out, *([own] if own else []), s], ""
            own += "" if s else t[at]
            at += len(s) or 1
        return "~".join([*out, *([own] if own else [])])

    got = {r.conv_id: r.parts for r in catalogue.queries()["special_split"](spark, str(tmp_path)).collect()}
    assert got == {i: parts(f"user<|end|>{t or ''}<|end|><|e") for i, t in enumerate(texts)}
