"""Composite operators and sources against plain NumPy and Python versions."""

import json
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from plyweave.functions import bits as B
from plyweave.functions import tokens as T
from plyweave.operators import codec, kv, linalg, nn
from plyweave.plans import catalogue, model
from plyweave.sources import dictionaries, tensors

D = "/root/testdata/sf0.001"


def numbers(df):
    return {r.id: np.array(r.embedding, "f8") for r in df.select(F.col("vec_id").alias("id"), "embedding").collect()}


@pytest.fixture(scope="module")
def small(spark):
    e = numbers(spark.read.parquet(f"{D}/embeddings.parquet"))
    w = {n: np.array([e[i * 60 + r] for r in range(m)]) for i, (n, m) in enumerate({"wq": 64, "wk": 32, "wv": 32, "wo": 64, "w_gate": 128, "w_up": 128}.items())}
    w["w_down"] = np.array([np.concatenate([e[2 * r], e[2 * r + 1]]) for r in range(64)])
    return w, np.array([e[i] for i in range(32)])


def norm(x):
    return x / np.sqrt((x * x).mean(-1, keepdims=True) + 1e-5)


def turned(x, pos):
    y = x.copy().reshape(len(x), -1, 16)
    a, b, t = y[:, :, :8].copy(), y[:, :, 8:].copy(), pos[:, None, None] * 10000.0 ** (-2.0 * np.arange(8) / 16)
    y[:, :, :8], y[:, :, 8:] = a * np.cos(t) - b * np.sin(t), a * np.sin(t) + b * np.cos(t)
    return y


def layer(w, x):
    pos = np.arange(len(x), dtype="f8")
    h = norm(x)
    q, k, v = turned(h @ w["wq"].T, pos), turned(h @ w["wk"].T, pos), (h @ w["wv"].T).reshape(len(x), 2, 16)
    out = np.zeros((len(x), 4, 16))
    for p in range(len(x)):
        for head in range(4):
            s = k[: p + 1, head // 2] @ q[p, head] / 4
            e = np.exp(s - s.max())
            out[p, head] = (e / e.sum()) @ v[: p + 1, head // 2]
    x = x + out.reshape(len(x), 64) @ w["wo"].T
    h = norm(x)
    g = h @ w["w_gate"].T
    return x + (g / (1 + np.exp(-g)) * (h @ w["w_up"].T)) @ w["w_down"].T


def followed(w, table, ids, steps, eos=None):
    ids = list(ids)
    for _ in range(steps):
        nxt = int(np.argmax(norm(layer(w, table[ids]))[-1] @ table.T))
        if nxt == eos:
            break
        ids.append(nxt)
    return ids


PROMPTS = {s: [(7 * s + 3 * p) % 32 for p in range(4)] for s in range(3)}


def test_layers(spark, small):
    w, table = small
    want = {s: layer(w, table[ids]) for s, ids in PROMPTS.items()}
    for r in catalogue.queries()["forward_one_layer"](spark, D).collect():
        assert r.y == pytest.approx(want[r.session][r.pos, r.col], abs=1e-4)
    other = {n: -x for n, x in w.items()}
    want = {s: layer(other, x) for s, x in want.items()}
    got = catalogue.queries()["forward_two_layers"](spark, D).collect()
    assert len(got) == 3 * 4 * 64
    for r in got:
        assert r.y == pytest.approx(want[r.session][r.pos, r.col], abs=1e-4)


def ids_of(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r.session, r.pos)):
        out.setdefault(r.session, []).append(r.token_id)
    return out


def test_generation_and_its_end(spark, small):
    w, table = small
    assert ids_of(catalogue.queries()["generate_k"](spark, D).collect()) == {s: followed(w, table, ids, 2) for s, ids in PROMPTS.items()}
    end = followed(w, table, PROMPTS[0], 1)[-1]
    got = ids_of(catalogue.queries()["generate_eos"](spark, D).collect())
    assert got == {s: followed(w, table, ids, 3, end) for s, ids in PROMPTS.items()} and got[0] == PROMPTS[0]


def test_turns(spark, small):
    """The begin id once, an end id after each answer."""
    w, table = small
    want = {}
    for s in range(3):
        ids = []
        for t in range(1 if s == 2 else 2):
            ids += [x for i in range(3) if (x := 1 if i == 0 else (5 * s + 3 * i + t) % 32) != 1 or i or not ids]
            for _ in range(2):
                nxt = followed(w, table, ids, 1)[-1]
                if nxt in (1, 2):
                    break
                ids.append(nxt)
            ids.append(2)
        want[s] = ids
    assert ids_of(catalogue.queries()["chat_turns"](spark, D).collect()) == want


def test_encoding_of_whole_texts(spark):
    """Every merge over the whole text in turn, without cutting it."""
    v, table = catalogue.dictionary(), T.byte_table()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{D}/documents.parquet").limit(40).collect()}
    docs |= {-1: None, -2: "", -3: "the thing thethe inging é the", -4: "t", -5: "h" * 1000 + "the" * 1000}
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string").coalesce(1)
    for merges in (catalogue.MERGES, [], [("a", "a"), ("aa", "a")]):
        vocab = dict(v)
        for a, b in merges:
            vocab.setdefault(a + b, len(vocab))
        got = {r.doc_id: list(r.ids) for r in df.select("doc_id", T.encode_udf(vocab, merges)("text").alias("ids")).collect()}
        assert got == {i: [vocab.get(p, 0) for p in T.merged([table[b] for b in (t or "").encode()], merges)] for i, t in docs.items()}


def test_pieces_back_to_bytes(spark):
    got = spark.createDataFrame([("▁the",), ("<0xC3>",), ("<0x41>b<0x",), ("a▁",), ("",)], "p string").select("p", T.piece_bytes(F.col("p")).alias("b")).collect()
    assert {r.p: bytes(r.b) for r in got} == {"▁the": b" the", "<0xC3>": b"\xc3", "<0x41>b<0x": b"Ab<0x", "a▁": b"a ", "": b""}
    ids = spark.createDataFrame([([0, 99, 1, 2],)], "ids array<int>")
    assert ids.select(T.decoded(F.col("ids"), {"Ġa": 0, "b": 1}, {2: "<|end|>"}).alias("t")).first().t == " ab<|end|>"
    pieces = spark.createDataFrame([("a",), ("zz",)], "token string")
    assert {r.token: r.token_id for r in T.with_ids(pieces, spark.createDataFrame([(5, "a")], "id int, token string")).collect()} == {"a": 5, "zz": 0}


def test_lanes(spark):
    x = spark.createDataFrame([(0, k, 1.0) for k in (1, 2, 128, 300)] + [(1, k, float("nan")) for k in range(3)] + [(2, 5, -1.0), (2, 3, 2.0)], "seq long, k long, x double")
    rank = lambda k: (int(f"{k % 256:08b}"[::-1], 2), k)
    assert {r.seq: r.idx for r in nn.argmax_lanes(x).collect()} == {0: min((1, 2, 128, 300), key=rank), 1: 0, 2: 3}


def test_half_floats(spark):
    every = np.arange(65536, dtype="u2").view("f2").astype("f8")
    got = spark.range(65536).select("id", B.from_fp16(F.col("id")).alias("v")).collect()
    assert all((np.isnan(r.v) and np.isnan(every[r.id])) or r.v == every[r.id] for r in got)


def test_product_by_shape(spark):
    rng = np.random.default_rng(3)
    a, x = rng.normal(size=(70, 130)), rng.normal(size=(130, 20))
    w = spark.createDataFrame([("t", r, k, float(a[r, k])) for r in range(70) for k in range(130)], "tensor string, r long, k long, v double")
    v = spark.createDataFrame([(s, k, float(x[k, s])) for s in range(20) for k in range(130)], "seq long, k long, x double")
    for mode in ("auto", "join", "blocked"):
        got = linalg.product(w, v, 20, 130, mode).collect()
        assert len(got) == 70 * 20 and all(abs(r.y - (a @ x)[r.r, r.seq]) < 1e-9 for r in got)
    assert linalg.matvec(w.limit(0), v).collect() == [] == linalg.gemm_blocked(w, v.limit(0)).collect()
    with pytest.raises(ValueError):
        linalg.product(w, v, 1, 1, "fast")


def test_settings(spark):
    from plyweave.plans.settings import setting

    assert setting(spark, "plyweave.product") == "auto" and setting(spark, "plyweave.context") == 8192
    spark.conf.set("plyweave.product", "fast")
    try:
        with pytest.raises(ValueError):
            setting(spark, "plyweave.product")
    finally:
        spark.conf.unset("plyweave.product")


def test_sessions_do_not_share_a_cache(spark):
    x = spark.createDataFrame([(s, 0, 0, d, float((s + 1) * 10**s * d)) for s in range(2) for d in range(4)], "session long, pos long, kv_head long, d long, x double")
    assert {r.scale for r in kv.quantise(x).collect()} == {3 / 127, 60 / 127}


def test_offsets_over_blocks(spark):
    bf = spark.range(9000).select(F.lit("t").alias("tensor"), F.col("id").alias("r"), F.lit(0).cast("long").alias("k"), (F.col("id") % 3).alias("grp"))
    got = {r.r: (r.n_escapes, r.start) for r in codec.row_offsets(bf, 1000).collect()}
    assert got == {r: (int(r % 3 == 0), (r + 2) // 3) for r in range(9000)}


def shard(path, tensors_):
    head, data = {"__metadata__": {"format": "pt"}}, b""
    for name, (kind, x) in tensors_.items():
        raw = (x.astype("f4").view("u4") >> 16).astype("<u2").tobytes() if kind == "BF16" else x.astype(tensors.KINDS[kind]).tobytes()
        head[name] = {"dtype": kind, "shape": list(x.shape), "data_offsets": [len(data), len(data) + len(raw)]}
        data += raw
    text = json.dumps(head).encode()
    path.write_bytes(struct.pack("<Q", len(text)) + text + data)


def test_model_from_safetensors(spark, tmp_path):
    rng = np.random.default_rng(4)
    bf = lambda *s: (rng.normal(size=s).astype("f4").view("u4") & np.uint32(0xFFFF0000)).view("f4")
    q, old, up, n = bf(4, 6), bf(4, 6), bf(3, 5), bf(6)
    shard(tmp_path / "a.safetensors", {"model.layers.0.self_attn.q_proj.weight": ("BF16", old), "model.layers.1.mlp.up_proj.weight": ("F32", up)})
    shard(tmp_path / "b.safetensors", {"model.layers.0.self_attn.q_proj.weight": ("BF16", q), "model.layers.0.input_layernorm.weight": ("F32", n), "other": ("F16", bf(2))})
    (tmp_path / "config.json").write_text('{"hidden_size": 6, "max_seq_len": 77}')
    rows = tensors.safetensors(spark, str(tmp_path)).collect()
    assert {(r["name"], r.r): list(r.vals) for r in rows}["model.layers.0.self_attn.q_proj.weight", 2] == pytest.approx(q[2].tolist())
    tensors.convert(spark, str(tmp_path), str(tmp_path / "out"))
    m = tensors.load_model(spark, str(tmp_path / "out"))
    got = {(r.tensor, r.layer, r.r, r.k): r.v for r in m["weights"].collect()}
    want = {("wq", 0, r, k): float(q[r, k]) for r in range(4) for k in range(6)} | {("w_up", 1, r, k): float(up[r, k]) for r in range(3) for k in range(5)}
    assert got == want | {("attn_norm", 0, 0, k): float(n[k]) for k in range(6)}
    c = m["config"].first()
    assert (c.n_embd, c.n_ff, c.n_ctx, c.n_head_kv, c.n_layer) == (6, 24, 77, 32, 32)


def test_raw_rows(spark, tmp_path):
    el = spark.createDataFrame([("w", r, k, float(r - k) / 4) for r in range(3) for k in range(5)], "tensor string, r long, k long, v float")
    tensors.save_raw(el, str(tmp_path / "raw"))
    got = {(r.tensor, r.r, r.k): r.bits for r in tensors.load_raw(spark, str(tmp_path / "raw")).collect()}
    assert got == {(r.tensor, r.r, r.k): r.bits for r in codec.with_bits(el).collect()}


def test_dictionaries(spark, tmp_path):
    text = {"model": {"vocab": {"a": 0, "b": 1, "Ġa": 2}, "merges": ["a b", "Ġ a"]}, "added_tokens": [{"id": 1, "content": "<s>", "special": True}, {"id": 9, "content": "<|end|>", "special": True}, {"id": 10, "content": "y", "special": True}, {"id": 11, "content": "zz"}]}
    at = tmp_path / "m"
    at.mkdir()
    (at / "tokenizer.json").write_text(json.dumps(text))
    vocab, merges = dictionaries.load(spark, str(at))
    want = {(0, "a"), (1, "b"), (2, "Ġa")}, {(0, "a", "b"), (1, "Ġ", "a")}
    assert ({tuple(r) for r in vocab.collect()}, {tuple(r) for r in merges.collect()}) == want
    string = lambda s: struct.pack("<H", len(s.encode())) + s.encode()
    (at / "vocab.bin").write_bytes(struct.pack("<iii", 3, 1, 2) + string("a") + string("b") + string("Ġa"))
    two = lambda a, b: struct.pack("<HH", len(a.encode()), len(b.encode())) + a.encode() + b.encode()
    (at / "merges.bin").write_bytes(struct.pack("<i", 2) + two("a", "b") + two("Ġ", "a"))
    vocab, merges = dictionaries.load(spark, str(at))
    assert ({tuple(r) for r in vocab.collect()}, {tuple(r) for r in merges.collect()}) == want
    assert dictionaries.from_binary(spark, str(at))[2].collect() == [(1, 2)]
    dictionaries.extract(spark, str(at / "tokenizer.json"), str(at))
    vocab, merges = dictionaries.load(spark, str(at))
    assert ({tuple(r) for r in vocab.collect()}, {tuple(r) for r in merges.collect()}) == want
    assert spark.read.parquet(f"{at}/special").collect() == [(9, "<|end|>")] and spark.read.parquet(f"{at}/ends").collect() == [(1, 128001)]
    pairs = spark.createDataFrame([(json.dumps({"model": {"merges": [["a", "b c"]]}}),)], "value string")
    assert dictionaries.merges_of(pairs).collect() == [(0, "a", "b c")]
    with pytest.raises(FileNotFoundError):
        dictionaries.load(spark, str(tmp_path / "none"))
