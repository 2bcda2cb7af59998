"""Known answers, round trips and edge cases of the tensor operators."""

import math

import pytest
from pyspark.sql import functions as F

from plyweave.functions import bits as B
from plyweave.functions import tokens as T
from plyweave.operators import codec, kv, linalg, nn
from plyweave.sources import tensors

W = [[1, -0.5, 0.15625, 3], [0, -2, 1e-8, 0.0625]]


@pytest.fixture(scope="module")
def small(spark):
    cells = [("w", r, k, float(v)) for r, row in enumerate(W) for k, v in enumerate(row)]
    return spark.createDataFrame(cells, "tensor string, r long, k long, v float")


def test_rounding(spark):
    xs = [1.00390625, 1.01171875, -0.0, 3.4028235e38, float("inf"), 1e-40]
    got = spark.createDataFrame([(x,) for x in xs], "x float").select(B.to_bf16(F.col("x")).alias("b")).collect()
    assert [r.b for r in got] == [0x3F80, 0x3F82, 0x8000, 0x7F80, 0x7F80, 0x0001]


def test_pack(small):
    rows, patches = codec.encode(small)
    got = sorted((r.r, r.base_exp, r.sm.hex(), r.gr.hex()) for r in rows.collect())
    assert got == [(0, 113, "00802040", "defb"), (1, 113, "00802c00", "f0a0")]
    assert sorted((r.r, r.k, r.correct, r.wrong) for r in patches.collect()) == [(1, 0, 0x0000, 0x3880), (1, 2, 0x322C, 0x38AC)]
    groups = codec.grouped(codec.with_bits(small), codec.base_exponent(codec.with_bits(small)))
    assert sorted((r.r, r.start, r.n_escapes) for r in codec.row_offsets(groups).collect()) == [(0, 0, 0), (1, 0, 2)]


def test_matvec(spark, small):
    rows, patches = codec.encode(small)
    x = spark.createDataFrame([(0, k, v) for k, v in enumerate([1.0, 2.0, -1.0, 0.5])], "seq long, k long, x double")
    plain = linalg.matvec(codec.decoded(codec.unpacked(rows)), x)
    y = {r.r: r.y for r in linalg.patched(plain, linalg.patch_correction(patches, x, B.from_bf16)).collect()}
    assert {r.r: r.y for r in plain.collect()} == pytest.approx({0: 1.34375, 1: -3.968770980834961}, abs=1e-12)
    assert y == pytest.approx({0: 1.34375, 1: -3.9687500100117177}, abs=1e-12)
    assert {r.r: r.y for r in linalg.gemm_blocked(codec.decode(rows, patches), x, 2).collect()} == pytest.approx(y, abs=1e-12)


def test_every_pattern_comes_back(spark):
    bf = spark.range(65536).select(F.lit("t").alias("tensor"), F.expr("id div 255").alias("r"), (F.col("id") % 255).alias("k"), F.col("id").alias("bits"))
    bf = bf.withColumn("exp", B.exponent(F.col("bits")))
    for base in (-1, 0, 113, 240):
        groups = codec.grouped(bf, spark.createDataFrame([("t", base)], "tensor string, base_exp int"))
        back = codec.decode(codec.packed(groups), codec.escapes(groups)).select("tensor", "r", "k", F.col("bits").alias("back"))
        both = groups.join(back, ["tensor", "r", "k"])
        assert both.count() == 65536 and both.filter("bits <> back").count() == 0


def test_empty_and_zero_tensors(spark, small):
    zero = small.withColumn("v", F.lit(0.0).cast("float"))
    assert [r.base_exp for r in codec.base_exponent(codec.with_bits(zero)).collect()] == [-1]
    assert codec.base_exponent(codec.with_bits(small.limit(0))).collect() == []


def test_quantise(spark):
    x = spark.createDataFrame([(p, 0, d, v) for p, vs in enumerate([[0.1, -0.4, 0.25, 1.0], [0.0] * 4]) for d, v in enumerate(vs)], "pos long, kv_head long, d long, x double")
    got = sorted((r.pos, r.d, r.q, round(r.scale, 9)) for r in kv.quantise(x).collect())
    assert [g[2] for g in got] == [13, -51, 32, 127, 0, 0, 0, 0] and got[0][3] == 0.007874016 and got[4][3] == 0


def test_norm_and_activation(spark):
    x = spark.createDataFrame([(0, k, float(k + 1)) for k in range(4)], "seq long, k long, x double")
    y = nn.rms_norm(x).select("k", B.to_bf16(F.col("y")).alias("b")).collect()
    assert [hex(r.b) for r in sorted(y)] == ["0x3ebb", "0x3f3b", "0x3f8c", "0x3fbb"]
    up = spark.createDataFrame([(0, 0, 2.0)], "seq long, k long, x double")
    assert nn.swiglu(x.filter("k = 0"), up).first().y == pytest.approx(1.4621171572600098, abs=1e-7)


def test_argmax(spark):
    nan, inf = float("nan"), float("inf")
    rows = {0: [1.0, 3.0, 3.0], 1: [nan, 2.0], 2: [nan, nan], 3: [-inf, -inf], 4: [5.0, 5.0]}
    x = spark.createDataFrame([(s, k, v) for s, vs in rows.items() for k, v in enumerate(vs)], "seq long, k long, x double")
    assert {r.seq: r.idx for r in nn.argmax(x).collect()} == {0: 1, 1: 1, 2: 0, 3: 0, 4: 0}


def test_tiles_agree(spark):
    q = spark.createDataFrame([(0, 9, h, d, math.sin(h + d)) for h in range(2) for d in range(4)], "session long, pos long, head long, d long, x double")
    c = spark.createDataFrame([(0, t, 0, d, math.cos(t * d + t)) for t in range(12) for d in range(4)], "session long, t long, kv_head long, d long, x double")
    a = {(r.head, r.d): r.o for r in nn.attention(q, c, c, 4, 2).collect()}
    for tile in (1, 3, 128):
        assert {(r.head, r.d): r.o for r in nn.flash_attention(q, c, c, 4, 2, tile).collect()} == pytest.approx(a)


def test_merges():
    assert T.merged(list("abcd"), [("b", "c"), ("abc", "d"), ("a", "bc")]) == ["abc", "d"]
    assert T.merged(list("aaa"), [("a", "a")]) == ["aa", "a"] and T.merged(list("aaaa"), [("a", "a")]) == ["aa", "aa"]


def test_shift():
    assert kv.shifted(101, 10, 120, 0) == (61, 50) and kv.shifted(100, 10, 8192, 0) == (110, 0)


def test_files(spark, small, tmp_path):
    tensors.save_packed(small, str(tmp_path / "t"))
    back = codec.decode(*tensors.load_packed(spark, str(tmp_path / "t")))
    assert {(r.r, r.k): r.bits for r in back.collect()}[1, 2] == 0x322C
    (tmp_path / "config.json").write_text('{"dim": 64, "num_attention_heads": 4}')
    c = tensors.model_config(spark, str(tmp_path / "config.json")).first()
    assert (c.n_embd, c.n_head, c.n_head_kv, c.n_vocab) == (64, 4, 4, 32000)
    (tmp_path / "w.bin").write_bytes(bytes([0x80, 0x3F, 0x00, 0xBF]))
    assert [r.bits for r in tensors.bf16_values(tensors.binaries(spark, str(tmp_path / "w.bin"))).orderBy("i").collect()] == [0x3F80, 0xBF00]
