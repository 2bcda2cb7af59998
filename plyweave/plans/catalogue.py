"""The tensor operators as queries over the test tables, each with its DuckDB twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import bits as B
from ..functions import tokens as T
from ..operators import codec, kv, linalg, nn
from ..sources import dictionaries
from ..streaming import chat
from . import model
from .settings import setting

QUERIES, SQL = {}, {}


def query(sql=None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def read(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


def elements(spark, d):
    e = read(spark, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("k", "v"))
    return e.select(F.lit("E").alias("tensor"), F.col("vec_id").alias("r"), F.col("k").cast("long").alias("k"), "v")


def discounts(spark, d):
    own = read(spark, d, "lineitem").select(F.lit("L").alias("tensor"), F.col("l_orderkey").alias("r"), F.col("l_linenumber").cast("long").alias("k"), F.col("l_discount").cast("float").alias("v"))
    return own.groupBy("tensor", "r", "k").agg(F.min("v").alias("v"))


def groups(els):
    bf = codec.with_bits(els)
    return codec.grouped(bf, codec.base_exponent(bf))


def cells(els):
    return codec.cells(groups(els))


def tensors(spark, d):
    """The embeddings as two tensors of different exponents: gate, and up, which is 0.37 of it."""
    both = F.explode(F.array(F.struct(F.lit("gate").alias("t"), F.lit(1.0).cast("float").alias("f")), F.struct(F.lit("up").alias("t"), F.lit(0.37).cast("float").alias("f"))))
    return elements(spark, d).withColumn("x", both).select(F.col("x.t").alias("tensor"), "r", "k", (F.col("v") * F.col("x.f")).cast("float").alias("v"))


def vectors(spark, d, n=1):
    """seq, k, x: the n vectors of least id."""
    e = read(spark, d, "embeddings").orderBy("vec_id").limit(n)
    return e.select(F.col("vec_id").alias("seq"), F.posexplode("embedding").alias("k", "x")).select("seq", F.col("k").cast("long").alias("k"), F.col("x").cast("double").alias("x"))


def rows(spark, d):
    return elements(spark, d).select(F.col("r").alias("seq"), "k", F.col("v").cast("double").alias("x"))


def r4(c, digits=4):
    """Rounded, and -0.0 as 0.0."""
    return F.round(c, digits) + F.lit(0.0)


# What the SQL twins share. bits: of the rounded bfloat16; val(b): its value.
_E = "e AS (SELECT 'E' AS tensor, vec_id AS r, i - 1 AS k, embedding[i]::FLOAT AS v FROM embeddings, unnest(range(1, 65)) t(i))"
_L = "e AS (SELECT 'L' AS tensor, l_orderkey AS r, l_linenumber::BIGINT AS k, min(l_discount::FLOAT) AS v FROM lineitem GROUP BY ALL)"
_BF = """u AS (SELECT *, (v::BIT)::UINTEGER::BIGINT AS u FROM e),
bf AS (SELECT tensor, r, k, v, ((u + 32767 + ((u >> 16) & 1)) >> 16) & 65535 AS bits FROM u),
hist AS (SELECT s.exp, coalesce(n, 0) AS n FROM unnest(range(0, 256)) s(exp) LEFT JOIN (SELECT (bits >> 7) & 255 AS exp, count(*) AS n FROM bf GROUP BY 1) h USING (exp)),
win AS (SELECT exp, sum(n) OVER (ORDER BY exp ROWS BETWEEN CURRENT ROW AND 14 FOLLOWING) AS covered, sum(n) OVER () AS n FROM hist),
base AS (SELECT exp - 1 AS base_exp, covered, n FROM win WHERE exp <= 241 ORDER BY covered DESC, exp LIMIT 1),
g AS (SELECT bf.*, base_exp, CASE WHEN ((bits >> 7) & 255) - base_exp BETWEEN 1 AND 15 THEN ((bits >> 7) & 255) - base_exp ELSE 0 END AS grp FROM bf, base),
p AS (SELECT tensor, r, k, bits AS correct, ((bits >> 15) << 15) | (base_exp << 7) | (bits & 127) AS wrong FROM g WHERE grp = 0),
x1 AS (SELECT vec_id AS seq, i - 1 AS k, embedding[i]::DOUBLE AS x FROM (SELECT * FROM embeddings ORDER BY vec_id LIMIT 8), unnest(range(1, 65)) t(i))"""


def _val(b):
    return f"(CASE WHEN ({b}) >> 15 = 1 THEN -1.0 ELSE 1.0 END * CASE WHEN (({b}) >> 7) & 255 = 0 THEN (({b}) & 127) * pow(2.0::DOUBLE, -133) ELSE (128 + (({b}) & 127)) * pow(2.0::DOUBLE, (({b}) >> 7 & 255) - 134) END)"


_PLAIN = "((bits >> 15) << 15) | ((base_exp + grp) << 7) | (bits & 127)"


def _sql(tail, source=_E):
    return f"WITH {source}, {_BF} {tail}"


@query(_sql("SELECT r AS vec_id, k AS col, bits, bits >> 15 AS sign, (bits >> 7) & 255 AS exp, bits & 127 AS mant FROM bf"))
def bf16_bits(spark, d):
    b = F.col("bits")
    return codec.with_bits(elements(spark, d)).select(F.col("r").alias("vec_id"), F.col("k").alias("col"), "bits", B.sign(b).alias("sign"), "exp", B.mantissa(b).alias("mant"))


@query(_sql("SELECT exp, n FROM hist"))
def exp_hist(spark, d):
    return codec.exponent_histogram(codec.with_bits(elements(spark, d))).drop("tensor")


@query(_sql("SELECT exp, n FROM hist", _L))
def exp_hist_discount(spark, d):
    return codec.exponent_histogram(codec.with_bits(discounts(spark, d))).drop("tensor")


@query(_sql("SELECT base_exp, covered::BIGINT AS covered, n::BIGINT AS n FROM base"))
def base_exp(spark, d):
    return codec.base_exponent(codec.with_bits(elements(spark, d))).drop("tensor")


@query(_sql("SELECT base_exp, covered::BIGINT AS covered, n::BIGINT AS n FROM base", _L))
def base_exp_discount(spark, d):
    return codec.base_exponent(codec.with_bits(discounts(spark, d))).drop("tensor")


@query(_sql("SELECT r AS vec_id, k AS col, grp FROM g"))
def exponent_groups(spark, d):
    return groups(elements(spark, d)).select(F.col("r").alias("vec_id"), F.col("k").alias("col"), "grp")


@query(_sql("SELECT r AS vec_id, string_agg(printf('%02X', ((bits >> 15) << 7) | (bits & 127)), '' ORDER BY k) AS sm_hex, (SELECT string_agg(printf('%02X', a.grp + 16 * b.grp), '' ORDER BY a.k) FROM g a JOIN g b ON a.r = b.r AND b.k = a.k + 1 WHERE a.k % 2 = 0 AND a.r = g.r) AS gr_hex FROM g GROUP BY r"))
def pack_hex(spark, d):
    return codec.packed(groups(elements(spark, d))).select(F.col("r").alias("vec_id"), F.hex("sm").alias("sm_hex"), F.hex("gr").alias("gr_hex"))


@query(_sql("SELECT r AS row, sum(c) OVER (ORDER BY r) - c AS offset_start, c AS n_escapes FROM (SELECT r, count(*) FILTER (grp = 0) AS c FROM g GROUP BY r)"))
def csr_offsets(spark, d):
    return codec.row_offsets(groups(elements(spark, d))).select(F.col("r").alias("row"), F.col("start").alias("offset_start"), "n_escapes")


@query(_sql("SELECT r AS row, k AS col, correct, wrong FROM p"))
def patches(spark, d):
    return codec.escapes(groups(elements(spark, d))).select(F.col("r").alias("row"), F.col("k").alias("col"), "correct", "wrong")


@query(_sql("SELECT r AS row, k AS col, correct, wrong FROM p", _L))
def patches_discount(spark, d):
    return codec.escapes(groups(discounts(spark, d))).select(F.col("r").alias("row"), F.col("k").alias("col"), "correct", "wrong")


@query(_sql("SELECT n, esc AS escapes, round(100.0 * esc / n, 4) AS escape_pct, bytes AS packed_bytes, round(2.0 * n / bytes, 4) AS ratio FROM (SELECT *, n + (n + 1) // 2 + 4 * (m + 1) + 8 * esc AS bytes FROM (SELECT count(*) AS n, count(*) FILTER (grp = 0) AS esc, count(DISTINCT r) AS m FROM g))"))
def codec_stats(spark, d):
    return codec.statistics(groups(elements(spark, d))).drop("tensor")


@query(_sql(f"SELECT base_exp, count(*) AS n, count(*) FILTER (grp = 0) AS n_escapes, count(*) FILTER (bits <> CASE WHEN grp = 0 THEN bits ELSE {_PLAIN} END) AS n_mismatch FROM g GROUP BY base_exp"))
def codec_roundtrip(spark, d):
    g = groups(elements(spark, d))
    back = codec.decode(codec.packed(g), codec.escapes(g)).select("tensor", "r", "k", F.col("bits").alias("back"))
    return g.join(back, ["tensor", "r", "k"]).groupBy("base_exp").agg(F.count("*").alias("n"), F.count_if(F.col("grp") == 0).alias("n_escapes"), F.count_if(F.col("bits") != F.col("back")).alias("n_mismatch"))


@query(_sql(f"SELECT r AS vec_id, k AS col, round({_val('bits')}, 8) + 0.0 AS value FROM g"))
def decode_exact(spark, d):
    return codec.decoded(cells(elements(spark, d))).select(F.col("r").alias("vec_id"), F.col("k").alias("col"), r4(F.col("v"), 8).alias("value"))


@query(_sql(f"SELECT r AS vec_id, k AS col, round({_val(_PLAIN)}, 8) + 0.0 AS value FROM g"))
def decode_unpatched(spark, d):
    return codec.decoded(cells(elements(spark, d)).drop("correct")).select(F.col("r").alias("vec_id"), F.col("k").alias("col"), r4(F.col("v"), 8).alias("value"))


_CORR = f"SELECT seq, r, sum(({_val('correct')} - {_val('wrong')}) * x) AS c FROM p JOIN x1 USING (k)"


@query(_sql(f"SELECT r AS row, round(c, 6) + 0.0 AS correction FROM ({_CORR} WHERE seq = (SELECT min(seq) FROM x1) GROUP BY ALL)"))
def patch_correction(spark, d):
    c = linalg.patch_correction(codec.escapes(groups(elements(spark, d))), vectors(spark, d), B.from_bf16)
    return c.select(F.col("r").alias("row"), r4(F.col("correction"), 6).alias("correction"))


@query(_sql(f"SELECT seq, r AS row, round(c, 6) + 0.0 AS correction FROM ({_CORR} GROUP BY ALL)"))
def patch_multi(spark, d):
    c = linalg.patch_correction(codec.escapes(groups(elements(spark, d))), vectors(spark, d, 8), B.from_bf16)
    return c.select("seq", F.col("r").alias("row"), r4(F.col("correction"), 6).alias("correction"))


@query(_sql("SELECT r AS row, lane, n, (sum(n) OVER (PARTITION BY r ORDER BY lane) - n)::BIGINT AS prefix FROM (SELECT r, k % 256 AS lane, count(*) AS n FROM p GROUP BY ALL)", _L))
def lane_prefix(spark, d):
    return codec.lane_prefix(codec.escapes(groups(discounts(spark, d)))).select(F.col("r").alias("row"), "lane", "n", "prefix")


@query(_sql("SELECT DISTINCT r AS row FROM p", _L))
def nonempty_rows(spark, d):
    return codec.escapes(groups(discounts(spark, d))).select(F.col("r").alias("row")).distinct()


def exact(spark, d):
    return codec.decoded(cells(elements(spark, d)))


def _mv(n, b="bits"):
    return f"SELECT seq, r AS row, round(sum({_val(b)} * x), 4) + 0.0 AS y FROM g JOIN (SELECT * FROM x1 WHERE seq IN (SELECT DISTINCT seq FROM x1 ORDER BY seq LIMIT {n})) USING (k) GROUP BY seq, r"


def _y(df, *names):
    return df.select(*names, F.col("r").alias("row"), r4(F.col("y")).alias("y"))


@query(_sql(f"SELECT row, y FROM ({_mv(1, _PLAIN)})"))
def matvec_unpatched(spark, d):
    return _y(linalg.matvec(codec.decoded(cells(elements(spark, d)).drop("correct")), vectors(spark, d)))


@query(_sql(f"SELECT row, y FROM ({_mv(1)})"))
def matvec(spark, d):
    return _y(linalg.matvec(exact(spark, d), vectors(spark, d)))


@query(_sql(f"SELECT row, y FROM ({_mv(1)})"))
def matvec_patched(spark, d):
    g, x = groups(elements(spark, d)), vectors(spark, d)
    y = linalg.matvec(codec.decoded(codec.cells(g).drop("correct")), x)
    return _y(linalg.patched(y, linalg.patch_correction(codec.escapes(g), x, B.from_bf16)))


@query(_sql(f"SELECT row // 2 AS row, max(y) FILTER (row % 2 = 0) AS gate, max(y) FILTER (row % 2 = 1) AS up FROM ({_mv(1)}) GROUP BY 1"))
def dual_matvec(spark, d):
    y = _y(linalg.matvec(exact(spark, d), vectors(spark, d)))
    pick = lambda i: F.max(F.when(F.col("row") % 2 == i, F.col("y")))
    return y.groupBy(F.expr("row div 2").alias("row")).agg(pick(0).alias("gate"), pick(1).alias("up"))


@query(_sql(f"SELECT seq AS seq_id, row, y FROM ({_mv(4)})"))
def gemm_batch4(spark, d):
    return _y(linalg.matvec(exact(spark, d), vectors(spark, d, 4)), F.col("seq").alias("seq_id"))


@query(_sql(f"SELECT seq AS seq_id, row, y FROM ({_mv(8)})"))
def gemm_batch8(spark, d):
    return _y(linalg.matvec(exact(spark, d), vectors(spark, d, 8)), F.col("seq").alias("seq_id"))


@query(_sql(f"SELECT seq AS seq_id, row, y FROM ({_mv(8)})"))
def gemm_blocked(spark, d):
    return _y(linalg.gemm_blocked(exact(spark, d), vectors(spark, d, 8)), F.col("seq").alias("seq_id"))


@query(_sql(f"SELECT seq AS seq_id, row, y FROM ({_mv(32)})").replace("LIMIT 8)", "LIMIT 32)"))
def gemm_auto(spark, d):
    """The plan is chosen by the shape: 32 sequences and rows of 64 are multiplied by blocks."""
    return _y(linalg.product(exact(spark, d), vectors(spark, d, 32), 32, 64, setting(spark, "plyweave.product")), F.col("seq").alias("seq_id"))


# The same for two tensors in one job, each with a base exponent of its own.
_TWO = """e AS (SELECT t.tensor, vec_id AS r, i - 1 AS k, (embedding[i]::FLOAT * t.f)::FLOAT AS v FROM embeddings, unnest(range(1, 65)) q(i), (VALUES ('gate', 1.0::FLOAT), ('up', 0.37::FLOAT)) t(tensor, f)),
u AS (SELECT *, (v::BIT)::UINTEGER::BIGINT AS u FROM e),
bf AS (SELECT tensor, r, k, ((u + 32767 + ((u >> 16) & 1)) >> 16) & 65535 AS bits FROM u),
hist AS (SELECT n.tensor, s.exp, coalesce(h.n, 0) AS n FROM (VALUES ('gate'), ('up')) n(tensor) CROSS JOIN unnest(range(0, 256)) s(exp) LEFT JOIN (SELECT tensor, (bits >> 7) & 255 AS exp, count(*) AS n FROM bf GROUP BY ALL) h ON h.tensor = n.tensor AND h.exp = s.exp),
win AS (SELECT tensor, exp, sum(n) OVER (PARTITION BY tensor ORDER BY exp ROWS BETWEEN CURRENT ROW AND 14 FOLLOWING) AS covered FROM hist),
base AS (SELECT tensor, exp - 1 AS base_exp FROM win WHERE exp <= 241 QUALIFY row_number() OVER (PARTITION BY tensor ORDER BY covered DESC, exp) = 1),
g AS (SELECT bf.*, base_exp, CASE WHEN ((bits >> 7) & 255) - base_exp BETWEEN 1 AND 15 THEN ((bits >> 7) & 255) - base_exp ELSE 0 END AS grp FROM bf JOIN base USING (tensor)),
p AS (SELECT tensor, r, k, bits AS correct, ((bits >> 15) << 15) | (base_exp << 7) | (bits & 127) AS wrong FROM g WHERE grp = 0),
x1 AS (SELECT vec_id AS seq, i - 1 AS k, embedding[i]::DOUBLE AS x FROM (SELECT * FROM embeddings ORDER BY vec_id LIMIT 8), unnest(range(1, 65)) t(i))"""


@query(f"WITH {_TWO} SELECT seq AS seq_id, r AS row, round(sum({_val('bits')} * x) FILTER (tensor = 'gate'), 4) + 0.0 AS gate, round(sum({_val('bits')} * x) FILTER (tensor = 'up'), 4) + 0.0 AS up FROM g JOIN x1 USING (k) GROUP BY ALL")
def dual_tensors(spark, d):
    """Two tensors of one input in one job."""
    y = linalg.matvec(codec.decoded(cells(tensors(spark, d))), vectors(spark, d, 8))
    pick = lambda t: r4(F.max(F.when(F.col("tensor") == t, F.col("y"))))
    return y.groupBy(F.col("seq").alias("seq_id"), F.col("r").alias("row")).agg(pick("gate").alias("gate"), pick("up").alias("up"))


@query(f"WITH {_TWO} SELECT tensor, seq, r AS row, round(sum(({_val('correct')} - {_val('wrong')}) * x), 6) + 0.0 AS correction FROM p JOIN x1 USING (k) GROUP BY tensor, seq, r")
def patch_tensors(spark, d):
    """The patches of two tensors in one job."""
    c = linalg.patch_correction(codec.escapes(groups(tensors(spark, d))), vectors(spark, d, 8), B.from_bf16)
    return c.select("tensor", "seq", F.col("r").alias("row"), r4(F.col("correction"), 6).alias("correction"))


@query(f"WITH {_TWO} SELECT tensor, vec_id, col, value FROM (SELECT tensor, r AS vec_id, k AS col, round({_val('bits')}, 8) + 0.0 AS value FROM g)")
def decode_tensors(spark, d):
    return codec.decoded(cells(tensors(spark, d))).select("tensor", F.col("r").alias("vec_id"), F.col("k").alias("col"), r4(F.col("v"), 8).alias("value"))


_X = "x AS (SELECT vec_id AS seq, i - 1 AS k, embedding[i]::DOUBLE AS x FROM embeddings, unnest(range(1, 65)) t(i)), n AS (SELECT max(seq) + 1 AS n FROM x), o AS (SELECT (seq + 1) % n.n AS seq, k, x AS b FROM x, n)"


def other(spark, d):
    """Each vector under the next one's id."""
    x = rows(spark, d)
    n = read(spark, d, "embeddings").agg((F.max("vec_id") + 1).alias("n")).scalar()
    return x.withColumn("seq", (F.col("seq") + 1) % n)


@query(f"WITH {_X} SELECT seq AS seq_id, k AS col, round(x + b, 4) + 0.0 AS y FROM x JOIN o USING (seq, k)")
def residual_add(spark, d):
    return linalg.residual_add(rows(spark, d), other(spark, d)).select(F.col("seq").alias("seq_id"), F.col("k").alias("col"), r4(F.col("y")).alias("y"))


_NORM = "round({0} / sqrt(sum({0} * {0}) OVER (PARTITION BY seq) / 64 + 1e-5), 4) + 0.0"


@query(f"WITH {_X} SELECT seq AS vec_id, k AS col, {_NORM.format('x')} AS y FROM x")
def rmsnorm(spark, d):
    return nn.rms_norm(rows(spark, d)).select(F.col("seq").alias("vec_id"), F.col("k").alias("col"), r4(F.col("y")).alias("y"))


@query(f"WITH {_X}, s AS (SELECT seq, k, x + b AS x FROM x JOIN o USING (seq, k)) SELECT seq AS vec_id, k AS col, round(x, 4) + 0.0 AS total, {_NORM.format('x')} AS y FROM s")
def add_rmsnorm(spark, d):
    return nn.add_rms_norm(rows(spark, d), other(spark, d)).select(F.col("seq").alias("vec_id"), F.col("k").alias("col"), r4(F.col("total")).alias("total"), r4(F.col("y")).alias("y"))


@query(f"WITH {_X} SELECT seq AS vec_id, k AS col, round(x / (1 + exp(-x)) * b, 4) + 0.0 AS y FROM x JOIN o USING (seq, k)")
def swiglu(spark, d):
    return nn.swiglu(rows(spark, d), other(spark, d)).select(F.col("seq").alias("vec_id"), F.col("k").alias("col"), r4(F.col("y")).alias("y"))


@query(f"WITH {_X}, y AS (SELECT seq, k, ((x / (1 + exp(-x)) * b)::FLOAT::BIT)::UINTEGER::BIGINT AS u FROM x JOIN o USING (seq, k)) SELECT seq AS vec_id, k AS col, ((u + 32767 + ((u >> 16) & 1)) >> 16) & 65535 AS bits FROM y")
def swiglu_bf16(spark, d):
    return nn.swiglu_bf16(rows(spark, d), other(spark, d)).select(F.col("seq").alias("vec_id"), F.col("k").alias("col"), "bits")


@query(f"WITH {_X}, t AS (SELECT conv_id, turn AS pos, length(text) % 600 AS id FROM conversations) SELECT conv_id, pos, i AS col, round(coalesce(x, 0), 4) + 0.0 AS value FROM t, unnest(range(0, 64)) q(i) LEFT JOIN x ON seq = id AND k = i")
def embed_lookup(spark, d):
    t = read(spark, d, "conversations").select(F.col("conv_id").alias("seq"), F.col("turn").alias("pos"), (F.length("text") % 600).cast("long").alias("token_id"))
    return nn.embed_lookup(t, rows(spark, d).withColumnRenamed("seq", "id"), 64).select(F.col("seq").alias("conv_id"), "pos", F.col("k").cast("long").alias("col"), r4(F.col("x")).alias("value"))


@query("SELECT d, round(pow(10000.0::DOUBLE, -2.0 * d / 16), 8) AS freq FROM unnest(range(0, 8)) t(d)")
def rope_freqs(spark, d):
    return spark.range(8).select(F.col("id").alias("d"), F.round(nn.rope_frequency(F.col("id"), 16), 8).alias("freq"))


@query(f"WITH {_X}, h AS (SELECT seq, k // 16 AS head, k % 16 AS d, x FROM x), a AS (SELECT l.seq, l.head, l.d, l.x AS a, u.x AS b, (l.seq % 100) * pow(10000.0::DOUBLE, -2.0 * l.d / 16) AS t FROM h l JOIN h u ON l.seq = u.seq AND l.head = u.head AND u.d = l.d + 8) SELECT seq AS vec_id, head * 16 + d AS col, round(a * cos(t) - b * sin(t), 4) + 0.0 AS value FROM a UNION ALL SELECT seq, head * 16 + d + 8, round(a * sin(t) + b * cos(t), 4) + 0.0 FROM a")
def rope(spark, d):
    x = rows(spark, d).withColumn("pos", F.col("seq") % 100)
    return nn.rope(x, 16).select(F.col("seq").alias("vec_id"), F.col("k").alias("col"), r4(F.col("y")).alias("value"))


_Q = f"{_X}, m AS (SELECT seq AS pos, k // 16 AS kv_head, k % 16 AS d, x, max(abs(x)) OVER (PARTITION BY seq, k // 16) AS top FROM x), q AS (SELECT *, greatest(least(CASE WHEN top = 0 THEN 0 ELSE round_even(x * 127.0 / top, 0) END, 127), -127)::INT AS q, top / 127.0 AS scale FROM m)"


def kv_cells(spark, d):
    return rows(spark, d).select(F.col("seq").alias("pos"), F.expr("k div 16").alias("kv_head"), (F.col("k") % 16).alias("d"), "x")


@query(f"WITH {_Q} SELECT pos, kv_head, d, q, round(scale, 8) AS scale FROM q")
def kv_quant(spark, d):
    return kv.quantise(kv_cells(spark, d)).select("pos", "kv_head", "d", "q", F.round("scale", 8).alias("scale"))


@query(f"WITH {_Q} SELECT pos, kv_head, round(max(abs(q * scale - x) / scale), 4) AS max_err FROM q GROUP BY ALL")
def kv_dequant_error(spark, d):
    q = kv.dequantised(kv.quantise(kv_cells(spark, d)))
    return q.groupBy("pos", "kv_head").agg(F.round(F.max(F.abs(F.col("y") - F.col("x")) / F.col("scale")), 4).alias("max_err"))


_S = "z AS (SELECT label::BIGINT AS session, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS pos, embedding FROM embeddings), x AS (SELECT session, pos, i - 1 AS k, embedding[i]::DOUBLE AS x FROM z, unnest(range(1, 65)) t(i))"
_STORE = "m AS (SELECT session, pos, k // 16 AS kv_head, k % 16 AS d, x, max(abs(x)) OVER (PARTITION BY session, pos, k // 16) AS top FROM {0}) SELECT session, pos, kv_head, d, greatest(least(CASE WHEN top = 0 THEN 0 ELSE round_even(x * 127.0 / top, 0) END, 127), -127)::INT AS q, round(top / 127.0, 8) AS scale FROM m"


def session_cells(spark, d):
    """session, pos, k, x: each label's embeddings in order, as the tokens of a session."""
    from pyspark.sql import Window

    e = read(spark, d, "embeddings").withColumn("pos", (F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1).cast("long"))
    return e.select(F.col("label").cast("long").alias("session"), "pos", F.posexplode("embedding").alias("k", "x")).select("session", "pos", F.col("k").cast("long").alias("k"), F.col("x").cast("double").alias("x"))


@query(f"WITH {_S}, {_STORE.format('x')}")
def kv_store_sessions(spark, d):
    """Sessions with positions in common, each with rows of its own."""
    c = session_cells(spark, d).withColumn("kv_head", F.expr("k div 16")).withColumn("d", F.col("k") % 16)
    return kv.quantise(c).select("session", "pos", "kv_head", "d", "q", F.round("scale", 8).alias("scale"))


@query(f"WITH {_S}, h AS (SELECT session, pos, k // 16 AS head, k % 16 AS d, x FROM x), a AS (SELECT l.session, l.pos, l.head, l.d, l.x AS a, u.x AS b, l.pos * pow(10000.0::DOUBLE, -2.0 * l.d / 16) AS t FROM h l JOIN h u ON l.session = u.session AND l.pos = u.pos AND l.head = u.head AND u.d = l.d + 8), r AS (SELECT session, pos, head * 16 + d AS k, a * cos(t) - b * sin(t) AS x FROM a UNION ALL SELECT session, pos, head * 16 + d + 8, a * sin(t) + b * cos(t) FROM a), {_STORE.format('r')}")
def rope_store_kv(spark, d):
    """Keys rotated by position, then stored."""
    return kv.rotated_store(session_cells(spark, d), 16).select("session", "pos", "kv_head", "d", "q", F.round("scale", 8).alias("scale"))


def turns(spark, d):
    return read(spark, d, "conversations").select("conv_id", "turn", (F.floor(F.length("text") / 4) + 1).cast("long").alias("n"))


_T = "t AS (SELECT conv_id, turn, length(text) // 4 + 1 AS n FROM conversations)"


@query(f"WITH {_T} SELECT conv_id, turn, (sum(n) OVER w - n)::BIGINT AS start_pos, (sum(n) OVER w)::BIGINT AS end_pos FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)")
def turn_positions(spark, d):
    return kv.turn_positions(turns(spark, d))


_SHIFT = f"WITH RECURSIVE {_T}, o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM t), f AS (SELECT conv_id, turn, i, n::BIGINT AS pos_after, 0::BIGINT AS discarded FROM o WHERE i = 1 UNION ALL SELECT o.conv_id, o.turn, o.i, (f.pos_after - CASE WHEN f.pos_after + o.n + 16 + 64 > 256 OR f.pos_after > 1024 THEN f.pos_after // 2 ELSE 0 END + o.n)::BIGINT, (CASE WHEN f.pos_after + o.n + 16 + 64 > 256 OR f.pos_after > 1024 THEN f.pos_after // 2 ELSE 0 END)::BIGINT FROM f JOIN o ON o.conv_id = f.conv_id AND o.i = f.i + 1) SELECT conv_id, turn, pos_after, discarded FROM f"


@query(_SHIFT)
def context_shift(spark, d):
    return kv.context_shift(turns(spark, d), 256, 16)


@query(_SHIFT)
def chat_state_stream(spark, d):
    src = read(spark, d, "conversations")
    path = f"{d}/conversations.parquet"
    feed = spark.readStream.schema(src.schema).parquet(path + "*")
    own = feed.select("conv_id", "turn", (F.floor(F.length("text") / 4) + 1).cast("long").alias("n"))
    return chat.drained(chat.context_shift_stream(own, 256, 16), "chat_state")


@query("SELECT 32 * 8 * 128 * 2 + 32 * 8 * 8 AS bytes_per_token, greatest(128, least(8192, 2000000000 // 67584)) AS max_seq")
def kv_capacity(spark, d):
    return kv.capacity(spark.createDataFrame([(32, 8, 128)], "n_layer long, n_head_kv long, head_dim long"), 2_000_000_000)


_A = "z AS (SELECT label AS session, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS t, embedding FROM embeddings), y AS (SELECT session, max(t) AS t FROM z GROUP BY 1), s AS (SELECT z.session, h.h AS head, z.t, sum(qz.embedding[h.h * 16 + d.d + 1]::DOUBLE * z.embedding[(h.h // 2) * 16 + d.d + 1]) / 4 AS s FROM z JOIN y ON y.session = z.session JOIN z qz ON qz.session = y.session AND qz.t = y.t, unnest(range(0, 4)) h(h), unnest(range(0, 16)) d(d) GROUP BY ALL), w AS (SELECT *, exp(s - max(s) OVER (PARTITION BY session, head)) AS e FROM s) SELECT session, head, d.d AS d, round(sum(e * z.embedding[32 + (head // 2) * 16 + d.d + 1]) / sum(e), 4) + 0.0 AS o FROM w JOIN z USING (session, t), unnest(range(0, 16)) d(d) GROUP BY ALL"
_A = "WITH " + _A


def sessions(spark, d):
    from pyspark.sql import Window

    e = read(spark, d, "embeddings").withColumn("t", (F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1).cast("long"))
    c = e.select(F.col("label").alias("session"), "t", F.posexplode("embedding").alias("i", "x")).withColumn("x", F.col("x").cast("double"))
    head, dim = F.expr("i div 16"), (F.col("i") % 16).cast("long").alias("d")
    last = c.groupBy("session").agg(F.max("t").alias("t"))
    q = c.join(last, ["session", "t"]).select("session", F.col("t").alias("pos"), head.alias("head"), dim, "x")
    keys = c.filter("i < 32").select("session", "t", head.alias("kv_head"), dim, "x")
    return q, keys, c.filter("i >= 32").select("session", "t", (head - 2).alias("kv_head"), dim, "x")


@query(_A)
def attention_naive(spark, d):
    return nn.attention(*sessions(spark, d), 16, 2).withColumn("o", r4(F.col("o")))


@query(_A)
def attention_flash(spark, d):
    return nn.flash_attention(*sessions(spark, d), 16, 2, 16).withColumn("o", r4(F.col("o")))


@query(f"WITH {_X} SELECT seq AS seq_id, k AS idx FROM (SELECT *, row_number() OVER (PARTITION BY seq ORDER BY x DESC, k) AS i FROM x WHERE NOT isnan(x)) WHERE i = 1")
def greedy_argmax(spark, d):
    return nn.argmax(rows(spark, d)).select(F.col("seq").alias("seq_id"), "idx")


@query("SELECT doc_id, i - 1 AS pos, ('0x' || substr(h, 2 * i - 1, 2))::INT AS byte FROM (SELECT doc_id, hex(encode(text)) AS h FROM documents), unnest(range(1, length(h) // 2 + 1)) t(i)")
def byte_tokens(spark, d):
    return T.byte_rows(read(spark, d, "documents"))


#: A small dictionary: bytes first, then what the merges make.
MERGES = [("t", "h"), ("th", "e"), ("i", "n"), ("e", "r"), ("o", "n"), ("a", "n"), ("r", "e"), ("\u0120", "the"), ("in", "g"), ("e", "n")]


def dictionary():
    v = {c: b for b, c in T.byte_table().items()}
    for left, right in MERGES:
        v.setdefault(left + right, len(v))
    return v


@query()
def bpe_encode(spark, d):
    return read(spark, d, "documents").select("doc_id", T.encode_udf(dictionary(), MERGES)("text").alias("ids"))


@query("SELECT doc_id, replace(replace(text, ' ', chr(288)), chr(10), chr(266)) AS text FROM documents WHERE regexp_matches(text, '^[ -~\\n]+$')")
def detokenize(spark, d):
    docs = read(spark, d, "documents").filter(F.col("text").rlike(r"^[ -~\n]+\z"))
    vocab = spark.createDataFrame([(i, t) for t, i in dictionary().items()], "id int, token string")
    tokens = docs.select("doc_id", F.posexplode(T.encode_udf(dictionary(), MERGES)("text")).alias("pos", "token_id"))
    return T.detokenize(tokens, vocab)


@query()
def detokenize_all(spark, d):
    """Every document; detokenize has the printable ASCII ones, for which a replacement in SQL can stand for the byte map."""
    ids = T.encode_udf(dictionary(), MERGES)("text")
    return read(spark, d, "documents").select("doc_id", T.joined(ids, dictionary()).alias("text"))


@query("SELECT doc_id, coalesce(text, '') AS text FROM documents")
def detokenize_bytes(spark, d):
    """Ids of whole texts back to bytes, token by token: every text as it was."""
    v = dictionary()
    return read(spark, d, "documents").select("doc_id", T.decoded(T.encode_udf(v, MERGES)("text"), v).alias("text"))


@query("SELECT doc_id, array_to_string([256] || list_transform(string_split(rtrim(regexp_replace(hex(encode(coalesce(text, ''))), '(..)', '\\1 ', 'g')), ' '), lambda h: CASE WHEN h = '' OR h >= '80' THEN 0 ELSE ('0x' || h)::INT END)[:CASE WHEN coalesce(text, '') = '' THEN 0 ELSE 10000000 END], ',') AS ids FROM documents")
def tokenize_bytes(spark, d):
    """Begin id first, then the bytes; those from 128 on are not in this vocabulary and get id 0."""
    v = {t: i for t, i in dictionary().items() if i < 128}
    return read(spark, d, "documents").select("doc_id", F.array_join(T.encode_udf(v, [], 256)("text").cast("array<string>"), ",").alias("ids"))


_JSON = '{"model": {"vocab": {"a": 0, "b": 1, "ab": 2}, "merges": ["a b"]}, "added_tokens": [{"id": 1, "content": "<s>", "special": true}, {"id": 2, "content": "</s>", "special": true}, {"id": 7, "content": "<|end|>", "special": true}, {"id": 8, "content": "x", "special": true}, {"id": 9, "content": "plain", "special": false}, {"id": 10, "content": "<|e", "special": true}]}'


@query(f"""SELECT (t->>'id')::INT AS id, t->>'content' AS text, (SELECT count(*) FROM conversations) AS n_turns FROM (SELECT unnest(json_extract('{_JSON}', '$.added_tokens[*]')) AS t) WHERE t->>'special' = 'true' AND (t->>'id')::INT > 2 AND length(t->>'content') > 1""")
def special_tokens(spark, d):
    """The special tokens of a tokenizer's JSON text, with the number of turns that they would be looked for in."""
    raw = spark.createDataFrame([(_JSON,)], "value string")
    n = read(spark, d, "conversations").agg(F.count("*").alias("n_turns"))
    return dictionaries.special_tokens(dictionaries.added_of(raw)).join(F.broadcast(n))


@query("SELECT conv_id, turn, list_aggregate(regexp_extract_all(role || '<|end|>' || text || '<|end|><|e', '(?s)<\\|end\\|>|<\\|e|[^<]+|<'), 'string_agg', '~') AS parts FROM conversations WHERE NOT contains(text, '<')")
def special_split(spark, d):
    """Every turn; the SQL has only those with a text that holds no '<', which is all of sf0.1."""
    c = read(spark, d, "conversations")
    text = F.concat(F.coalesce("role", F.lit("")), F.lit("<|end|>"), F.coalesce("text", F.lit("")), F.lit("<|end|><|e"))
    return c.select("conv_id", "turn", F.array_join(T.special_split(text, ["<|e", "<|end|>"]), "~").alias("parts"))


@query("SELECT conv_id, turn, CASE WHEN contains(text, '[INST]') OR contains(text, '<|') THEN text ELSE '[INST] ' || text || ' [/INST]' END AS prompt FROM conversations")
def prompt_template(spark, d):
    return read(spark, d, "conversations").select("conv_id", "turn", T.prompt_template(F.col("text")).alias("prompt"))


@query("SELECT conv_id, turn, regexp_replace(regexp_replace('[INST]  ' || text || ' [/INST]', '\\[/?INST\\]', '', 'g'), '^[ \\t\\r\\n]+', '') AS text FROM conversations")
def strip_markers(spark, d):
    text = F.concat(F.lit("[INST]  "), "text", F.lit(" [/INST]"))
    return read(spark, d, "conversations").select("conv_id", "turn", T.strip_markers(text).alias("text"))


@query("SELECT conv_id, count(*) AS turns, sum(length(text)) FILTER (role = 'user')::BIGINT AS n_prompt, sum(length(text)) FILTER (role = 'assistant')::BIGINT AS n_gen, round(coalesce(sum(length(text)) FILTER (role IN ('user', 'assistant')), 0) / (count(*) * 0.5), 4) AS tok_s FROM conversations GROUP BY conv_id")
def run_stats(spark, d):
    """Prompt and generated units by conversation, and the rate at half a second a turn: prefill is prorated, not timed."""
    n = lambda *r: F.sum(F.when(F.col("role").isin(*r), F.length("text")))
    rate = F.coalesce(n("user", "assistant"), F.lit(0)) / (F.count("*") * 0.5)
    return read(spark, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("turns"), n("user").alias("n_prompt"), n("assistant").alias("n_gen"), F.round(rate, 4).alias("tok_s"))


_PRINTED = "conv_id, turn, length(text) AS n, length(text) // 3 AS m, (length(text) // 3) / 4.0 AS s"


@query(f"SELECT conv_id, turn, n AS n_prompt, m AS n_gen, turn::BIGINT AS context, 4096::BIGINT AS max_context, round(s, 2)::DOUBLE AS seconds, CASE WHEN m > 0 THEN 4.0::DOUBLE END AS speed FROM (SELECT {_PRINTED} FROM conversations WHERE text IS NOT NULL)")
def stats_parse(spark, d):
    """The statistics that an interactive run prints for each turn, read back from their text."""
    n = F.length("text")
    m = F.expr("length(text) div 3")
    speed = F.when(m > 0, F.lit("Decode speed: 4.0 tok/s\n")).otherwise(F.lit(""))
    shown = F.concat(F.lit("\n--- Stats ---\nPrompt tokens: "), n, F.lit("\nGenerated tokens: "), m, F.lit("\nContext: "), "turn", F.lit(" / 4096 tokens\nTotal time: "), F.format_string("%.2f", m / F.lit(4.0)), F.lit(" s\n"), speed)
    own = read(spark, d, "conversations").filter("text is not null").select("conv_id", "turn", shown.alias("out"))
    return own.select("conv_id", "turn", *(c.alias(k) for k, c in T.stats_of(F.col("out")).items()))


@query("WITH t AS (SELECT conv_id, turn, role, length(text) AS n, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS pos FROM conversations) SELECT conv_id, turn, n AS n_gen, pos::BIGINT AS context, round(n / (0.02 * n + 0.1), 4) AS tok_s FROM t WHERE role = 'assistant' AND n > 0")
def interactive_stats(spark, d):
    """Each answer's units, the position after it, and the rate of its decoding alone, at 0.1 s and 0.02 s a unit."""
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    own = read(spark, d, "conversations").withColumn("n", F.length("text")).withColumn("context", F.sum("n").over(w))
    return own.filter("role = 'assistant' and n > 0").select("conv_id", "turn", F.col("n").alias("n_gen"), "context", F.round(F.col("n") / (0.02 * F.col("n") + 0.1), 4).alias("tok_s"))


@query("SELECT event_id // 10 AS step, event_type AS stage, round(sum(value), 4) AS ms, round(100 * sum(value) / sum(sum(value)) OVER (PARTITION BY event_id // 10), 4) AS pct FROM events GROUP BY event_id // 10, event_type")
def profile_stages(spark, d):
    """Time by stage for every ten steps, and its share of them."""
    from pyspark.sql import Window

    by = read(spark, d, "events").groupBy(F.expr("event_id div 10").alias("step"), F.col("event_type").alias("stage")).agg(F.sum("value").alias("t"))
    share = 100 * F.col("t") / F.sum("t").over(Window.partitionBy("step"))
    return by.select("step", "stage", F.round("t", 4).alias("ms"), F.round(share, 4).alias("pct"))


def small_model(spark, d):
    """Weights whose rows are embeddings in turn; ids below 32 are the vocabulary."""
    x = rows(spark, d)
    out = None
    for i, (name, m) in enumerate({"wq": 64, "wk": 32, "wv": 32, "wo": 64, "w_gate": 128, "w_up": 128}.items()):
        w = x.filter(f"seq >= {i * 60} and seq < {i * 60 + m}").select(F.lit(name).alias("tensor"), (F.col("seq") - i * 60).alias("r"), "k", F.col("x").alias("v"))
        out = w if out is None else out.union(w)
    down = x.filter("seq < 128").select(F.lit("w_down").alias("tensor"), F.expr("seq div 2").alias("r"), (F.col("k") + F.col("seq") % 2 * 64).alias("k"), F.col("x").alias("v"))
    return out.union(down), x.filter("seq < 32").withColumnRenamed("seq", "id")


def prompts(spark):
    return spark.createDataFrame([(s, p, (7 * s + 3 * p) % 32) for s in range(3) for p in range(4)], "session long, pos long, token_id long")


@query()
def forward_one_layer(spark, d):
    weights, table = small_model(spark, d)
    x = prompts(spark).join(table.withColumnRenamed("id", "token_id"), "token_id").select("session", "pos", "k", "x")
    return model.forward(weights, x).select("session", "pos", F.col("k").alias("col"), r4(F.col("x")).alias("y"))


@query()
def forward_two_layers(spark, d):
    weights, table = small_model(spark, d)
    both = weights.withColumn("layer", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("v", F.when(F.col("layer") == 1, -F.col("v")).otherwise(F.col("v")))
    x = prompts(spark).join(table.withColumnRenamed("id", "token_id"), "token_id").select("session", "pos", "k", "x")
    return model.forward_all(both, x, 2).select("session", "pos", F.col("k").alias("col"), r4(F.col("x")).alias("y"))


@query()
def generate_eos(spark, d):
    """Generation that ends a session at the end id, here the one that generate_k's first session begins with."""
    weights, table = small_model(spark, d)
    first = model.generate(weights, table, prompts(spark), 1).filter("session = 0").agg(F.max_by("token_id", "pos")).first()[0]
    return model.generate(weights, table, prompts(spark), 3, eos=first)


@query()
def chat_turns(spark, d):
    """Two sessions of two turns and one of one, answered turn by turn."""
    weights, table = small_model(spark, d)
    own = [(s, t, i, 1 if i == 0 else (5 * s + 3 * i + t) % 32) for s in range(3) for t in range(1 if s == 2 else 2) for i in range(3)]
    return model.converse(weights, table, spark.createDataFrame(own, "session long, turn long, i long, token_id long"), 2, 1, 2)


@query()
def generate_k(spark, d):
    weights, table = small_model(spark, d)
    return model.generate(weights, table, prompts(spark), 2)


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(SQL)
