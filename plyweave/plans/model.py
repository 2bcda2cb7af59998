"""A transformer layer and greedy generation, as plans over the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import linalg, nn

HEADS, KV_HEADS, HEAD_DIM = 4, 2, 16


def split_heads(x: DataFrame, dim: int) -> DataFrame:
    return x.select("*", F.expr(f"k div {dim}").alias("head"), (F.col("k") % dim).alias("d"))


def forward(weights: DataFrame, x: DataFrame) -> DataFrame:
    """One layer. x: session, pos, k, x, the embedded tokens of whole sessions; gives session, pos, k, x of the same shape.

    weights: tensor (wq wk wv wo w_gate w_up w_down), r, k, v. Every position attends to its own session up to itself.
    """
    seq = F.struct("session", "pos").alias("seq")
    h = x.select(seq, "k", "x")

    def product(names, y):
        return linalg.matvec(weights.filter(F.col("tensor").isin(*names)), y.withColumnRenamed("y", "x"), counted=False)

    one = lambda df, name: df.filter(F.col("tensor") == name).select("seq", F.col("r").alias("k"), F.col("y").alias("x"))
    qkv = product(["wq", "wk", "wv"], nn.rms_norm(h))
    turned = lambda n: nn.rope(one(qkv, n).select(F.col("seq.session").alias("seq"), F.col("seq.pos").alias("pos"), "k", "x"), HEAD_DIM)
    q = split_heads(turned("wq"), HEAD_DIM).select(F.col("seq").alias("session"), "pos", "head", "d", F.col("y").alias("x"))
    k = split_heads(turned("wk"), HEAD_DIM).select(F.col("seq").alias("session"), F.col("pos").alias("t"), F.col("head").alias("kv_head"), "d", F.col("y").alias("x"))
    v = split_heads(one(qkv, "wv"), HEAD_DIM).select(F.col("seq.session").alias("session"), F.col("seq.pos").alias("t"), F.col("head").alias("kv_head"), "d", "x")
    # Every position asks as a session of its own, with the keys of its session up to itself.
    ask = q.select(F.struct("session", "pos").alias("session"), "pos", "head", "d", "x")
    at = q.select("session", "pos").distinct()
    seen = lambda c: c.join(at, "session").filter("t <= pos").select(F.struct("session", "pos").alias("session"), "t", "kv_head", "d", "x")
    o = nn.attention(ask, seen(k), seen(v), HEAD_DIM, HEADS // KV_HEADS)
    o = o.select(F.col("session").alias("seq"), (F.col("head") * HEAD_DIM + F.col("d")).alias("k"), F.col("o").alias("x"))
    h = linalg.residual_add(h, one(product(["wo"], o), "wo")).withColumnRenamed("y", "x")
    gu = product(["w_gate", "w_up"], nn.rms_norm(h))
    f = nn.swiglu(one(gu, "w_gate"), one(gu, "w_up"))
    h = linalg.residual_add(h, one(product(["w_down"], f), "w_down"))
    return h.select(F.col("seq.session").alias("session"), F.col("seq.pos").alias("pos"), "k", F.col("y").alias("x"))


def forward_all(weights: DataFrame, x: DataFrame, layers: int) -> DataFrame:
    """All layers in turn, each cut from the plan of the one before. weights: as for forward, with layer."""
    for i in range(layers):
        x = forward(weights.filter(F.col("layer") == i).drop("layer"), x)
        if i + 1 < layers:
            x = x.checkpoint()
    return x


def next_token(weights: DataFrame, table: DataFrame, x: DataFrame, layers: int | None = None) -> DataFrame:
    """session, token_id: greedy, from the last position's logits over the table (id, k, x). layers: of weights with layer."""
    out = forward(weights, x) if layers is None else forward_all(weights, x, layers)
    last = out.groupBy("session").agg(F.max("pos").alias("pos"))
    h = out.join(last, ["session", "pos"]).select(F.col("session").alias("seq"), "k", "x")
    w = table.select(F.lit("out").alias("tensor"), F.col("id").alias("r"), "k", F.col("x").alias("v"))
    logits = linalg.matvec(w, nn.rms_norm(h).withColumnRenamed("y", "x"), counted=False)
    return nn.argmax(logits.select("seq", F.col("r").alias("k"), F.col("y").alias("x"))).select(F.col("seq").alias("session"), F.col("idx").alias("token_id"))


def generate(weights: DataFrame, table: DataFrame, prompt: DataFrame, steps: int, eos: int | tuple[int, ...] | None = None, layers: int | None = None) -> DataFrame:
    """session, pos, token_id: prompt and what follows it; each step is cut from the plan of the last one.

    A session whose next token is eos (or one of several) ends without it, whatever the others do; the loop ends when all
    have.
    """
    stops = () if eos is None else eos if isinstance(eos, tuple) else (eos,)
    tokens, ended = prompt, None
    for _ in range(steps):
        live = tokens if ended is None else tokens.join(ended, "session", "left_anti")
        x = live.join(table.withColumnRenamed("id", "token_id"), "token_id").select("session", "pos", "k", "x")
        ends = live.groupBy("session").agg((F.max("pos") + 1).alias("pos"))
        fresh = next_token(weights, table, x, layers).join(ends, "session").select("session", "pos", "token_id").checkpoint()
        if stops:
            over = fresh.filter(F.col("token_id").isin(*stops)).select("session")
            ended = (over if ended is None else ended.unionByName(over)).checkpoint()
            fresh = fresh.filter(~F.col("token_id").isin(*stops))
        if fresh.isEmpty():
            break
        tokens = tokens.unionByName(fresh).checkpoint()
    return tokens


def converse(weights: DataFrame, table: DataFrame, turns: DataFrame, steps: int, bos: int, eos: int, layers: int | None = None) -> DataFrame:
    """session, pos, token_id: turns (session, turn, i, token_id) in order, each followed by at most `steps` tokens and eos.

    The begin id is left out after a session's first turn; an answer ends before eos or bos. Sessions may have different
    turns; all that have a turn of one number are answered together.
    """
    tokens = None
    for t in sorted(r.turn for r in turns.select("turn").distinct().collect()):  # as many as the longest conversation has
        new = turns.filter(F.col("turn") == t)
        ends = None if tokens is None else tokens.groupBy("session").agg((F.max("pos") + 1).alias("start"))
        new = new.withColumn("start", F.lit(0).cast("long")) if ends is None else new.join(ends, "session", "left").withColumn("start", F.coalesce("start", F.lit(0)))
        new = new.filter((F.col("start") == 0) | (F.col("i") > 0) | (F.col("token_id") != bos))
        at = F.row_number().over(Window.partitionBy("session").orderBy("i")) - 1
        new = new.select("session", (F.col("start") + at).alias("pos"), "token_id").checkpoint()
        here = new.select("session").distinct()
        asked = new if tokens is None else new.unionByName(tokens.join(here, "session", "left_semi"))
        said = generate(weights, table, asked, steps, (eos, bos), layers)
        over = said.groupBy("session").agg((F.max("pos") + 1).alias("pos")).withColumn("token_id", F.lit(eos))
        after = said.unionByName(over)
        tokens = (after if tokens is None else after.unionByName(tokens.join(here, "session", "left_anti"))).checkpoint()
    return tokens if tokens is not None else turns.select("session", F.col("i").alias("pos"), "token_id")
