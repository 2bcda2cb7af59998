"""The 12-bit weight codec: 8 bits of sign and mantissa, a 4-bit exponent group, and patches for what has no group.

Tensors come as elements: tensor, r, k, v. All tensors of a frame are handled by one job, keyed by tensor.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import bits as B

GROUPS = 15


def with_bits(elements: DataFrame) -> DataFrame:
    """Adds the bfloat16 bits and their exponent."""
    return elements.withColumn("bits", B.to_bf16(F.col("v"))).withColumn("exp", B.exponent(F.col("bits")))


def exponent_histogram(bf: DataFrame) -> DataFrame:
    """tensor, exp, n for all 256 exponents, empty ones too."""
    n = bf.groupBy("tensor", "exp").agg(F.count("*").alias("n"))
    counts = n.groupBy("tensor").agg(F.map_from_entries(F.collect_list(F.struct("exp", "n"))).alias("by"))  # 256 entries at most
    dense = counts.select("tensor", "by", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(255).cast("long"))).alias("exp"))
    return dense.select("tensor", "exp", F.coalesce(F.try_element_at("by", F.col("exp")), F.lit(0)).cast("long").alias("n"))


def base_exponent(bf: DataFrame) -> DataFrame:
    """tensor, base_exp, covered, n: the window of 15 exponents with most elements, the lowest of equals; its start less one."""
    w = Window.partitionBy("tensor").orderBy("exp")
    hist = exponent_histogram(bf)
    sums = hist.withColumn("covered", F.sum("n").over(w.rowsBetween(0, GROUPS - 1))).withColumn("n", F.sum("n").over(Window.partitionBy("tensor")))
    best = sums.filter(F.col("exp") <= 256 - GROUPS).groupBy("tensor").agg(F.max(F.struct("covered", (-F.col("exp")).alias("low"))).alias("b"), F.max("n").alias("n"))
    return best.select("tensor", (-F.col("b.low") - 1).cast("int").alias("base_exp"), F.col("b.covered").alias("covered"), "n")


def grouped(bf: DataFrame, base: DataFrame) -> DataFrame:
    """Adds base_exp and grp: 1 to 15, or 0 for an escape. base has a row per tensor, some hundreds in a model, and is
    broadcast: a join by shuffle would bring all elements of a tensor into one task."""
    g = F.col("exp") - F.col("base_exp")
    return bf.join(F.broadcast(base.select("tensor", "base_exp")), "tensor").withColumn("grp", F.when(g.between(1, GROUPS), g).otherwise(0))


def sign_mantissa(bits):
    return F.shiftleft(B.sign(bits), 7).bitwiseOR(B.mantissa(bits))


def packed(groups: DataFrame) -> DataFrame:
    """tensor, r, n, base_exp, sm, gr (binary): each row packed by itself, an odd one with a last nibble of 0.

    A tensor's bytes are its rows' in order, for even row lengths.
    """
    hex2 = lambda x: F.lpad(F.hex(x), 2, "0")
    cells = groups.groupBy("tensor", "r").agg(
        F.max("base_exp").alias("base_exp"), F.array_sort(F.collect_list(F.struct("k", sign_mantissa(F.col("bits")).alias("sm"), "grp"))).alias("a")
    )
    pair = lambda i: F.get("a", 2 * i)["grp"] + 16 * F.coalesce(F.get("a", 2 * i + 1)["grp"], F.lit(0))
    nibbles = F.transform(F.sequence(F.lit(0), F.expr("(size(a) + 1) div 2 - 1").cast("int")), lambda i: hex2(pair(i)))
    return cells.select(
        "tensor", "r", F.size("a").alias("n"), "base_exp", F.unhex(F.array_join(F.transform("a", lambda x: hex2(x["sm"])), "")).alias("sm"), F.unhex(F.array_join(nibbles, "")).alias("gr")
    )


def unpacked(rows: DataFrame) -> DataFrame:
    """tensor, r, k, base_exp, sm, grp of packed rows."""
    at = rows.select("*", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("k"))
    byte = lambda c, i: F.conv(F.hex(F.substring(c, i + 1, F.lit(1))), 16, 10).cast("long")
    nibble = byte(F.col("gr"), F.expr("k div 2").cast("int"))
    grp = F.when(F.col("k") % 2 == 0, nibble.bitwiseAND(F.lit(15))).otherwise(F.shiftright(nibble, 4))
    return at.select("tensor", "r", "k", "base_exp", byte(F.col("sm"), F.col("k")).alias("sm"), grp.alias("grp"))


def row_offsets(groups: DataFrame, block: int = 4096) -> DataFrame:
    """tensor, r, n_escapes, start: escapes before each row; rows without any are kept.

    Sums are made within blocks of rows, then over the blocks' sums, so that no task has all rows of a tensor.
    """
    per_row = groups.groupBy("tensor", "r").agg(F.count_if(F.col("grp") == 0).alias("n_escapes")).withColumn("block", F.expr(f"r div {block}"))
    sums = per_row.groupBy("tensor", "block").agg(F.sum("n_escapes").alias("n"))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select("tensor", "block", F.coalesce(F.sum("n").over(before(Window.partitionBy("tensor").orderBy("block"))), F.lit(0)).alias("base"))
    own = F.coalesce(F.sum("n_escapes").over(before(Window.partitionBy("tensor", "block").orderBy("r"))), F.lit(0))
    return per_row.withColumn("own", own).join(bases, ["tensor", "block"]).select("tensor", "r", "n_escapes", (F.col("base") + F.col("own")).alias("start"))


def escapes(groups: DataFrame) -> DataFrame:
    """tensor, r, k, correct, wrong: the bits of an escape, and what decoding gives without its patch."""
    wrong = B.assembled(B.sign(F.col("bits")), F.col("base_exp"), B.mantissa(F.col("bits")))
    return groups.filter("grp = 0").select("tensor", "r", "k", F.col("bits").alias("correct"), wrong.alias("wrong"))


def statistics(groups: DataFrame) -> DataFrame:
    """tensor, n, escapes, escape_pct, packed_bytes, ratio to 2 bytes an element."""
    s = groups.groupBy("tensor").agg(F.count("*").alias("n"), F.count_if(F.col("grp") == 0).alias("escapes"), F.countDistinct("r").alias("m"))
    size = F.col("n") + F.expr("(n + 1) div 2") + 4 * (F.col("m") + 1) + 8 * F.col("escapes")
    return s.select("tensor", "n", "escapes", F.round(100.0 * F.col("escapes") / F.col("n"), 4).alias("escape_pct"), size.alias("packed_bytes"), F.round(2.0 * F.col("n") / size, 4).alias("ratio"))


def cells(groups: DataFrame) -> DataFrame:
    """tensor, r, k, base_exp, sm, grp, correct: what a packed row and its patches hold of each element, side by side."""
    return groups.select("tensor", "r", "k", "base_exp", sign_mantissa(F.col("bits")).alias("sm"), "grp", F.when(F.col("grp") == 0, F.col("bits")).alias("correct"))


def decoded(cells: DataFrame, patches: DataFrame | None = None) -> DataFrame:
    """tensor, r, k, bits, v of cells (sm, grp, base_exp). With patches, or cells that carry their own (correct), exact;
    without, escapes decode to their wrong value."""
    plain = B.assembled(F.shiftright("sm", 7), F.col("base_exp") + F.col("grp"), F.col("sm").bitwiseAND(F.lit(127)))
    if patches is not None:
        cells = cells.drop("correct").join(patches.select("tensor", "r", "k", "correct"), ["tensor", "r", "k"], "left")
    out = cells.withColumn("bits", F.coalesce("correct", plain) if "correct" in cells.columns else plain)
    return out.select("tensor", "r", "k", "bits", B.from_bf16(F.col("bits")).alias("v"))


def lane_prefix(patches: DataFrame, lanes: int = 256) -> DataFrame:
    """tensor, r, lane, n, prefix: escapes of earlier lanes (k mod lanes) of the row."""
    n = patches.groupBy("tensor", "r", (F.col("k") % lanes).alias("lane")).agg(F.count("*").alias("n"))
    before = Window.partitionBy("tensor", "r").orderBy("lane").rowsBetween(Window.unboundedPreceding, -1)
    return n.withColumn("prefix", F.coalesce(F.sum("n").over(before), F.lit(0)))


def encode(elements: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The whole compression: packed rows and patches."""
    bf = with_bits(elements)
    groups = grouped(bf, base_exponent(bf))
    return packed(groups), escapes(groups)


def decode(rows: DataFrame, patches: DataFrame) -> DataFrame:
    return decoded(unpacked(rows), patches)
