"""Float and bfloat16 bit patterns as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MASK32 = 0xFFFFFFFF


def float_bits(x: Column) -> Column:
    """The 32 bits of a float as a non-negative bigint; NaN payloads and -0.0 are kept."""
    raw = F.java_method(F.lit("java.lang.Float"), F.lit("floatToRawIntBits"), x.cast("float"))
    return raw.cast("long").bitwiseAND(F.lit(MASK32))


def to_bf16(x: Column) -> Column:
    """Rounds to the nearest bfloat16, ties to even; its 16 bits as a bigint. NaN is not treated apart."""
    u = float_bits(x)
    return F.shiftright(u + 32767 + F.shiftright(u, 16).bitwiseAND(F.lit(1)), 16).bitwiseAND(F.lit(0xFFFF))


def sign(bits: Column) -> Column:
    return F.shiftright(bits, 15).bitwiseAND(F.lit(1))


def exponent(bits: Column) -> Column:
    return F.shiftright(bits, 7).bitwiseAND(F.lit(255))


def mantissa(bits: Column) -> Column:
    return bits.bitwiseAND(F.lit(127))


def from_bf16(bits: Column) -> Column:
    """The value as a double, exactly; subnormals, infinities and NaN included. Stays inside code generation."""
    e, m = exponent(bits), mantissa(bits).cast("double")
    size = (
        F.when(e == 255, F.when(m == 0, F.lit(float("inf"))).otherwise(F.lit(float("nan"))))
        .when(e == 0, m * F.lit(2.0**-133))
        .otherwise((m + 128) * F.pow(F.lit(2.0), (e - 134).cast("double")))
    )
    return F.when(sign(bits) == 1, -size).otherwise(size)


def assembled(sign_: Column, exp: Column, mant: Column) -> Column:
    """sign, exponent and mantissa as 16 bits."""
    return F.shiftleft(sign_, 15).bitwiseOR(F.shiftleft(exp.cast("long").bitwiseAND(F.lit(255)), 7)).bitwiseOR(mant)


def from_fp16(bits: Column) -> Column:
    """The value of a half-precision float's 16 bits as a double, exactly."""
    e, m = F.shiftright(bits, 10).bitwiseAND(F.lit(31)), bits.bitwiseAND(F.lit(1023)).cast("double")
    size = (
        F.when(e == 31, F.when(m == 0, F.lit(float("inf"))).otherwise(F.lit(float("nan"))))
        .when(e == 0, m * F.lit(2.0**-24))
        .otherwise((m + 1024) * F.pow(F.lit(2.0), (e - 25).cast("double")))
    )
    return F.when(sign(bits) == 1, -size).otherwise(size)
