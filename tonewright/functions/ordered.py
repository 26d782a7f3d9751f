"""Doubles as order-preserving 64-bit integers, in JVM expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_MANTISSA = float(2**52)
_TINY = 2.0**-1022


def ordered_long(value: Column) -> Column:
    """A bigint that sorts as the double does; equal values (also 0.0 and -0.0) share one.

    For a positive double it's its IEEE 754 bit pattern, for a negative one the negated
    pattern of its magnitude. NULL, NaN and infinite values give NULL. Scaling by powers
    of two is exact, so the exponent found by a logarithm only needs a correction by one.
    """
    x = F.abs(value.cast("double"))
    guess = F.floor(F.log2(x))
    # two factors: 2^-e alone overflows for the smallest exponents
    half = F.floor(guess / 2)
    scaled = x * F.pow(F.lit(2.0), -half) * F.pow(F.lit(2.0), half - guess)
    exponent = guess + F.when(scaled >= 2, 1).when(scaled < 1, -1).otherwise(0)
    mantissa = F.when(scaled >= 2, scaled / 2).when(scaled < 1, scaled * 2).otherwise(scaled)
    normal = (exponent + 1023) * F.lit(2**52) + ((mantissa - 1) * F.lit(_MANTISSA)).cast("long")
    tiny = (x * F.lit(2.0**537) * F.lit(2.0**537)).cast("long")
    bits = F.when(x == 0, F.lit(0).cast("long")).when(x < F.lit(_TINY), tiny).otherwise(normal)
    signed = F.when(value < 0, -bits).otherwise(bits)
    return F.when(~F.isnan(x) & (x != F.lit(float("inf"))), signed)


def with_ordered_long(df: DataFrame, value: Column, name: str) -> DataFrame:
    """``df`` with :func:`ordered_long` of a value in the column ``name``, worked out in steps.

    Each step is a column of its own, so that no logarithm or power is computed twice. The
    columns ``_ol_...`` must be free.
    """
    x, g, h, m = (F.col(f"_ol_{n}") for n in "xghm")
    df = df.withColumn("_ol_s", value.cast("double")).withColumn("_ol_x", F.abs("_ol_s"))
    df = df.withColumn("_ol_g", F.floor(F.log2(x))).withColumn("_ol_h", F.floor(g / 2))
    df = df.withColumn("_ol_m", x * F.pow(F.lit(2.0), -h) * F.pow(F.lit(2.0), h - g))
    mantissa = F.when(m >= 2, m / 2).when(m < 1, m * 2).otherwise(m)
    normal = (g + F.when(m >= 2, 1024).when(m < 1, 1022).otherwise(1023)) * F.lit(2**52) + ((mantissa - 1) * F.lit(_MANTISSA)).cast("long")
    tiny = (x * F.lit(2.0**537) * F.lit(2.0**537)).cast("long")
    df = df.withColumn("_ol_b", F.when(x == 0, F.lit(0).cast("long")).when(x < F.lit(_TINY), tiny).when(x < F.lit(float("inf")), normal))
    return df.withColumn(name, F.when(F.col("_ol_s") < 0, -F.col("_ol_b")).otherwise(F.col("_ol_b"))).drop(*[f"_ol_{n}" for n in "sxghmb"])


def ordered_double(code: Column) -> Column:
    """The double of a code of :func:`ordered_long` (0 for both zeros)."""
    bits = F.abs(code)
    exponent = F.shiftright(bits, 52)
    mantissa = (bits - F.shiftleft(exponent, 52)).cast("double")
    power = (exponent - 1023).cast("double")
    half = F.floor(power / 2).cast("double")
    normal = (F.lit(1.0) + mantissa / F.lit(_MANTISSA)) * F.pow(F.lit(2.0), half) * F.pow(F.lit(2.0), power - half)
    tiny = mantissa * F.lit(2.0**-537) * F.lit(2.0**-537)
    size = F.when(exponent == 0, tiny).otherwise(normal)
    return F.when(code < 0, -size).otherwise(size)
