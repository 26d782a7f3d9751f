"""Percentiles per group by radix selection over order-preserving integers.

Every value becomes a 64-bit integer that sorts like it. A histogram of the first 16 bits
(sign, exponent, 4 bits of the mantissa) per group and part (a day) tells in which digit
each wanted rank lies; only the rows in those digits are counted again by their next 16
bits, and so on. Histograms of parts add up, so the ranks of all parts together are found
from the parts' histograms without a further scan. No values are gathered: each task sends
one row per group, part and digit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tonewright.functions.ordered import ordered_double, with_ordered_long
from tonewright.session import cut

DIGIT = 16


def _coded(df: DataFrame, group: Column, part: Column, value: Column, valid: Column | None) -> DataFrame:
    usable = value.cast("double") if valid is None else F.when(valid, value.cast("double"))
    rows = df.select(group.alias("group"), part.alias("part"), usable.alias("_u"))
    rows = rows.where(F.col("group").isNotNull() & F.col("_u").isNotNull() & ~F.isnan("_u") & (F.abs("_u") != F.lit(float("inf"))))
    # the code is never NULL, so that no filter on it is pushed down and works it out once more
    return with_ordered_long(rows, F.col("_u"), "_v").select("group", "part", F.coalesce("_v", F.lit(0).cast("long")).alias("_v"))


def histogram(df: DataFrame, group: Column, part: Column, value: Column, valid: Column | None = None, mantissa_bits: int = 8) -> DataFrame:
    """Mergeable summary: ``group, part, bin, n``, one row per occupied bin.

    A bin holds the values that share sign, exponent and ``mantissa_bits`` bits of the
    mantissa. NULL groups and NULL, NaN, infinite or not ``valid`` values don't count.
    """
    if not 0 <= mantissa_bits <= 52:
        raise ValueError("mantissa_bits must be between 0 and 52")
    rows = _coded(df, group, part, value, valid)
    return rows.groupBy("group", "part", F.shiftright("_v", 52 - mantissa_bits).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def merge(histograms: DataFrame) -> DataFrame:
    """All parts of each group as one: ``group, bin, n``."""
    return histograms.groupBy("group", "bin").agg(F.sum("n").alias("n"))


def estimate(merged: DataFrame, keys: list[str], percents: list[int], mantissa_bits: int = 8) -> DataFrame:
    """Percentiles from histograms: ``keys, percent, n_values, value``.

    ``value`` is the middle of the bin that holds rank ``ceil(p * n / 100)`` (at least 1). Its
    relative error is at most ``2 ** -(mantissa_bits + 1)``, or half the bin below 2**-1022.
    """
    w = Window.partitionBy(*keys)
    ranked = merged.withColumn("n_values", F.sum("n").over(w)).withColumn("_upto", F.sum("n").over(w.orderBy("bin")))
    shift = 52 - mantissa_bits
    low = F.shiftleft(F.col("bin"), shift)
    # a negative code's bin ends at -1 towards zero; the next bin's first code is the bound in either case
    middle = (ordered_double(low) + ordered_double(F.shiftleft(F.col("bin") + 1, shift))) / 2
    return ranked.select(*keys, "n_values", F.col("n"), "_upto", middle.alias("value"), F.explode(F.array(*[F.lit(int(p)) for p in percents])).alias("percent")).where(
        (_rank() <= F.col("_upto")) & (_rank() > F.col("_upto") - F.col("n"))
    ).select(*keys, "percent", "n_values", "value")


def _rank() -> Column:
    return F.greatest(F.lit(1), F.floor((F.col("percent").cast("long") * F.col("n_values") + 99) / 100)).cast("long")


def _known() -> Column:
    """The code of the rank, where a digit's least or greatest code already is it."""
    return F.when((F.col("lo") == F.col("hi")) | (F.col("rank") == 1), F.col("lo")).when(F.col("rank") == F.col("n"), F.col("hi"))


_COUNTS = (F.sum, "n"), (F.min, "lo"), (F.max, "hi")


def percentiles(df: DataFrame, group: Column, part: Column, value: Column, percents: list[int], valid: Column | None = None) -> DataFrame:
    """Exact percentiles of every group and of every group and part.

    ``scope, group, part, percent, n_values, value``: ``scope`` is 'all' (``part`` NULL) or
    'part'. The percentile of p is the value of rank ``ceil(p * n / 100)``, at least 1: an
    element of the data, so the error is 0. NULL groups and NULL, NaN, infinite or not
    ``valid`` values don't count; a NULL part is a part of its own; groups without usable
    values give no rows. Repeated rows count as often as they occur.
    """
    if not percents or any(not 0 <= p <= 100 for p in percents):
        raise ValueError("percents must be between 0 and 100")
    rows = _coded(df, group, part, value, valid)
    scoped = ["scope", "group", "part"]

    def both(counts: DataFrame, digit: list[str]) -> DataFrame:
        """The parts' counts and, from them, those of all parts."""
        whole = counts.groupBy("group", *digit).agg(*[f(c).alias(c) for f, c in _COUNTS])
        return counts.select(F.lit("part").alias("scope"), "group", "part", *digit, "n", "lo", "hi").unionByName(
            whole.select(F.lit("all").alias("scope"), "group", F.lit(None).cast(rows.schema["part"].dataType).alias("part"), *digit, "n", "lo", "hi")
        )

    def count(digit: Column, source: DataFrame, more: list[str]) -> DataFrame:
        return source.groupBy("group", "part", *more, digit.alias("digit")).agg(F.count(F.lit(1)).alias("n"), F.min("_v").alias("lo"), F.max("_v").alias("hi"))

    w = Window.partitionBy(*scoped)
    shift = 64 - DIGIT
    top = both(cut(count(F.shiftright("_v", shift), rows, [])), ["digit"])
    state = (
        top.withColumn("n_values", F.sum("n").over(w))
        .withColumn("_upto", F.sum("n").over(w.orderBy("digit")))
        .withColumn("percent", F.explode(F.array(*[F.lit(int(p)) for p in sorted(set(percents))])))
        .withColumn("rank", _rank() - (F.col("_upto") - F.col("n")))
        .where((F.col("rank") >= 1) & (F.col("rank") <= F.col("n")))
    )
    state = cut(state.select(*scoped, "percent", "n_values", F.col("digit").alias("prefix"), "rank", _known().alias("code")))
    found = [state.where(F.col("code").isNotNull())]
    while shift > 0:
        left = state.where(F.col("code").isNull()).drop("code")
        if left.isEmpty():
            break
        head, shift = shift, shift - DIGIT
        # only rows in a followed digit are counted; Spark broadcasts the digits below its own size limit only
        wanted = left.select("group", "prefix").distinct()
        inside = rows.withColumn("prefix", F.shiftright("_v", head)).join(wanted, ["group", "prefix"], "left_semi")
        finer = both(count(F.shiftright("_v", shift), inside, ["prefix"]), ["prefix", "digit"])
        pairs = finer.alias("f").join(
            left.alias("t"),
            (F.col("f.scope") == F.col("t.scope")) & (F.col("f.group") == F.col("t.group")) & F.col("f.part").eqNullSafe(F.col("t.part")) & (F.col("f.prefix") == F.col("t.prefix")),
        ).select(*[F.col(f"t.{c}").alias(c) for c in (*scoped, "percent", "n_values", "rank")], *[F.col(f"f.{c}").alias(c) for c in ("digit", "n", "lo", "hi")])
        upto = F.sum("n").over(Window.partitionBy(*scoped, "percent").orderBy("digit"))
        state = (
            pairs.withColumn("rank", F.col("rank") - (upto - F.col("n")))
            .where((F.col("rank") >= 1) & (F.col("rank") <= F.col("n")))
            .select(*scoped, "percent", "n_values", F.col("digit").alias("prefix"), "rank", _known().alias("code"))
        )
        state = cut(state)
        found.append(state.where(F.col("code").isNotNull()))
    out = None
    for s in found:
        s = s.select(*scoped, "percent", "n_values", ordered_double(F.col("code")).alias("value"))
        out = s if out is None else out.unionByName(s)
    return out
