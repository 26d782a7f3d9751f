"""Results per key that don't depend on how the rows are spread over the keys.

Counts, busy keys and exact quantiles come from histograms per key whose counts add up, so
every task sends at most one row per key and bin. Quantiles are selected by refining: the
bin that holds a wanted rank is cut again until its rank is certain. The values of a key
are never brought together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tonewright.functions.ordered import ordered_double, with_ordered_long
from tonewright.session import cut

_TOP_SHIFT = 44  # first bins: exponent and 8 bits of the mantissa
_BINS = 1024
_MAX_ROUNDS = 8  # 44 bits at 10 a round need 5; more is an error


def _keyed(df: DataFrame, keys: dict[str, Column], value: Column | None, valid: Column | None, usable_only: bool = False) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(name).alias("key_field"), c.cast("string").alias("key_value")) for name, c in keys.items()])
    usable = F.lit(None).cast("double") if value is None else value if valid is None else F.when(valid, value)
    # the code is worked out once per row, before a row is multiplied by its keys
    rows = df.select(pairs.alias("_pairs"), usable.alias("_u"))
    if usable_only:
        rows = rows.where(F.col("_u").isNotNull() & ~F.isnan("_u") & (F.abs("_u") != F.lit(float("inf"))))
    rows = with_ordered_long(rows, F.col("_u"), "_v")
    if usable_only:  # never NULL, so that no filter on the code is pushed down and works it out once more
        rows = rows.withColumn("_v", F.coalesce("_v", F.lit(0).cast("long")))
    return (
        rows.select(F.explode("_pairs").alias("_k"), "_v")
        .select("_k.key_field", "_k.key_value", "_v")
        .where(F.col("key_value").isNotNull())
    )


def key_histogram(df: DataFrame, keys: dict[str, Column], value: Column | None = None, valid: Column | None = None) -> DataFrame:
    """Level-one histogram of every key: ``key_field, key_value, bin, n, lo, hi``.

    ``keys`` maps a name to the expression of a key; all are counted in one scan. ``bin`` is
    the head of the value's ordered code, NULL for rows without a usable value, which count
    as rows of the key only. Rows whose key is NULL are left out. Histograms of parts of the
    input add up: sum ``n``, least ``lo``, greatest ``hi``.
    """
    return _histogram(_keyed(df, keys, value, valid))


def _histogram(rows: DataFrame) -> DataFrame:
    return rows.groupBy("key_field", "key_value", F.shiftright("_v", _TOP_SHIFT).alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.min("_v").alias("lo"), F.max("_v").alias("hi")
    )


def busy_keys(df: DataFrame, keys: dict[str, Column], share: float = 0.03, value: Column | None = None, valid: Column | None = None) -> DataFrame:
    """The keys with at least ``share`` of all rows: ``key_field, key_value, n_rows, total_rows``.

    Counts come from the level-one histogram. A field's histogram also counts its rows
    without a key, so the total needs no second scan; NULL keys aren't reported. An empty
    table gives no rows.
    """
    if not 0 < share <= 1:
        raise ValueError("share must be above 0 and at most 1")
    marked = {name: F.coalesce(F.concat(F.lit("k"), c.cast("string")), F.lit("-")) for name, c in keys.items()}
    # whether it's a key is an aggregate: as a filter on the name it would be pushed into one of two scans, and nothing be shared
    counts = key_histogram(df, marked, value, valid).groupBy("key_field", "key_value").agg(F.sum("n").alias("n_rows"), F.max(F.col("key_value") != "-").alias("_named"))
    totals = counts.groupBy("key_field").agg(F.sum("n_rows").alias("total_rows"))
    return (
        counts.join(totals, "key_field")
        .where(F.col("_named"))
        .where(F.col("n_rows") >= F.col("total_rows") * F.lit(share))
        .select("key_field", F.substring("key_value", 2, 1 << 30).alias("key_value"), "n_rows", "total_rows")
    )


def _pick(bins: DataFrame, group: list[str], order: str) -> DataFrame:
    """The bin of every wanted rank, with the rank inside it (``_rank`` from 1)."""
    w = Window.partitionBy(*group).orderBy(order)
    return (
        bins.withColumn("_upto", F.sum("n").over(w))
        .where((F.col("_upto") >= F.col("_rank")) & (F.col("_upto") - F.col("n") < F.col("_rank")))
        .withColumn("_rank", F.col("_rank") - (F.col("_upto") - F.col("n")))
        .drop("_upto")
    )


def _known(rank: Column) -> Column:
    """The code of a rank, where the bin's ends tell it."""
    return F.when((F.col("lo") == F.col("hi")) | (rank == 1), F.col("lo")).when(rank == F.col("n"), F.col("hi"))


def key_quantiles(
    df: DataFrame, keys: dict[str, Column], value: Column, percents: list[int], valid: Column | None = None
) -> DataFrame:
    """Exact quantiles of every key: ``key_field, key_value, percent, n_values, value``.

    The quantile of ``percent`` p is the value of rank ``ceil(p * n / 100)``, at least 1, among
    the key's n usable values: an element of the data, ties included. NULL, NaN and infinite
    values and those that fail ``valid`` don't count; keys without usable values give no rows.
    """
    if not percents or any(not 0 <= p <= 100 for p in percents):
        raise ValueError("percents must be between 0 and 100")
    key = ["key_field", "key_value"]
    rows = _keyed(df, keys, value, valid, usable_only=True)
    bins = _histogram(rows)
    total = Window.partitionBy(*key)
    up = total.orderBy("bin")
    # one pass over a key's bins: every bin gets the percents whose ranks fall into it
    spread = bins.withColumn("n_values", F.sum("n").over(total)).withColumn("_upto", F.sum("n").over(up))
    wanted = F.filter(
        F.transform(
            F.array(*[F.lit(int(p)) for p in sorted(set(percents))]),
            lambda p: F.struct(p.alias("percent"), F.greatest(F.lit(1), F.floor((p.cast("long") * F.col("n_values") + 99) / 100)).cast("long").alias("r")),
        ),
        lambda x: (x["r"] <= F.col("_upto")) & (x["r"] > F.col("_upto") - F.col("n")),
    )
    state = spread.select(*key, "n_values", "bin", "n", "lo", "hi", "_upto", F.explode(wanted).alias("_w")).select(
        *key, "n_values", F.col("_w.percent").alias("percent"), "bin", "n", "lo", "hi", (F.col("_w.r") - F.col("_upto") + F.col("n")).alias("_rank")
    )
    state = cut(state.withColumn("_code", _known(F.col("_rank"))))
    found = [state.where(F.col("_code").isNotNull())]
    rows = rows.withColumn("bin", F.shiftright("_v", _TOP_SHIFT))
    for round_ in range(_MAX_ROUNDS + 1):
        left = state.where(F.col("_code").isNull())
        if left.isEmpty():
            break
        if round_ == _MAX_ROUNDS:
            raise RuntimeError("ranks are still open after all bits were read")
        # joined on key and bin: a busy key is spread over its bins, and Spark broadcasts only below its own size limit
        inside = rows.join(left.select(*key, "bin", "percent", "n_values", "_rank", "lo", "hi"), [*key, "bin"]).where(
            F.col("_v").between(F.col("lo"), F.col("hi"))
        )
        width = F.floor((F.col("hi") - F.col("lo")) / F.lit(_BINS)) + 1
        finer = (
            inside.groupBy(*key, "percent", "n_values", "bin", "_rank", F.floor((F.col("_v") - F.col("lo")) / width).alias("_sub"))
            .agg(F.count(F.lit(1)).alias("n"), F.min("_v").alias("lo"), F.max("_v").alias("hi"))
        )
        state = cut(_pick(finer, [*key, "percent"], "_sub").drop("_sub").withColumn("_code", _known(F.col("_rank"))))
        found.append(state.where(F.col("_code").isNotNull()))
    out = None
    for part in found:
        part = part.select(*key, "percent", "n_values", ordered_double(F.col("_code")).alias("value"))
        out = part if out is None else out.unionByName(part)
    return out
