"""Continuous periods and gaps of overlapping intervals, in two levels.

Level one clips every interval at the end of the time shard in which it starts. The parts
inside a shard are merged there, all shards of an entity in parallel; what reaches past
the shard's end is kept as one number, the furthest end. Level two stitches: per entity a
running maximum over the few shard rows tells each shard how far it's already covered, so
pieces that touch this coverage join the period that began earlier. Only one row per
entity and shard meets in one task, never an entity's intervals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tonewright.functions.naming import finite


def valid_rows(df: DataFrame, keys: list[str], start: Column, end: Column) -> DataFrame:
    """keys, _s, _e of the intervals that count."""
    return (
        df.select(*keys, finite(start).alias("_s"), finite(end).alias("_e"))
        .where(F.col("_s").isNotNull() & (F.col("_e") >= F.col("_s")))
        .dropna(subset=keys)
    )


def shard_of(shard_seconds: float) -> Column:
    # never NULL, so that no filter on it makes two readers of one shuffle differ
    return F.coalesce(F.floor(F.col("_s") / F.lit(float(shard_seconds))), F.lit(0).cast("long"))


def pieces(rows: DataFrame, keys: list[str], gap: float, shard_seconds: float = 600.0, order: tuple[str, ...] = ("_e",), carry: tuple[Column, ...] = ()) -> DataFrame:
    """Locally merged pieces with what earlier shards cover: keys, _s, _e, _before, _cover, _owner, _opens.

    ``rows`` has the keys, ``_s`` and ``_e`` and is taken in order of ``_s``, then ``order``.
    Where ``rows`` already has ``_shard``, its partitioning by shard is used.
    ``carry`` are named aggregates of a piece's rows, to be merged by the caller.
    """
    if not shard_seconds > 0:
        raise ValueError("shard_seconds must be above 0")
    if "_shard" not in rows.columns:
        rows = rows.withColumn("_shard", shard_of(shard_seconds))
    shard = [*keys, "_shard"]
    along = Window.partitionBy(*shard).orderBy("_s", *order)
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    marked = rows.withColumn("_end_before", F.max("_e").over(before)).withColumn(
        "_n", F.sum(F.when(F.col("_s") - F.col("_end_before") <= F.lit(float(gap)), 0).otherwise(1)).over(along)
    )
    # the same partitioning: no further exchange
    local = (
        marked.groupBy(*shard, "_n")
        .agg(F.min("_s").alias("_s"), F.max("_e").alias("_e"), *carry)
        .withColumn("_before", F.lag("_e").over(Window.partitionBy(*shard).orderBy("_n")))
    )
    ends = local.groupBy(*shard).agg(F.max("_e").alias("_reach"), F.max(F.struct("_s", "_n")).alias("_last"))
    earlier = Window.partitionBy(*keys).orderBy("_shard").rowsBetween(Window.unboundedPreceding, -1)
    stitched = (
        ends.withColumn("_cover", F.max("_reach").over(earlier))
        .withColumn("_opened", F.when(F.col("_cover").isNull() | (F.col("_last._s") - F.col("_cover") > F.lit(float(gap))), F.col("_last")))
        .withColumn("_owner", F.max("_opened").over(earlier))
        .select(*shard, "_cover", "_owner")
    )
    return local.join(stitched, shard).withColumn(
        "_opens", F.col("_cover").isNull() | (F.col("_s") - F.col("_cover") > F.lit(float(gap)))
    )


def opened() -> Column:
    """The piece (``_s``, ``_n``) that opens the period a piece belongs to.

    Its start alone doesn't name a period where intervals may end before they start.
    """
    return F.when(F.col("_opens"), F.struct("_s", "_n")).otherwise(F.col("_owner"))


def periods(df: DataFrame, keys: list[str], start: str = "time_start", end: str = "time_end", gap: float = 0.1, shard_seconds: float = 600.0) -> DataFrame:
    """Continuous periods per entity: ``keys, start, end``.

    Intervals that overlap, touch or lie at most ``gap`` apart form one period; a single
    interval is a period too. Rows with a NULL key, a NULL, NaN or infinite bound, or an end
    before the start don't count; an empty input gives no rows; repeated rows and ties change
    nothing. Of ``df`` only the named columns are read, so further columns can't clash.
    """
    if not gap >= 0:
        raise ValueError("gap must be 0 or more")
    p = pieces(valid_rows(df, keys, F.col(start), F.col(end)), keys, gap, shard_seconds)
    return p.groupBy(*keys, opened()["_s"].alias("start")).agg(F.max("_e").alias("end"))


def periods_and_gaps(
    df: DataFrame,
    keys: list[str],
    start: str = "time_start",
    end: str = "time_end",
    gap: float = 0.1,
    longest_gap: float | None = None,
    shard_seconds: float = 600.0,
) -> DataFrame:
    """Periods, and the gaps between successive periods: ``kind, keys, start, end``.

    ``kind`` is 'period' or 'gap'. A gap ends where a period opens and starts where all that
    came before has ended; with ``longest_gap`` only gaps of at most that length are listed.
    Other inputs are treated as in :func:`periods`.
    """
    if not gap >= 0:
        raise ValueError("gap must be 0 or more")
    p = pieces(valid_rows(df, keys, F.col(start), F.col(end)), keys, gap, shard_seconds)
    covered = F.greatest(F.col("_cover"), F.col("_before"))
    wanted = F.col("_opens") & covered.isNotNull()
    if longest_gap is not None:
        wanted = wanted & (F.col("_s") - covered <= F.lit(float(longest_gap)))
    piece = F.struct(
        F.lit("period").alias("kind"),
        opened()["_s"].alias("start"),
        F.col("_e").alias("end"),
    )
    silence = F.struct(F.lit("gap").alias("kind"), F.col("_s").alias("start"), covered.alias("end"))
    # one pass over the pieces for both kinds; a gap is keyed by the start of the period after it
    both = p.select(*keys, F.explode(F.when(wanted, F.array(piece, silence)).otherwise(F.array(piece))).alias("_x"))
    merged = both.groupBy(*keys, F.col("_x.kind").alias("kind"), F.col("_x.start").alias("_a")).agg(F.max("_x.end").alias("_b"))
    is_gap = F.col("kind") == "gap"
    return merged.select(
        "kind", *keys, F.when(is_gap, F.col("_b")).otherwise(F.col("_a")).alias("start"), F.when(is_gap, F.col("_a")).otherwise(F.col("_b")).alias("end")
    )
