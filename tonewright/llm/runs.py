"""Runs of near-identical consecutive events, from boundary rows only.

A row opens a run if it differs from the row just before it. Only such boundary rows are
kept; the next boundary's position gives a run's length, and the end of the row before
that boundary its duration. A sequence is worked on in time shards: each shard is one
group of a window, and one summary row per shard (its first and last row, its number of
rows, its first boundary) tells the neighbours what they need, so that a sequence with a
third of all rows is spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tonewright.functions.naming import finite


def _continues(prev: str, row: str, within: float, tolerance: float) -> Column:
    a, b = (lambda n: F.col(f"{prev}.{n}")), (lambda n: F.col(f"{row}.{n}"))
    same = (a("label") == b("label")) & (b("t") - a("t") <= F.lit(float(within))) & ~F.isnan(a("v")) & ~F.isnan(b("v")) & (F.abs(a("v") - b("v")) <= F.lit(float(tolerance)))
    return F.coalesce(same, F.lit(False))


def runs(
    df: DataFrame,
    sequence: str,
    event_id: str = "det_id",
    label: str = "species",
    value: str = "confidence",
    start: str = "time_start",
    end: str = "time_end",
    within: float = 0.5,
    tolerance: float = 0.05,
    shard_seconds: float = 600.0,
) -> DataFrame:
    """One row per run: ``sequence, first_id, label, start, end, duration, events, first_value``.

    Events of a sequence are ordered by start, then id. An event continues the run of the
    event just before it if both have the same label (blanks around and case ignored, never
    NULL), it starts at most ``within`` later and both values are numbers that differ by at
    most ``tolerance``. ``end`` is the end of the run's last event; where that is missing or
    lies before its start, its start. Events without a sequence or a finite start don't
    count; rows delivered twice are events of their own; rows equal in start and id follow
    one another by their other columns. An empty table gives no rows. Only the named columns
    are read, so others can't clash.
    """
    if not shard_seconds > 0:
        raise ValueError("shard_seconds must be above 0")
    t, e = finite(F.col(start)), finite(F.col(end))
    events = df.select(
        F.col(sequence).alias("_q"),
        F.struct(
            t.alias("t"),
            F.col(event_id).alias("id"),
            F.lower(F.trim(F.col(label))).alias("label"),
            F.col(value).cast("double").alias("v"),
            F.when(e >= t, e).otherwise(t).alias("e"),
        ).alias("_r"),
    ).where(F.col("_q").isNotNull() & F.col("_r.t").isNotNull())
    # never NULL, so that no filter on it makes two readers of one shuffle differ
    events = events.withColumn("_shard", F.coalesce(F.floor(F.col("_r.t") / F.lit(float(shard_seconds))), F.lit(0).cast("long")))
    shard = ["_q", "_shard"]
    order = Window.partitionBy(*shard).orderBy("_r")
    placed = events.withColumn("_pos", F.row_number().over(order)).withColumn("_prev", F.lag("_r").over(order))
    first = F.col("_prev").isNull()
    opens = ~_continues("_prev", "_r", within, tolerance)
    spot = F.struct(F.col("_pos").cast("long").alias("pos"), F.col("_prev.e").alias("e"))

    # one row per shard, then windows over a sequence's shards only
    summary = placed.groupBy(*shard).agg(
        F.count(F.lit(1)).alias("_n"),
        F.min("_r").alias("_first"),
        F.max("_r").alias("_last"),
        F.min(F.when(opens & ~first, spot)).alias("_inner"),
    )
    along = Window.partitionBy("_q").orderBy("_shard")
    after = along.rowsBetween(1, Window.unboundedFollowing)
    whole = along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    summary = (
        summary.withColumn("_offset", F.coalesce(F.sum("_n").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("_before", F.lag("_last").over(along))
        .withColumn("_heads", ~_continues("_before", "_first", within, tolerance))
        .withColumn(
            "_open",
            F.when(F.col("_heads"), F.struct((F.col("_offset") + 1).alias("pos"), F.col("_before.e").alias("e"))).when(
                F.col("_inner").isNotNull(), F.struct((F.col("_offset") + F.col("_inner.pos")).alias("pos"), F.col("_inner.e").alias("e"))
            ),
        )
        .withColumn(
            "_next",
            F.coalesce(F.first("_open", ignorenulls=True).over(after), F.struct((F.sum("_n").over(whole) + 1).alias("pos"), F.last("_last.e").over(whole).alias("e"))),
        )
        .select(*shard, "_offset", "_heads", "_next")
    )
    boundaries = placed.where(opens).select(*shard, "_r", first.alias("_is_first"), spot.alias("_spot"))
    kept = (
        boundaries.join(summary, shard)
        .where(~F.col("_is_first") | F.col("_heads"))
        .withColumn("_here", F.struct((F.col("_offset") + F.col("_spot.pos")).alias("pos"), F.col("_spot.e").alias("e")))
    )
    follows = F.coalesce(F.lead("_here").over(Window.partitionBy(*shard).orderBy("_here.pos")), F.col("_next"))
    return kept.withColumn("_then", follows).select(
        F.col("_q").alias("sequence"),
        F.col("_r.id").alias("first_id"),
        F.col("_r.label").alias("label"),
        F.col("_r.t").alias("start"),
        F.col("_then.e").alias("end"),
        (F.col("_then.e") - F.col("_r.t")).alias("duration"),
        (F.col("_then.pos") - F.col("_here.pos")).alias("events"),
        F.col("_r.v").alias("first_value"),
    )
