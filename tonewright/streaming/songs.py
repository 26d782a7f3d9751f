"""Merging a stream of detections into songs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def to_micros(df: DataFrame) -> DataFrame:
    """Times rounded to microseconds, as timestamps since 1970 hold them."""
    us = lambda c: F.round(F.col(c) * 1e6).cast("long")
    return df.withColumn("_start", F.timestamp_micros(us("time_start"))).withColumn("_end", F.timestamp_micros(us("time_end")))


def stream_songs(df: DataFrame, gap: float = 0.1, late: str = "1 minute") -> DataFrame:
    """Songs by session windows: a session lasts until ``gap`` after the furthest end.

    Batch and stream agree on times rounded to microseconds. Rows later than ``late`` behind
    the latest start are dropped by the watermark. Needs gap > 0; rows whose end lies before
    the start don't count.
    """
    if not gap > 0:
        raise ValueError("gap must be above 0")
    rows = to_micros(df.where(F.col("time_end") >= F.col("time_start"))).withWatermark("_start", late)
    micros = F.unix_micros("_end") - F.unix_micros("_start") + F.lit(round(gap * 1e6))
    length = F.concat(micros.cast("string"), F.lit(" microseconds"))
    name = F.coalesce("filename", F.lit("__single_file__"))
    grouped = rows.groupBy(F.session_window("_start", length).alias("_w"), name.alias("filename"), "species_id")
    return grouped.agg(
        F.min("species").alias("species"), F.max("_end").alias("_to"), F.avg("confidence").alias("avg_confidence"), F.max("confidence").alias("max_confidence"),
        F.count(F.lit(1)).alias("detections_merged"), F.min("freq_low_hz").alias("freq_low_hz"), F.max("freq_high_hz").alias("freq_high_hz"),
    ).select(
        "filename", "species", "species_id", (F.unix_micros("_w.start") / 1e6).alias("time_start"), (F.unix_micros("_to") / 1e6).alias("time_end"),
        "avg_confidence", "max_confidence", "detections_merged", "freq_low_hz", "freq_high_hz",
    )
