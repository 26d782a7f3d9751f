"""Counts and summaries of detections, songs and labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonewright.operators.songs import confident, first_n, reconstruct


def confidence_stats(df: DataFrame) -> DataFrame:
    c = F.col("confidence")
    ok = F.when(~F.isnan(c), c)
    return df.agg(F.count(F.lit(1)).alias("detections"), F.min(ok).alias("least"), F.max(ok).alias("greatest"), F.avg(ok).alias("mean"))


def detection_summary(songs: DataFrame) -> DataFrame:
    """Per species: count, mean duration, mean number of merged rows."""
    return songs.groupBy("species").agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.col("time_end") - F.col("time_start")).alias("mean_duration"), F.avg("detections_merged").alias("mean_merged")
    )


def first_songs(songs: DataFrame, n: int = 5) -> DataFrame:
    return first_n(songs, "species", n, [F.col("filename"), F.col("time_start"), F.col("time_end")])


def filter_summary(df: DataFrame, least: float, gap: float = 0.1) -> DataFrame:
    """Numbers of rows as read, after the filter and after merging."""
    kept = confident(df, least)
    part = lambda d, n: d.agg(F.count(F.lit(1)).alias(n))
    return part(df, "original").join(part(kept, "filtered")).join(part(reconstruct(kept, gap), "merged"))  # single rows


def song_confidence(songs: DataFrame) -> DataFrame:
    c = F.coalesce("max_confidence", "avg_confidence")
    return songs.groupBy("species").agg(F.count(F.lit(1)).alias("n"), F.avg(c).alias("mean"), F.min(c).alias("least"), F.max(c).alias("greatest"))


def dataset_statistics(det: DataFrame, lab: DataFrame) -> DataFrame:
    """Detections and labels per species, and the totals in a row named Total."""
    rows = det.select("species", F.lit(1).alias("d"), F.lit(0).alias("l")).unionByName(lab.select("species", F.lit(0).alias("d"), F.lit(1).alias("l")))
    rows = rows.where(F.trim("species") != "")
    return rows.rollup("species").agg(F.sum("d").cast("long").alias("detections"), F.sum("l").cast("long").alias("labels")).withColumn(
        "species", F.when(F.col("species").isNull(), F.lit("Total")).otherwise(F.col("species"))
    )


def file_match_stats(det: DataFrame, lab: DataFrame, key: str = "stem") -> DataFrame:
    """Numbers of files in all, with detections, with labels, with both."""
    files = det.select(key, F.lit(1).alias("d"), F.lit(0).alias("l")).union(lab.select(key, F.lit(0), F.lit(1))).where(F.col(key).isNotNull())
    per = files.groupBy(key).agg(F.max("d").alias("d"), F.max("l").alias("l"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return per.agg(F.count(F.lit(1)).alias("files"), total("d").alias("with_detections"), total("l").alias("with_labels"), total(F.col("d") * F.col("l")).alias("with_both"))


def headline(songs: DataFrame) -> DataFrame:
    """Number of songs and of species, mean confidence, total duration."""
    c = F.coalesce("avg_confidence", "max_confidence")
    return songs.agg(F.count(F.lit(1)).alias("songs"), F.countDistinct("species").alias("species"), F.avg(c).alias("mean_confidence"), F.sum(F.col("time_end") - F.col("time_start")).alias("duration"))


def species_counts(df: DataFrame, n: int | None = None) -> DataFrame:
    """Rows per species, most first; with ``n`` only the first of them."""
    out = df.groupBy("species").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "species")
    return out if n is None else out.limit(n)
