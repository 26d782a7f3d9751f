"""Filtering detections and merging them into songs (gap-based sessions per file and class)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tonewright.functions.naming import basename, blank_to_null, finite
from tonewright.operators.intervals import opened, pieces

SINGLE_FILE = "__single_file__"
NO_CLASS = -(2**31)  # in place of a missing species_id


def confident(df: DataFrame, least: float) -> DataFrame:
    """Rows with a confidence of at least ``least``; a missing one counts as 0, NaN never passes."""
    if not 0 <= least <= 1:
        raise ValueError("the confidence threshold must be between 0 and 1")
    c = F.coalesce(F.col("confidence"), F.lit(0.0))
    return df.where((c >= F.lit(float(least))) & ~F.isnan(c))


def backfill_filename(df: DataFrame, audio_file: Column | None = None) -> DataFrame:
    """filename, else the name in audio_file or file_path, else 'unknown'."""
    names = [blank_to_null(F.col("filename"))]
    if audio_file is not None:
        names.append(blank_to_null(basename(audio_file)))
    if "file_path" in df.columns:
        names.append(blank_to_null(basename(F.col("file_path"))))
    return df.withColumn("filename", F.coalesce(*names, F.lit("unknown")))


def reconstruct(df: DataFrame, gap: float = 0.1, shard_seconds: float = 600.0, with_id: bool = False) -> DataFrame:
    """Songs: detections of one file and species_id whose gap to the furthest end so far is at most ``gap``.

    Columns are ``filename, species, species_id, time_start, time_end, avg_confidence,
    max_confidence, detections_merged, freq_low_hz, freq_high_hz``. ``species`` is that of the
    first row by time_start, then det_id; ``with_id`` adds that row's det_id, which names the
    song. A missing file name groups its rows as one file and stays missing; rows without a
    finite start or end don't count. Works in time shards, so that a recording of any size is
    merged by many tasks.
    """
    keys = ["_file", "species_id"]
    rows = df.select(
        F.coalesce(blank_to_null(F.col("filename")), F.lit(SINGLE_FILE)).alias("_file"),
        F.coalesce(F.col("species_id"), F.lit(NO_CLASS)).alias("species_id"),
        finite(F.col("time_start")).alias("_s"),
        finite(F.col("time_end")).alias("_e"),
        "det_id", "species", "confidence", "freq_low_hz", "freq_high_hz",
    ).where(F.col("_s").isNotNull() & F.col("_e").isNotNull())
    first = F.min(F.struct("_s", "det_id", "species"))
    carry = (
        first.alias("_first"), F.sum("confidence").alias("_sum"), F.count("confidence").alias("_with"), F.max("confidence").alias("_max"),
        F.count(F.lit(1)).alias("_rows"), F.min("freq_low_hz").alias("_low"), F.max("freq_high_hz").alias("_high"),
    )
    local = pieces(rows, keys, gap, shard_seconds, ("det_id",), carry)
    merged = local.groupBy(*keys, opened().alias("_song")).agg(
        F.min("_first").alias("_first"), F.max("_e").alias("time_end"), F.sum("_sum").alias("_sum"), F.sum("_with").alias("_with"),
        F.max("_max").alias("max_confidence"), F.sum("_rows").alias("detections_merged"), F.min("_low").alias("freq_low_hz"), F.max("_high").alias("freq_high_hz"),
    )
    return merged.select(
        *[F.col("_first.det_id").alias("det_id")] * with_id,
        F.when(F.col("_file") != SINGLE_FILE, F.col("_file")).alias("filename"),
        F.col("_first.species").alias("species"),
        F.when(F.col("species_id") != NO_CLASS, F.col("species_id")).alias("species_id"),
        F.col("_song._s").alias("time_start"), "time_end",
        F.try_divide("_sum", "_with").alias("avg_confidence"),
        "max_confidence", "detections_merged", "freq_low_hz", "freq_high_hz",
    )


def filter_then_merge(df: DataFrame, least: float, gap: float = 0.1, with_id: bool = False) -> DataFrame:
    """Confidence filter on the raw rows, then merging; the order matters."""
    return reconstruct(backfill_filename(confident(df, least)), gap, with_id=with_id)


def at_thresholds(df: DataFrame, thresholds: list[float]) -> DataFrame:
    """Every row once for each threshold that its confidence reaches: ``threshold`` added.

    The thresholds are an array literal, so no join is planned and a row is generated only
    for the thresholds it passes.
    """
    values = F.array(*[F.lit(float(t)) for t in thresholds])
    c = F.coalesce(F.col("confidence"), F.lit(0.0))
    passed = F.filter(values, lambda t: (t <= c) & ~F.isnan(c))
    return df.withColumn("threshold", F.explode(passed))


def threshold_grid(least: float = 0.0, most: float = 1.0, step: float = 0.01) -> list[float]:
    """Thresholds from ``least`` on, to ``most`` inclusive, rounded to three decimals."""
    if not (0 <= least <= most <= 1 and step > 0):
        raise ValueError("need 0 <= least <= most <= 1 and a step above 0")
    import numpy as np

    return [float(x) for x in np.round(np.arange(least, most + step, step), 3)]


def suppress(df: DataFrame, iou: float = 0.7) -> DataFrame:
    """Non-maximum suppression in time per file and species_id: boxes by falling confidence, dropped
    if their IoU with a kept one is above ``iou``. Ties go to the smaller det_id (of any type).

    Boxes that share no time can't suppress each other, so each cluster of overlapping boxes
    is decided on its own; clusters come from the sharded interval merge. Rows without a
    finite start or end, or with an end before the start, share no time with others and stay.
    """
    s, e = finite(F.col("time_start")), finite(F.col("time_end"))
    usable = F.coalesce(e >= s, F.lit(False))
    rows = df.where(usable).select(
        F.coalesce(F.col("filename"), F.lit(SINGLE_FILE)).alias("_file"), F.coalesce(F.col("species_id"), F.lit(NO_CLASS)).alias("_sid"),
        s.alias("_s"), e.alias("_e"), "det_id", F.nanvl(F.coalesce(F.col("confidence"), F.lit(0.0)), F.lit(0.0)).alias("_c"),
    )
    keys = ["_file", "_sid"]
    # in the order of decision
    box = F.struct((-F.col("_c")).alias("c"), F.col("det_id").alias("id"), F.col("_s").alias("s"), F.col("_e").alias("e"))
    parts = pieces(rows, keys, 0.0, 600.0, ("_e",), (F.collect_list(box).alias("_boxes"),))
    clusters = parts.groupBy(*keys, opened().alias("_period")).agg(F.sort_array(F.flatten(F.collect_list("_boxes"))).alias("_boxes"))

    @F.pandas_udf("array<int>")
    def kept(starts, ends):
        import numpy as np
        import pandas as pd

        out = []
        for first, last in zip(starts, ends):
            s, e, n = np.empty(len(first)), np.empty(len(first)), []
            for i, (a, b) in enumerate(zip(first, last)):
                k = len(n)
                inter = np.minimum(e[:k], b) - np.maximum(s[:k], a)
                union = (e[:k] - s[:k]) + (b - a) - inter
                if not ((inter > 0) & (inter > iou * union)).any():
                    s[k], e[k] = a, b
                    n.append(i)
            out.append(n)
        return pd.Series(out)

    single = F.size("_boxes") == 1
    solved = clusters.where(~single).withColumn("_kept", kept(F.col("_boxes.s"), F.col("_boxes.e")))
    ids = clusters.where(single).select(F.col("_boxes")[0]["id"].alias("det_id")).unionByName(
        solved.select(F.explode(F.transform("_kept", lambda i: F.col("_boxes")[i]["id"])).alias("det_id"))
    )
    return df.where(usable).join(ids, "det_id", "left_semi").unionByName(df.where(~usable))


def merge_detections(df: DataFrame, mode: str = "reconstruct", gap: float = 0.1, iou: float = 0.7) -> DataFrame:
    if mode == "reconstruct":
        return reconstruct(df, gap)
    if mode == "nms":
        return suppress(df, iou)
    raise ValueError(f"unknown mode {mode!r}: use 'nms' or 'reconstruct'")


def first_n(df: DataFrame, key: str, n: int, order: list[Column]) -> DataFrame:
    """The first ``n`` rows of each key in the given order, numbered from 1 in ``row_no``."""
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("row_no", F.row_number().over(w)).where(F.col("row_no") <= n)
