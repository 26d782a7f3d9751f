"""Precision, recall and F-beta over thresholds, classes and averages."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tonewright.functions.naming import stem
from tonewright.operators.matching import edges, one_to_one
from tonewright.operators.songs import backfill_filename
from tonewright.operators.sweep import at_each, per_threshold, song_versions
from tonewright.session import cut

MICRO, MACRO = "Overall_Micro", "Overall_Macro"


def single_class(species: Column, name: str = "bird") -> Column:
    """Every species that isn't blank becomes one class."""
    return F.when(F.trim(species) != "", F.lit(name)).otherwise(species)


def rates(tp: Column, fp: Column, fn: Column, beta: float = 1.0) -> dict[str, Column]:
    """precision, recall, f_beta_score; NULL where undefined, F is 0 if both are 0."""
    tp, fp, fn = (c.cast("double") for c in (tp, fp, fn))
    p, r = F.try_divide(tp, tp + fp), F.try_divide(tp, tp + fn)
    b = F.lit(float(beta) * float(beta))
    f = F.when(p.isNull() | r.isNull(), F.lit(None).cast("double")).when((p == 0) & (r == 0), F.lit(0.0)).otherwise((1 + b) * p * r / (b * p + r))
    return {"precision": p, "recall": r, "f_beta_score": f}


def threshold_table(spark: SparkSession, thresholds: list[float]) -> DataFrame:
    return spark.createDataFrame([(float(t),) for t in thresholds], "threshold double")


def score_rows(counts: DataFrame, thresholds: DataFrame, beta: float = 1.0) -> DataFrame:
    """Rows per class, the micro row of every threshold and the macro row of those with classes.

    ``counts`` has ``threshold, species, tp, fp, fn``. Columns: ``species, confidence_threshold, tp,
    fp, fn, precision, recall, f_beta_score``; undefined values are NULL and skipped by macro.
    """
    shown = lambda df: df.select("species", F.col("threshold").alias("confidence_threshold"), "tp", "fp", "fn", "precision", "recall", "f_beta_score")
    with_rates = lambda df: df.withColumns(rates(F.col("tp"), F.col("fp"), F.col("fn"), beta))
    classes = with_rates(counts)
    sums = [F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("tp", "fp", "fn")]
    micro = with_rates(thresholds.join(counts, "threshold", "left").groupBy("threshold").agg(*sums)).withColumn("species", F.lit(MICRO))
    macro = classes.groupBy("threshold").agg(*[F.avg(c).alias(c) for c in ("precision", "recall", "f_beta_score")])
    macro = macro.withColumn("species", F.lit(MACRO)).withColumns({c: F.lit(None).cast("long") for c in ("tp", "fp", "fn")})
    return shown(classes).unionByName(shown(micro)).unionByName(shown(macro))


def sweep_counts(det: DataFrame, lab: DataFrame, thresholds: list[float], iou: float = 0.5, gap: float = 0.1, optimal: bool = True, one_class: str | None = None, file_key: Callable[[Column], Column] = stem) -> DataFrame:
    """``threshold, species, tp, fp, fn`` of songs against labels at every threshold.

    Files pair by ``file_key`` of their names on both sides, by default the stem (labels without
    ``filename`` by their own ``stem``), whichever side has them. With ``one_class`` songs are still merged per species_id, only the matching is
    blind to it. Greedy matching takes songs by file and start.
    """
    with_key = lambda df: (df.withColumn("stem", file_key(F.col("filename"))) if "filename" in df.columns else df).where(F.trim("species") != "")
    songs, lab = with_key(cut(song_versions(backfill_filename(det), thresholds, gap))), with_key(lab)
    if one_class:
        songs, lab = (x.withColumn("species", single_class(F.col("species"), one_class)) for x in (songs, lab))
    grid = threshold_table(det.sparkSession, thresholds)
    n_det = per_threshold(songs, thresholds, "species", n_det=F.lit(1))
    n_lab = lab.groupBy("species").agg(F.count(F.lit(1)).alias("n_lab")).crossJoin(F.broadcast(grid))  # classes by given thresholds
    keys = ["threshold", "stem", "species"]
    listed = songs.withColumn("place", F.struct("filename", "time_start"))
    e = at_each(edges(listed, lab, ["stem", "species"], iou, keep=("lo", "hi", "place")), thresholds)
    tp = one_to_one(e, keys, optimal, "place").groupBy("threshold", "species").agg(F.count(F.lit(1)).alias("tp"))
    both = ["threshold", "species"]
    all_ = n_det.join(n_lab, both, "full_outer").join(tp, both, "left").na.fill(0, ["n_det", "n_lab", "tp"])
    return all_.select(*both, F.col("tp").cast("long").alias("tp"), (F.col("n_det") - F.col("tp")).cast("long").alias("fp"), (F.col("n_lab") - F.col("tp")).cast("long").alias("fn"))


def best_thresholds(rows: DataFrame) -> DataFrame:
    """Of each species the row with the highest F; the lowest threshold among equal ones."""
    w = Window.partitionBy("species").orderBy(F.desc("f_beta_score"), "confidence_threshold")
    return rows.where(F.col("f_beta_score").isNotNull()).withColumn("_r", F.row_number().over(w)).where(F.col("_r") == 1).drop("_r")


def best_per_class(rows: DataFrame) -> DataFrame:
    """Highest F of each real class, NULL where it never is defined."""
    return rows.where(~F.col("species").isin(MICRO, MACRO)).groupBy("species").agg(F.max("f_beta_score").alias("best"))


def top_classes(rows: DataFrame, n: int = 10) -> DataFrame:
    return best_per_class(rows).orderBy(F.desc_nulls_last("best"), "species").limit(n)


def bottom_classes(rows: DataFrame, n: int = 5) -> DataFrame:
    """The last ``n`` in falling order of the best F, undefined ones last of all."""
    return best_per_class(rows).orderBy(F.asc_nulls_first("best"), F.desc("species")).limit(n)


def f_pivot(rows: DataFrame, thresholds: list[float]) -> DataFrame:
    """Class by threshold, F in the cells."""
    named = rows.where(~F.col("species").isin(MICRO, MACRO)).withColumn("_t", F.call_function("format_number", F.col("confidence_threshold"), F.lit("0.00")))
    return named.groupBy("species").pivot("_t", [f"{t:.2f}" for t in thresholds]).agg(F.first("f_beta_score"))


def plot_frame(rows: DataFrame) -> DataFrame:
    """Rows with 0 in place of undefined rates."""
    return rows.na.fill(0.0, ["precision", "recall", "f_beta_score"])
