"""Confusion counts between predicted and true class, with a background class."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tonewright.operators.matching import common_files, edges, one_to_one
from tonewright.session import cut

BACKGROUND = "background"


def class_list(det: DataFrame, lab: DataFrame) -> DataFrame:
    """Sorted distinct species of both sides, blank ones removed."""
    both = det.select("species").union(lab.select("species")).where(F.trim("species") != "")
    return both.distinct().orderBy("species")


def matches(det: DataFrame, lab: DataFrame, iou: float = 0.5, boxes: bool = True, optimal: bool = True) -> DataFrame:
    """One-to-one matches per file, whatever the classes: ``stem, det_id, label_id, iou``."""
    return one_to_one(edges(det, lab, ["stem"], iou, boxes), ["stem"], optimal)


def confusion(det: DataFrame, lab: DataFrame, matched: DataFrame, background: bool = True, dense: bool = False) -> DataFrame:
    """``pred, true, n``: matched pairs, and unmatched rows against the background.

    ``dense`` adds the empty cells (the classes squared, not the data).
    """
    d = det.select("det_id", F.col("species").alias("pred")).where(F.trim("pred") != "")
    lb = lab.select("label_id", F.col("species").alias("true")).where(F.trim("true") != "")
    m = matched.select("det_id", "label_id")
    pairs = m.join(d, "det_id").join(lb, "label_id").select("pred", "true")
    if background:
        pairs = pairs.unionByName(d.join(m, "det_id", "left_anti").select("pred", F.lit(BACKGROUND).alias("true"))).unionByName(
            lb.join(m, "label_id", "left_anti").select(F.lit(BACKGROUND).alias("pred"), "true")
        )
    cells = pairs.groupBy("pred", "true").agg(F.count(F.lit(1)).alias("n"))
    if not dense:
        return cells
    names = class_list(det, lab).select("species")
    if background:
        names = names.union(names.sparkSession.createDataFrame([(BACKGROUND,)], "species string"))
    grid = names.select(F.col("species").alias("pred")).crossJoin(names.select(F.col("species").alias("true")))  # classes only
    return grid.join(cells, ["pred", "true"], "left").na.fill(0, ["n"])


def analyse(det: DataFrame, lab: DataFrame, iou: float = 0.5, boxes: bool = True, background: bool = True, optimal: bool = True, dense: bool = False) -> DataFrame:
    """Restriction to common files, matching and counting in one call; an empty side is an error."""
    if det.isEmpty() or lab.isEmpty():
        raise ValueError("need detections and labels to analyse")
    det, lab = common_files(det, lab)
    return confusion(det, lab, matches(det, lab, iou, boxes, optimal), background, dense)


def wide(cells: DataFrame, classes: list[str]) -> DataFrame:
    """One row per predicted class, one column per true class."""
    return cells.groupBy("pred").pivot("true", classes).agg(F.sum("n")).na.fill(0)


def square(cells: DataFrame) -> DataFrame:
    """The wide matrix with a row and a column for every class of the cells, those of one side included."""
    cells = cut(cells)
    names = cells.select(F.explode(F.array("pred", "true")).alias("pred")).distinct().withColumn("true", F.col("pred")).withColumn("n", F.lit(0).cast("long"))
    return wide(cells.unionByName(names), [r["pred"] for r in names.orderBy("pred").collect()])  # column names


def prefixed(matrix: DataFrame) -> DataFrame:
    """The wide matrix with ``pred_`` before row names and ``true_`` before column names."""
    named = matrix.withColumn("pred", F.concat(F.lit("pred_"), "pred"))
    return named.select("pred", *[F.col("`" + c.replace("`", "``") + "`").alias(f"true_{c}") for c in matrix.columns if c != "pred"])


def normalised(cells: DataFrame) -> DataFrame:
    """Shares of each true class; columns without rows stay 0."""
    total = F.sum("n").over(Window.partitionBy("true"))
    return cells.withColumn("share", F.col("n") / F.greatest(total, F.lit(1)))


def class_scores(cells: DataFrame, beta: float = 1.0) -> DataFrame:
    """Per class: precision, recall and F from the matrix; undefined rates are 0; background is left out."""
    tp = cells.where(F.col("pred") == F.col("true")).select(F.col("pred").alias("species"), F.col("n").alias("tp"))
    row = cells.groupBy(F.col("pred").alias("species")).agg(F.sum("n").alias("predicted"))
    col = cells.groupBy(F.col("true").alias("species")).agg(F.sum("n").alias("actual"))
    s = row.join(col, "species", "full_outer").join(tp, "species", "left").na.fill(0, ["tp", "predicted", "actual"])
    p = F.coalesce(F.try_divide("tp", "predicted"), F.lit(0.0))
    r = F.coalesce(F.try_divide("tp", "actual"), F.lit(0.0))
    b = F.lit(float(beta) ** 2)
    return (
        s.where(F.col("species") != BACKGROUND)
        .withColumn("precision", p)
        .withColumn("recall", r)
        .select(
            "species", "precision", "recall",
            F.coalesce(F.try_divide((1 + b) * F.col("precision") * F.col("recall"), b * F.col("precision") + F.col("recall")), F.lit(0.0)).alias("f_beta"),
            F.col("tp").alias("true_positives"), (F.col("predicted") - F.col("tp")).alias("false_positives"), (F.col("actual") - F.col("tp")).alias("false_negatives"),
        )
    )


def average_scores(cells: DataFrame, beta: float = 1.0) -> DataFrame:
    """macro, weighted and micro averages; weights are shares of all true rows, background included."""
    s = class_scores(cells, beta)
    total = cells.agg(F.sum("n").alias("_all"))
    both = s.join(F.broadcast(total))  # one row
    sums = both.agg(
        F.coalesce(F.avg("f_beta"), F.lit(0.0)).alias("macro"),
        F.coalesce(F.sum(F.try_divide((F.col("true_positives") + F.col("false_negatives")), "_all") * F.col("f_beta")), F.lit(0.0)).alias("weighted"),
        F.sum("true_positives").alias("tp"), F.sum("false_positives").alias("fp"), F.sum("false_negatives").alias("fn"),
    )
    b = F.lit(float(beta) ** 2)
    p = F.coalesce(F.try_divide("tp", F.col("tp") + F.col("fp")), F.lit(0.0))
    r = F.coalesce(F.try_divide("tp", F.col("tp") + F.col("fn")), F.lit(0.0))
    micro = F.coalesce(F.try_divide((1 + b) * p * r, b * p + r), F.lit(0.0))
    return sums.select(
        F.explode(F.array(*[F.struct(F.lit(n).alias("average"), c.alias("f_beta")) for n, c in (("MACRO_AVERAGE", F.col("macro")), ("WEIGHTED_AVERAGE", F.col("weighted")), ("MICRO_AVERAGE", micro))])).alias("x")
    ).select("x.average", "x.f_beta")
