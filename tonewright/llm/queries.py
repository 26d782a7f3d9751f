"""Queries of the training-data operators and, where it can be told in SQL, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonewright.llm import percentiles as radix
from tonewright.llm.entities import match
from tonewright.llm.leakage import leaked_passages
from tonewright.llm.packing import pack
from tonewright.llm.runs import runs
from tonewright.llm.visible import consistent, look_classes, look_pairs
from tonewright.plans.tables import SQL_CODE, SQL_RECORDING, detections, table

PERCENTS = [1, 5, 25, 50, 75, 95, 99]


def _usable_confidence():
    c = F.col("confidence")
    return ~F.isnan(c) & c.between(0, 1)


def p1_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a detection and a label of the same vocalisation, with confidence."""
    return match(table(spark, sf_dir, "detections"), table(spark, sf_dir, "labels"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same pairs, ids only."""
    return p1_matches(spark, sf_dir).select("det_id", "label_id")


def p2_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact percentiles of confidence for every species, and for every species and day."""
    p = radix.percentiles(detections(spark, sf_dir), F.col("code"), F.col("recorded_on"), F.col("confidence"), PERCENTS, _usable_confidence())
    return p.select("scope", F.col("group").alias("species"), F.col("part").alias("recorded_on"), "percent", "n_values", "value")


def p2_merged_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles of every species from the merged histograms of single days, within 1/512."""
    days = radix.histogram(detections(spark, sf_dir), F.col("code"), F.col("recorded_on"), F.col("confidence"), _usable_confidence())
    return radix.estimate(radix.merge(days), ["group"], PERCENTS).withColumnRenamed("group", "species")


def p4_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All runs of detections, single ones too, one row each as in songs."""
    r = runs(detections(spark, sf_dir), "recording")
    return r.select(
        F.col("first_id").alias("first_det_id"), F.col("sequence").alias("recording"), F.col("label").alias("species"),
        F.col("start").alias("time_start"), F.col("end").alias("time_end"), "duration", F.col("events").alias("detections_merged"),
    )


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of two or more detections."""
    r = runs(detections(spark, sf_dir), "recording").where(F.col("events") >= 2)
    return r.select(F.col("first_id").alias("first_det_id"), F.col("events").alias("detections_merged"))


def p6_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The container of 2,048 tokens of every document or piece."""
    return pack(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def p6_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of containers, of tokens and the share of used space."""
    return p6_containers(spark, sf_dir).agg(
        (F.max("container_id") + 1).alias("containers"), F.sum("length").alias("tokens"), (F.sum("length") / ((F.max("container_id") + 1) * 2048)).alias("used")
    )


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that carry a passage of a test item."""
    hits = leaked_passages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))
    return hits.select(F.col("id").alias("doc_id"), F.col("item_id").alias("eval_id"))


def p7_leaked_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The test items that leaked, with their number of documents."""
    items = table(spark, sf_dir, "eval_items").select("eval_id", "suite", "lang")
    return p7_found(spark, sf_dir).groupBy("eval_id").agg(F.count(F.lit(1)).alias("documents")).join(items, "eval_id")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of documents that look the same but aren't the same string."""
    return look_pairs(table(spark, sf_dir, "documents")).select(F.col("id_a").alias("doc_id_a"), F.col("id_b").alias("doc_id_b"))


def p8_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class of every document by look, with the number of documents that look the same but differ."""
    return look_classes(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def p8_consistent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The consistent form of every text."""
    return table(spark, sf_dir, "documents").select("doc_id", consistent(F.col("text")).alias("text"))


def queries() -> dict:
    return {f.__name__: f for f in (p1_matches, p1_found, p2_percentiles, p2_merged_days, p4_runs, p4_found, p6_containers, p6_fill, p7_found, p7_leaked_items, p8_found, p8_classes, p8_consistent)}


_RUNS = f"""WITH r AS (SELECT {SQL_RECORDING} AS rec, det_id, lower(trim(species)) AS sp, confidence AS v, time_start AS t,
    CASE WHEN isfinite(time_end) AND time_end >= time_start THEN time_end ELSE time_start END AS e FROM detections WHERE isfinite(time_start)),
p AS (SELECT *, lag(sp) OVER w AS psp, lag(v) OVER w AS pv, lag(t) OVER w AS pt FROM r WHERE rec IS NOT NULL WINDOW w AS (PARTITION BY rec ORDER BY t, det_id)),
f AS (SELECT *, CASE WHEN sp = psp AND t - pt <= 0.5::DOUBLE AND NOT isnan(v) AND NOT isnan(pv) AND abs(v - pv) <= 0.05::DOUBLE THEN 0 ELSE 1 END AS opens FROM p),
k AS (SELECT *, sum(opens) OVER (PARTITION BY rec ORDER BY t, det_id ROWS UNBOUNDED PRECEDING) AS run FROM f),
g AS (SELECT rec, run, arg_min(det_id, (t, det_id)) AS first_det_id, arg_min(sp, (t, det_id)) FILTER (sp IS NOT NULL) AS species, min(t) AS time_start,
    arg_max(e, (t, det_id)) AS time_end, count(*) AS detections_merged FROM k GROUP BY rec, run)"""


def oracle_sql() -> dict[str, str]:
    percents = ", ".join(f"({p})" for p in PERCENTS)
    return {
        "p2_percentiles": f"""WITH d AS (SELECT {SQL_CODE} AS species, recorded_on, confidence AS v FROM detections WHERE confidence BETWEEN 0 AND 1),
s AS (SELECT 'all' AS scope, species, NULL::DATE AS recorded_on, v FROM d UNION ALL SELECT 'part', species, recorded_on, v FROM d),
u AS (SELECT *, row_number() OVER (PARTITION BY scope, species, recorded_on ORDER BY v) AS r, count(*) OVER (PARTITION BY scope, species, recorded_on) AS n
  FROM s WHERE species IS NOT NULL)
SELECT scope, species, recorded_on, q.percent::INTEGER AS percent, n AS n_values, v AS value
FROM u, (VALUES {percents}) AS q(percent) WHERE r = greatest(1, (q.percent * n + 99) // 100)""",
        "p4_runs": f"""{_RUNS}
SELECT first_det_id, rec AS recording, species, time_start, time_end, time_end - time_start AS duration, detections_merged FROM g""",
        "p4_found": f"{_RUNS}\nSELECT first_det_id, detections_merged FROM g WHERE detections_merged >= 2",
    }
