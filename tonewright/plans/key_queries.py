"""Queries over intervals per key and over unevenly spread keys (problems 3 and 5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonewright.operators.intervals import periods, periods_and_gaps
from tonewright.operators.skew import busy_keys, key_quantiles
from tonewright.plans.tables import SQL_CODE, SQL_RECORDING, detections

PERCENTS = [1, 5, 25, 50, 75, 95, 99]


def _usable(c):
    return ~F.isnan(c) & c.between(0, 1)


def _keys():
    return {"species": F.col("code"), "filename": F.col("recording")}


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periods and gaps up to 600 s of every recording and species_id, in milliseconds."""
    rows = periods_and_gaps(detections(spark, sf_dir), ["recording", "species_id"], gap=0.1, longest_gap=600.0)
    ms = lambda c: F.floor(F.col(c) * 1000).cast("long")
    return rows.select("kind", "recording", "species_id", ms("start").alias("start_ms"), ms("end").alias("end_ms"))


def p3_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of periods and covered milliseconds of every recording and species_id."""
    p = periods(detections(spark, sf_dir), ["recording", "species_id"], gap=0.1)
    return p.groupBy("recording", "species_id").agg(
        F.count(F.lit(1)).alias("periods"),
        F.sum(F.floor(F.col("end") * 1000) - F.floor(F.col("start") * 1000)).cast("long").alias("covered_ms"),
    )


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The species and recordings that hold at least 3 % of all rows."""
    c = F.col("confidence")
    return busy_keys(detections(spark, sf_dir), _keys(), 0.03, value=c, valid=_usable(c)).select("key_field", "key_value")


def p5_key_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact percentiles of the confidence for every species and every recording."""
    c = F.col("confidence")
    return key_quantiles(detections(spark, sf_dir), _keys(), c, PERCENTS, _usable(c))


def queries() -> dict:
    return {f.__name__: f for f in (p3_found, p3_coverage, p5_found, p5_key_quantiles)}


_BASE = f"""d AS (SELECT *, {SQL_RECORDING} AS recording, {SQL_CODE} AS code FROM detections)"""
_PERIODS = f"""WITH {_BASE},
r AS (SELECT recording, species_id, time_start AS s, time_end AS e FROM d
  WHERE recording IS NOT NULL AND species_id IS NOT NULL AND isfinite(time_start) AND isfinite(time_end) AND time_end >= time_start),
m AS (SELECT *, max(e) OVER (PARTITION BY recording, species_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM r),
n AS (SELECT *, sum(CASE WHEN s - before <= 0.1::DOUBLE THEN 0 ELSE 1 END) OVER (PARTITION BY recording, species_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS k FROM m),
p AS (SELECT recording, species_id, k, min(s) AS s, max(e) AS e FROM n GROUP BY ALL)"""


def oracle_sql() -> dict[str, str]:
    percents = ", ".join(f"({p})" for p in PERCENTS)
    return {
        "p3_found": f"""{_PERIODS},
g AS (SELECT recording, species_id, lag(e) OVER (PARTITION BY recording, species_id ORDER BY k) AS s, s AS e FROM p)
SELECT 'period' AS kind, recording, species_id, floor(s * 1000)::BIGINT AS start_ms, floor(e * 1000)::BIGINT AS end_ms FROM p
UNION ALL
SELECT 'gap', recording, species_id, floor(s * 1000)::BIGINT, floor(e * 1000)::BIGINT FROM g WHERE s IS NOT NULL AND e - s <= 600""",
        "p3_coverage": f"""{_PERIODS}
SELECT recording, species_id, count(*) AS periods, sum(floor(e * 1000) - floor(s * 1000))::BIGINT AS covered_ms FROM p GROUP BY ALL""",
        "p5_found": f"""WITH {_BASE},
k AS (SELECT 'species' AS key_field, code AS key_value FROM d UNION ALL SELECT 'filename', recording FROM d)
SELECT key_field, key_value FROM k WHERE key_value IS NOT NULL GROUP BY ALL HAVING count(*) >= 0.03 * (SELECT count(*) FROM detections)""",
        "p5_key_quantiles": f"""WITH {_BASE},
k AS (SELECT 'species' AS key_field, code AS key_value, confidence AS v FROM d UNION ALL SELECT 'filename', recording, confidence FROM d),
u AS (SELECT *, row_number() OVER (PARTITION BY key_field, key_value ORDER BY v) AS r, count(*) OVER (PARTITION BY key_field, key_value) AS n
  FROM k WHERE key_value IS NOT NULL AND v BETWEEN 0 AND 1)
SELECT key_field, key_value, q.percent::INTEGER AS percent, n AS n_values, v AS value
FROM u, (VALUES {percents}) AS q(percent) WHERE r = greatest(1, (q.percent * n + 99) // 100)""",
    }
