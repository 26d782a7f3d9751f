"""Reading the tables that queries run over."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonewright.functions.naming import recording, species_code


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """detections with ``recording`` (NULL without any name) and the tidy ``code``."""
    return table(spark, sf_dir, "detections").withColumns(
        {"recording": recording(F.col("filename"), F.col("file_path")), "code": species_code(F.col("species"))}
    )


#: The same in SQL, for the comparison queries.
SQL_RECORDING = r"""lower(regexp_replace(regexp_extract(regexp_replace(
  coalesce(CASE WHEN trim(filename) <> '' THEN filename END, CASE WHEN trim(file_path) <> '' THEN file_path END),
  '[/\\]+$', ''), '([^/\\]*)$', 1), '(.)[.][^.]+$', '\1'))"""
SQL_CODE = "CASE WHEN trim(species) <> '' THEN lower(trim(species)) END"
