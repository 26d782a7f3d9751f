"""Reading detections documents, CSV files, taxonomies and audio files."""

from __future__ import annotations

import time

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonewright.functions.naming import basename, blank_to_null
from tonewright.schema import AUDIO_EXTENSIONS, CSV_COLUMNS, DOCUMENT


def read_document(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """The documents themselves, one row each: one per file, or one per line as our writer puts them."""
    return spark.read.schema(DOCUMENT).option("multiLine", not lines).json(path)


def read_detections(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Rows of detections documents with file names filled in and a ``det_id`` (bigint, unique).

    Ids rise by document and place in it, so their order is that of the rows.
    """
    rows = read_document(spark, path, lines).select("audio_file", F.explode("detections").alias("_d")).select("audio_file", "_d.*")
    name = F.coalesce(blank_to_null(F.col("filename")), blank_to_null(basename(F.col("audio_file"))), blank_to_null(basename(F.col("file_path"))), F.lit("unknown"))
    return rows.withColumn("filename", name).withColumn("det_id", F.monotonically_increasing_id()).drop("audio_file")


def read_csv(spark: SparkSession, path: str, id_col: str = "label_id") -> DataFrame:
    """Label or detection CSV files: renamed columns, rows without species left out.

    Columns are found by header, so their order and further ones don't matter.
    """
    raw = spark.read.option("header", True).csv(path)
    absent = [c for c in CSV_COLUMNS if c not in raw.columns]
    if absent:
        raise ValueError(f"{path} lacks the columns {absent}")
    picked = [F.expr(f"try_cast(`{c}` AS {d.split()[1]})").alias(d.split()[0]) for c, d in CSV_COLUMNS.items()]
    if "Confidence" in raw.columns:
        picked.append(F.expr("try_cast(`Confidence` AS double)").alias("confidence"))
    return raw.select(*picked, F.monotonically_increasing_id().alias(id_col)).where(blank_to_null(F.col("species")).isNotNull())


def read_taxonomy_json(spark: SparkSession, path: str) -> DataFrame:
    """code, scientific_name, english_name of a lookup file; empty if there's none."""
    out = "code string, scientific_name string, english_name string"
    names = "map<string,struct<scientific_name:string,english_name:string>>"
    try:
        raw = spark.read.text(path, wholetext=True)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], out)
    text = raw.select(F.explode(F.from_json("value", names)).alias("code", "v"))
    return text.select("code", "v.scientific_name", "v.english_name")


def read_taxonomy_sheet(spark: SparkSession, path: str) -> DataFrame:
    """A taxonomy as CSV or parquet, or a spreadsheet where a reader for it is installed."""
    if path.lower().endswith((".xlsx", ".xls")):
        import pandas as pd

        for left in (4, 3, 2, 1, 0):
            try:
                sheet = pd.read_excel(path, dtype=str)
                break
            except ImportError as e:
                raise RuntimeError("reading spreadsheets needs openpyxl; save the sheet as CSV") from e
            except PermissionError:  # open in another program
                if not left:
                    raise
                time.sleep(1)
        df = spark.createDataFrame(sheet.where(sheet.notna(), None))
    elif path.lower().endswith(".csv"):
        df = spark.read.option("header", True).csv(path)
    else:
        df = spark.read.parquet(path)
    lower = df.toDF(*[c.lower() for c in df.columns])
    return lower if "row_no" in lower.columns else lower.withColumn("row_no", F.monotonically_increasing_id())


def find_audio(spark: SparkSession, path: str, content: bool = False) -> DataFrame:
    """Audio files below a path by extension in any case: ``path, length[, content]``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    wanted = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(*AUDIO_EXTENSIONS)
    return files.where(wanted).select("path", "length", *["content"] * content)


def drop_blank_rows(df: DataFrame) -> DataFrame:
    """Blank texts become NULL, and rows of NULLs only are left out."""
    tidy = df.select(*[blank_to_null(F.col(f"`{c}`")).alias(c) if t == "string" else F.col(f"`{c}`") for c, t in df.dtypes])
    return tidy.na.drop("all")


def within(df: DataFrame, seconds: float = 600.0) -> DataFrame:
    """Only clips that end within the first seconds of a recording."""
    return df.where(F.col("clip_end") <= F.lit(float(seconds)))
