"""Species dimension and taxonomy."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tonewright.functions.text import clean_text, common_name, rgb_hex, scientific_name

REQUIRED = ("taxon_rank", "species_code_cornell_lab", "scientific_name", "english_name_avilist")


def species_rows(sheet: DataFrame) -> DataFrame:
    """Rows of rank species with a code: tidy code and names; an absent English name is the scientific one."""
    missing = [c for c in REQUIRED if c not in sheet.columns]
    if missing:
        raise KeyError(f"the sheet lacks the columns {missing}")
    tidy = sheet.where(F.lower(clean_text(F.col("taxon_rank"))) == "species").select(
        F.lower(F.trim("species_code_cornell_lab")).alias("code"),
        clean_text(F.col("scientific_name")).alias("scientific_name"),
        clean_text(F.col("english_name_avilist")).alias("english_name"),
        *[c for c in ("row_no",) if c in sheet.columns],
    )
    return tidy.where(F.col("code") != "").withColumn("english_name", F.when(F.col("english_name") != "", F.col("english_name")).otherwise(F.col("scientific_name")))


def taxonomy_map(sheet: DataFrame, order: str = "row_no") -> DataFrame:
    """One row per code, the first in the order of ``order``."""
    w = Window.partitionBy("code").orderBy(order)
    return species_rows(sheet).withColumn("_r", F.row_number().over(w)).where(F.col("_r") == 1).select("code", "scientific_name", "english_name")


def splits(sheet: DataFrame) -> DataFrame:
    """Codes with more than one pair of names."""
    pair = F.struct("scientific_name", "english_name")
    return species_rows(sheet).groupBy("code").agg(F.countDistinct(pair).alias("names")).where(F.col("names") > 1)


def merges(sheet: DataFrame) -> DataFrame:
    """Scientific names with more than one code; blank names don't count."""
    rows = species_rows(sheet).where(F.col("scientific_name") != "")
    return rows.groupBy("scientific_name").agg(F.array_join(F.array_sort(F.collect_set("code")), ", ").alias("codes"), F.countDistinct("code").alias("n")).where(F.col("n") > 1)


def warnings(sheet: DataFrame, n: int = 30) -> DataFrame:
    """The first ``n`` codes with several names and the first ``n`` names with several codes: ``kind, what, detail``."""
    split = splits(sheet).orderBy("code").limit(n).select(F.lit("split").alias("kind"), F.col("code").alias("what"), F.col("names").cast("string").alias("detail"))
    merged = merges(sheet).orderBy("scientific_name").limit(n).select(F.lit("merge").alias("kind"), F.col("scientific_name").alias("what"), F.col("codes").alias("detail"))
    return split.unionByName(merged)


def species_mapping(dim: DataFrame, name: str) -> DataFrame:
    """The rows of one mapping with split names and colour; an unknown name is an error that lists the known ones."""
    rows = dim.where(F.col("mapping") == name)
    if rows.isEmpty():
        known = [r["mapping"] for r in dim.select("mapping").distinct().orderBy("mapping").limit(100).collect()]
        raise ValueError(f"unknown mapping {name!r}; known: {', '.join(known)}")
    return rows.select(
        "species_id", "code", scientific_name(F.col("full_name")).alias("scientific_name"), common_name(F.col("full_name"), F.col("code")).alias("common_name"),
        rgb_hex(F.col("r"), F.col("g"), F.col("b")).alias("color"),
    )


def mapping_of_model(path: str, names: list[tuple[str, str]]) -> str | None:
    """Mapping for a model file: the first of (part of the name, mapping) that occurs in its stem."""
    from pathlib import Path

    model = Path(path).stem.lower().replace("_", "-")
    for part, mapping in names:
        if part.lower().replace("_", "-") in model:
            return f"{mapping}_subset" if "subset" in model else mapping
    return None


def with_code(boxes: DataFrame, dim: DataFrame, id_col: str = "cls") -> DataFrame:
    """The code of a class number; unknown numbers become ``unknown_<number>``."""
    d = dim.select(F.col("species_id").alias(id_col), "code")
    return boxes.join(d, id_col, "left").withColumn("species", F.coalesce("code", F.concat(F.lit("unknown_"), F.col(id_col).cast("string")))).drop("code")


def resolved_names(df: DataFrame, taxonomy: DataFrame, dim: DataFrame) -> DataFrame:
    """Scientific name by taxonomy, else by the mapping, else the code itself."""
    tax = taxonomy.select(F.col("code").alias("_c"), F.col("scientific_name").alias("_t"))
    names = dim.select(F.lower("code").alias("_d"), F.col("full_name").alias("_f")).dropDuplicates(["_d"])
    low = F.lower("species")
    out = df.join(tax, low == F.col("_c"), "left").join(names, low == F.col("_d"), "left")
    return out.withColumn("scientific_name", F.coalesce(F.when(F.col("_t") != "", F.col("_t")), scientific_name(F.col("_f")), "species")).drop("_c", "_t", "_d", "_f")


def coverage(df: DataFrame) -> DataFrame:
    """Sorted distinct scientific names in one string; as many as there are species."""
    return df.agg(F.array_join(F.array_sort(F.collect_set("scientific_name")), ", ").alias("taxon_coverage"))
