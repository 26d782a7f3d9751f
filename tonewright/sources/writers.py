"""Writing detections, songs, scores, matrices and annotation sets."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonewright.functions.naming import blank_to_null
from tonewright.functions.text import fixed, recording_number, rounded, sound_file
from tonewright.schema import CSV_COLUMNS
from tonewright.session import cut

SONG_COLUMNS = ("species", "species_id", "time_start", "time_end", "avg_confidence", "max_confidence", "detections_merged", "freq_low_hz", "freq_high_hz", "filename")


def csv_rows(df: DataFrame, audio_path: str | None = None, confidence: bool = True) -> DataFrame:
    """Rows as text: times with one, confidences with three decimals."""
    names = [blank_to_null(F.col("filename"))] if "filename" in df.columns else []
    name = F.coalesce(*names, F.lit(audio_path and audio_path.rstrip("/").rsplit("/", 1)[-1]).cast("string"), F.lit("unknown"))
    texts = [name, fixed(F.col("time_start"), 1), fixed(F.col("time_end"), 1), F.col("freq_low_hz").cast("string"), F.col("freq_high_hz").cast("string"), F.col("species")]
    out = [c.alias(n) for c, n in zip(texts, CSV_COLUMNS)]
    if confidence:
        value = [F.col(c) for c in ("avg_confidence", "confidence") if c in df.columns]
        out.append(fixed(F.coalesce(*value), 3).alias("Confidence"))
    return df.select(*out)


def write_csv(df: DataFrame, path: str, audio_path: str | None = None, confidence: bool = True) -> None:
    csv_rows(df, audio_path, confidence).write.mode("overwrite").option("header", True).csv(path)


def numbered(df: DataFrame, *order: Column | str) -> DataFrame:
    """``df`` with a running ``number`` from 1 in the given order.

    Rows are dealt into ranges of the order and sorted there; only the number of rows of
    each range reaches the driver. Rows equal in the order follow one another in any order.
    """
    parts = cut(df.repartitionByRange(*order).sortWithinPartitions(*order)).withColumn("_m", F.monotonically_increasing_id())
    counts = parts.groupBy(F.shiftright("_m", 33).alias("part")).agg(F.count(F.lit(1)).alias("n")).orderBy("part").collect()  # one row per range
    before, offsets = 0, []
    for r in counts:
        offsets += [F.lit(int(r["part"])), F.lit(before)]
        before += r["n"]
    if not offsets:
        return parts.withColumn("number", F.lit(None).cast("long")).drop("_m")
    place = F.element_at(F.create_map(*offsets), F.shiftright("_m", 33).cast("int"))
    return parts.withColumn("number", (place + F.col("_m").bitwiseAND(F.lit(2**33 - 1)) + 1).cast("long")).drop("_m")


def documents(df: DataFrame, config: dict, per_file: bool = True, original_count: int | None = None, filtering: dict | None = None, most: int = 50_000) -> DataFrame:
    """Detections documents as JSON text: ``filename, value``.

    One document per file, or with ``per_file=False`` documents over several files (``filename``
    NULL) that list them. A document has at most ``most`` detections, in order of file, time
    and det_id; more go on in the next document of the file or set, numbered in ``part_no``,
    so that no task ever holds a whole busy recording. Readers take their union.
    ``filtering`` and ``original_count`` are added to documents of filtered detections.
    """
    rows = [c for c in df.columns if c != "det_id"]
    named = df.withColumn("_file", F.coalesce("filename", F.lit("unknown")))
    listed = numbered(named, "_file", *[c for c in ("time_start", "time_end", "species_id", "det_id") if c in df.columns])
    key = ["_file"] if per_file else []
    if per_file:
        first = listed.groupBy("_file").agg(F.min("number").alias("_first"))
        listed = listed.join(first, "_file")
    else:
        listed = listed.withColumn("_first", F.lit(1))
    listed = listed.withColumn("part_no", F.floor((F.col("number") - F.col("_first")) / F.lit(most)))
    grouped = listed.groupBy(*key, "part_no").agg(
        F.sort_array(F.collect_list(F.struct("number", F.struct(*rows).alias("_r")))).alias("_all"), F.array_sort(F.collect_set("_file")).alias("_files")
    )
    head = F.struct(*[F.lit(config.get(k)).cast(t).alias(k) for k, t in (("model", "string"), ("confidence_threshold", "double"), ("nms_iou_threshold", "double"), ("song_gap_threshold", "double"), ("species_mapping", "string"))])
    parts: list[Column] = [F.col("_file").alias("audio_file")] if per_file else [F.col("_files").alias("audio_files"), F.size("_files").alias("file_count")]
    parts.append(head.alias("model_config"))
    if filtering is not None:
        parts.append(F.struct(*[F.lit(float(v)).alias(k) for k, v in filtering.items()]).alias("filtering_config"))
    if original_count is not None:
        parts.append(F.lit(original_count).alias("original_detection_count"))
    parts += ["part_no", F.size("_all").alias("detection_count"), F.transform("_all", lambda x: x["_r"]).alias("detections")]
    return grouped.select((F.col("_file") if per_file else F.lit(None).cast("string")).alias("filename"), F.to_json(F.struct(*parts)).alias("value"))


def write_documents(df: DataFrame, path: str, config: dict, **more) -> None:
    documents(df, config, **more).select("value").write.mode("overwrite").text(path)


def annotation_rows(df: DataFrame, scientific: Column, prefix: str = "segment", audio: str = "", annotator: str = "", software: str = "tonewright", on: date | None = None) -> DataFrame:
    """One annotation per song, in the order of files and times, with a running id.

    Ids come from :func:`numbered`, so an export of any size is written by many tasks.
    """
    name = sound_file(F.col("filename"), F.lit(""), F.lit(audio))
    value = F.coalesce(*[F.col(c) for c in ("avg_confidence", "confidence", "max_confidence") if c in df.columns])
    said = F.when(value.isNotNull(), F.concat(F.lit("; confidence: "), fixed(value, 3))).otherwise(F.lit(""))
    remarks = F.concat(F.lit(f"Detected by {software}; eBird code: "), F.coalesce("species", F.lit("")), said)
    order = ["filename", "time_start", "time_end", "species_id", "freq_low_hz", *[c for c in ("det_id", "song_id") if c in df.columns]]
    return numbered(df, *order).select(
        "number",
        F.concat(F.lit(prefix + "-"), F.when(F.col("number") < 1_000_000, F.lpad(F.col("number").cast("string"), 6, "0")).otherwise(F.col("number").cast("string"))).alias("annotation_source_id"),
        name.alias("sound_file"),
        recording_number(name).alias("xc_nr"),
        F.lit(annotator or software).alias("annotator"),
        F.lit("").alias("annotator_xc_id"),
        rounded(F.col("freq_high_hz")).alias("frequency_high"),
        rounded(F.col("freq_low_hz")).alias("frequency_low"),
        rounded(F.col("time_start")).alias("start_time"),
        rounded(F.col("time_end")).alias("end_time"),
        scientific.alias("scientific_name"),
        F.lit("call").alias("sound_type"),
        F.lit((on or date.today()).isoformat()).alias("date_identified"),
        remarks.alias("annotation_remarks"),
    )


def annotation_set(rows: DataFrame, name: str, software: str = "tonewright", creator: str = "", most: int = 50_000) -> DataFrame:
    """The nested annotation documents as JSON text, of at most ``most`` annotations each, in their order.

    The scope names the taxa of the whole set, or 'birds' where none is known.
    """
    fields = [c for c in rows.columns if c != "number"]
    chunks = rows.groupBy(F.floor((F.col("number") - 1) / F.lit(most)).alias("_part")).agg(F.sort_array(F.collect_list(F.struct("number", F.struct(*fields).alias("_r")))).alias("_all"))
    taxa = rows.agg(F.array_join(F.array_sort(F.collect_set(F.when(F.col("scientific_name") != "", F.col("scientific_name")))), ", ").alias("_taxa"))  # as many as there are taxa
    scope = F.array(F.struct(F.when(F.col("_taxa") != "", F.col("_taxa")).otherwise(F.lit("birds")).alias("taxon_coverage"), F.lit("part").alias("completeness")))
    # fixed values: names of the format's fields
    texts = {
        "set_source": f"{software} detection results", "set_uri": "", "set_name": name, "annotation_software_name_and_version": software, "set_creator": creator or software,
        "set_creator_id": "", "set_owner": "", "set_license": "", "project_uri": "", "project_name": software, "funding": "", "set_remarks": f"Generated from {software} detections.",
    }
    document = F.struct(*[F.lit(v).alias(k) for k, v in texts.items()], scope.alias("scope"), F.transform("_all", lambda x: x["_r"]).alias("annotations"))
    return chunks.join(F.broadcast(taxa)).orderBy("_part").select(F.to_json(document, {"ignoreNullFields": "false"}).alias("value"))


def write_scores(rows: DataFrame, path: str, form: str = "csv") -> None:
    if form not in ("csv", "json"):
        raise ValueError("form must be csv or json")
    out = rows.orderBy("confidence_threshold", "species").coalesce(1).write.mode("overwrite")
    out.option("header", True).csv(path) if form == "csv" else out.json(path)


def write_matrix(matrix: DataFrame, path: str) -> None:
    matrix.orderBy("pred").coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def metadata_rows(spark, facts: dict) -> DataFrame:
    return spark.createDataFrame([(f"{k}: {v}",) for k, v in facts.items()], "value string")


def score_table(per_class: DataFrame, averages: DataFrame) -> DataFrame:
    """Class rows, then the three averages with their names as species."""
    return per_class.unionByName(averages.select(F.col("average").alias("species"), "f_beta"), allowMissingColumns=True)


def taxonomy_json(taxonomy: DataFrame) -> DataFrame:
    """{code: names} as one JSON text; a taxonomy is a small dimension."""
    entry = F.struct("code", F.struct("scientific_name", "english_name").alias("v"))
    return taxonomy.agg(F.to_json(F.map_from_entries(F.sort_array(F.collect_list(entry)))).alias("value"))


def save(df: DataFrame, base: str, form: str, config: dict | None = None, scientific: Column | None = None, filtering: dict | None = None, original_count: int | None = None, per_file: bool = True) -> list[str]:
    """Write as json, csv, xc-json or all of them; the form is appended to the base path."""
    if form not in ("json", "csv", "xc-json", "all"):
        raise ValueError(f"unknown format {form!r}")
    wrote = []
    if form in ("json", "all"):
        write_documents(df, f"{base}.json", config or {}, filtering=filtering, original_count=original_count, per_file=per_file)
        wrote.append(f"{base}.json")
    if form in ("csv", "all"):
        write_csv(df, f"{base}.csv")
        wrote.append(f"{base}.csv")
    if form in ("xc-json", "all"):
        rows = annotation_rows(df, scientific if scientific is not None else F.col("species"))
        annotation_set(rows, base.rsplit("/", 1)[-1]).write.mode("overwrite").text(f"{base}_xc.json")
        wrote.append(f"{base}_xc.json")
    return wrote
