"""Command line: ``python -m tonewright.cli filter|sweep|confusion|detect|taxonomy ...``"""

from __future__ import annotations

import argparse
import importlib
import os

from pyspark.sql import functions as F

from tonewright.functions.naming import stem
from tonewright.operators import confusion, scores, songs, summaries, taxonomy
from tonewright.session import build_session
from tonewright.sources import readers, writers

#: With more classes than this the confusion matrix is written as its cells above 0, not as columns.
WIDEST = 10_000


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tonewright", description="Detections: filter and merge, score, confuse.")
    sub = p.add_subparsers(dest="task", required=True)
    f = sub.add_parser("filter", help="filter by confidence, then merge")
    f.add_argument("--input", required=True)
    f.add_argument("--output-path", required=True)
    f.add_argument("--conf", type=float, required=True)
    f.add_argument("--song-gap", type=float)
    f.add_argument("--output-format", choices=["json", "csv", "xc-json", "all"], default="all")
    s = sub.add_parser("sweep", help="F-beta over thresholds")
    s.add_argument("--detections", required=True)
    s.add_argument("--labels", required=True)
    s.add_argument("--conf-range", type=float, nargs=3, metavar=("MIN", "MAX", "STEP"), default=(0.0, 1.0, 0.01))
    s.add_argument("--beta", type=float, default=1.0)
    s.add_argument("--iou-threshold", type=float, default=0.5)
    s.add_argument("--song-gap", type=float)
    s.add_argument("--single-cls", action="store_true")
    s.add_argument("--single-cls-name", default="bird")
    s.add_argument("--no-optimal-matching", action="store_true")
    s.add_argument("--output-path", required=True)
    c = sub.add_parser("confusion", help="confusion matrix")
    c.add_argument("--detections", required=True, help="CSV of songs")
    c.add_argument("--labels", required=True)
    c.add_argument("--iou-threshold", type=float, default=0.5)
    c.add_argument("--use-1d-iou", action="store_true")
    c.add_argument("--no-background", action="store_true")
    c.add_argument("--single-cls", action="store_true")
    c.add_argument("--single-cls-name", default="bird")
    c.add_argument("--output-path", required=True)
    d = sub.add_parser("detect", help="run a detector over audio files")
    d.add_argument("--audio", required=True)
    d.add_argument("--detector", required=True, help="module:Class of a tonewright.operators.clips.Detector")
    d.add_argument("--species-dim", required=True, help="parquet with species_id and code")
    d.add_argument("--species-mapping", help="the mapping of the dimension to use, where it holds several")
    d.add_argument("--conf", type=float, default=0.2)
    d.add_argument("--nms-iou", type=float, default=0.7)
    d.add_argument("--song-gap", type=float, default=0.1)
    d.add_argument("--no-merge", action="store_true")
    d.add_argument("--output-path", required=True)
    d.add_argument("--output-format", choices=["json", "csv", "xc-json", "all"], default="all")
    t = sub.add_parser("taxonomy", help="lookup of names by code")
    t.add_argument("--input", required=True, help="sheet with rank, code and names: csv, parquet or a spreadsheet")
    t.add_argument("--output-path", required=True)
    return p


def _gap(spark, path: str, given: float | None, lines: bool) -> float:
    """The given gap, else that of the document, else 0.1."""
    if given is not None:
        return given
    row = readers.read_document(spark, path, lines).select("model_config.song_gap_threshold").where("song_gap_threshold is not null").first()
    return row[0] if row else 0.1


def _unit(value: float, name: str) -> None:
    if not 0 <= value <= 1:
        raise SystemExit(f"{name} must be between 0 and 1")


def main(argv: list[str] | None = None) -> None:
    a = _parser().parse_args(argv)
    for path in [getattr(a, n) for n in ("input", "detections", "labels", "audio") if hasattr(a, n)]:
        if "://" not in path and "*" not in path and not os.path.exists(path):
            raise SystemExit(f"{path} doesn't exist")
    for n in ("conf", "iou_threshold", "nms_iou"):
        if getattr(a, n, None) is not None:
            _unit(getattr(a, n), n)
    spark = build_session("tonewright", os.environ.get("SPARK_MASTER"))
    lines = lambda p: os.path.isdir(p)  # noqa: E731 - a folder holds what our writer puts
    with_stem = lambda df: df.withColumn("stem", stem(F.col("filename")))
    if a.task == "filter":
        det = readers.read_detections(spark, a.input, lines(a.input))
        gap = _gap(spark, a.input, a.song_gap, lines(a.input))
        summaries.filter_summary(det, a.conf, gap).show()
        merged = songs.filter_then_merge(det, a.conf, gap)
        config = readers.read_document(spark, a.input, lines(a.input)).select("model_config.*").first()
        limits = {"confidence_threshold": a.conf, "song_gap_threshold": gap}
        writers.save(merged, a.output_path, a.output_format, config.asDict() if config else {}, filtering=limits, original_count=det.count())
    elif a.task == "sweep":
        det = readers.read_detections(spark, a.detections, lines(a.detections))
        labels = readers.read_csv(spark, a.labels)
        grid = songs.threshold_grid(*a.conf_range)
        counts = scores.sweep_counts(det, labels, grid, a.iou_threshold, _gap(spark, a.detections, a.song_gap, lines(a.detections)), not a.no_optimal_matching, a.single_cls_name if a.single_cls else None)
        rows = scores.score_rows(counts, scores.threshold_table(spark, grid), a.beta).cache()
        for form in ("csv", "json"):
            writers.write_scores(rows, f"{a.output_path}/f{a.beta:g}_score_analysis.{form}", form)
        writers.write_scores(scores.best_thresholds(rows), f"{a.output_path}/optimal_thresholds.csv")
        scores.top_classes(rows, 12).show()
    elif a.task == "confusion":
        det, labels = with_stem(readers.read_csv(spark, a.detections, "det_id")), with_stem(readers.read_csv(spark, a.labels))
        if a.single_cls:
            det, labels = (x.withColumn("species", scores.single_class(F.col("species"), a.single_cls_name)) for x in (det, labels))
        cells = confusion.analyse(det, labels, a.iou_threshold, not a.use_1d_iou, not a.no_background, dense=True).cache()
        names = cells.select("true").distinct().orderBy("true")
        n = names.count()
        if n > WIDEST:
            writers.write_matrix(cells.where("n > 0"), f"{a.output_path}/confusion_cells.csv")
        else:
            matrix = confusion.wide(cells, [r["true"] for r in names.collect()])  # column names
            writers.write_matrix(matrix, f"{a.output_path}/confusion_matrix.csv")
            writers.write_matrix(confusion.prefixed(matrix), f"{a.output_path}/confusion_matrix_labelled.csv")
        species = [r["species"] for r in confusion.class_list(det, labels).limit(WIDEST).collect()] if n <= WIDEST else ["see confusion_cells.csv"]  # column names
        facts = {
            "detections_file": a.detections, "labels_file": a.labels, "iou_threshold": a.iou_threshold, "iou_type": "1D (time only)" if a.use_1d_iou else "2D (time-frequency)",
            "matching_method": "Optimal (Hungarian)", "include_background": not a.no_background, "num_detections": det.count(), "num_labels": labels.count(),
            "num_species": n - (not a.no_background), "species_list": ", ".join(species), "classes": n,
        }
        table = writers.score_table(confusion.class_scores(cells), confusion.average_scores(cells))
        table.coalesce(1).write.mode("overwrite").option("header", True).csv(f"{a.output_path}/f_beta_table.csv")
        writers.metadata_rows(spark, facts).coalesce(1).write.mode("overwrite").text(f"{a.output_path}/metadata.txt")
        summaries.dataset_statistics(det, labels).show(1000, False)
    elif a.task == "taxonomy":
        sheet = readers.drop_blank_rows(readers.read_taxonomy_sheet(spark, a.input))
        writers.taxonomy_json(taxonomy.taxonomy_map(sheet)).coalesce(1).write.mode("overwrite").text(a.output_path)
        taxonomy.warnings(sheet).show(60, False)
    else:
        from tonewright.operators.clips import boxes_to_detections, run_detector
        from tonewright.sources.audio import clips_of

        module, _, name = a.detector.partition(":")
        found = clips_of(readers.find_audio(spark, a.audio, content=True)).where("error is null")
        boxes = run_detector(found, getattr(importlib.import_module(module), name)(), a.conf, a.nms_iou)
        dim = spark.read.parquet(a.species_dim)
        if a.species_mapping:
            dim = taxonomy.species_mapping(dim, a.species_mapping)
        det = boxes_to_detections(boxes, dim)
        det = songs.confident(det.withColumn("det_id", F.monotonically_increasing_id()), a.conf)
        writers.save(det if a.no_merge else songs.reconstruct(det, a.song_gap), a.output_path, a.output_format, {"confidence_threshold": a.conf, "nms_iou_threshold": a.nms_iou, "song_gap_threshold": a.song_gap, "species_mapping": a.species_mapping, "model": a.detector})


if __name__ == "__main__":
    main()
