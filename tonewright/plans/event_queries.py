"""Queries over detections, songs, labels and their dimensions, each with its SQL where SQL can tell it."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonewright.functions import geometry as geo
from tonewright.functions import text as txt
from tonewright.functions.naming import basename, finite, recording, species_code, stem
from tonewright.operators import clips, confusion, scores, songs, summaries, taxonomy
from tonewright.operators.matching import common_files, edges, mutual_best, one_to_one, unmatched
from tonewright.operators.sweep import per_threshold, song_versions
from tonewright.plans.matching_sql import sql_greedy, sql_optimal, sql_suppressed
from tonewright.plans.tables import SQL_CODE, table
from tonewright.session import cut
from tonewright.sources import writers
from tonewright.streaming.songs import stream_songs

LEAST, GAP, IOU = 0.2, 0.1, 0.25
FINE = songs.threshold_grid()


def _file_key(filename):
    """Stem in lower case: these tables name one file in several ways."""
    return recording(filename, F.lit(None).cast("string"))


def _det(spark: SparkSession, d: str) -> DataFrame:
    """Detections with a tidy species, a file name and its stem, as raw rows of the pipeline."""
    rows = songs.backfill_filename(table(spark, d, "detections"))
    return rows.withColumn("species", species_code(F.col("species"))).withColumn("stem", _file_key(F.col("filename")))


def _lab(spark: SparkSession, d: str) -> DataFrame:
    """Labels with a tidy species and stem; labels without species are left out."""
    rows = table(spark, d, "labels").withColumn("species", species_code(F.col("species"))).where(F.col("species").isNotNull())
    return rows.withColumn("stem", _file_key(F.col("filename")))


def _songs(spark: SparkSession, d: str) -> DataFrame:
    """Songs with their stem; ``det_id`` is that of their first row."""
    return songs.filter_then_merge(_det(spark, d), LEAST, GAP, with_id=True).withColumn("stem", _file_key(F.col("filename")))


_BASE_NAME = r"nullif(regexp_extract(regexp_replace({}, '[/\\]+$', ''), '([^/\\]*)$', 1), '')"
_STEM = r"lower(regexp_replace(regexp_extract(regexp_replace({}, '[/\\]+$', ''), '([^/\\]*)$', 1), '(.)[.][^.]+$', '\1'))"
_DET = f"""det AS (SELECT det_id, CASE WHEN trim(filename) <> '' THEN filename ELSE coalesce({_BASE_NAME.format('file_path')}, 'unknown') END AS filename,
  {SQL_CODE} AS species, species_id, confidence, time_start, time_end, freq_low_hz, freq_high_hz, clip_start, clip_end FROM detections)"""
_LAB = f"""lab AS (SELECT label_id, filename, {_STEM.format('filename')} AS stem, {SQL_CODE} AS species, time_start, time_end, freq_low_hz, freq_high_hz
  FROM labels WHERE trim(species) <> '')"""


def _sql_songs(source: str, more: str = "") -> str:
    """CTEs m, k, songs over a source of raw rows; ``more`` are further key columns with a comma."""
    key = f"{more}filename, species_id"
    return f"""m AS (SELECT *, max(time_end) OVER (PARTITION BY {key} ORDER BY time_start, det_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before
  FROM {source} WHERE time_start IS NOT NULL AND time_end IS NOT NULL),
k AS (SELECT *, sum(CASE WHEN time_start - before <= {GAP}::DOUBLE THEN 0 ELSE 1 END) OVER (PARTITION BY {key} ORDER BY time_start, det_id ROWS UNBOUNDED PRECEDING) AS song FROM m),
songs AS (SELECT {key}, song, arg_min(det_id, (time_start, det_id)) AS det_id, arg_min(coalesce(species, '~'), (time_start, det_id)) AS sp, min(time_start) AS time_start, max(time_end) AS time_end,
  avg(confidence) AS avg_confidence, max(confidence) AS max_confidence, count(*) AS detections_merged, min(freq_low_hz) AS freq_low_hz, max(freq_high_hz) AS freq_high_hz
  FROM k GROUP BY {key}, song)"""


_KEPT = f"kept AS (SELECT * FROM det WHERE coalesce(confidence, 0) >= {LEAST}::DOUBLE AND NOT isnan(coalesce(confidence, 0)))"
_WITH_SONGS = f"""WITH {_DET}, {_KEPT}, {_sql_songs('kept')},
song AS (SELECT *, nullif(sp, '~') AS species, {_STEM.format('filename')} AS stem FROM songs)"""
_SONG_OUT = """filename, species, species_id, time_start, time_end, round(avg_confidence, 6) AS avg_confidence, max_confidence,
  detections_merged, freq_low_hz, freq_high_hz"""

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


# --- filtering and merging ---------------------------------------------------------------


@query(f"{_WITH_SONGS} SELECT {_SONG_OUT} FROM song")
def reconstruct_songs(spark, d):
    return _songs(spark, d).drop("stem", "det_id").withColumn("avg_confidence", F.round("avg_confidence", 6))


@query(f"WITH {_DET}, {_KEPT} SELECT det_id, filename, species, confidence FROM kept")
def conf_filter(spark, d):
    return songs.confident(_det(spark, d), LEAST).select("det_id", "filename", "species", "confidence")


@query("""SELECT count(*) AS detections, min(c) AS least, max(c) AS greatest, round(avg(c), 6) AS mean
FROM (SELECT CASE WHEN NOT isnan(confidence) THEN confidence END AS c FROM detections)""")
def conf_stats(spark, d):
    return summaries.confidence_stats(table(spark, d, "detections")).withColumn("mean", F.round("mean", 6))


@query(f"{_WITH_SONGS} SELECT (SELECT count(*) FROM det) AS original, (SELECT count(*) FROM kept) AS filtered, (SELECT count(*) FROM song) AS merged")
def filter_summary(spark, d):
    return summaries.filter_summary(_det(spark, d), LEAST, GAP)


@query(f"""{_WITH_SONGS} SELECT species, count(*) AS n, round(avg(time_end - time_start), 6) AS mean_duration, round(avg(detections_merged), 6) AS mean_merged FROM song GROUP BY ALL""")
def detection_summary(spark, d):
    return summaries.detection_summary(_songs(spark, d)).withColumns({c: F.round(c, 6) for c in ("mean_duration", "mean_merged")})


@query(f"""{_WITH_SONGS} SELECT species, count(*) AS n, round(avg(max_confidence), 6) AS mean, min(max_confidence) AS least, max(max_confidence) AS greatest FROM song GROUP BY ALL""")
def song_confidence(spark, d):
    return summaries.song_confidence(_songs(spark, d)).withColumn("mean", F.round("mean", 6))


@query(f"WITH {_DET} SELECT species, count(*) AS n FROM det GROUP BY ALL")
def species_counts(spark, d):
    return summaries.species_counts(_det(spark, d))


@query(f"WITH {_DET} SELECT species, count(*) AS n FROM det GROUP BY ALL ORDER BY n DESC, species NULLS FIRST LIMIT 10")
def top_species_counts(spark, d):
    return summaries.species_counts(_det(spark, d), 10)


@query(f"""{_WITH_SONGS} SELECT count(*) AS songs, count(DISTINCT species) AS species, round(avg(avg_confidence), 6) AS mean_confidence, round(sum(time_end - time_start), 3) AS duration FROM song""")
def web_metrics(spark, d):
    return summaries.headline(_songs(spark, d)).withColumns({"mean_confidence": F.round("mean_confidence", 6), "duration": F.round("duration", 3)})


@query(f"""{_WITH_SONGS}, r AS (SELECT species, filename, species_id, time_start, time_end,
  row_number() OVER (PARTITION BY species ORDER BY filename, time_start, time_end, species_id) AS row_no FROM song) SELECT * FROM r WHERE row_no <= 5""")
def first_n_per_species(spark, d):
    order = [F.col(c) for c in ("filename", "time_start", "time_end")] + [F.col("species_id").asc_nulls_last()]
    return songs.first_n(_songs(spark, d), "species", 5, order).select("species", "filename", "species_id", "time_start", "time_end", "row_no")


@query(f"WITH {_DET} SELECT det_id, CASE WHEN trim(species) <> '' THEN 'bird' ELSE species END AS species FROM det")
def single_class_remap(spark, d):
    return _det(spark, d).select("det_id", scores.single_class(F.col("species")).alias("species"))


@query(f"""SELECT det_id, regexp_replace(regexp_extract(regexp_replace(file_path, '[/\\\\]+$', ''), '([^/\\\\]*)$', 1), '(.)[.][^.]+$', '\\1') AS stem,
  {_BASE_NAME.format('file_path')} AS base FROM detections WHERE file_path IS NOT NULL""")
def filename_stem(spark, d):
    rows = table(spark, d, "detections").where(F.col("file_path").isNotNull())
    return rows.select("det_id", stem(F.col("file_path")).alias("stem"), basename(F.col("file_path")).alias("base"))


@query(f"WITH {_DET} SELECT det_id, filename FROM det")
def filename_backfill(spark, d):
    return _det(spark, d).select("det_id", "filename")


@query(f"""{_WITH_SONGS}, {_LAB}, f AS (SELECT DISTINCT stem FROM song INTERSECT SELECT DISTINCT stem FROM lab)
SELECT 'song' AS side, stem, count(*) AS n FROM song WHERE stem IN (SELECT stem FROM f) GROUP BY ALL
UNION ALL SELECT 'label', stem, count(*) FROM lab WHERE stem IN (SELECT stem FROM f) GROUP BY ALL""")
def common_file_rows(spark, d):
    a, b = common_files(_songs(spark, d), _lab(spark, d))
    count = lambda df, n: df.groupBy("stem").agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("side"), "stem", "n")
    return count(a, "song").unionByName(count(b, "label"))


@query(f"""{_WITH_SONGS}, {_LAB}, s AS (SELECT species, 1 AS a, 0 AS b FROM song WHERE trim(species) <> '' UNION ALL SELECT species, 0, 1 FROM lab)
SELECT species, sum(a)::BIGINT AS detections, sum(b)::BIGINT AS labels FROM s GROUP BY species
UNION ALL SELECT 'Total', sum(a)::BIGINT, sum(b)::BIGINT FROM s""")
def dataset_statistics(spark, d):
    return summaries.dataset_statistics(_songs(spark, d), _lab(spark, d))


@query(f"""{_WITH_SONGS}, {_LAB}, f AS (SELECT stem, max(a) AS a, max(b) AS b FROM (SELECT stem, 1 AS a, 0 AS b FROM song UNION ALL SELECT stem, 0, 1 FROM lab) WHERE stem IS NOT NULL GROUP BY stem)
SELECT count(*) AS files, sum(a)::BIGINT AS with_detections, sum(b)::BIGINT AS with_labels, sum(a * b)::BIGINT AS with_both FROM f""")
def file_match_stats(spark, d):
    return summaries.file_match_stats(_songs(spark, d), _lab(spark, d))


@query(f"{_WITH_SONGS}, {_LAB} SELECT species FROM song WHERE trim(species) <> '' UNION SELECT species FROM lab")
def species_list(spark, d):
    return confusion.class_list(_songs(spark, d), _lab(spark, d))


@query("SELECT det_id, clip_start, clip_end FROM detections WHERE clip_end <= 600")
def first_ten_minutes(spark, d):
    from tonewright.sources.readers import within

    return within(table(spark, d, "detections")).select("det_id", "clip_start", "clip_end")


@query(f"""WITH RECURSIVE {_DET}, {_KEPT}, rw AS (SELECT det_id, (filename, species_id) AS k, time_start AS s, time_end AS e, coalesce(confidence, 0) AS c
  FROM kept WHERE isfinite(time_start) AND isfinite(time_end) AND time_end >= time_start),
{sql_suppressed('rw', 0.7)}
SELECT det_id, filename, species_id, time_start, time_end FROM kept WHERE det_id IN (SELECT det_id FROM left_) OR det_id NOT IN (SELECT det_id FROM rw)""")
def nms(spark, d):
    """Detections left by suppression in time."""
    return songs.merge_detections(songs.confident(_det(spark, d), LEAST), "nms", iou=0.7).select("det_id", "filename", "species_id", "time_start", "time_end")


# --- interval joins and matching ---------------------------------------------------------

_IOU2 = """(SELECT *, w * h / nullif((se - ss) * (sh - sl) + (le - ls) * (lh - ll) - w * h, 0) AS iou FROM (
  SELECT s.stem, s.species AS s_species, l.species AS l_species, s.det_id, s.filename, s.species_id, s.time_start AS ss, s.time_end AS se, s.freq_low_hz AS sl, s.freq_high_hz AS sh, l.label_id,
    l.time_start AS ls, l.time_end AS le, l.freq_low_hz AS ll, l.freq_high_hz AS lh,
    least(s.time_end, l.time_end) - greatest(s.time_start, l.time_start) AS w, greatest(0, least(s.freq_high_hz, l.freq_high_hz) - greatest(s.freq_low_hz, l.freq_low_hz)) AS h
  FROM song s JOIN lab l ON s.stem = l.stem AND s.time_start < l.time_end AND l.time_start < s.time_end AND s.freq_low_hz < l.freq_high_hz AND l.freq_low_hz < s.freq_high_hz))"""
_EDGES = f"{_WITH_SONGS}, {_LAB}, e AS (SELECT * FROM {_IOU2} WHERE iou >= {IOU}::DOUBLE AND iou > 0)"
_SONG_KEY = ("filename", "species_id", "time_start")


def _edges(spark, d, keys=("stem", "species"), boxes=True, iou=IOU):
    s = _songs(spark, d)
    return edges(s.withColumn("song_start", F.col("time_start")), _lab(spark, d), list(keys), iou, boxes, keep=("filename", "species_id", "song_start"))


@query(f"{_EDGES} SELECT filename, species_id, ss AS song_start, label_id, round(iou, 6) AS iou FROM e WHERE s_species = l_species")
def iou_edges_2d(spark, d):
    return _edges(spark, d).select("filename", "species_id", "song_start", "label_id", F.round("iou", 6).alias("iou"))


@query(f"""{_WITH_SONGS}, {_LAB} SELECT s.filename, s.species_id, s.time_start AS song_start, l.label_id,
  round((least(s.time_end, l.time_end) - greatest(s.time_start, l.time_start)) / (greatest(s.time_end, l.time_end) - least(s.time_start, l.time_start)), 6) AS iou
FROM song s JOIN lab l ON s.stem = l.stem AND s.species = l.species AND s.time_start < l.time_end AND l.time_start < s.time_end
WHERE (least(s.time_end, l.time_end) - greatest(s.time_start, l.time_start)) / (greatest(s.time_end, l.time_end) - least(s.time_start, l.time_start)) >= {IOU}::DOUBLE""")
def iou_edges_1d(spark, d):
    return _edges(spark, d, boxes=False).select("filename", "species_id", "song_start", "label_id", F.round("iou", 6).alias("iou"))


@query(f"{_EDGES} SELECT filename, species_id, ss AS song_start, label_id, s_species AS species, l_species AS true_species, round(iou, 6) AS iou FROM e")
def iou_edges_any_class(spark, d):
    e = _edges(spark, d, keys=("stem",))
    s = _songs(spark, d).select("det_id", "species")
    lb = _lab(spark, d).select("label_id", F.col("species").alias("true_species"))
    return e.join(s, "det_id").join(lb, "label_id").select("filename", "species_id", "song_start", "label_id", "species", "true_species", F.round("iou", 6).alias("iou"))


@query(f"""{_WITH_SONGS}, {_LAB} SELECT s.stem, count(*) AS pairs FROM song s JOIN lab l ON s.stem = l.stem AND s.time_start < l.time_end AND l.time_start < s.time_end
  AND least(s.time_end, l.time_end) > greatest(s.time_start, l.time_start) GROUP BY ALL""")
def overlap_pairs(spark, d):
    """Pairs that share time; a song that ends before it starts shares none."""
    everything = edges(_songs(spark, d), _lab(spark, d), ["stem"], 0.0, boxes=False)
    return everything.groupBy("stem").agg(F.count(F.lit(1)).alias("pairs"))


_MUTUAL = f"""{_EDGES}, r AS (SELECT *, round(iou, 9) AS q FROM e WHERE s_species = l_species),
b AS (SELECT *, row_number() OVER (PARTITION BY filename, species_id, ss ORDER BY q DESC, label_id) AS x,
  row_number() OVER (PARTITION BY label_id ORDER BY q DESC, ss, filename, species_id) AS y FROM r)"""


@query(f"{_MUTUAL} SELECT filename, species_id, ss AS song_start, label_id FROM b WHERE x = 1 AND y = 1")
def mutual_best_match(spark, d):
    # ties by start and file, so that both engines decide alike
    e = _edges(spark, d).withColumn("iou", F.round("iou", 9)).withColumn("det_id", F.struct("song_start", "filename", "species_id"))
    return mutual_best(e, ["species"]).select("filename", "species_id", "song_start", "label_id")


@query(f"{_EDGES} SELECT label_id, species FROM lab WHERE label_id NOT IN (SELECT label_id FROM e WHERE s_species = l_species)")
def unmatched_labels_anti(spark, d):
    return unmatched(_lab(spark, d), _edges(spark, d), "label_id").select("label_id", "species")


_CLASS_EDGES = f"{_EDGES}, ge AS (SELECT (stem, s_species) AS g, stem, s_species, (filename, ss) AS o, det_id AS d, label_id AS l, round(iou, 9) AS iou FROM e WHERE s_species = l_species)".replace("WITH ", "WITH RECURSIVE ", 1)
_FILE_EDGES = f"{_EDGES}, ge AS (SELECT stem AS g, (filename, ss) AS o, det_id AS d, label_id AS l, round(iou, 9) AS iou FROM e)".replace("WITH ", "WITH RECURSIVE ", 1)
_PAIRS = "d AS det_id, l AS label_id, round(iou, 6) AS iou"


def _matched(spark, d, keys, optimal=True):
    s, lb = _songs(spark, d), _lab(spark, d)
    e = edges(s.withColumn("place", F.struct("filename", "time_start")), lb, list(keys), IOU, keep=("place",)).withColumn("iou", F.round("iou", 9))
    return one_to_one(e, list(keys), optimal, "place").withColumn("iou", F.round("iou", 6))


@query(f"{_CLASS_EDGES}, {sql_optimal('ge')} SELECT g[1] AS stem, g[2] AS species, {_PAIRS} FROM mt".replace("g[1]", "struct_extract_at(g, 1)").replace("g[2]", "struct_extract_at(g, 2)"))
def optimal_match_sweep(spark, d):
    """Most pairs, then most IoU, per file and class."""
    return _matched(spark, d, ("stem", "species"))


@query(f"{_FILE_EDGES}, {sql_optimal('ge')} SELECT g AS stem, {_PAIRS} FROM mt")
def optimal_match_confusion(spark, d):
    """The same per file, whatever the classes."""
    return _matched(spark, d, ("stem",))


@query(f"{_CLASS_EDGES}, {sql_greedy('ge')} SELECT struct_extract_at(g, 1) AS stem, struct_extract_at(g, 2) AS species, {_PAIRS} FROM mt")
def greedy_match(spark, d):
    """Songs in order of file and start take the best label left."""
    return _matched(spark, d, ("stem", "species"), optimal=False)


@query(f"{_FILE_EDGES}, {sql_greedy('ge')} SELECT g AS stem, {_PAIRS} FROM mt")
def greedy_match_confusion(spark, d):
    return _matched(spark, d, ("stem",), optimal=False)


# --- threshold sweep ---------------------------------------------------------------------


def _values(ts) -> str:
    return "(VALUES " + ", ".join(f"({t}::DOUBLE)" for t in ts) + ") AS v(threshold)"


def _fan(ts) -> str:
    return f"fan AS (SELECT threshold, det.* FROM det JOIN {_values(ts)} ON coalesce(confidence, 0) >= threshold AND NOT isnan(coalesce(confidence, 0)))"


@query(f"WITH {_DET}, {_fan(FINE)} SELECT threshold, count(*) AS n FROM fan GROUP BY ALL")
def threshold_fanout(spark, d):
    return songs.at_thresholds(_det(spark, d), FINE).groupBy("threshold").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_DET}, {_fan(FINE)}, {_sql_songs('fan', 'threshold, ')} SELECT threshold, count(*) AS n, sum(detections_merged)::BIGINT AS merged FROM songs GROUP BY ALL")
def songs_per_threshold(spark, d):
    return per_threshold(song_versions(_det(spark, d), FINE, GAP), FINE, n=F.lit(1), merged=F.col("detections_merged"))


def _sql_counts(iou: float, optimal: bool = True, one_class: bool = False) -> str:
    """CTEs up to c (threshold, species, tp, fp, fn) over solved matches at all thresholds."""
    kind = "'bird'" if one_class else "nullif(sp, '~')"
    ge = f"""ge AS (SELECT (threshold, stem, species) AS g, (filename, ss) AS o, det_id AS d, label_id AS l, iou FROM (
  SELECT *, w * h / nullif((se - ss) * (sh - sl) + (le - ls) * (lh - ll) - w * h, 0) AS iou FROM (
  SELECT s.threshold, s.stem, s.species, s.det_id, s.filename, s.time_start AS ss, s.time_end AS se, s.freq_low_hz AS sl, s.freq_high_hz AS sh, l.label_id,
    l.time_start AS ls, l.time_end AS le, l.freq_low_hz AS ll, l.freq_high_hz AS lh,
    least(s.time_end, l.time_end) - greatest(s.time_start, l.time_start) AS w, greatest(0, least(s.freq_high_hz, l.freq_high_hz) - greatest(s.freq_low_hz, l.freq_low_hz)) AS h
  FROM song s JOIN labs l ON s.stem = l.stem AND s.species = l.species AND s.time_start < l.time_end AND l.time_start < s.time_end AND s.freq_low_hz < l.freq_high_hz AND l.freq_low_hz < s.freq_high_hz))
  WHERE iou >= {iou}::DOUBLE AND iou > 0)"""
    return f"""WITH RECURSIVE {_DET}, {_LAB}, labs AS (SELECT * REPLACE ({"'bird'" if one_class else 'species'} AS species) FROM lab), {_fan(FINE)}, {_sql_songs('fan', 'threshold, ')},
song AS (SELECT *, {kind} AS species, {_STEM.format('filename')} AS stem FROM songs WHERE sp <> '~'),
{ge}, {(sql_optimal if optimal else sql_greedy)('ge')},
tp AS (SELECT g.threshold, g.species, count(*) AS tp FROM (SELECT struct_pack(threshold := struct_extract_at(g, 1), species := struct_extract_at(g, 3)) AS g FROM mt) GROUP BY ALL),
nd AS (SELECT threshold, species, count(*) AS n_det FROM song GROUP BY ALL),
nl AS (SELECT threshold, species, count(*) AS n_lab FROM labs, {_values(FINE)} GROUP BY ALL),
c AS (SELECT threshold, species, coalesce(tp, 0) AS tp, coalesce(n_det, 0) - coalesce(tp, 0) AS fp, coalesce(n_lab, 0) - coalesce(tp, 0) AS fn
  FROM nd FULL JOIN nl USING (threshold, species) LEFT JOIN tp USING (threshold, species))"""


def _f_sql(tp: str, fp: str, fn: str) -> str:
    p, r = f"({tp}::DOUBLE / nullif({tp} + {fp}, 0))", f"({tp}::DOUBLE / nullif({tp} + {fn}, 0))"
    return f"{p} AS p, {r} AS r, CASE WHEN {p} IS NULL OR {r} IS NULL THEN NULL WHEN {p} = 0 AND {r} = 0 THEN 0 ELSE 2 * {p} * {r} / ({p} + {r}) END AS f"


def _sql_rows(iou: float, optimal: bool = True, one_class: bool = False) -> str:
    return f"""{_sql_counts(iou, optimal, one_class)}, cls AS (SELECT *, {_f_sql('tp', 'fp', 'fn')} FROM c),
mic AS (SELECT threshold, 'Overall_Micro' AS species, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn FROM c GROUP BY threshold),
rows_ AS (SELECT species, threshold AS confidence_threshold, tp, fp, fn, p, r, f FROM cls
UNION ALL SELECT species, threshold, tp, fp, fn, p, r, f FROM (SELECT *, {_f_sql('tp', 'fp', 'fn')} FROM mic)
UNION ALL SELECT 'Overall_Macro', threshold, NULL, NULL, NULL, avg(p), avg(r), avg(f) FROM cls GROUP BY threshold)"""


_ROWS = _sql_rows(0.5)


def _counts(spark, d, iou=0.5, **how):
    """Counts over solved matches at all 101 thresholds."""
    return scores.sweep_counts(_det(spark, d), _lab(spark, d), FINE, iou, GAP, file_key=_file_key, **how)


def _score_rows(spark, d, iou=0.5, **how):
    return scores.score_rows(_counts(spark, d, iou, **how), scores.threshold_table(spark, FINE))


_RATES = "round(p, 6) AS precision, round(r, 6) AS recall, round(f, 6) AS f_beta_score"


def _short(df):
    return df.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f_beta_score")})


@query(f"{_sql_counts(0.5)} SELECT threshold, species, tp, fp, fn FROM c")
def tp_fp_fn(spark, d):
    return _counts(spark, d)


@query(f"{_ROWS} SELECT species, confidence_threshold, tp, fp, fn, {_RATES} FROM rows_")
def f_beta_rows(spark, d):
    return _short(_score_rows(spark, d))


@query(f"{_ROWS}, q AS (SELECT *, row_number() OVER (PARTITION BY species ORDER BY round(f, 9) DESC, confidence_threshold) AS k FROM rows_ WHERE f IS NOT NULL) SELECT species, confidence_threshold, tp, fp, fn, {_RATES} FROM q WHERE k = 1")
def optimal_threshold(spark, d):
    rows = _score_rows(spark, d).withColumn("f_beta_score", F.round("f_beta_score", 9))
    return _short(scores.best_thresholds(rows))


_BEST = f"{_ROWS}, best AS (SELECT species, round(max(f), 6) AS best FROM rows_ WHERE species NOT IN ('Overall_Micro', 'Overall_Macro') GROUP BY species)"


def _best_rows(spark, d):
    return _short(_score_rows(spark, d))


@query(f"{_BEST} SELECT * FROM best ORDER BY best DESC NULLS LAST, species LIMIT 12")
def top_species(spark, d):
    return scores.top_classes(_best_rows(spark, d), 12)


@query(f"{_BEST} SELECT * FROM best ORDER BY best NULLS FIRST, species DESC LIMIT 5")
def bottom_species(spark, d):
    return scores.bottom_classes(_best_rows(spark, d), 5)


@query(f"""{_ROWS} SELECT species, {', '.join(f'''max(CASE WHEN confidence_threshold = {t}::DOUBLE THEN round(f, 6) END) AS "{t:.2f}"''' for t in FINE)}
FROM rows_ WHERE species NOT IN ('Overall_Micro', 'Overall_Macro') GROUP BY species""")
def f_pivot(spark, d):
    return scores.f_pivot(_best_rows(spark, d), FINE)


@query(f"{_ROWS} SELECT species, confidence_threshold, coalesce(round(p, 6), 0) AS precision, coalesce(round(r, 6), 0) AS recall, coalesce(round(f, 6), 0) AS f_beta_score FROM rows_")
def plot_frame(spark, d):
    return scores.plot_frame(_best_rows(spark, d)).select("species", "confidence_threshold", "precision", "recall", "f_beta_score")


_ALL_ROWS = f"SELECT species, confidence_threshold, tp, fp, fn, {_RATES} FROM rows_"


@query(f"{_sql_rows(IOU)} {_ALL_ROWS}")
def sweep_optimal(spark, d):
    """Score rows at IoU 0.25."""
    return _short(_score_rows(spark, d, IOU))


@query(f"{_sql_rows(IOU, one_class=True)} {_ALL_ROWS}")
def sweep_single_class(spark, d):
    return _short(_score_rows(spark, d, IOU, one_class="bird"))


@query(f"{_sql_rows(IOU, optimal=False)} {_ALL_ROWS}")
def sweep_greedy(spark, d):
    return _short(_score_rows(spark, d, IOU, optimal=False))


# --- confusion ---------------------------------------------------------------------------

_COUNTED = """cells AS (SELECT pred, true_, count(*) AS n FROM (
  SELECT s.species AS pred, l.species AS true_ FROM mt JOIN song s ON s.det_id = mt.d JOIN lab l ON l.label_id = mt.l WHERE s.species IS NOT NULL
  UNION ALL SELECT species, 'background' FROM song WHERE species IS NOT NULL AND det_id NOT IN (SELECT d FROM mt)
  UNION ALL SELECT 'background', species FROM lab WHERE label_id NOT IN (SELECT l FROM mt)) GROUP BY ALL)"""
_RAW_EDGES = f"{_EDGES}, ge AS (SELECT stem AS g, (filename, ss) AS o, det_id AS d, label_id AS l, iou FROM e)".replace("WITH ", "WITH RECURSIVE ", 1)
_CELLS = f"{_RAW_EDGES}, {sql_optimal('ge')}, {_COUNTED}"
_MUTUAL_CELLS = f"""{_EDGES}, r AS (SELECT *, round(iou, 9) AS q FROM e),
b AS (SELECT *, row_number() OVER (PARTITION BY det_id ORDER BY q DESC, label_id) AS x, row_number() OVER (PARTITION BY label_id ORDER BY q DESC, ss, filename, species_id) AS y FROM r),
mt AS (SELECT det_id AS d, label_id AS l FROM b WHERE x = 1 AND y = 1), {_COUNTED}"""


def _cells(spark, d):
    """Confusion cells over optimal matches per file, in all files."""
    s, lb = cut(_songs(spark, d)), _lab(spark, d)
    return confusion.confusion(s, lb, confusion.matches(s, lb, IOU))


@query(f'{_MUTUAL_CELLS} SELECT pred, true_ AS "true", n FROM cells')
def confusion_mutual_best(spark, d):
    """Cells over mutual best pairs; fewer pairs than can be matched."""
    s, lb = _songs(spark, d), _lab(spark, d)
    e = _edges(spark, d, keys=("stem",)).withColumn("iou", F.round("iou", 9)).withColumn("_id", F.col("det_id")).withColumn("det_id", F.struct("song_start", "filename", "species_id"))
    m = mutual_best(e.withColumn("one", F.lit(1)), ["one"]).select(F.col("_id").alias("det_id"), "label_id")
    return confusion.confusion(s, lb, m)


@query(f'{_CELLS} SELECT pred, true_ AS "true", n FROM cells')
def confusion_long(spark, d):
    return _cells(spark, d)


@query(f'{_CELLS} SELECT pred, true_ AS "true", n, round(n / greatest(sum(n) OVER (PARTITION BY true_), 1), 6) AS share FROM cells')
def confusion_normalised(spark, d):
    return confusion.normalised(_cells(spark, d)).withColumn("share", F.round("share", 6))


@query()
def confusion_pivot(spark, d):
    """All classes as columns; their names come from the data, so SQL has no fixed columns for them."""
    return confusion.square(_cells(spark, d))


@query()
def confusion_prefixed(spark, d):
    return confusion.prefixed(confusion.square(_cells(spark, d)))


_MATRIX = f"""{_CELLS}, sc AS (SELECT coalesce(a.species, b.species) AS species, coalesce(predicted, 0) AS predicted, coalesce(actual, 0) AS actual, coalesce(tp, 0) AS tp
  FROM (SELECT pred AS species, sum(n) AS predicted FROM cells GROUP BY 1) a FULL JOIN (SELECT true_ AS species, sum(n) AS actual FROM cells GROUP BY 1) b ON a.species = b.species
  LEFT JOIN (SELECT pred AS species, n AS tp FROM cells WHERE pred = true_) c ON c.species = coalesce(a.species, b.species)),
pr AS (SELECT *, coalesce(tp / nullif(predicted, 0), 0) AS p, coalesce(tp / nullif(actual, 0), 0) AS r FROM sc WHERE species <> 'background'),
fs AS (SELECT *, coalesce(2 * p * r / nullif(p + r, 0), 0) AS f FROM pr)"""


@query(f"""{_MATRIX} SELECT species, round(p, 6) AS precision, round(r, 6) AS recall, round(f, 6) AS f_beta, tp AS true_positives, (predicted - tp)::BIGINT AS false_positives, (actual - tp)::BIGINT AS false_negatives FROM fs""")
def matrix_f_beta(spark, d):
    return confusion.class_scores(_cells(spark, d)).withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f_beta")})


@query(f"""{_MATRIX}, t AS (SELECT sum(tp) AS tp, sum(predicted - tp) AS fp, sum(actual - tp) AS fn FROM fs)
SELECT 'MACRO_AVERAGE' AS average, round(avg(f), 6) AS f_beta FROM fs
UNION ALL SELECT 'WEIGHTED_AVERAGE', round(sum(actual / (SELECT sum(n) FROM cells) * f), 6) FROM fs
UNION ALL SELECT 'MICRO_AVERAGE', round(2 * (tp / (tp + fp)) * (tp / (tp + fn)) / ((tp / (tp + fp)) + (tp / (tp + fn))), 6) FROM t""")
def matrix_averages(spark, d):
    return confusion.average_scores(_cells(spark, d)).withColumn("f_beta", F.round("f_beta", 6))


@query()
def confusion_optimal(spark, d):
    """Cells over optimal matches per file, after the restriction to common files."""
    return confusion.analyse(_songs(spark, d), _lab(spark, d), IOU)


@query()
def confusion_1d(spark, d):
    return confusion.analyse(_songs(spark, d), _lab(spark, d), IOU, boxes=False, background=False)


# --- scalars, dimensions and exports -----------------------------------------------------


@query("""SELECT y, CAST(round_even(least(15000, greatest(50, 700 * (pow(10, ((1 - y / 256.0::DOUBLE) * (3505.3301835 - 77.7545654) + 77.7545654) / 2595) - 1))), 0) AS INTEGER) AS hz
FROM (SELECT unnest(range(0, 257, 16))::DOUBLE AS y)""")
def pixels_to_hz(spark, d):
    rows = spark.range(0, 257, 16).select(F.col("id").cast("double").alias("y"))
    return rows.select("y", geo.pixel_to_hz(F.col("y")).alias("hz"))


@query("""SELECT det_id, round((2595 * log10(1 + freq_low_hz / 700.0::DOUBLE) - 77.754565) / (3505.330184 - 77.754565), 4) AS low FROM detections""")
def hz_to_mel(spark, d):
    return table(spark, d, "detections").select("det_id", F.round(geo.hz_to_mel_share(F.col("freq_low_hz").cast("double")), 4).alias("low"))


@query("""SELECT mapping, species_id, code, CASE WHEN contains(full_name, '_') THEN substr(full_name, 1, instr(full_name, '_') - 1) ELSE full_name END AS scientific_name,
CASE WHEN contains(full_name, '_') THEN substr(full_name, instr(full_name, '_') + 1) ELSE code END AS common_name,
CASE WHEN r IS NULL OR g IS NULL OR b IS NULL THEN '#FFFFFF' ELSE lower(printf('#%02x%02x%02x', r, g, b)) END AS color FROM species_dim""")
def species_names(spark, d):
    dim = table(spark, d, "species_dim")
    return dim.select(
        "mapping", "species_id", "code", txt.scientific_name(F.col("full_name")).alias("scientific_name"),
        txt.common_name(F.col("full_name"), F.col("code")).alias("common_name"), txt.rgb_hex(F.col("r"), F.col("g"), F.col("b")).alias("color"),
    )


@query("""SELECT species_id, code, CASE WHEN contains(full_name, '_') THEN substr(full_name, 1, instr(full_name, '_') - 1) ELSE full_name END AS scientific_name,
CASE WHEN contains(full_name, '_') THEN substr(full_name, instr(full_name, '_') + 1) ELSE code END AS common_name,
CASE WHEN r IS NULL OR g IS NULL OR b IS NULL THEN '#FFFFFF' ELSE lower(printf('#%02x%02x%02x', r, g, b)) END AS color FROM species_dim WHERE mapping = 'All-Sites'""")
def species_mapping(spark, d):
    return taxonomy.species_mapping(table(spark, d, "species_dim"), "All-Sites")


@query("""SELECT det_id, coalesce(nullif(regexp_extract(filename, '(?i)(?:^|[^A-Za-z0-9])XC[_-]?(\\d+)', 1), ''), '') AS xc_nr FROM detections WHERE filename IS NOT NULL""")
def xc_number(spark, d):
    return table(spark, d, "detections").where(F.col("filename").isNotNull()).select("det_id", txt.recording_number(F.col("filename")).alias("xc_nr"))


@query("""SELECT d.det_id, coalesce(s.code, 'unknown_' || d.species_id) AS species FROM detections d
LEFT JOIN (SELECT species_id, code FROM species_dim WHERE mapping = 'All-Sites') s ON s.species_id = d.species_id""")
def code_of_id(spark, d):
    dim = table(spark, d, "species_dim").where(F.col("mapping") == "All-Sites")
    return taxonomy.with_code(table(spark, d, "detections").select("det_id", "species_id"), dim, "species_id").select("det_id", "species")


_TAX = """t AS (SELECT lower(trim(species_code_cornell_lab)) AS code, trim(coalesce(scientific_name, '')) AS scientific_name, trim(coalesce(english_name_avilist, '')) AS en
  FROM taxonomy WHERE lower(trim(taxon_rank)) = 'species' AND trim(species_code_cornell_lab) <> ''),
s AS (SELECT code, scientific_name, CASE WHEN en <> '' THEN en ELSE scientific_name END AS english_name FROM t)"""


def _sheet(spark, d):
    """The sheet with a row number; sorted by all columns, since a table has no order of its own."""
    from pyspark.sql import Window

    t = table(spark, d, "taxonomy")
    return t.withColumn("row_no", F.row_number().over(Window.orderBy(*[F.coalesce(c, F.lit("")) for c in t.columns])))  # a small dimension


@query(f"""WITH o AS (SELECT *, row_number() OVER (ORDER BY coalesce(taxon_rank, ''), coalesce(species_code_cornell_lab, ''), coalesce(scientific_name, ''), coalesce(english_name_avilist, '')) AS row_no FROM taxonomy),
{_TAX.replace('english_name_avilist, \'\')) AS en', "english_name_avilist, '')) AS en, row_no").replace('FROM taxonomy', 'FROM o').replace('s AS (SELECT code', 's AS (SELECT row_no, code')},
r AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY row_no) AS k FROM s) SELECT code, scientific_name, english_name FROM r WHERE k = 1""")
def taxonomy_map(spark, d):
    return taxonomy.taxonomy_map(_sheet(spark, d))


@query(f"WITH {_TAX} SELECT code, count(DISTINCT (scientific_name, english_name)) AS names FROM s GROUP BY code HAVING names > 1")
def taxonomy_splits(spark, d):
    return taxonomy.splits(table(spark, d, "taxonomy"))


@query(f"WITH {_TAX} SELECT scientific_name, array_to_string(list_sort(list(DISTINCT code)), ', ') AS codes, count(DISTINCT code) AS n FROM s WHERE scientific_name <> '' GROUP BY scientific_name HAVING n > 1")
def taxonomy_merges(spark, d):
    return taxonomy.merges(table(spark, d, "taxonomy"))


@query(f"""WITH o AS (SELECT *, row_number() OVER (ORDER BY coalesce(taxon_rank, ''), coalesce(species_code_cornell_lab, ''), coalesce(scientific_name, ''), coalesce(english_name_avilist, '')) AS row_no FROM taxonomy),
{_TAX.replace('english_name_avilist, \'\')) AS en', "english_name_avilist, '')) AS en, row_no").replace('FROM taxonomy', 'FROM o').replace('s AS (SELECT code', 's AS (SELECT row_no, code')},
x AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY code ORDER BY row_no) AS k FROM s) WHERE k = 1),
dm AS (SELECT lower(code) AS code, min(full_name) AS full_name FROM species_dim GROUP BY 1)
SELECT det_id, coalesce(nullif(x.scientific_name, ''), CASE WHEN contains(full_name, '_') THEN substr(full_name, 1, instr(full_name, '_') - 1) ELSE full_name END, species) AS scientific_name
FROM detections LEFT JOIN x ON x.code = lower(species) LEFT JOIN dm ON dm.code = lower(species)""")
def scientific_names(spark, d):
    tax = taxonomy.taxonomy_map(_sheet(spark, d))
    dim = table(spark, d, "species_dim").groupBy("code").agg(F.min("full_name").alias("full_name"))
    return taxonomy.resolved_names(table(spark, d, "detections").select("det_id", "species"), tax, dim).select("det_id", "scientific_name")


@query("""WITH x AS (SELECT DISTINCT scientific_name AS n FROM taxonomy WHERE scientific_name IS NOT NULL) SELECT array_to_string(list_sort(list(n)), ', ') AS taxon_coverage FROM x""")
def taxon_coverage(spark, d):
    return taxonomy.coverage(table(spark, d, "taxonomy"))


_OUT_CSV = """coalesce(filename, 'unknown') AS "Filename", printf('%.1f', time_start) AS "Start Time (s)", printf('%.1f', time_end) AS "End Time (s)",
freq_low_hz::VARCHAR AS "Low Freq (Hz)", freq_high_hz::VARCHAR AS "High Freq (Hz)", species AS "Species eBird Code" """


@query(f"SELECT {_OUT_CSV} FROM songs")
def csv_rows(spark, d):
    return writers.csv_rows(table(spark, d, "songs"), confidence=False)


@query(f"""SELECT {_OUT_CSV}, printf('%.3f', avg_confidence) AS "Confidence" FROM songs""".replace("printf('%.3f', avg_confidence)", "CASE WHEN avg_confidence IS NULL THEN printf('%.3f', max_confidence) ELSE printf('%.3f', avg_confidence) END"))
def csv_rows_confidence(spark, d):
    s = table(spark, d, "songs").withColumn("confidence", F.col("max_confidence"))
    return writers.csv_rows(s)


@query()
def json_documents(spark, d):
    """One detections document per recording."""
    return writers.documents(_songs(spark, d).drop("stem", "det_id"), {"model": "detector", "song_gap_threshold": GAP, "confidence_threshold": LEAST})


@query(r"""SELECT 'segment-' || lpad(n::VARCHAR, 6, '0') AS annotation_source_id, coalesce(filename, '') AS sound_file,
  coalesce(regexp_extract(coalesce(filename, ''), '(?i)(?:^|[^A-Za-z0-9])XC[_-]?(\d+)', 1), '') AS xc_nr, 'tonewright' AS annotator, '' AS annotator_xc_id,
  printf('%.3f', freq_high_hz::DOUBLE)::DOUBLE AS frequency_high, printf('%.3f', freq_low_hz::DOUBLE)::DOUBLE AS frequency_low,
  printf('%.3f', time_start)::DOUBLE AS start_time, printf('%.3f', time_end)::DOUBLE AS end_time, species AS scientific_name, 'call' AS sound_type, '2031-01-01' AS date_identified,
  'Detected by tonewright; eBird code: ' || coalesce(species, '') || CASE WHEN v IS NULL THEN '' ELSE '; confidence: ' || printf('%.3f', v) END AS annotation_remarks
FROM (SELECT *, coalesce(avg_confidence, max_confidence) AS v, row_number() OVER (ORDER BY filename NULLS FIRST, time_start NULLS FIRST, time_end NULLS FIRST,
  species_id NULLS FIRST, freq_low_hz NULLS FIRST, song_id) AS n FROM songs)""")
def annotation_rows(spark, d):
    return writers.annotation_rows(table(spark, d, "songs"), F.col("species"), on=date(2031, 1, 1)).drop("number")


@query("""WITH f AS (SELECT filename, max(clip_end) AS duration FROM detections WHERE filename IS NOT NULL GROUP BY 1)
SELECT filename, n AS clip_no, n * 1.5::DOUBLE AS clip_start, n * 1.5::DOUBLE + 3 AS clip_end, floor(n * 1.5::DOUBLE / 60)::BIGINT AS segment
FROM (SELECT filename, unnest(range(0, floor((duration - 3) / 1.5)::BIGINT + 1)) AS n FROM f WHERE duration >= 3)""")
def clip_schedule(spark, d):
    files = table(spark, d, "detections").where(F.col("filename").isNotNull()).groupBy("filename").agg(F.max("clip_end").alias("duration"))
    return clips.clip_schedule(files).drop("duration")


@query(f"""WITH b AS (SELECT det_id, filename, species_id, confidence, time_start, time_end FROM detections WHERE time_end >= time_start)
SELECT a.det_id, b.det_id AS other_id, round((least(a.time_end, b.time_end) - greatest(a.time_start, b.time_start)) /
  nullif((a.time_end - a.time_start) + (b.time_end - b.time_start) - (least(a.time_end, b.time_end) - greatest(a.time_start, b.time_start)), 0), 6) AS iou
FROM b a JOIN b ON a.filename = b.filename AND a.species_id = b.species_id AND a.det_id < b.det_id AND a.time_start < b.time_end AND b.time_start < a.time_end""")
def nms_overlaps(spark, d):
    """IoU of boxes of a file and class that share time, the pairs that suppression looks at."""
    rows = table(spark, d, "detections").where(finite(F.col("time_end")) >= finite(F.col("time_start")))
    cell = lambda c: F.floor(F.col(c) / 60.0)
    side = lambda p: rows.select(*[F.col(c).alias(f"{p}_{c}") for c in ("det_id", "filename", "species_id", "time_start", "time_end")]).withColumn(f"{p}_cell", F.explode(F.sequence(cell(f"{p}_time_start"), cell(f"{p}_time_end"))))
    a, b = side("a"), side("b")
    c = lambda n: F.col(n)
    on = (
        (c("a_filename") == c("b_filename")) & (c("a_species_id") == c("b_species_id")) & (c("a_cell") == c("b_cell")) & (c("a_det_id") < c("b_det_id"))
        & geo.time_overlap(c("a_time_start"), c("a_time_end"), c("b_time_start"), c("b_time_end"))
        & (F.floor(F.greatest("a_time_start", "b_time_start") / 60.0) == c("a_cell"))
    )
    value = geo.interval_iou(c("a_time_start"), c("a_time_end"), c("b_time_start"), c("b_time_end"))
    return a.join(b, on).select(c("a_det_id").alias("det_id"), c("b_det_id").alias("other_id"), F.round(value, 6).alias("iou"))


@query(f"""WITH {_DET}, {_KEPT}, us AS (SELECT * REPLACE (round(time_start * 1e6)::BIGINT AS time_start, round(time_end * 1e6)::BIGINT AS time_end) FROM kept WHERE time_end >= time_start),
m AS (SELECT *, max(time_end) OVER (PARTITION BY filename, species_id ORDER BY time_start, det_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM us),
k AS (SELECT *, sum(CASE WHEN time_start - before <= 100000 THEN 0 ELSE 1 END) OVER (PARTITION BY filename, species_id ORDER BY time_start, det_id ROWS UNBOUNDED PRECEDING) AS song FROM m)
SELECT filename, species_id, min(time_start) / 1e6 AS time_start, max(time_end) / 1e6 AS time_end, count(*) AS detections_merged FROM k GROUP BY filename, species_id, song""")
def session_merge(spark, d):
    """The streaming merge run over a table as a bounded stream of sessions."""
    return stream_songs(songs.confident(_det(spark, d), LEAST), GAP).select("filename", "species_id", "time_start", "time_end", "detections_merged")


def queries() -> dict:
    return dict(Q)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
