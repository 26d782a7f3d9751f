"""Hand-computed cases and properties of the reference's operators."""

import itertools
import json
import math
import random
import wave

import pytest
from pyspark.sql import functions as F

from tonewright.functions import geometry as geo
from tonewright.functions import text as txt
from tonewright.functions.naming import stem
from tonewright.operators import clips, confusion, scores, songs, sweep, taxonomy
from tonewright.operators.matching import best_assignment, common_files, edges, greedy_assignment, one_to_one
from tonewright.sources import audio, readers, writers

DET = "det_id bigint, filename string, species string, species_id int, confidence double, time_start double, time_end double, freq_low_hz int, freq_high_hz int"


def det(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], DET)


def spans(df):
    return sorted((r.filename, r.time_start, r.time_end, r.detections_merged) for r in df.collect())


def box(file, s, e, conf=0.9, sid=0, sp="x", lo=100, hi=200):
    return (file, sp, sid, conf, float(s), float(e), lo, hi)


def test_gap_is_inclusive_and_uses_the_furthest_end(spark):
    a = songs.reconstruct(det(spark, [box("f", 0, 1), box("f", 1.25, 2), box("f", 2.5, 3)]), 0.25)
    assert spans(a) == [("f", 0, 2, 2), ("f", 2.5, 3, 1)]
    b = songs.reconstruct(det(spark, [box("f", 0, 10), box("f", 1, 2), box("f", 9, 11)]), 0.0)
    assert spans(b) == [("f", 0, 11, 3)]
    c = songs.reconstruct(det(spark, [box("f", 0, 1), box("g", 0, 1), box(None, 0, 1), box(None, 1, 2)]), 0.1)
    assert sorted(str(x[0]) for x in spans_or_none(c)) == ["None", "f", "g"]


def spans_or_none(df):
    return [(r.filename, r.detections_merged) for r in df.collect()]


def test_filter_comes_before_merge(spark):
    df = det(spark, [box("f", 0, 1, 0.9), box("f", 1, 2, 0.1), box("f", 2, 3, 0.9)])
    assert spans(songs.filter_then_merge(df, 0.5, 0.1)) == [("f", 0, 1, 1), ("f", 2, 3, 1)]
    missing = det(spark, [box("f", 0, 1, None), box("f", 5, 6, float("nan"))])
    assert songs.confident(missing, 0.0).count() == 1 and songs.confident(missing, 0.1).count() == 0
    with pytest.raises(ValueError):
        songs.confident(missing, 1.5)


def test_songs_match_a_sequential_fold(spark):
    r = random.Random(2)
    rows = []
    for _ in range(1200):
        s = r.randrange(0, 4000) / 8
        rows.append(box(r.choice(["f", "g"]), s, s + r.choice([0.125, 0.5, 2, -0.25, 30 if r.random() < 0.01 else 1]), r.randrange(100) / 100, r.randrange(2), r.choice("xyz"), r.randrange(50, 99), r.randrange(100, 200)))
    got = sorted(tuple(x) for x in songs.reconstruct(det(spark, rows), 0.25, shard_seconds=16).collect())
    want = []
    by = {}
    for i, x in enumerate(rows):
        by.setdefault((x[0], x[2]), []).append((x[4], i, x))
    for (f, sid), xs in by.items():
        cur = None
        for s, _, x in sorted(xs, key=lambda y: y[:2]):
            if cur and s - cur["e"] <= 0.25:
                cur["rows"].append(x)
                cur["e"] = max(cur["e"], x[5])
            else:
                cur = {"rows": [x], "e": x[5]}
                want.append((f, sid, cur))
    flat = sorted((f, c["rows"][0][1], sid, c["rows"][0][4], c["e"], max(x[3] for x in c["rows"]), len(c["rows"]), min(x[6] for x in c["rows"]), max(x[7] for x in c["rows"])) for f, sid, c in want)
    assert [(*g[:5], *g[6:]) for g in got] == flat
    assert all(abs(g[5] - sum(x[3] for x in c["rows"]) / len(c["rows"])) < 1e-12 for g, c in zip(sorted(got), [w[2] for w in sorted(want, key=lambda w: (w[0], w[2]["rows"][0][1], w[1], w[2]["rows"][0][4], w[2]["e"]))]))


def test_suppression_matches_greedy_and_keeps_equal_overlap(spark):
    two = det(spark, [box("f", 0, 4, 0.9), box("f", 1, 5, 0.8)])  # IoU 3/5
    assert songs.suppress(two, 0.6).count() == 2 and songs.suppress(two, 0.59).count() == 1
    r = random.Random(4)
    rows = [box("f", s := r.randrange(400) / 4, s + r.choice([1, 2, 3]), r.randrange(100) / 100, r.randrange(2)) for _ in range(300)]
    kept = []
    for i, x in sorted(enumerate(rows), key=lambda y: (-y[1][3], y[0])):
        if not any(k[2] == x[2] and (o := min(k[5], x[5]) - max(k[4], x[4])) > 0 and o > 0.4 * (k[5] - k[4] + x[5] - x[4] - o) for _, k in kept):
            kept.append((i, x))
    assert sorted(x.det_id for x in songs.suppress(det(spark, rows), 0.4).collect()) == sorted(i for i, _ in kept)
    with pytest.raises(ValueError):
        songs.merge_detections(two, "other")


def solve(method, es):
    """Matched edges (d, l, iou) of records."""
    at = method([e["d"] for e in es], [e["l"] for e in es], [e["iou"] for e in es])
    return [(es[k]["d"], es[k]["l"], es[k]["iou"]) for k in at]


def test_assignment_is_largest_then_heaviest():
    g6 = [{"d": "A", "l": 1, "iou": 0.9}, {"d": "A", "l": 2, "iou": 0.3}, {"d": "B", "l": 1, "iou": 0.3}]
    assert sorted(solve(best_assignment, g6)) == [("A", 2, 0.3), ("B", 1, 0.3)]
    assert solve(greedy_assignment, g6) == [("A", 1, 0.9)]
    r = random.Random(9)
    for _ in range(300):
        n, m = r.randrange(1, 5), r.randrange(1, 5)
        es = [{"d": i, "l": j, "iou": r.randrange(1, 100) / 100} for i in range(n) for j in range(m) if r.random() < 0.6]
        best = (0, 0.0)
        for k in range(1, min(n, m) + 1):
            for c in itertools.combinations(es, k):
                if len({e["d"] for e in c}) == k == len({e["l"] for e in c}):
                    best = max(best, (k, round(sum(e["iou"] for e in c), 9)))
        got = solve(best_assignment, es)
        assert (len(got), round(sum(x[2] for x in got), 9)) == best


def lab(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "label_id bigint, stem string, species string, time_start double, time_end double, freq_low_hz double, freq_high_hz double")


def test_edges_need_overlap_and_find_every_pair(spark):
    d = det(spark, [box("f", 0, 1), box("f", 2, 3), box("f", 59, 130)]).withColumn("stem", F.col("filename"))
    touching = lab(spark, [("f", "x", 1.0, 2.0, 100.0, 200.0), ("g", "x", 0.0, 1.0, 100.0, 200.0)])
    assert edges(d, touching, ["stem"], 0.0).count() == 0
    long = lab(spark, [("f", "x", 58.0, 131.0, 100.0, 200.0)])
    assert [round(x.iou, 6) for x in edges(d, long, ["stem"], 0.1).collect()] == [round(71 / 73, 6)]
    r = random.Random(6)
    ds = [box("f", s := r.randrange(2000) / 8, s + r.randrange(1, 20) / 4, lo=(a := r.randrange(100)), hi=a + r.randrange(1, 60)) for _ in range(200)]
    ls = [("f", "x", (s := r.randrange(2000) / 8), s + r.randrange(1, 20) / 4, float(a := r.randrange(100)), float(a + r.randrange(1, 60))) for _ in range(200)]
    got = {(x.det_id, x.label_id) for x in edges(det(spark, ds).withColumn("stem", F.col("filename")), lab(spark, ls), ["stem"], 0.2, bucket_seconds=10).collect()}
    want = set()
    for i, a in enumerate(ds):
        for j, b in enumerate(ls):
            w, h = min(a[5], b[3]) - max(a[4], b[2]), min(a[7], b[5]) - max(a[6], b[4])
            if w > 0 and h > 0 and w * h / ((a[5] - a[4]) * (a[7] - a[6]) + (b[3] - b[2]) * (b[5] - b[4]) - w * h) >= 0.2:
                want.add((i, j))
    assert got == want and len(want) > 20
    e = edges(det(spark, ds).withColumn("stem", F.col("filename")), lab(spark, ls), ["stem"], 0.05)
    whole = solve(best_assignment, [{"d": x.det_id, "l": x.label_id, "iou": x.iou} for x in e.collect()])
    solved = one_to_one(e, ["stem"]).collect()
    assert len(solved) == len(whole) and abs(sum(x.iou for x in solved) - sum(x[2] for x in whole)) < 1e-9
    greedy = solve(greedy_assignment, [{"d": x.det_id, "l": x.label_id, "iou": x.iou} for x in e.collect()])
    assert {(x.det_id, x.label_id) for x in one_to_one(e, ["stem"], False).collect()} == {g[:2] for g in greedy}


def test_rates_and_averages(spark):
    rows = [(0.1, "g8", 0, 0, 3), (0.1, "g11", 2, 2, 0), (0.2, "g9", 0, 2, 0), (0.2, "g10", 0, 1, 1)]
    counts = spark.createDataFrame(rows, "threshold double, species string, tp bigint, fp bigint, fn bigint")
    out = {(r.species, r.confidence_threshold): r for r in scores.score_rows(counts, scores.threshold_table(spark, [0.1, 0.2, 0.3]), 2.0).collect()}
    assert (out["g8", 0.1].precision, out["g8", 0.1].recall, out["g8", 0.1].f_beta_score) == (None, 0.0, None)
    assert (out["g9", 0.2].precision, out["g9", 0.2].recall, out["g9", 0.2].f_beta_score) == (0.0, None, None)
    assert out["g10", 0.2].f_beta_score == 0.0
    assert math.isclose(out["g11", 0.1].f_beta_score, 5 * 0.5 / 3)
    assert math.isclose(out[scores.MACRO, 0.1].f_beta_score, 5 * 0.5 / 3) and out[scores.MACRO, 0.1].recall == 0.5 and out[scores.MACRO, 0.1].tp is None
    m = out[scores.MICRO, 0.1]
    assert (m.tp, m.fp, m.fn, m.precision, m.recall) == (2, 2, 3, 0.5, 0.4)
    assert out[scores.MICRO, 0.3].tp == 0 and (scores.MACRO, 0.3) not in out


def test_best_threshold_is_the_lowest_of_equals(spark):
    rows = spark.createDataFrame([("a", 0.3, 0.5), ("a", 0.5, 0.5), ("a", 0.1, 0.2), ("b", 0.1, None)], "species string, confidence_threshold double, f_beta_score double")
    assert [(r.species, r.confidence_threshold) for r in scores.best_thresholds(rows).collect()] == [("a", 0.3)]
    assert len(songs.threshold_grid()) == 101 and len(songs.threshold_grid(0.05, 0.95, 0.05)) == 19
    with pytest.raises(ValueError):
        songs.threshold_grid(0.5, 0.1)


def test_single_class_keeps_songs_apart_but_matches_across(spark):
    d = det(spark, [box("f.wav", 0, 2, sid=0, sp="a"), box("f.wav", 1, 3, sid=1, sp="b")])
    labels = lab(spark, [("f", "b", 0.0, 2.0, 100.0, 200.0)])
    flat = scores.sweep_counts(d, labels, [0.5], 0.5, 0.1, one_class="bird").collect()
    assert [(r.species, r.tp, r.fp, r.fn) for r in flat] == [("bird", 1, 1, 0)]
    apart = {r.species: (r.tp, r.fp, r.fn) for r in scores.sweep_counts(d, labels, [0.5], 0.5, 0.1).collect()}
    assert apart == {"a": (0, 1, 0), "b": (0, 1, 1)}


def test_confusion_counts_and_shares(spark):
    d = det(spark, [box("f", 0, 1, sp="a"), box("f", 5, 6, sp="b"), box("z", 0, 1, sp="a")]).withColumn("stem", F.col("filename"))
    labels = lab(spark, [("f", "b", 0.0, 1.0, 100.0, 200.0), ("f", "b", 8.0, 9.0, 100.0, 200.0), ("y", "a", 0.0, 1.0, 100.0, 200.0)])
    cells = {(r.pred, r.true): r.n for r in confusion.analyse(d, labels, 0.5).collect()}
    assert cells == {("a", "b"): 1, ("b", "background"): 1, ("background", "b"): 1}
    dense = confusion.normalised(confusion.analyse(d, labels, 0.5, dense=True)).collect()
    assert len(dense) == 9 and all(r.share == 0 for r in dense if r.true == "a")
    a, b = common_files(d.where("stem = 'z'"), labels)
    assert (a.count(), b.count()) == (1, 3)
    with pytest.raises(ValueError):
        confusion.analyse(d.limit(0), labels)


def test_scalars(spark):
    names = ["a/b.c.wav", ".wav", "x.", "a..wav", "a/"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert [r[0] for r in df.select(stem(F.col("n"))).collect()] == ["b.c", ".wav", "x.", "a.", "a"]
    px = spark.createDataFrame([(float(y),) for y in (0, 64, 128, 192, 256)], "y double")
    assert [r[0] for r in px.select(geo.pixel_to_hz(F.col("y"))).collect()] == [15000, 6640, 2731, 904, 50]
    one = spark.range(1)
    num = lambda x, d: one.select(txt.fixed(F.lit(x), d)).first()[0]
    assert [num(x, 1) for x in (0.25, 0.35, 12.25)] == ["0.2", "0.3", "12.2"] and num(1234567.0, 2) == "1234567.00"
    text = spark.createDataFrame([("rec_XC-12345.wav",), ("aXC1.wav",)], "f string")
    assert [r[0] for r in text.select(txt.recording_number(F.col("f"))).collect()] == ["12345", ""]
    n = spark.createDataFrame([("Unknown", "????"), ("Sci name_Com_mon", "c")], "n string, c string")
    assert [tuple(r) for r in n.select(txt.scientific_name(F.col("n")), txt.common_name(F.col("n"), F.col("c"))).collect()] == [("Unknown", "????"), ("Sci name", "Com_mon")]
    dur = spark.createDataFrame([(x,) for x in (2.9, 3.0, 4.4, 4.5)], "duration double")
    counts = {r.duration: r.n for r in clips.clip_schedule(dur).groupBy("duration").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert counts == {3.0: 1, 4.4: 1, 4.5: 2}


def test_taxonomy_keeps_the_first_and_reports_splits(spark):
    sheet = spark.createDataFrame(
        [("Species ", " ABC", "Sci a", None, 1), ("species", "abc", "Sci b", "B", 2), ("genus", "g", "G", None, 3), ("species", "", "X", "X", 4), ("species", "d", "Sci a", "D", 5), ("species", None, "N", "N", 6)],
        "taxon_rank string, species_code_cornell_lab string, scientific_name string, english_name_avilist string, row_no int",
    )
    assert sorted(tuple(r) for r in taxonomy.taxonomy_map(sheet).collect()) == [("abc", "Sci a", "Sci a"), ("d", "Sci a", "D")]
    assert [r.code for r in taxonomy.splits(sheet).collect()] == ["abc"]
    assert [(r.scientific_name, r.codes) for r in taxonomy.merges(sheet).collect()] == [("Sci a", "abc, d")]
    with pytest.raises(KeyError):
        taxonomy.splits(sheet.drop("scientific_name"))
    assert taxonomy.mapping_of_model("/m/Hawaii_subset_v2.pt", [("hawaii", "Hawaii")]) == "Hawaii_subset"


def test_documents_and_csv_come_back(spark, tmp_path):
    d = det(spark, [box("f.wav", 0.25, 1.5), box("g.wav", 2, 3), box("f.wav", 9, 9.5, None)]).withColumn("file_path", F.lit(None).cast("string"))
    writers.write_documents(d, str(tmp_path / "doc"), {"model": "m", "song_gap_threshold": 0.1})
    back = readers.read_detections(spark, str(tmp_path / "doc/*.txt"), lines=True)
    key = lambda df: sorted((r.filename, r.species, r.species_id, r.confidence or -1, r.time_start, r.time_end) for r in df.collect())
    assert key(back) == key(d)
    writers.write_csv(d, str(tmp_path / "csv"))
    rows = readers.read_csv(spark, str(tmp_path / "csv")).collect()
    assert sorted((r.filename, r.time_start) for r in rows) == [("f.wav", 0.2), ("f.wav", 9.0), ("g.wav", 2.0)]
    notes = writers.annotation_rows(songs.reconstruct(d, 0.1), F.col("species"))
    doc = json.loads(writers.annotation_set(notes, "set").first()[0])
    assert [a["annotation_source_id"] for a in doc["annotations"]] == [f"segment-{i:06d}" for i in (1, 2, 3)]
    wrote = writers.save(songs.reconstruct(d, 0.1), str(tmp_path / "x_0.5"), "all", {})
    assert [w.rsplit("/", 1)[1] for w in wrote] == ["x_0.5.json", "x_0.5.csv", "x_0.5_xc.json"]
    assert readers.read_taxonomy_json(spark, str(tmp_path / "none.json")).count() == 0


def test_detector_over_clips_of_a_wav_file(spark, tmp_path):
    import numpy as np

    x = (np.sin(np.arange(int(4.5 * 32000)) * 2 * np.pi * 2000 / 32000) * 20000).astype("<i2")
    with wave.open(str(tmp_path / "tone.WAV"), "wb") as w:
        w.setnchannels(1), w.setsampwidth(2), w.setframerate(32000), w.writeframes(x.tobytes())
    (tmp_path / "broken.wav").write_bytes(b"nothing")
    (tmp_path / "notes.txt").write_text("no audio")
    files = readers.find_audio(spark, str(tmp_path), content=True)
    assert files.count() == 2
    found = audio.clips_of(files).cache()
    assert found.where("error is not null").count() == 1 and found.where("pcen is not null").count() == 2

    class Whole:
        def load(self):
            pass

        def boxes(self, batch):
            for c in batch:
                yield dict(filename=c["path"].rsplit("/", 1)[-1], clip_start=c["clip_start"], clip_end=c["clip_end"], cls=7, conf=0.5, x1=0.0, y1=0.0, x2=256.0, y2=256.0)

    dim = spark.createDataFrame([(1, "one")], "species_id int, code string")
    rows = clips.boxes_to_detections(clips.run_detector(found.where("pcen is not null"), Whole()), dim).collect()
    assert sorted((r.species, r.time_start, r.time_end, r.freq_low_hz, r.freq_high_hz) for r in rows) == [("unknown_7", 0.0, 3.0, 50, 15000), ("unknown_7", 1.5, 4.5, 50, 15000)]


def test_stream_agrees_with_batch(spark, tmp_path):
    from tonewright.streaming.songs import stream_songs

    rows = [box("f", 0, 1), box("f", 1.05, 2), box("f", 2.5, 3), box("g", 0, 1), box("f", 400, 401)]
    det(spark, rows).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(DET).parquet(str(tmp_path / "in"))
    q = stream_songs(stream, 0.1).writeStream.format("memory").queryName("songs_out").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r.filename, r.time_start, r.time_end, r.detections_merged) for r in spark.table("songs_out").collect()}
    batch = set(spans(songs.reconstruct(det(spark, rows), 0.1)))
    assert got <= batch and len(got) >= 3


def test_sweep_songs_are_those_of_each_threshold(spark):
    r = random.Random(12)
    rows = [box(r.choice(["f", "g", None]), s := r.randrange(400) / 4, s + r.choice([0.25, 1, 3, -0.5, 35 if r.random() < 0.1 else 1]), r.choice([None, float("nan"), *(k / 10 for k in range(11))]), r.choice([0, 1, None])) for _ in range(500)]
    df = det(spark, rows)
    swept = sweep.at_each(sweep.song_versions(df, [0.0, 0.3, 0.8], 0.25, shard_seconds=10), [0.0, 0.3, 0.8]).collect()
    for t in (0.0, 0.3, 0.8):
        own = songs.reconstruct(songs.confident(df, t), 0.25).collect()
        key = lambda x: (x.filename or "", x.species_id is None, x.species_id or 0, x.time_start, x.time_end, x.detections_merged, x.species, x.freq_low_hz, x.freq_high_hz, x.max_confidence or -1, round(x.avg_confidence or -1, 9))
        assert sorted(map(key, (x for x in swept if x.threshold == t))) == sorted(map(key, own))


def test_sweep_of_nothing_and_of_one_row(spark):
    assert sweep.song_versions(det(spark, []), [0.0, 0.5]).count() == 0
    one = sweep.song_versions(det(spark, [box("f", 0, 1, 0.5)]), [0.0, 0.5, 0.6]).collect()
    assert [(x.lo, x.hi, x.time_end, x.detections_merged) for x in one] == [(0, 1, 1.0, 1)]
    with pytest.raises(ValueError):
        sweep.song_versions(det(spark, []), [0.5, 0.5])


def test_edges_of_absurd_bounds(spark):
    inf = float("inf")
    d = det(spark, [box("f", 0, 1e12), box("f", 0, inf), box("f", float("nan"), 2), box("f", 5, 5), box("f", 0, 1e-9)]).withColumn("stem", F.col("filename"))
    labels = lab(spark, [("f", "x", 0.0, 9e11, 100.0, 200.0), ("f", "x", 0.0, inf, 100.0, 200.0), ("f", "x", 0.0, 1e-9, 100.0, 200.0)])
    assert sorted((x.det_id, x.label_id) for x in edges(d, labels, ["stem"], 0.5).collect()) == [(0, 0), (4, 2)]


def test_suppression_keeps_rows_without_time(spark):
    rows = [box("f", 0, 1), box("f", 0, 1, 0.8), ("f", "x", 0, 0.5, None, 1.0, 1, 2), ("f", "x", 0, 0.5, 0.0, float("nan"), 1, 2), box("f", 5, 4)]
    assert sorted(x.det_id for x in songs.suppress(det(spark, rows), 0.5).collect()) == [0, 2, 3, 4]


def test_annotation_documents_have_all_fields_and_are_cut(spark):
    rows = [box(f"r{k}_XC{k}.wav", k, k + 1, 0.5) for k in range(7)]
    notes = writers.annotation_rows(songs.reconstruct(det(spark, rows), 0.1), F.col("species"), software="s")
    docs = [json.loads(r[0]) for r in writers.annotation_set(notes, "n", software="s", most=3).collect()]
    assert [[a["annotation_source_id"] for a in d["annotations"]] for d in docs] == [[f"segment-{i:06d}" for i in g] for g in ((1, 2, 3), (4, 5, 6), (7,))]
    assert docs[0]["scope"] == [{"taxon_coverage": "x", "completeness": "part"}] and len(docs[0]) == 14
    a = docs[0]["annotations"][0]
    assert a["annotation_remarks"] == "Detected by s; eBird code: x; confidence: 0.500" and a["xc_nr"] == "0" and a["sound_type"] == "call" and len(a) == 13
    bare = writers.annotation_set(writers.annotation_rows(songs.reconstruct(det(spark, [box("f", 0, 1)]), 0.1), F.lit("")), "n").first()[0]
    assert json.loads(bare)["scope"][0]["taxon_coverage"] == "birds"


def test_documents_of_several_files_and_long_files(spark, tmp_path):
    rows = [box("f", k, k + 0.5) for k in range(7)] + [box("g", 0, 1)]
    per = [json.loads(r.value) for r in writers.documents(det(spark, rows), {}, most=3, filtering={"confidence_threshold": 0.2}, original_count=99).collect()]
    assert sorted((d["audio_file"], d["part_no"], d["detection_count"]) for d in per) == [("f", 0, 3), ("f", 1, 3), ("f", 2, 1), ("g", 0, 1)]
    assert all(d["filtering_config"] == {"confidence_threshold": 0.2} and d["original_detection_count"] == 99 for d in per)
    assert sorted(x["time_start"] for d in per for x in d["detections"] if d["audio_file"] == "f") == [float(k) for k in range(7)]
    several = writers.documents(det(spark, rows), {}, per_file=False)
    one = json.loads(several.first().value)
    assert one["audio_files"] == ["f", "g"] and one["file_count"] == 2 and one["detection_count"] == 8
    several.select("value").write.text(str(tmp_path / "d"))
    back = readers.read_detections(spark, str(tmp_path / "d/*.txt"), lines=True).collect()
    assert len(back) == 8 == len({x.det_id for x in back})


def test_blank_rows_and_warnings(spark):
    rows = spark.createDataFrame([(" ", None, None), ("a", " ", None), (None, None, 1)], "x string, y string, z int")
    assert sorted(map(tuple, readers.drop_blank_rows(rows).collect()), key=str) == [("a", None, None), (None, None, 1)]
    sheet = spark.createDataFrame([("species", c, n, "e") for c, n in (("a", "A"), ("a", "B"), ("b", "A"))], "taxon_rank string, species_code_cornell_lab string, scientific_name string, english_name_avilist string")
    assert sorted(map(tuple, taxonomy.warnings(sheet).collect())) == [("merge", "A", "a, b"), ("split", "a", "2")]


def test_normalisation_against_its_definition():
    import numpy as np

    e = np.abs(np.random.default_rng(3).standard_normal((4, 30))) * 1e6
    t = audio.TIME_CONSTANT * audio.RATE / audio.HOP
    s = (np.sqrt(1 + 4 * t * t) - 1) / (2 * t * t)
    level, want = 1.0, []
    for k in range(30):
        level = (1 - s) * level + s * e[:, k]
        want.append((e[:, k] / (1e-6 + level) ** 0.75 + 1) ** 0.35 - 1)
    assert np.allclose(audio.normalised(e), np.array(want).T)
    x = (np.sin(np.arange(125 * audio.RATE) * 0.4) * np.linspace(0.1, 1, 125 * audio.RATE)).astype(np.float32)
    got = dict(audio.clips_of_samples(x))
    assert sorted(got) == list(range(82)) and all(v.shape == (256, 252) for v in got.values())
    # the clip at 61.5 s belongs to the second minute, whose sound starts at 58 s
    assert np.array_equal(got[41], audio.pcen(x[58 * audio.RATE : 122 * audio.RATE])[:, 298 : 298 + 252])
    first = audio.pcen(x[: 62 * audio.RATE])
    assert np.array_equal(got[0], first[:, :252])
