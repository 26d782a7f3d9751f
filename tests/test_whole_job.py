"""Registered queries do the whole job: small tables against hand-made or brute-force results."""

import random

import __spark_entry__ as entry
from tonewright import cli
from tonewright.operators.matching import best_assignment, one_to_one

DETECTIONS = "det_id bigint, filename string, file_path string, species string, species_id int, confidence double, time_start double, time_end double, freq_low_hz int, freq_high_hz int, clip_start double, clip_end double"
LABELS = "label_id bigint, filename string, time_start double, time_end double, freq_low_hz double, freq_high_hz double, species string"


def song(file, s, e, sp="x", sid=0, conf=1.0, lo=100, hi=200):
    return (file, None, sp, sid, conf, float(s), float(e), lo, hi, 0.0, 3.0)


def mark(file, s, e, sp="x", lo=100.0, hi=200.0):
    return (file, float(s), float(e), lo, hi, sp)


def tables(spark, tmp_path, songs, marks) -> str:
    spark.createDataFrame([(i, *r) for i, r in enumerate(songs)], DETECTIONS).write.parquet(str(tmp_path / "detections.parquet"))
    spark.createDataFrame([(1000 + i, *r) for i, r in enumerate(marks)], LABELS).write.parquet(str(tmp_path / "labels.parquet"))
    return str(tmp_path)


def run(spark, d, name):
    return entry.queries()[name](spark, d).collect()


def most_pairs(pairs) -> int:
    """Size of a maximum matching, by augmenting paths."""
    near, of = {}, {}
    for a, b in pairs:
        near.setdefault(a, []).append(b)

    def free(a, seen):
        for b in near[a]:
            if b not in seen:
                seen.add(b)
                if b not in of or free(of[b], seen):
                    of[b] = a
                    return True
        return False

    return sum(free(a, set()) for a in near)


def iou(a, b):
    w, h = min(a[6], b[2]) - max(a[5], b[1]), min(a[8], b[4]) - max(a[7], b[3])
    return w * h / ((a[6] - a[5]) * (a[8] - a[7]) + (b[2] - b[1]) * (b[4] - b[3]) - w * h) if w > 0 and h > 0 else 0


def test_several_songs_of_a_label_are_one_true_positive(spark, tmp_path):
    # one code under two ids, and two files of one stem, over one label each
    d = tables(spark, tmp_path, [song("f.wav", 0, 2, sid=0), song("f.wav", 0, 2, sid=1), song("a/g.wav", 0, 2), song("b/g.flac", 0, 2)], [mark("f.wav", 0, 2), mark("g.wav", 0, 2)])
    assert {(r.tp, r.fp, r.fn) for r in run(spark, d, "tp_fp_fn")} == {(2, 2, 0)}
    best = {r.species: r for r in run(spark, d, "optimal_threshold")}
    assert (best["x"].precision, best["x"].recall) == (0.5, 1.0)
    r = random.Random(31)
    songs = [song(r.choice(["a/f.wav", "b/f.wav"]), s := r.randrange(60) * 4, s + r.choice([1, 2, 3]), r.choice("xy"), r.randrange(3)) for _ in range(80)]
    songs = list({(s[0], s[3], s[5]): s for s in songs}.values())  # nothing merges: starts of a file and id are 4 s apart
    marks = [mark("f.wav", s := r.randrange(60) * 4, s + r.choice([1, 2, 3]), r.choice("xy")) for _ in range(80)]
    (tmp_path / "2").mkdir()
    got = {x.species: x.tp for x in run(spark, tables(spark, tmp_path / "2", songs, marks), "tp_fp_fn") if x.threshold == 0.5}
    pairs = [(i, j, a[2]) for i, a in enumerate(songs) for j, b in enumerate(marks) if a[2] == b[5] and iou(a, b) >= 0.5]
    assert got == {sp: most_pairs([p[:2] for p in pairs if p[2] == sp]) for sp in "xy"}
    assert sum(got.values()) < len({p[0] for p in pairs})  # counting songs would differ


def test_scores_cover_every_hundredth(spark, tmp_path):
    # the right song is sure to 0.57, false ones up to 0.56: only at 0.57 does F reach 1
    d = tables(spark, tmp_path, [song("f.wav", 0, 2, conf=0.57), song("f.wav", 10, 12, conf=0.56), song("f.wav", 20, 22, conf=0.54)], [mark("f.wav", 0, 2)])
    grid = [k / 100 for k in range(101)]
    best = {r.species: (r.confidence_threshold, r.f_beta_score) for r in run(spark, d, "optimal_threshold")}
    assert best["x"] == (0.57, 1.0)
    for name in ("tp_fp_fn", "f_beta_rows", "plot_frame", "sweep_optimal", "sweep_single_class", "sweep_greedy"):
        at = [r["threshold" if name == "tp_fp_fn" else "confidence_threshold"] for r in run(spark, d, name) if r.species in ("x", "bird")]
        assert sorted(at) == grid, name
    assert [r.best for r in run(spark, d, "top_species") + run(spark, d, "bottom_species")] == [1.0, 1.0]
    wide = entry.queries()["f_pivot"](spark, d)
    assert wide.columns == ["species", *(f"{t:.2f}" for t in grid)] and wide.first()["0.57"] == 1.0


def test_wide_confusion_has_every_class(spark, tmp_path):
    d = tables(spark, tmp_path, [song("f.wav", 0, 2, "new`1"), song("f.wav", 9, 11, "only.pred", 1)], [mark("f.wav", 0, 2, "st. x"), mark("f.wav", 20, 22, "pazreq")])
    classes = ["background", "new`1", "only.pred", "pazreq", "st. x"]
    want = {("new`1", "st. x"): 1, ("only.pred", "background"): 1, ("background", "pazreq"): 1}
    m = {r["pred"]: r.asDict() for r in run(spark, d, "confusion_pivot")}
    assert {(p, t): m[p][t] for p in m for t in m[p] if t != "pred"} == {(p, t): want.get((p, t), 0) for p in classes for t in classes}
    named = {r["pred"]: r.asDict() for r in run(spark, d, "confusion_prefixed")}
    assert {(p, t): n for p, r in named.items() for t, n in r.items() if n and t != "pred"} == {(f"pred_{p}", f"true_{t}"): n for (p, t), n in want.items()}


def test_confusion_matches_second_best_pairs(spark, tmp_path):
    # song b is best for both labels, and both songs' best label is y: one mutual pair, two matches
    # z.wav has no labels, and its song counts too
    d = tables(spark, tmp_path, [song("f.wav", 0, 10, "a", 0), song("f.wav", 2, 12, "b", 1), song("z.wav", 0, 1, "c", 2)], [mark("f.wav", 2, 12, "y"), mark("f.wav", 3, 16, "x")])
    want = {("a", "x"): 1, ("b", "y"): 1, ("c", "background"): 1}
    cells = {(r["pred"], r["true"]): r["n"] for r in run(spark, d, "confusion_long")}
    assert cells == want
    assert {(r["pred"], r["true"]): r["share"] for r in run(spark, d, "confusion_normalised")} == {k: 1.0 for k in want}
    m = {r["pred"]: r.asDict() for r in run(spark, d, "confusion_pivot")}
    assert m["a"]["x"] == m["b"]["y"] == 1 and not any(v for k, v in m["background"].items() if k != "pred")
    assert {r.species: (r.true_positives, r.false_positives, r.false_negatives) for r in run(spark, d, "matrix_f_beta")} == {"a": (0, 1, 0), "b": (0, 1, 0), "c": (0, 1, 0), "x": (0, 0, 1), "y": (0, 0, 1)}
    assert {(r["pred"], r["true"]) for r in run(spark, d, "confusion_mutual_best")} == {("b", "y"), ("a", "background"), ("c", "background"), ("background", "x")}


def test_averages_rest_on_all_matches(spark, tmp_path):
    d = tables(spark, tmp_path, [song("f.wav", 0, 10, "x", 0), song("f.wav", 2, 12, "x", 1)], [mark("f.wav", 2, 12), mark("f.wav", 3, 16)])
    assert {r.f_beta for r in run(spark, d, "matrix_averages")} == {1.0}


def test_long_chains_stay_one_part(spark):
    # detection i meets labels i and i + 1; the better pairs leave one label in the middle out
    r = random.Random(5)
    e = [("f", i, j, r.randrange(30, 90) / 100) for i in range(1000) for j in (i, i + 1)]
    got = one_to_one(spark.createDataFrame(e, "stem string, det_id bigint, label_id bigint, iou double"), ["stem"]).collect()
    want = best_assignment([x[1] for x in e], [x[2] for x in e], [x[3] for x in e])
    assert len(got) == len({x.det_id for x in got}) == len({x.label_id for x in got}) == 1000
    assert {(x.det_id, x.label_id) for x in got} == {e[k][1:3] for k in want}
    # the label left out is where the sums of the pairs to the left and to the right are best
    left, right = [e[2 * i][3] for i in range(1000)], [e[2 * i + 1][3] for i in range(1000)]
    best = max(sum(left[:k]) + sum(right[k:]) for k in range(1001))
    assert abs(sum(x.iou for x in got) - best) < 1e-9


def test_greedy_goes_by_file_and_start(spark):
    # the later row has the smaller id; by start the first takes label 1, the second is left with label 2
    e = spark.createDataFrame([("s", 9, 1, 0.6, 0.0), ("s", 2, 1, 0.9, 1.0), ("s", 2, 2, 0.5, 1.0)], "stem string, det_id bigint, label_id bigint, iou double, start double")
    assert sorted(x[1:3] for x in one_to_one(e, ["stem"], False, "start").collect()) == [(2, 2), (9, 1)]
    assert [x[1:3] for x in one_to_one(e, ["stem"], False).collect()] == [(2, 1)]
    # ids of any type
    text = e.withColumn("det_id", e.det_id.cast("string"))
    assert sorted(x[1:3] for x in one_to_one(text, ["stem"]).collect()) == [("2", 2), ("9", 1)]


def test_matrix_of_too_many_classes_is_written_as_cells(spark, tmp_path, monkeypatch):
    head = "Filename,Start Time (s),End Time (s),Low Freq (Hz),High Freq (Hz),Species eBird Code\n"
    (tmp_path / "d.csv").write_text(head + "".join(f"f.wav,{10 * i},{10 * i + 2},100,200,s{i}\n" for i in range(4)))
    (tmp_path / "l.csv").write_text(head + "".join(f"f.wav,{10 * i},{10 * i + 2},100,200,t{i}\n" for i in range(4)))
    monkeypatch.setattr(cli, "WIDEST", 8)  # of 9 classes
    cli.main(["confusion", "--detections", str(tmp_path / "d.csv"), "--labels", str(tmp_path / "l.csv"), "--output-path", str(tmp_path / "c")])
    rows = spark.read.option("header", True).csv(str(tmp_path / "c/confusion_cells.csv")).collect()
    assert sorted((r["pred"], r["true"], r["n"]) for r in rows) == [(f"s{i}", f"t{i}", "1") for i in range(4)]
    assert not (tmp_path / "c/confusion_matrix.csv").exists() and any("9" in x.value for x in spark.read.text(str(tmp_path / "c/metadata.txt")).collect())
    monkeypatch.setattr(cli, "WIDEST", 9)
    cli.main(["confusion", "--detections", str(tmp_path / "d.csv"), "--labels", str(tmp_path / "l.csv"), "--output-path", str(tmp_path / "w")])
    assert len(spark.read.option("header", True).csv(str(tmp_path / "w/confusion_matrix.csv")).columns) == 10
