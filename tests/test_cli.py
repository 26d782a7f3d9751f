"""The command line over small files."""

import json

import pytest

from tonewright import cli


def test_filter_sweep_and_confusion(spark, tmp_path):
    doc = {"audio_file": "/a/f.wav", "model_config": {"song_gap_threshold": 0.3}, "detections": [
        {"species": "x", "species_id": 1, "confidence": c, "time_start": s, "time_end": e, "freq_low_hz": 100, "freq_high_hz": 200}
        for c, s, e in [(0.9, 0.0, 1.0), (0.8, 1.2, 2.0), (0.1, 2.0, 5.0), (0.7, 9.0, 10.0)]
    ]}
    (tmp_path / "d.json").write_text(json.dumps(doc))
    (tmp_path / "l.csv").write_text("Filename,Start Time (s),End Time (s),Low Freq (Hz),High Freq (Hz),Species eBird Code\nf.flac,0.0,2.0,100,200,x\nf.flac,20,21,100,200,\n")
    cli.main(["filter", "--input", str(tmp_path / "d.json"), "--output-path", str(tmp_path / "out"), "--conf", "0.2", "--output-format", "csv"])
    rows = spark.read.option("header", True).csv(str(tmp_path / "out.csv")).collect()
    assert sorted((r[0], r[1], r[2]) for r in rows) == [("f.wav", "0.0", "2.0"), ("f.wav", "9.0", "10.0")]
    cli.main(["sweep", "--detections", str(tmp_path / "d.json"), "--labels", str(tmp_path / "l.csv"), "--conf-range", "0.2", "0.9", "0.7", "--output-path", str(tmp_path / "s")])
    best = {r["species"]: r for r in spark.read.option("header", True).csv(str(tmp_path / "s/optimal_thresholds.csv")).collect()}
    # at 0.9 one song is left, which covers just half of the label
    assert best["x"]["confidence_threshold"] == "0.9" and best["x"]["tp"] == "1" and best["x"]["fp"] == "0" and best["x"]["fn"] == "0"
    cli.main(["confusion", "--detections", str(tmp_path / "out.csv"), "--labels", str(tmp_path / "l.csv"), "--output-path", str(tmp_path / "c")])
    m = {r["pred"]: r.asDict() for r in spark.read.option("header", True).csv(str(tmp_path / "c/confusion_matrix.csv")).collect()}
    assert m["x"] == {"pred": "x", "background": "1", "x": "1"} and m["background"]["x"] == "0"
    facts = dict(r.value.split(": ", 1) for r in spark.read.text(str(tmp_path / "c/metadata.txt")).collect())
    assert facts["num_detections"] == "2" and facts["num_labels"] == "1" and facts["species_list"] == "x" and facts["num_species"] == "1" and facts["iou_type"] == "2D (time-frequency)"
    table = {r["species"] for r in spark.read.option("header", True).csv(str(tmp_path / "c/f_beta_table.csv")).collect()}
    assert table == {"x", "MACRO_AVERAGE", "WEIGHTED_AVERAGE", "MICRO_AVERAGE"}
    cli.main(["filter", "--input", str(tmp_path / "d.json"), "--output-path", str(tmp_path / "j"), "--conf", "0.2", "--output-format", "json"])
    doc = json.loads(spark.read.text(str(tmp_path / "j.json")).first()[0])
    assert doc["filtering_config"] == {"confidence_threshold": 0.2, "song_gap_threshold": 0.3} and doc["original_detection_count"] == 4 and doc["model_config"]["song_gap_threshold"] == 0.3
    with pytest.raises(SystemExit):
        cli.main(["filter", "--input", str(tmp_path / "d.json"), "--output-path", "o", "--conf", "2"])
    with pytest.raises(SystemExit):
        cli.main(["filter", "--input", str(tmp_path / "absent.json"), "--output-path", "o", "--conf", "0.2"])


@pytest.mark.parametrize("sound,marked,tp", [("REC_1.wav", "REC_1.flac", 1), ("/a/B/Rec.1.WAV", "Rec.1.flac", 1), ("REC.wav", "rec.wav", 0)])
def test_sweep_pairs_files_by_stem_as_written(spark, tmp_path, sound, marked, tp):
    doc = {"audio_file": sound, "detections": [{"species": "x", "species_id": 1, "confidence": 0.9, "time_start": 0.0, "time_end": 1.0, "freq_low_hz": 100, "freq_high_hz": 200}]}
    (tmp_path / "d.json").write_text(json.dumps(doc))
    (tmp_path / "l.csv").write_text(f"Filename,Start Time (s),End Time (s),Low Freq (Hz),High Freq (Hz),Species eBird Code\n{marked},0.0,1.0,100,200,x\n")
    cli.main(["sweep", "--detections", str(tmp_path / "d.json"), "--labels", str(tmp_path / "l.csv"), "--conf-range", "0.5", "0.5", "0.1", "--output-path", str(tmp_path / "s")])
    rows = {r["species"]: r for r in spark.read.option("header", True).csv(str(tmp_path / "s/f1_score_analysis.csv")).collect()}
    assert (rows["x"]["tp"], rows["x"]["fp"], rows["x"]["fn"]) == (str(tp), str(1 - tp), str(1 - tp))
