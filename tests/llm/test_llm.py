"""The training-data operators against brute force on small fixtures, with their odd inputs."""

import math
import os
import random
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from tonewright.llm import entities, leakage, packing, percentiles, visible
from tonewright.llm.runs import runs

NAN = float("nan")


# --- 1 matching --------------------------------------------------------------------------


def test_recording_keys_of_all_styles():
    same = ["HUBA1_20310102_073000.wav", "huba1-20310102-073000.flac", "2031-01-02/HUBA1_073000.flac", "HUBA1_310102_0730.wav", "HUBA1 02.01.2031 0730.mp3", "annotations\\HUBA1_20310102_073000_final.flac", "/a/b/HUBA1_20310102_073000.wav"]
    assert {entities.key_of_name(n) for n in same} == {"huba1|310102|0730"}
    assert [entities.key_of_name(n) for n in ("a/Other.wav", "", None, " ", "x/", ".wav", "two words 1.2.flac")] == ["other", None, None, None, None, ".wav", "two words 1.2"]


def _match_fixture(spark, seed=1):
    r = random.Random(seed)
    det, lab, truth = [], [], set()
    species = ["aaa", "bbb", "ccc", "ddd"]
    names = {"aaa": "Alpha bird", "bbb": "Beta bird", "ccc": "Gamma bird", "ddd": "Delta bird"}
    bands = {"aaa": (500, 1500), "bbb": (2500, 4500), "ccc": (6000, 8000), "ddd": (900, 6500)}
    i, j = 0, 10**6
    for rec in range(12):
        t, shift = 0.0, 1.5 if rec % 4 == 3 else 0.0
        for _ in range(25):
            t += 1.5 + r.random() * 4
            sp = r.choice(species)
            lo, hi = bands[sp]
            length = 0.4 + r.random()
            boxes = []
            for _ in range(r.choice([1, 1, 2])):
                i += 1
                boxes.append(i)
                det.append((i, f"STA{rec:02d}_20310101_{rec:02d}0000.wav", None, r.choice([sp, sp, sp, sp, None]), t + r.uniform(-0.03, 0.03), t + length + r.uniform(-0.03, 0.03), lo + r.randrange(-60, 60), hi + r.randrange(-90, 90)))
            if r.random() < 0.7:
                j += 1
                lab.append((j, f"STA{rec:02d}_310101_{rec:02d}00.flac", round(t + shift, 1), round(t + length + shift, 1), float(lo + r.randrange(-150, 150)), float(hi + r.randrange(-200, 200)), r.choice([sp.upper(), names[sp]]), "x"))
                truth |= {(b, j) for b in boxes}
    D = "det_id bigint, filename string, file_path string, species string, time_start double, time_end double, freq_low_hz int, freq_high_hz int"
    L = "label_id bigint, filename string, time_start double, time_end double, freq_low_hz double, freq_high_hz double, species string, annotator string"
    return det, lab, truth, D, L


def test_matching_finds_the_pairs_and_not_others(spark):
    det, lab, truth, D, L = _match_fixture(spark)
    odd = [(90001, None, None, "aaa", 1.0, 2.0, 1, 2), (90002, "STA00_20310101_000000.wav", None, "aaa", None, 2.0, 1, 2), (90003, "STA00_20310101_000000.wav", None, None, 5.0, NAN, None, None)]
    d = spark.createDataFrame(det + odd, D).withColumn("cosine", F.lit("clash"))
    got = {(x.det_id, x.label_id) for x in entities.match(d, spark.createDataFrame(lab, L)).collect()}
    assert len(got & truth) >= 0.95 * len(truth) and len(got & truth) >= 0.95 * len(got)


def test_matching_of_empty_tables(spark):
    det, lab, _, D, L = _match_fixture(spark)
    assert entities.match(spark.createDataFrame([], D), spark.createDataFrame(lab[:5], L)).count() == 0
    assert entities.match(spark.createDataFrame(det[:5], D), spark.createDataFrame([], L)).count() == 0


def _candidates(spark, det, lab, D, L, vectors=None):
    a = entities._with_tokens(entities._keyed(spark.createDataFrame(det, D), "det_id", "filename"), entities._DET, entities._NAME)
    a = a.withColumn("slab", entities._slab(F.col("t")))
    b = entities._with_tokens(entities._keyed(spark.createDataFrame(lab, L), "label_id", "filename"), entities._NAME, entities._LOW - entities._NAME)
    trained = vectors or entities.train(a, b)
    b = b.withColumn("decoy", F.lit(False)).withColumn("block", entities._slab(F.col("t")))
    at = entities._at_slabs(b, a.select("key", "slab").distinct(), 2.0)
    rows = entities._probe(a, at, entities._prober(trained, 6, 4, 9, 0.4, -1.0, 6)).select("d_id", "l_id").collect()
    return {(x.d_id, x.l_id) for x in rows}, trained


def test_blocking_by_trained_vectors_beats_random_ones(spark):
    det, lab, truth, D, L = _match_fixture(spark, 2)
    shifted = {x[0] for x in lab if x[1][3:5] in ("03", "07", "11")}
    truth = {t for t in truth if t[1] not in shifted}  # clocks are put right before
    lab = [(*x[:2], x[2] + 0.3, x[3] + 0.3, *x[4:]) for x in lab]  # but not wholly
    found, trained = _candidates(spark, det, lab, D, L)
    assert len(truth & found) >= 0.95 * len(truth)
    rng = np.random.default_rng(0)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    chance = entities.Vectors(unit(rng.standard_normal(trained.what.shape)), unit(rng.standard_normal(trained.place.shape)))
    blind, _ = _candidates(spark, det, lab, D, L, chance)
    # with random vectors a place's neighbours are strangers
    assert len(truth & blind) < 0.7 * len(truth & found)


def test_places_near_in_time_have_near_vectors(spark):
    det, lab, _, D, L = _match_fixture(spark, 3)
    a = entities._with_tokens(entities._keyed(spark.createDataFrame(det, D), "det_id", "filename"), entities._DET, entities._NAME)
    v = entities.train(a, a.limit(0))
    t = np.arange(0, 64, 0.5)
    cos = lambda d: float((v.of_place(t) * v.of_place(t + d)).sum(axis=1).mean())
    assert cos(0.1) > 0.97 and cos(0.1) > cos(0.5) > cos(2) > cos(8) and abs(cos(64) - 1) < 1e-9


def test_matching_copes_with_absurd_rows(spark):
    det, lab, truth, D, L = _match_fixture(spark, 4)
    inf = float("inf")
    det += [(10**7 + k, f, None, None, t, e, None, None) for k, (f, t, e) in enumerate([(None, 1.0, 2.0), ("STA00_20310101_000000.wav", None, 2.0), ("STA00_20310101_000000.wav", NAN, 1.0), ("STA00_20310101_000000.wav", inf, 1.0), ("STA00_20310101_000000.wav", 5.0, inf)])]
    lab += [(2 * 10**6 + k, "STA00_20310101_000000.wav", t, e, None, NAN, "\x00" * 3, "x") for k, (t, e) in enumerate([(3.0, 1e15), (None, 2.0), (4.0, inf), (1e15, 2e15), (-1e15, 1e15)])]
    d = spark.createDataFrame(det, D).withColumn("key", F.lit("clash")).withColumn("slab", F.lit(1))
    got = {(x.det_id, x.label_id) for x in entities.match(d, spark.createDataFrame(lab, L)).collect()}
    assert len(got & truth) >= 0.95 * len(truth)


def test_isotonic_pools_violators():
    assert entities.isotonic(np.array([1.0, 3.0, 2.0, 4.0]), np.array([1.0, 1.0, 3.0, 1.0])).tolist() == [1.0, 2.25, 2.25, 4.0]
    assert entities.isotonic(np.array([]), np.array([])).tolist() == []


# --- 2 percentiles -----------------------------------------------------------------------


def test_percentiles_are_exact_and_days_combine(spark):
    r = random.Random(3)
    rows = [("a", d, r.choice([r.random(), 0.5, r.gauss(0, 1e-3), -r.random()])) for d in range(5) for _ in range(700)]
    rows += [("b", 1, 0.1 + 0.2), ("b", 1, 0.3), ("b", None, 5e-324), ("c", 1, None), (None, 1, 1.0), ("a", 2, NAN)] + rows[:200]
    df = spark.createDataFrame(rows, "g string, d int, v double").withColumn("digit", F.lit("clash"))
    ps = [0, 1, 50, 99, 100]
    got = {(x.scope, x.group, x.part, x.percent): (x.n_values, x.value) for x in percentiles.percentiles(df, F.col("g"), F.col("d"), F.col("v"), ps).collect()}
    by = {}
    for g, d, v in rows:
        if g is not None and v is not None and v == v:
            by.setdefault(("all", g, None), []).append(v)
            by.setdefault(("part", g, d), []).append(v)
    want = {(*k, p): (len(v), sorted(v)[max(1, -(-p * len(v) // 100)) - 1]) for k, v in by.items() for p in ps}
    assert got == want
    days = percentiles.histogram(df, F.col("g"), F.col("d"), F.col("v"))
    for x in percentiles.estimate(percentiles.merge(days), ["group"], ps).collect():
        n, true = want["all", x.group, None, x.percent]
        assert x.n_values == n and abs(x.value - true) <= abs(true) / 512 + 2.0**-1031  # half a bin below 2**-1022
    assert percentiles.percentiles(df.limit(0), F.col("g"), F.col("d"), F.col("v"), ps).count() == 0
    with pytest.raises(ValueError):
        percentiles.percentiles(df, F.col("g"), F.col("d"), F.col("v"), [])


# --- 4 runs ------------------------------------------------------------------------------


@pytest.mark.parametrize("shard", [1.5, 40.0, 10000.0])
def test_runs_match_a_scan_for_any_shard_width(spark, shard):
    r = random.Random(5)
    rows = [(i, r.choice(["hot", "hot", "b", None]), r.choice(["x", " X", "y", None]), r.choice([0.5, 0.52, 0.9, None, NAN]), r.choice([None, NAN, *(k / 4 for k in range(400))]), None) for i in range(1500)]
    rows = [(*x[:5], None if x[4] is None else x[4] + r.choice([0.2, -1.0])) for x in rows] + [(2000, "b", "x", 0.5, 3.0, 3.1), (2000, "b", "x", 0.5, 3.0, 3.1)]
    df = spark.createDataFrame(rows, "det_id bigint, q string, species string, confidence double, time_start double, time_end double").withColumn("_r", F.lit(0)).withColumn("label", F.lit(1))
    got = sorted((x.sequence, x.first_id, x.start, x.end, x.events) for x in runs(df, "q", shard_seconds=shard).collect())
    by, want = {}, []
    for x in rows:
        if x[1] is not None and x[4] is not None and x[4] == x[4]:
            by.setdefault(x[1], []).append(x)
    for q, xs in by.items():
        xs.sort(key=lambda x: (x[4], x[0]))
        last = None
        for x in xs:
            end = x[5] if x[5] is not None and x[5] >= x[4] else x[4]
            ok = last and x[2] is not None and last[2] is not None and x[2].strip().lower() == last[2].strip().lower() and x[4] - last[4] <= 0.5
            ok = ok and None not in (x[3], last[3]) and abs(x[3] - last[3]) <= 0.05
            if ok:
                want[-1][3:] = [end, want[-1][4] + 1]
            else:
                want.append([q, x[0], x[4], end, 1])
            last = x
    assert got == sorted(tuple(w) for w in want)
    assert runs(df.limit(0), "q").count() == 0


# --- 6 packing ---------------------------------------------------------------------------


def test_nnls_solves_small_systems():
    rng = np.random.default_rng(1)
    for _ in range(20):
        a = rng.random((6, 4))
        x = np.maximum(rng.standard_normal(4), 0)
        assert np.allclose(packing.nnls(a, a @ x), x, atol=1e-6)


@pytest.mark.parametrize("capacity", [1, 7, 64, 2048])
def test_plan_holds_everything_once_and_wastes_little(capacity):
    r = random.Random(capacity)
    counts = {}
    for _ in range(3000):
        n = min(capacity, max(1, int(r.expovariate(4 / capacity))))
        counts[n] = counts.get(n, 0) + 1
    slots, containers = packing.plan(counts, capacity)
    fill, covered = [0] * containers, {}
    for length, first, n, base, per in slots:
        assert covered.get(length, 0) == first
        covered[length] = first + n
        for k in range(n):
            fill[base + k // per] += length
    assert covered == counts and max(fill) <= capacity and min(fill) > 0
    assert containers <= math.ceil(sum(k * v for k, v in counts.items()) / capacity) * 1.02 + 1
    assert packing.plan({}, capacity) == ([], 0)


def test_patterns_do_the_packing_and_beat_best_fit():
    # best fit puts the large ones with the wrong partners
    counts = {1034: 600, 532: 600, 522: 600, 492: 1200}
    _, containers, placed = packing._planned(counts, 2048, 128, 12)
    _, best_fit, _ = packing._planned(counts, 2048, 128, 1)
    assert containers == 900 < best_fit and placed == 3000
    r = random.Random(8)
    mixed = {}
    for _ in range(20_000):
        n = min(2048, max(1, int(r.expovariate(1 / 300))))
        mixed[n] = mixed.get(n, 0) + 1
    _, containers, placed = packing._planned(mixed, 2048, 128, 12)
    assert placed > 0.9 * sum(mixed.values()) and containers <= 1.005 * sum(k * v for k, v in mixed.items()) / 2048 + 1


def test_best_pattern_is_the_most_valuable_filling():
    import itertools

    r = np.random.default_rng(5)
    for _ in range(20):
        sizes = np.unique(r.integers(1, 12, 5))
        value = r.standard_normal(len(sizes))
        gain, p = packing.best_pattern(value, sizes, 20, 4, 3)
        all_ = [c for k in range(1, 5) for c in itertools.combinations_with_replacement(range(len(sizes)), k) if 17 <= sizes[list(c)].sum() <= 20]
        want = max((value[list(c)].sum() for c in all_), default=-np.inf)
        assert gain == want == -np.inf or abs(gain - want) < 1e-9 and abs(value[list(p)].sum() - gain) < 1e-9


def test_containers_of_texts(spark):
    rows = [(1, 0), (2, None), (3, 5000), (4, 2048), (5, 100), (5, 100)] + [(i, i % 700 + 1) for i in range(10, 900)]
    got = packing.containers(spark.createDataFrame(rows, "id bigint, length bigint").withColumn("piece", F.lit(7)), 2048).collect()
    fill, by = {}, {}
    for x in got:
        fill[x.container_id] = fill.get(x.container_id, 0) + x.length
        by.setdefault(x.id, []).append((x.piece, x.first_token, x.length))
    assert max(fill.values()) <= 2048 and set(fill) == set(range(len(fill)))
    assert sorted(by[3]) == [(0, 0, 2048), (1, 2048, 2048), (2, 4096, 904)] and 1 not in by and 2 not in by and len(by[5]) == 2
    assert sum(x.length for x in got) == sum(n or 0 for _, n in rows)
    assert packing.containers(spark.createDataFrame([], "id bigint, length bigint")).count() == 0


@pytest.mark.skipif(not os.path.exists(packing.VOCABULARY), reason="no vocabulary here")
def test_token_counts(spark):
    df = spark.createDataFrame([("",), (None,), ("hello world",), ("a" * 5000,), ("<|endoftext|>",)], "t string")
    n = [r[0] for r in df.select(packing.token_count(F.col("t"))).collect()]
    assert n[:3] == [0, None, 2] and n[3] > 100 and n[4] > 1


# --- 7 leakage ---------------------------------------------------------------------------


def _leak_brute(docs, items):
    out = set()
    for d, text in docs:
        w = leakage.visible_words(text or "")
        for i, item in items:
            q = leakage.visible_words(item or "")
            if any(sum(a == b for a, b in zip(w[x : x + 30], q[y : y + 30])) >= 27 for x in range(len(w) - 29) for y in range(len(q) - 29)):
                out.add((d, i))
    return out


def test_words_are_those_a_reader_sees():
    text = "Caf&eacute;&nbsp;au<br/>lait, ex<b>am</b>ple <A HREF='x>y' title=z>link</a> a <b and c> d <!-- no -->don't " + "<i class='" + "k" * 400 + "'>end</i>"
    assert leakage.visible_words(text) == "café au lait ex am ple link a b and c d don t end".split()
    assert leakage.visible_words(text, joined=True) == "café au lait example link a b and c d don't end".split()


def test_replaced_words_with_apostrophes_are_one_word(spark):
    w = [f"w{i}" for i in range(40)]
    item = w[:]
    item[12] = "it's"
    other, few = w[:], w[:]
    other[5], other[12], other[22] = "mother-in-law", "plain", "x"
    few[4], few[11], few[18], few[25], few[32] = "a", "b", "c", "d", "e"
    docs = spark.createDataFrame([(1, " ".join(other)), (2, " ".join(few)), (3, "ex<b>tra</b> " + " ".join(x[0] + "<em>" + x[1:] + "</em>" for x in item))], "doc_id bigint, text string")
    items = spark.createDataFrame([(9, " ".join(item))], "eval_id bigint, text string")
    assert sorted(r.id for r in leakage.leaked_passages(docs, items).collect()) == [1, 3]
    many = items.union(spark.createDataFrame([(k, " ".join(f"v{k}_{i}" for i in range(35))) for k in range(20, 30)], items.schema))
    assert sorted(r.id for r in leakage.leaked_passages(docs, many, block_chars=300, blocks=2).collect()) == [1, 3]


def test_leaks_match_brute_force(spark):
    r = random.Random(8)
    vocab = [f"w{k}" for k in range(300)] + ["größe", "élan", "тест"]
    words = lambda n: [r.choice(vocab) for _ in range(n)]
    items = [(1000 + i, " ".join(words(r.choice([20, 30, 45, 90])))) for i in range(12)] + [(2000, None), (2001, "")]
    docs = []
    for d in range(160):
        text = words(r.choice([0, 5, 40, 120, 600]))
        if d % 2:
            q = r.choice(items[:12])[1].split()
            n = r.choice([26, 29, 30, 33, 60])
            s = r.randrange(max(1, len(q) - n))
            part = q[s : s + n]
            for k in r.sample(range(len(part)), min(len(part), r.choice([0, 1, 2, 3, 4, 6]))):
                part[k] = "other"
            if d % 4 == 1:
                part = [p.upper() if r.random() < 0.3 else p + r.choice(["", ",", "<br/>", "​"]) for p in part]
            at = r.randrange(len(text) + 1)
            text[at:at] = part
        docs.append((d, r.choice([" ", "\n", " "]).join(text)))
    docs += [(500, None), (501, ""), (3, docs[3][1])]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("id", F.lit("clash"))
    it = spark.createDataFrame(items, "eval_id bigint, text string")
    want = _leak_brute(docs, items)
    assert len(want) > 15
    for block in (4_000_000, 400):
        assert {tuple(x) for x in leakage.leaked_passages(df, it, block_chars=block).collect()} == want
    assert leakage.leaked_passages(df.limit(0), it).count() == 0 and leakage.leaked_passages(df, it.limit(0)).count() == 0


# --- 8 visible text ----------------------------------------------------------------------


def test_look_is_kept_and_characters_are_levelled():
    t = visible.transducer()
    for a, b in [("ＡＢ１", "AB1"), ("café", "café"), ("a b", "a b"), ("a b", "a b"), ("pау", "pay"), ("z​ero﻿", "zero"), ("K", "K"), ("ﬁn", "fin"), ("ạ̇", "ạ̇"), ("e‍́", "é"), ("x\r\ny", "x\ny"), ("й", "й")]:
        assert t(a) == t(b), (a, b)
    for a, b in [("a", "A"), ("café", "cafe"), ("m²", "m2"), ("a  b", "a b"), ("a.", "a"), ("👍🏽", "👍"), ("👩‍👩", "👩👩"), ("ß", "ss"), ("1", "l"), ("", " ")]:
        assert t(a) != t(b), (a, b)


def test_consistent_form_is_a_fixed_point():
    t, r = visible.transducer(), random.Random(1)
    pool = [chr(c) for c in [*range(32, 127), *range(0xA0, 0x250), *range(0x300, 0x330), *range(0x370, 0x530), 0x200B, 0x200D, 0xFE0F, 0xFF21, 0xFB01, 0x1F44D, 0x1F3FD, 13, 10, 9]]
    for _ in range(1500):
        s = "".join(r.choice(pool) for _ in range(r.randrange(1, 12)))
        assert t(t(s)) == t(s), ascii(s)
        assert t(unicodedata.normalize("NFD", s)) == t(s), ascii(s)


def test_units_are_compiled_before_any_text():
    units = visible.compile_units(visible.LOOK_ALIKES)
    assert units["\r\n"] == "\n" and units["Ａ"] == "A" and units["\u00a0"] == " " and units["\u200b"] == ""
    assert units["e\u0301"] == units["\u0435\u0301"] == "é" if "\u0435\u0301" in units else units["e\u0301"] == "é"
    assert all(visible.transducer()(f) == f for f in units.values())
    with pytest.raises(visible.Conflict):
        visible.compile_units({"x": "Ａ"})  # the width rule says A


def test_conflicts_are_refused():
    with pytest.raises(visible.Conflict):
        visible.compile_mapping({"a": "x", "b": "x"})
    with pytest.raises(visible.Conflict):
        visible.compile_mapping({"a": "b", "b": "c"})


def test_pairs_and_classes_of_looks(spark):
    texts = ["pay", "pаy", "ｐay", "pay", "Pay", None, "", "", "x" * 100_000, "х" * 100_000]
    rows = [(i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("look", F.lit("clash"))
    want = {(0, 1), (0, 2), (1, 2), (1, 3), (2, 3), (8, 9)}
    for block in (2000, 1):
        assert {tuple(x) for x in visible.look_pairs(df, block=block).collect()} == want
    classes = {x.id: (x.class_id, x.documents, x.spellings, x.links) for x in visible.look_classes(df).collect()}
    assert classes[3] == (0, 4, 3, 2) and classes[1] == (0, 4, 3, 3) and classes[4] == (4, 1, 1, 0) and classes[7] == (6, 2, 1, 0) and 5 not in classes
    assert visible.look_pairs(df.limit(0)).count() == 0
    assert [r[0] for r in df.orderBy("doc_id").select(visible.consistent(F.col("text"))).collect()][:8] == ["pay", "pay", "pay", "pay", "Pay", None, "", ""]
