"""Periods, gaps and per-key results against sequential folds."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tonewright.functions.ordered import ordered_double, ordered_long
from tonewright.operators.intervals import periods, periods_and_gaps
from tonewright.operators.skew import busy_keys, key_quantiles

NAN, INF = float("nan"), float("inf")


def fold(rows, gap):
    by = {}
    for k, s, e in rows:
        if None in (k, s, e) or not math.isfinite(s) or not math.isfinite(e) or e < s:
            continue
        by.setdefault(k, []).append((s, e))
    out = []
    for k, xs in by.items():
        cur = None
        for s, e in sorted(xs):
            if cur and s - cur[1] <= gap:
                cur[1] = max(cur[1], e)
            else:
                cur = [s, e]
                out.append((k, cur))
    return [(k, s, e) for k, (s, e) in out]


@pytest.mark.parametrize("shard", [0.75, 7.0, 1000.0])
def test_periods_match_a_fold_for_any_shard_width(spark, shard):
    r = random.Random(3)
    rows = []
    for _ in range(1500):
        s = r.randrange(0, 1600) / 4 - 20
        rows.append((r.choice(["hot", "hot", "hot", "a", "b", None]), s, s + r.choice([0.0, 0.25, 0.5, 3.0, 40.0 if r.random() < 0.03 else 0.25, -1.0])))
    rows += [("a", None, 1.0), ("a", 1.0, None), ("a", NAN, 2.0), ("a", 5.0, INF), ("b", 3.0, 3.0)] + rows[:40]
    df = spark.createDataFrame(rows, "k string, time_start double, time_end double").withColumn("_s", F.lit("clash")).withColumn("kind", F.lit(1))
    want = fold(rows, 0.25)
    got = [tuple(x) for x in periods(df, ["k"], gap=0.25, shard_seconds=shard).collect()]
    assert sorted(got) == sorted(want)
    both = [tuple(x) for x in periods_and_gaps(df, ["k"], gap=0.25, shard_seconds=shard).collect()]
    assert sorted(x[1:] for x in both if x[0] == "period") == sorted(want)
    gaps = []
    for k in {w[0] for w in want}:
        p = sorted(w for w in want if w[0] == k)
        gaps += [(k, a[2], b[1]) for a, b in zip(p, p[1:])]
    assert sorted(x[1:] for x in both if x[0] == "gap") == sorted(gaps)
    short = periods_and_gaps(df, ["k"], gap=0.25, longest_gap=2.0, shard_seconds=shard).where("kind = 'gap'").count()
    assert short == sum(e - s <= 2.0 for _, s, e in gaps)


def test_periods_of_nothing_and_bad_arguments(spark):
    empty = spark.createDataFrame([], "k string, time_start double, time_end double")
    assert periods_and_gaps(empty, ["k"]).count() == 0
    with pytest.raises(ValueError):
        periods(empty, ["k"], gap=-1)
    with pytest.raises(ValueError):
        periods(empty, ["k"], shard_seconds=0)


def test_ordered_codes_sort_like_doubles_and_come_back(spark):
    r = random.Random(5)
    xs = [0.0, -0.0, 1.0, -1.0, 5e-324, -5e-324, 2.2250738585072014e-308, 2.225073858507201e-308, 1.7976931348623157e308, -1.7976931348623157e308, 0.1, 0.3, 2.0, 0.5]
    xs += [math.ldexp(r.random() - 0.5, r.randrange(-1070, 1023)) for _ in range(400)] + [math.nextafter(2.0**k, s) for k in range(-60, 60, 7) for s in (0, 4e99)]
    df = spark.createDataFrame([(x,) for x in xs], "x double").withColumn("c", ordered_long(F.col("x"))).withColumn("y", ordered_double(F.col("c")))
    rows = df.collect()
    assert all(x.x == x.y for x in rows)
    rows.sort(key=lambda x: x.x)
    assert all((a.c < b.c) == (a.x < b.x) for a, b in zip(rows, rows[1:]))
    odd = spark.createDataFrame([(None,), (NAN,), (INF,), (-INF,)], "x double").select(ordered_long(F.col("x")).alias("c")).collect()
    assert [x.c for x in odd] == [None] * 4


def test_key_quantiles_are_exact_for_busy_and_rare_keys(spark):
    r = random.Random(7)
    rows = [("hot", r.gauss(0, 1)) for _ in range(6000)] + [(f"k{i % 50}", float(r.randrange(5))) for i in range(700)] + [("same", 0.3)] * 500
    rows += [("hot", None), ("hot", NAN), ("none", None), (None, 1.0), ("tiny", 5e-324), ("tiny", 1e-310), ("near", 1.0), ("near", math.nextafter(1.0, 2)), ("near", math.nextafter(1.0, 0))]
    df = spark.createDataFrame(rows, "k string, v double").withColumn("bin", F.lit("clash"))
    percents = [0, 1, 25, 50, 99, 100]
    got = {(x.key_value, x.percent): (x.n_values, x.value) for x in key_quantiles(df, {"k": F.col("k")}, F.col("v"), percents).collect()}
    want, by = {}, {}
    for k, v in rows:
        if k is not None and v is not None and v == v:
            by.setdefault(k, []).append(v)
    for k, vs in by.items():
        vs.sort()
        for p in percents:
            want[k, p] = (len(vs), vs[max(1, -(-p * len(vs) // 100)) - 1])
    assert got == want


def test_busy_keys(spark):
    df = spark.createDataFrame([("a",)] * 50 + [("b",)] * 3 + [("c",)] * 2 + [(None,)] * 45, "k string")
    got = {(x.key_value, x.n_rows, x.total_rows) for x in busy_keys(df, {"k": F.col("k")}, 0.03).collect()}
    assert got == {("a", 50, 100), ("b", 3, 100)}
    assert busy_keys(df.limit(0), {"k": F.col("k")}).count() == 0
    with pytest.raises(ValueError):
        busy_keys(df, {"k": F.col("k")}, 0)
