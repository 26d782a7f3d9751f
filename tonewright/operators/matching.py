"""Pairing songs with labels: interval join, optimal and greedy one-to-one matching."""

from __future__ import annotations

import math
from heapq import heappop, heappush

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tonewright.functions.geometry import box_iou, hull_iou
from tonewright.functions.naming import finite
from tonewright.session import cut


def edges(det: DataFrame, lab: DataFrame, keys: list[str], least: float, boxes: bool = True, keep: tuple[str, ...] = (), bucket_seconds: float = 60.0) -> DataFrame:
    """Pairs of one key with an IoU of at least ``least`` and above 0: ``keys, det_id, label_id, iou``.

    ``det`` has the keys and ``det_id, time_start, time_end, freq_low_hz, freq_high_hz``, ``lab`` the
    same with ``label_id``; ids may be of any type. ``keep`` names columns of ``det`` to carry along.
    Only boxes that share time can pair, so both sides are joined on the key and on the time
    buckets they touch; a pair is kept in the bucket where its overlap starts, and a key with
    very many boxes spreads over its buckets. An IoU of ``least`` bounds the ratio of two
    lengths, so with ``least`` above 0 the buckets grow with the boxes (by powers of two) and
    no box, however long, touches more than two of its own size; the labels enter the sizes
    they can pair with. With ``least`` 0 every box touches buckets of ``bucket_seconds``.
    Boxes with a bound that isn't finite have no IoU and don't count.
    """
    band = ["time_start", "time_end", "freq_low_hz", "freq_high_hz"]

    def side(df: DataFrame, p: str, i: str, more: tuple[str, ...] = ()) -> DataFrame:
        rows = df.select(*[F.col(k).alias(f"{p}_{k}") for k in keys], F.col(i).alias(i), *[finite(F.col(c)).alias(f"{p}_{c}") for c in band], *more)
        return rows.where(F.col(f"{p}_time_end") > F.col(f"{p}_time_start"))

    a, b = side(det, "d", "det_id", keep), side(lab, "l", "label_id")
    size = lambda p: F.floor(F.log2(F.col(f"{p}_time_end") - F.col(f"{p}_time_start"))).cast("int")
    if least > 0:
        reach = math.ceil(math.log2(1 / least)) + 1
        a = a.withColumn("d_size", size("d"))
        b = b.withColumn("l_size", F.explode(F.sequence(size("l") - reach, size("l") + reach)))
        # 64 lengths: about a minute for boxes of a second
        width = lambda p: F.pow(F.lit(2.0), F.col(f"{p}_size") + 6)
        on = F.col("d_size") == F.col("l_size")
    else:
        width = lambda p: F.lit(float(bucket_seconds))
        on = F.lit(True)
    cell = lambda p, c: F.floor(c / width(p))
    a = a.withColumn("d_cell", F.explode(F.sequence(cell("d", F.col("d_time_start")), cell("d", F.col("d_time_end")))))
    b = b.withColumn("l_cell", F.explode(F.sequence(cell("l", F.col("l_time_start")), cell("l", F.col("l_time_end")))))
    on = on & (F.col("d_cell") == F.col("l_cell")) & (cell("d", F.greatest("d_time_start", "l_time_start")) == F.col("d_cell"))
    for k in keys:
        on = on & (F.col(f"d_{k}") == F.col(f"l_{k}"))
    on = on & (F.col("d_time_start") < F.col("l_time_end")) & (F.col("l_time_start") < F.col("d_time_end"))
    d, lb = [F.col(f"d_{c}") for c in band], [F.col(f"l_{c}") for c in band]
    if boxes:
        on = on & (d[2] < lb[3]) & (lb[2] < d[3])
        value = box_iou(*d, *lb)
    else:
        value = hull_iou(d[0], d[1], lb[0], lb[1])
    found = a.join(b, on).select(*[F.col(f"d_{k}").alias(k) for k in keys], "det_id", "label_id", *keep, value.alias("iou"))
    return found.where((F.col("iou") >= F.lit(float(least))) & (F.col("iou") > 0))


def mutual_best(e: DataFrame, keys: list[str]) -> DataFrame:
    """Edges that are the best of both their ends; ties go to the smaller id."""
    by_det = Window.partitionBy(*keys, "det_id").orderBy(F.desc("iou"), "label_id")
    by_lab = Window.partitionBy(*keys, "label_id").orderBy(F.desc("iou"), "det_id")
    return e.withColumn("_a", F.row_number().over(by_det)).withColumn("_b", F.row_number().over(by_lab)).where((F.col("_a") == 1) & (F.col("_b") == 1)).drop("_a", "_b")


def unmatched(rows: DataFrame, matched: DataFrame, key: str) -> DataFrame:
    return rows.join(matched.select(key).distinct(), key, "left_anti")


def best_assignment(dets: list[int], labs: list[int], ious: list[float]) -> list[int]:
    """Places of the edges (dets[k], labs[k]) that are matched: as many as possible, of those the greatest total IoU.

    Shortest augmenting paths over a sparse graph, one detection after the other. A matched
    edge is worth more than all IoUs together, leaving a detection alone nothing.
    """
    rows, cols = sorted(set(dets)), sorted(set(labs))
    row_at, col_at = {d: i for i, d in enumerate(rows)}, {c: j for j, c in enumerate(cols)}
    worth = float(len(rows) + 1)
    near: list[list[tuple[int, float]]] = [[(len(cols) + i, 0.0)] for i in range(len(rows))]  # its own way out
    edge: dict[tuple[int, int], int] = {}
    for k, (d, c, v) in enumerate(zip(dets, labs, ious)):
        i, j = row_at[d], col_at[c]
        edge[i, j] = k
        near[i].append((j, -worth - v))
    of_col = [-1] * (len(cols) + len(rows))
    u, v = [0.0] * len(rows), [0.0] * len(of_col)
    for s in range(len(rows)):
        best: dict[int, float] = {}
        came: dict[int, int] = {}
        done: list[int] = []
        seen: set[int] = set()
        heap: list[tuple[float, int]] = []
        i, low = s, 0.0
        while True:
            for j, c in near[i]:
                if j not in seen:
                    way = low + c - u[i] - v[j]
                    if j not in best or way < best[j]:
                        best[j], came[j] = way, i
                        heappush(heap, (way, j))
            low, j = heappop(heap)
            while j in seen:
                low, j = heappop(heap)
            seen.add(j)
            if of_col[j] < 0:
                break
            done.append(j)
            i = of_col[j]
        u[s] += low
        for c in done:
            u[of_col[c]] += low - best[c]
            v[c] -= low - best[c]
        before = {of_col[c]: c for c in done}
        while True:
            i = came[j]
            of_col[j] = i
            if i == s:
                break
            j = before[i]
    return sorted(edge[i, j] for j, i in enumerate(of_col[: len(cols)]) if i >= 0)


def greedy_assignment(dets: list[int], labs: list[int], ious: list[float]) -> list[int]:
    """Each detection in its order takes the best label left; the first one wins ties."""
    by_det: dict[int, list[int]] = {}
    for k, d in enumerate(dets):
        by_det.setdefault(d, []).append(k)
    taken, out = set(), []
    for d in sorted(by_det):
        free = [k for k in by_det[d] if labs[k] not in taken]
        if free:
            k = min(free, key=lambda x: (-ious[x], labs[x]))
            taken.add(labs[k])
            out.append(k)
    return out


def _cluster(e: DataFrame, keys: list[str]) -> DataFrame:
    """``part`` for edges that aren't alone: the smallest label id that can be reached.

    Edges whose both ends have no other edge are certain and never come here. Labels spread
    along shared detections and back until nothing changes; each round is two aggregations.
    Parts that are still open after four rounds also take the part of their part's label,
    which doubles the distance each round, so long chains end soon too.
    """
    state, n = cut(e.withColumn("part", F.col("label_id"))), 0
    while True:
        by_det = Window.partitionBy(*keys, "det_id")
        by_lab = Window.partitionBy(*keys, "label_id")
        new = state.withColumn("_p", F.min("part").over(by_det)).withColumn("_q", F.min("_p").over(by_lab))
        new = cut(new.withColumn("_moved", F.col("_q") != F.col("part")).withColumn("part", F.col("_q")).drop("_p", "_q"))
        if new.where("_moved").isEmpty():
            return new.drop("_moved")
        state, n = new.drop("_moved"), n + 1
        if n >= 4:
            heads = state.select(*keys, F.col("label_id").alias("part"), F.col("part").alias("_head")).distinct()
            state = cut(state.join(heads, [*keys, "part"]).drop("part").withColumnRenamed("_head", "part"))


def one_to_one(e: DataFrame, keys: list[str], optimal: bool = True, order: str = "det_id") -> DataFrame:
    """Matched edges ``keys, det_id, label_id, iou``: optimal (most pairs, then most IoU) or greedy.

    Edges alone at both ends are matched at once. The rest is cut into connected parts, and
    each part is solved on its own in batches of many parts per call, so no file or class is
    ever solved, or gathered, as a whole. Greedy takes the detections in the order of the
    column ``order``, then det_id, and of equally good labels the smaller id; ids may be of any type.
    """
    degree_d = F.count(F.lit(1)).over(Window.partitionBy(*keys, "det_id"))
    degree_l = F.count(F.lit(1)).over(Window.partitionBy(*keys, "label_id"))
    marked = e.select(*keys, "det_id", "label_id", "iou", F.col(order).alias("_o")).withColumn("_x", degree_d).withColumn("_y", degree_l)
    alone = (F.col("_x") == 1) & (F.col("_y") == 1)
    sure = marked.where(alone).drop("_x", "_y", "_o")
    rest = _cluster(marked.where(~alone).drop("_x", "_y"), keys)
    solve = best_assignment if optimal else greedy_assignment

    @F.pandas_udf("array<int>")
    def solved(dets, labs, ious):
        import pandas as pd

        return pd.Series([solve(list(d), list(c), list(v)) for d, c, v in zip(dets, labs, ious)])

    # within a part detections and labels get their places, in order; only these reach the solver
    parts = rest.groupBy(*keys, "part").agg(F.collect_list(F.struct(F.struct("_o", "det_id").alias("d"), F.col("label_id").alias("l"), "iou")).alias("_e"))
    place = lambda f: F.transform(F.col(f"_e.{f}"), lambda x: F.array_position(F.array_sort(F.array_distinct(F.col(f"_e.{f}"))), x).cast("int"))
    found = parts.withColumn("_k", solved(place("d"), place("l"), F.col("_e.iou"))).select(*keys, F.explode(F.transform("_k", lambda k: F.col("_e")[k])).alias("_m"))
    return sure.unionByName(found.select(*keys, "_m.d.det_id", F.col("_m.l").alias("label_id"), "_m.iou"))


def common_files(det: DataFrame, lab: DataFrame, key: str = "stem") -> tuple[DataFrame, DataFrame]:
    """Both sides restricted to the files they share; if they share none, both as they are."""
    shared = det.select(key).distinct().join(lab.select(key).distinct(), key, "left_semi")
    none = shared.agg(F.count(F.lit(1)).alias("_n"))

    def keep(df: DataFrame) -> DataFrame:
        marked = df.join(shared.withColumn("_in", F.lit(True)), key, "left").join(F.broadcast(none))  # one row
        return marked.where(F.col("_in") | (F.col("_n") == 0)).drop("_in", "_n")

    return keep(det), keep(lab)
