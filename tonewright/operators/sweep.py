"""Songs at many confidence thresholds in one pass over the rows.

As the threshold falls rows are only added, so a song changes only where it gains a row.
One pass over the sorted rows of a time shard keeps the open song of every threshold and
writes a finished song once, with the range of thresholds at which it's the same. There
are at most as many of these versions as rows, however many thresholds there are. Songs
that reach a shard's end, or start in what earlier shards cover, are stitched per threshold;
they are few.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tonewright.functions.naming import blank_to_null, finite
from tonewright.operators.songs import NO_CLASS, SINGLE_FILE
from tonewright.session import cut

_OUT = (
    "_file string, species_id int, _shard bigint, lo int, hi int, _s double, _e double, det_id bigint, species string, "
    "_sum double, _with bigint, _max double, _rows bigint, _low double, _high double"
)
_NAMES = [f.split()[0] for f in _OUT.split(", ")]


class _Open:
    """The open song of every threshold, of one file, class and shard."""

    def __init__(self, levels: int):
        self.cover = np.full(levels, -np.inf)
        self.rows = np.zeros(levels, np.int64)
        self.known = np.zeros(levels, np.int64)
        self.opener = np.zeros(levels, np.int64)
        self.end, self.sum, self.most, self.low, self.high = (np.full(levels, np.nan) for _ in range(5))
        self.openers: list[tuple] = []

    def finished(self, a: int, b: int, key: tuple, out: list) -> None:
        """The songs of the thresholds a to b - 1, one row for each range in which they are the same."""
        rows, opener = self.rows[a:b], self.opener[a:b]
        cuts = np.flatnonzero((opener[1:] != opener[:-1]) | (rows[1:] != rows[:-1])) + 1
        for x, y in zip([0, *cuts], [*cuts, b - a]):
            if rows[x]:
                i = a + x
                start, det, species = self.openers[opener[x]]
                out.append((*key, i, a + y - 1, start, self.end[i], det, species, self.sum[i], self.known[i], self.most[i], self.rows[i], self.low[i], self.high[i]))

    def take(self, k: int, gap: float, s: float, e: float, det: int, species: str | None, c: float, low: float, high: float, key: tuple, out: list) -> None:
        """A row that passes the thresholds 0 to k - 1."""
        new = s - self.cover[:k] > gap  # the cover falls with rising thresholds
        b = int(new.argmax()) if new[-1] else k
        if b < k:
            self.finished(b, k, key, out)
            self.opener[b:k] = len(self.openers)
            self.openers.append((s, det, species))
            self.rows[b:k] = self.known[b:k] = 0
            self.sum[b:k] = 0.0
            self.end[b:k] = -np.inf
            self.most[b:k] = self.low[b:k] = self.high[b:k] = np.nan
        np.maximum(self.cover[:k], e, out=self.cover[:k])
        np.maximum(self.end[:k], e, out=self.end[:k])
        self.rows[:k] += 1
        if c == c:
            self.known[:k] += 1
            self.sum[:k] += c
            np.fmax(self.most[:k], c, out=self.most[:k])
        np.fmin(self.low[:k], low, out=self.low[:k])
        np.fmax(self.high[:k], high, out=self.high[:k])


def _pass(thresholds: list[float], gap: float):
    grid = np.array(thresholds, float)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, None
        for batch in batches:
            out: list[tuple] = []
            c = batch["confidence"].to_numpy(float)
            level = np.searchsorted(grid, np.where(np.isnan(c), 0.0, c), "right")
            text = lambda n: batch[n].astype(object).where(batch[n].notna(), None)
            columns = zip(
                batch["_file"], batch["species_id"], batch["_shard"], level, batch["_s"], batch["_e"], batch["det_id"], text("species"), c,
                batch["freq_low_hz"].to_numpy(float), batch["freq_high_hz"].to_numpy(float),
            )
            for f, sid, shard, k, s, e, det, species, v, low, high in columns:
                if (f, sid, shard) != key:
                    if state is not None:
                        state.finished(0, len(grid), key, out)
                    key, state = (f, sid, shard), _Open(len(grid))
                if k:
                    state.take(k, gap, s, e, det, species, v, low, high, key, out)
            yield pd.DataFrame(out, columns=_NAMES)
        if state is not None:
            out = []
            state.finished(0, len(grid), key, out)
            yield pd.DataFrame(out, columns=_NAMES)

    return run


def song_versions(df: DataFrame, thresholds: list[float], gap: float = 0.1, shard_seconds: float = 600.0) -> DataFrame:
    """Songs of all thresholds: those of ``reconstruct`` with ``lo, hi``, the first and last place in the sorted
    ``thresholds`` at which the song is the same, and ``det_id``, its first row's.

    At each threshold the rows that reach it are merged on their own (a missing confidence
    counts as 0, NaN reaches none); ``det_id`` (bigint, unique) names a song among those of
    one threshold. Rows without a finite start or end don't count. ``thresholds`` must rise.
    """
    if not thresholds or any(a >= b for a, b in zip(thresholds, thresholds[1:])):
        raise ValueError("thresholds must rise")
    if not gap >= 0:
        raise ValueError("gap must be 0 or more")
    keys = ["_file", "species_id"]
    c = F.coalesce(F.col("confidence").cast("double"), F.lit(-1.0))  # NaN never passes
    rows = df.where(~F.isnan(c)).select(
        F.coalesce(blank_to_null(F.col("filename")), F.lit(SINGLE_FILE)).alias("_file"),
        F.coalesce(F.col("species_id"), F.lit(NO_CLASS)).alias("species_id"),
        finite(F.col("time_start")).alias("_s"), finite(F.col("time_end")).alias("_e"), F.col("det_id").cast("long").alias("det_id"),
        "species", F.col("confidence").cast("double").alias("confidence"), F.col("freq_low_hz").cast("double").alias("freq_low_hz"), F.col("freq_high_hz").cast("double").alias("freq_high_hz"),
    ).where(F.col("_s").isNotNull() & F.col("_e").isNotNull())
    rows = rows.withColumn("_shard", F.floor(F.col("_s") / F.lit(float(shard_seconds))))
    ordered = rows.repartition(*keys, "_shard").sortWithinPartitions(*keys, "_shard", "_s", "det_id")
    local = cut(ordered.mapInPandas(_pass(thresholds, gap), _OUT))

    reach = local.groupBy(*keys, "_shard").agg(F.max("_e").alias("_reach"))
    earlier = Window.partitionBy(*keys).orderBy("_shard").rowsBetween(Window.unboundedPreceding, -1)
    covered = reach.withColumn("_cover", F.max("_reach").over(earlier)).where(F.col("_cover") >= F.col("_shard") * F.lit(float(shard_seconds)) - F.lit(gap))
    marked = local.join(covered.select(*keys, "_shard", "_cover"), [*keys, "_shard"], "left")
    at_edge = (F.col("_e") >= (F.col("_shard") + 1) * F.lit(float(shard_seconds)) - F.lit(gap)) | F.coalesce(F.col("_s") - F.col("_cover") <= F.lit(gap), F.lit(False))

    # the few pieces at shard ends, per threshold
    each = marked.where(at_edge).withColumn("lo", F.explode(F.sequence("lo", "hi")))
    along = Window.partitionBy(*keys, "lo").orderBy("_s", "det_id")
    before = F.max("_e").over(along.rowsBetween(Window.unboundedPreceding, -1))
    each = each.withColumn("_prev", before).withColumn("_n", F.sum(F.when(F.col("_s") - F.col("_prev") <= F.lit(gap), 0).otherwise(1)).over(along))
    first = F.min(F.struct("_s", "det_id", "species"))
    joined = each.groupBy(*keys, "lo", "_n").agg(
        first.alias("_f"), F.max("_e").alias("_e"), F.sum("_sum").alias("_sum"), F.sum("_with").alias("_with"), F.max("_max").alias("_max"),
        F.sum("_rows").alias("_rows"), F.min("_low").alias("_low"), F.max("_high").alias("_high"),
    ).select(*keys, "lo", F.col("lo").alias("hi"), "_f._s", "_e", "_f.det_id", "_f.species", "_sum", "_with", "_max", "_rows", "_low", "_high")
    songs = marked.where(~at_edge).select(*joined.columns).unionByName(joined)

    number = lambda n, t: F.when(~F.isnan(n), F.col(n)).cast(t)
    return songs.select(
        "lo", "hi", "det_id",
        F.when(F.col("_file") != SINGLE_FILE, F.col("_file")).alias("filename"), "species",
        F.when(F.col("species_id") != NO_CLASS, F.col("species_id")).alias("species_id"),
        F.col("_s").alias("time_start"), F.col("_e").alias("time_end"),
        F.try_divide("_sum", "_with").alias("avg_confidence"), number("_max", "double").alias("max_confidence"), F.col("_rows").alias("detections_merged"),
        number("_low", "int").alias("freq_low_hz"), number("_high", "int").alias("freq_high_hz"),
    )


def per_threshold(versions: DataFrame, thresholds: list[float], *keys: str, **sums: Column) -> DataFrame:
    """Sums per threshold and key: ``threshold, keys, sums``. Ranges are added up before they are spread."""
    ranges = versions.groupBy(*keys, "lo", "hi").agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    return at_each(ranges, thresholds).groupBy("threshold", *keys).agg(*[F.sum(n).alias(n) for n in sums])


def at_each(versions: DataFrame, thresholds: list[float]) -> DataFrame:
    """Each row once for every threshold of its range, with ``threshold`` in place of ``lo, hi``."""
    values = F.array(*[F.lit(float(t)) for t in thresholds])
    return versions.withColumn("threshold", F.explode(F.slice(values, F.col("lo") + 1, F.col("hi") - F.col("lo") + 1))).drop("lo", "hi")
