"""Filling containers of fixed capacity with texts: pattern packing by non-negative least squares.

Only the histogram of lengths (at most one entry per token of the capacity) reaches the
driver. There, patterns of a few documents whose length classes fill a container are
enumerated (implicitly, by dynamic programming), their repeat counts are fitted to the
histogram by non-negative least squares and rounded down, and the few documents left are
packed into the remaining room, tightest first. The
plan is a list of slots "the documents of length L with ranks a to b go to containers from
c on". Every document finds its slot by its rank within its length; ranks come from counts
per length and bucket, so no length's documents meet in one task.
"""

from __future__ import annotations

import base64
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tonewright.session import cut

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the split pattern that belongs to this vocabulary.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=2)
def _encoding(data: bytes, split: str):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}
    return tiktoken.Encoding("vocabulary", pat_str=split, mergeable_ranks=ranks, special_tokens={})


def token_count(text: Column, vocabulary: str = VOCABULARY, split: str = SPLIT) -> Column:
    """Number of tokens of the whole text; NULL stays NULL, an empty text has none.

    ``vocabulary`` is the path of a rank file, read on the driver.
    """
    with open(vocabulary, "rb") as f:
        data = f.read()

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = _encoding(data, split).encode_ordinary
        for texts in batches:
            yield pd.Series([None if t is None else len(encode(t)) for t in texts], dtype="Int64")

    return F.pandas_udf(run, "bigint")(text)


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 2000, start: np.ndarray | None = None) -> np.ndarray:
    """The x >= 0 with the least ||a x - b||, by the active set method of Lawson and Hanson; ``start`` is a feasible x."""
    n = a.shape[1]
    x = np.zeros(n) if start is None else start.astype(float)
    active = x > 0
    slope = a.T @ (b - a @ x)
    limit = 1e-9 * max(1.0, float(np.abs(a.T @ b).max(initial=0)))
    for _ in range(rounds):
        if active.all() or (best := np.where(active, -np.inf, slope).argmax()) is None or slope[best] <= limit or active[best]:
            break
        active[best] = True
        while True:
            own = np.flatnonzero(active)
            z = np.linalg.lstsq(a[:, own], b, rcond=None)[0]
            if (z > 0).all():
                x[:] = 0
                x[own] = z
                break
            low = z <= 0
            step = (x[own][low] / np.maximum(x[own][low] - z[low], 1e-300)).min()
            x[own] += step * (z - x[own])
            gone = own[(x[own] <= 1e-12)]
            gone = gone if len(gone) else own[low][:1]
            x[gone] = 0
            active[gone] = False
            if not active.any():
                break
        slope = a.T @ (b - a @ x)
    return x


def best_pattern(value: np.ndarray, sizes: np.ndarray, capacity: int, parts: int, slack: int) -> tuple[float, tuple[int, ...]]:
    """The multiset of at most ``parts`` classes that fills the capacity but for ``slack`` with the greatest total value, as places in ``sizes``.

    ``value[i]`` is what a document of size ``sizes[i]`` is worth. Dynamic programming over
    the room filled so far.
    """
    best = np.full((parts + 1, capacity + 1), -np.inf)
    best[0, 0] = 0.0
    last = np.zeros((parts + 1, capacity + 1), np.int64)
    room = np.arange(capacity + 1)[:, None] - sizes[None]  # what was filled before a document was added
    fits = room >= 0
    for k in range(1, parts + 1):
        worth = np.where(fits, best[k - 1][np.maximum(room, 0)] + value, -np.inf)
        last[k] = worth.argmax(axis=1)
        best[k] = worth.max(axis=1)
    full = best[:, capacity - slack :]
    k, over = np.unravel_index(int(full.argmax()), full.shape)
    left = over + capacity - slack
    gain, chosen = float(best[k, left]), []
    for n in range(int(k), 0, -1):
        i = int(last[n, left])
        chosen.append(i)
        left -= sizes[i]
    return gain, tuple(sorted(chosen, reverse=True))


def fit_patterns(counts: np.ndarray, sizes: np.ndarray, capacity: int, parts: int, slack: int, rounds: int = 400) -> list[tuple[tuple[int, ...], float]]:
    """Patterns with their repeat counts: non-negative least squares on the histogram of classes.

    All patterns of at most ``parts`` documents take part without being listed: the one with
    the steepest descent is the most valuable filling under the residual counts. The active
    set of patterns then is fitted as by Lawson and Hanson.
    """
    if not len(counts):
        return []
    scale = max(1.0, counts.max())
    b = counts / scale
    columns: list[tuple[int, ...]] = []
    a, x = np.zeros((len(b), 0)), np.zeros(0)
    for _ in range(rounds):
        gain, p = best_pattern(b - a @ x, sizes, capacity, parts, slack)
        if gain <= 1e-6 or p in columns:
            break
        columns.append(p)
        a = np.c_[a, np.bincount(p, minlength=len(b))]
        x = nnls(a, b, start=np.r_[x, 0.0])
        keep = x > 1e-9
        columns, a, x = [c for c, k in zip(columns, keep) if k], a[:, keep], x[keep]
    # fullest first
    return sorted(zip(columns, x * scale), key=lambda t: (-sizes[list(t[0])].sum(), -t[1], t[0]))


class _Room:
    """Open containers by room left: runs (first container, how many) under each room."""

    def __init__(self) -> None:
        self.rooms: list[int] = []
        self.runs: dict[int, list[tuple[int, int]]] = {}

    def add(self, room: int, first: int, n: int) -> None:
        if room > 0 and n > 0:
            if room not in self.runs:
                insort(self.rooms, room)
                self.runs[room] = []
            self.runs[room].append((first, n))

    def take(self, least: int) -> tuple[int, int, int] | None:
        """A run of containers with the tightest room of at least ``least``."""
        i = bisect_left(self.rooms, least)
        if i == len(self.rooms):
            return None
        room = self.rooms[i]
        first, n = self.runs[room].pop()
        if not self.runs[room]:
            del self.runs[room]
            self.rooms.pop(i)
        return room, first, n


def plan(counts: dict[int, int], capacity: int, classes: int = 128, parts: int = 12) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Slots (length, first rank, documents, first container, per container) and the number of containers.

    ``counts`` maps lengths from 1 to ``capacity`` to numbers of documents. The slots of a
    length cover its ranks from 0 without gaps, and no container holds more than ``capacity``.
    """
    slots, containers, _ = _planned(counts, capacity, classes, parts)
    return slots, containers


def _planned(counts: dict[int, int], capacity: int, classes: int, parts: int) -> tuple[list[tuple[int, int, int, int, int]], int, int]:
    """As :func:`plan`, and the number of documents that patterns have placed."""
    classes = min(classes, capacity)
    left = {length: n for length, n in counts.items() if n > 0}
    if any(not 1 <= length <= capacity for length in left):
        raise ValueError("lengths must be between 1 and the capacity")
    used = dict.fromkeys(left, 0)
    slots: list[tuple[int, int, int, int, int]] = []
    room, containers, by_pattern = _Room(), 0, 0

    def put(length: int, n: int, first: int, per: int = 1) -> None:
        slots.append((length, used[length], n, first, per))
        used[length] += n
        left[length] -= n
        if not left[length]:
            del left[length]

    # containers that one document fills
    if n := left.get(capacity, 0):
        put(capacity, n, 0)
        containers = by_pattern = n

    # few lengths are classes of their own; of many, a class is the nearest multiple of the capacity's part,
    # and what rounding leaves is made up by a pattern's last document
    # what rounding down and spent lengths leave over is fitted again, while that fills a container
    before = -1
    while left and containers > before:
        before = containers
        there = sorted(left)
        unit = 1 if len(there) <= classes else capacity / classes
        of_class: dict[int, list[int]] = {}
        for length in there:
            of_class.setdefault(max(1, round(length / unit)), []).append(length)
        sizes = np.array(sorted(of_class), np.int64)
        histogram = np.array([sum(left[x] for x in of_class[c]) for c in sizes], float)
        longest = [of_class[c][-1] for c in sizes]
        for p, repeats in fit_patterns(histogram, sizes, round(capacity / unit), parts, capacity // 64 if unit == 1 else 0):
            todo = round(repeats) if unit == 1 else int(repeats + 1e-6)
            while todo > 0:
                # the longest documents left within each class's length; the last one fills the room that is left
                chosen: list[int] = []
                for i in p[:-1]:
                    at = _longest(there, left, chosen, min(longest[i], capacity - sum(chosen)))
                    chosen.append(there[at] if at >= 0 else 0)
                at = _longest(there, left, chosen, capacity - sum(chosen) if unit != 1 else min(longest[p[-1]], capacity - sum(chosen)))
                if at < 0 or not all(chosen):
                    break
                chosen.append(there[at])
                n = min([todo, *(left[x] // chosen.count(x) for x in chosen)])
                for x in set(chosen):
                    per = chosen.count(x)
                    put(x, n * per, containers, per)
                    if x not in left:
                        there.pop(bisect_left(there, x))
                room.add(capacity - sum(chosen), containers, n)
                containers += n
                by_pattern += n * len(chosen)
                todo -= n

    # the rest: longest first into the tightest room, then into new containers
    for length in sorted(left, reverse=True):
        n = left[length]
        while n and (hit := room.take(length)):
            size, first, m = hit
            k = min(n, m)
            put(length, k, first)
            room.add(size - length, first, k)
            room.add(size, first + k, m - k)
            n -= k
        if n:
            per = capacity // length
            if full := n // per:
                put(length, full * per, containers, per)
                room.add(capacity - per * length, containers, full)
                containers += full
            if rest := n % per:
                put(length, rest, containers, rest)
                room.add(capacity - rest * length, containers, 1)
                containers += 1
    return slots, containers, by_pattern


def _longest(there: list[int], left: dict[int, int], chosen: list[int], most: int) -> int:
    """Place of the longest length of at most ``most`` that isn't used up by ``chosen``, else -1."""
    for at in range(bisect_right(there, most) - 1, -1, -1):
        if left[there[at]] > chosen.count(there[at]):
            return at
    return -1


def pieces(lengths: DataFrame, capacity: int) -> DataFrame:
    """``id, piece, first_token, length``: a text is cut only if it alone exceeds the capacity."""
    cuts = F.sequence(F.lit(0).cast("long"), F.floor((F.col("length") - 1) / F.lit(capacity)))
    return (
        lengths.where(F.col("length") > 0)
        .select("id", "length", F.explode(cuts).alias("piece"))
        .select(
            "id",
            "piece",
            (F.col("piece") * capacity).alias("first_token"),
            F.least(F.lit(capacity).cast("long"), F.col("length") - F.col("piece") * capacity).alias("length"),
        )
    )


def _assigner(slots: list[tuple[int, int, int, int, int]]):
    order = sorted(slots)
    key = np.array([length << 44 | first for length, first, *_ in order], np.int64)
    start, base, per = (np.array([s[i] for s in order], np.int64) for i in (1, 3, 4))

    @F.pandas_udf("bigint")
    def container(length: pd.Series, rank: pd.Series) -> pd.Series:
        at = np.searchsorted(key, length.to_numpy(np.int64) << 44 | rank.to_numpy(np.int64), "right") - 1
        return pd.Series(base[at] + (rank.to_numpy(np.int64) - start[at]) // per[at])

    return container


def containers(lengths: DataFrame, capacity: int = 2048, buckets: int = 64, classes: int = 128, parts: int = 12) -> DataFrame:
    """The container of each text or piece: ``id, piece, first_token, length, container_id``.

    ``lengths`` has ``id, length``. Texts without tokens or with a NULL length need no room
    and give no row. Repeated rows are texts of their own. At most ``capacity`` tokens are in
    a container; container ids run from 0 without gaps. The result is the same in every run
    over rows with different ids.
    """
    if capacity < 1:
        raise ValueError("capacity must be 1 or more")
    # spread by id: the bucket keeps a length that many texts share in many tasks
    cutup = cut(pieces(lengths, capacity).withColumn("_bucket", F.pmod(F.xxhash64("id", "piece"), F.lit(buckets))))
    counted = cut(cutup.groupBy("length", "_bucket").agg(F.count(F.lit(1)).alias("_n")))
    # at most one row per length up to the capacity
    histogram = {r["length"]: r["n"] for r in counted.groupBy("length").agg(F.sum("_n").alias("n")).collect()}
    slots, _ = plan(histogram, capacity, classes, parts)
    earlier = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counted.select("length", "_bucket", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset"))
    within = Window.partitionBy("length", "_bucket").orderBy("id", "piece")
    ranked = (
        cutup.withColumn("_rank", F.row_number().over(within) - 1)
        .join(offsets, ["length", "_bucket"])
        .withColumn("_rank", F.col("_rank") + F.col("_offset"))
    )
    return ranked.select("id", "piece", "first_token", "length", _assigner(slots)(F.col("length"), F.col("_rank")).alias("container_id"))


def pack(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, vocabulary: str = VOCABULARY, split: str = SPLIT) -> DataFrame:
    """:func:`containers` of whole texts, measured in tokens of a public tokenizer."""
    lengths = df.select(F.col(id_col).alias("id"), token_count(F.col(text_col), vocabulary, split).alias("length"))
    return containers(lengths, capacity)
