"""Matching detections with labels of the same vocalisation; the sources share no id.

1. Both sources become records with a recording key and the tokens of their attributes:
   species or name, band edges, length, and their place on a ring of time.
2. Random walks over the graph of records, attributes and tokens train skip-gram vectors
   (:mod:`tonewright.llm.graphvec`). Places are tokens like the others: a record holds the two
   nearest quarter seconds and the four seconds around it, so walks go from place to near
   place and near times get near vectors. A record's vector follows from its tokens'.
3. Several tables of random hyperplanes hash the trained vectors: some the place alone, so
   that a wrong name can't hide a pair, some the place beside the other attributes. Records of
   one slab of a recording that agree in all bits of a table are candidates. Each record is
   shuffled to its slab once, and tables are probed there. Long labels are looked up at
   places all along their span.
4. Labels' clocks are off, by annotation file and stretch: before, tables over the other attributes find
   similar records within ``clock_reach``, whose differences in time vote.
5. Candidates are reranked by exact cosines and exact differences of times and bands. Every
   label also looks for candidates at a place where it can't belong. What these decoys meet
   is chance; the surplus of found over decoy pairs gives each cell of a cosine or difference
   its log odds, and isotonic regression turns their sum into a probability. Nothing is set
   by hand but the widths of cells. A label can span a series of equal short calls; its
   parts are recognised by their common length and band, and how they fill it is calibrated alike.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from tonewright.functions.naming import finite
from tonewright.llm.graphvec import skip_gram, walks
from tonewright.session import cut

#: Tokens by number: codes of detections, names of labels, lower and upper band edges, lengths, and the five attributes.
_DET, _NAME, _LOW, _HIGH, _LENGTH, _ATTRIBUTE, _SIZE = 0, 1024, 9216, 9248, 9280, 9304, 9309
PLACE_S, RING = 0.25, 256  # places of a quarter second on a ring of a slab's length
SLAB_S = PLACE_S * RING
DECOY_S = 1.5  # between a label and its decoy


_STYLES = tuple(
    (re.compile(head + r"(?:\d\d)?(?:_[a-z]+)?(?:\.[a-z][a-z0-9]{1,4})?$"), order)
    for head, order in (
        (r"(?:.*/)?\d\d(\d\d)-(\d\d)-(\d\d)/([a-z]+\d*)[_ -](\d{4})", (4, 1, 2, 3, 5)),
        (r"(?:.*/)?([a-z]+\d*)[_ -](?:\d\d)?(\d\d)(\d\d)(\d\d)[_ -](\d{4})", (1, 2, 3, 4, 5)),
        (r"(?:.*/)?([a-z]+\d*)[_ -](\d\d)\.(\d\d)\.\d\d(\d\d)[_ -](\d{4})", (1, 4, 3, 2, 5)),
    )
)


def key_of_name(name: str | None) -> str | None:
    """One key for the ways in which recordings are named: station, date, hour and minute.

    Understood are ``STA_YYYYMMDD_HHMMSS`` with ``_``, ``-`` or blanks, ``YYYY-MM-DD/STA_HHMMSS``,
    ``STA_YYMMDD_HHMM`` and ``STA DD.MM.YYYY HHMM``, in any case, below folders, with an
    extension or a further ``_word``. Other names give their stem in lower case, blank ones
    and those that end in a slash None.
    """
    s = (name or "").strip().lower().replace("\\", "/")
    for style, order in _STYLES:
        if m := style.match(s):
            sta, year, month, day, clock = (m[k] for k in order)
            return f"{sta}|{year}{month}{day}|{clock}"
    last = s.rpartition("/")[2]
    return (re.sub(r"(?<=.)\.[^.]+$", "", last)) or None


def _hash_names(first: pd.Series, second: pd.Series) -> pd.Series:
    """Hash of the key of the first name that isn't blank. A name is parsed once per batch, not per row."""
    names = first.where(first.str.strip().fillna("") != "", second)
    codes, unique = pd.factorize(names)
    hashes = [xxh3_64_intdigest(k) - 2**63 if (k := key_of_name(n)) is not None else None for n in unique]
    return pd.Series(hashes, dtype="Int64").reindex(codes).reset_index(drop=True)  # a missing name has code -1


def _key_hash(first: str, second: str) -> Column:
    # not deterministic: a filter on the key must not have it computed a second time
    return F.pandas_udf(_hash_names, "bigint").asNondeterministic()(F.col(first), F.col(second))


def _bucket(hz: Column, base: int) -> Column:
    return F.when(hz > 0, F.least(F.lit(31), F.greatest(F.lit(0), F.floor(F.log(hz / 60) * 5))).cast("int") + base).otherwise(F.lit(-1))


def _keyed(df: DataFrame, id_col: str, *names: str) -> DataFrame:
    """``id, key, file, t, e, lo, hi, species`` of the rows that count; ``file`` is the name as written."""
    t, e = finite(F.col("time_start")), finite(F.col("time_end"))
    low, high = finite(F.col("freq_low_hz")), finite(F.col("freq_high_hz"))
    rows = df.where(F.col(id_col).isNotNull() & t.isNotNull()).select(
        F.col(id_col).cast("long").alias("id"),
        _key_hash(names[0], names[-1]).alias("key"),
        F.xxhash64(names[0]).alias("file"),
        t.alias("t"),
        F.when(e >= t, e).alias("e"),
        F.when(low.isNull() | high.isNull(), low).otherwise(F.least(low, high)).alias("lo"),
        F.when(low.isNull() | high.isNull(), high).otherwise(F.greatest(low, high)).alias("hi"),
        "species",
    )
    return rows.where(F.col("key").isNotNull())


def _with_tokens(rows: DataFrame, species_base: int, species_size: int) -> DataFrame:
    """The tokens ``sp, kl, kh, kd`` (-1: none) in place of the species; without a species ``sp`` is its base."""
    word = F.lower(F.trim(F.regexp_replace(F.col("species"), r"\s+", " ")))
    number = F.when(word != "", F.pmod(F.xxhash64(word), F.lit(species_size - 1)) + 1).otherwise(F.lit(0)).cast("int")
    length = F.col("e") - F.col("t")
    return rows.select(
        *[c for c in ("file",) if c in rows.columns],
        "id", "key", "t", "e", "lo", "hi",
        (number + species_base).alias("sp"),
        _bucket(F.col("lo"), _LOW).alias("kl"),
        _bucket(F.col("hi"), _HIGH).alias("kh"),
        F.when(length.isNotNull(), F.least(F.lit(23), F.greatest(F.lit(0), F.floor(F.log2(length + 0.01) * 2) + 10)).cast("int") + _LENGTH).otherwise(F.lit(-1)).alias("kd"),
    )


# --- vectors -------------------------------------------------------------------------------


def _links(det: DataFrame, lab: DataFrame) -> DataFrame:
    """``a, b, n``: how often two tokens share a record, or a second of a recording across the sources."""
    tokens = ["sp", "kl", "kh", "kd"]
    combos = det.select(*tokens).unionByName(lab.select(*tokens)).groupBy(*tokens).agg(F.count(F.lit(1)).alias("n"))
    both = F.array(*[F.struct(F.col(x).alias("a"), F.col(y).alias("b")) for i, x in enumerate(tokens) for y in tokens[i + 1 :]])
    inside = combos.select("n", F.explode(both).alias("p")).select("p.a", "p.b", "n").where((F.col("a") >= 0) & (F.col("b") >= 0))
    second = lambda d, n: d.groupBy("key", F.floor("t").alias("s"), F.col("sp").alias(n)).agg(F.count(F.lit(1)).alias(f"n_{n}"))
    across = second(det, "a").join(second(lab, "b"), ["key", "s"]).select("a", "b", (F.least("n_a", "n_b") * 2).alias("n"))
    return inside.unionByName(across).groupBy("a", "b").agg(F.sum("n").alias("n"))


class Vectors:
    """Trained vectors of tokens: ``what`` by token, ``place`` by quarter second of the ring; and a record's, from them."""

    def __init__(self, what: np.ndarray, place: np.ndarray):
        self.what, self.place = what, place

    def of_place(self, t: np.ndarray) -> np.ndarray:
        """Unit vectors of times: between those of the two nearest tokens, so that near times have near vectors."""
        at = t / PLACE_S
        k = np.floor(at)
        part = (at - k)[:, None]
        k = np.mod(k, RING).astype(np.int64)
        return _unit(self.place[k] * (1 - part) + self.place[(k + 1) % RING] * part)

    def of_what(self, *tokens: np.ndarray) -> np.ndarray:
        """Unit mean of a record's other tokens, -1 for a missing one; the first, the species, counts double."""
        total = 0
        for k, t in enumerate(tokens):
            total = total + self.what[np.maximum(t, 0)] * ((t >= 0) * (2.0 if k == 0 else 1.0))[:, None]
        return _unit(total)


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(norm == 0, 1, norm)


def train(det: DataFrame, lab: DataFrame, dim: int = 24, place_dim: int = 16, per_token: int = 30, length: int = 8, seed: int = 11) -> Vectors:
    """Vectors of all tokens from walks by way of records, attributes and places.

    The number of tokens is fixed by hashing, which bounds the graph on the driver; what is
    collected are its links, counted over all rows.
    """
    rng = np.random.default_rng(seed)
    rows = _links(det, lab).toPandas().sort_values(["a", "b"])
    a, b, n = rows["a"].to_numpy(np.int64), rows["b"].to_numpy(np.int64), rows["n"].to_numpy(float)
    # a token is linked with its attribute, too, by a quarter of what it's linked with otherwise
    token, at = np.unique(np.r_[a, b], return_inverse=True)
    weight = np.bincount(at, np.r_[n, n]) / 4
    kind = _ATTRIBUTE + np.searchsorted([_NAME, _LOW, _HIGH, _LENGTH], token, "right")
    path, names = _compact_walks(np.r_[a, token], np.r_[b, kind], np.r_[n, weight], per_token, length, rng)
    what = np.zeros((_SIZE, dim), np.float32)
    if len(names):
        what[names] = skip_gram(path, len(names), dim, window=2, negatives=4, epochs=2, rng=rng)

    # places: a record holds the two nearest quarter seconds and, at two offsets, the four seconds around it
    quarter = det.select("t").unionByName(lab.select("t")).groupBy(F.pmod(F.floor(F.col("t") / PLACE_S), F.lit(RING)).cast("int").alias("q")).agg(F.count(F.lit(1)).alias("n"))
    seen = np.ones(RING)
    for r in quarter.collect():  # at most RING rows
        seen[r["q"]] += r["n"]
    q = np.arange(RING)
    wide = 16
    coarse = [RING + j * (RING // wide) + ((q + j * wide // 2) // wide) % (RING // wide) for j in (0, 1)]
    path, _ = _compact_walks(np.r_[q, q, q], np.r_[(q + 1) % RING, *coarse], np.r_[seen, seen / 2, seen / 2], 40, 10, rng)
    place = skip_gram(path, RING + 2 * (RING // wide), place_dim, window=3, negatives=4, epochs=2, rng=rng)[:RING]
    return Vectors(what, place)


def _compact_walks(a: np.ndarray, b: np.ndarray, weight: np.ndarray, per_token: int, length: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Walks over the tokens that occur, by their place among them, and those tokens."""
    names, at = np.unique(np.r_[a, b], return_inverse=True)
    if not len(names):
        return np.empty((0, length), np.int64), names
    return walks(at[: len(a)], at[len(a) :], weight, len(names), per_token, length, rng), names


# --- candidates ----------------------------------------------------------------------------


def _slab(c: Column) -> Column:
    return F.floor(c / F.lit(SLAB_S))


def _at_slabs(lab: DataFrame, places: DataFrame, margin: float) -> DataFrame:
    """Labels once for each slab within ``margin`` of their span that holds detections (``places``: key, slab).

    A label over more than two slabs is joined with the slabs that the recording has, so
    that an absurd end costs no more than there are detections.
    """
    first, last = _slab(F.col("t") - margin), _slab(F.coalesce(F.col("e"), F.col("t")) + margin)
    marked = lab.withColumn("_a", first).withColumn("_z", last)
    short = marked.where(F.col("_z") - F.col("_a") <= 3).withColumn("slab", F.explode(F.sequence("_a", "_z"))).join(places, ["key", "slab"], "left_semi")
    long = marked.where(F.col("_z") - F.col("_a") > 3).join(places, "key").where(F.col("slab").between(F.col("_a"), F.col("_z")))
    return short.unionByName(long.select(*short.columns)).drop("_a", "_z")


_RECORD = ("id", "t", "e", "lo", "hi", "sp", "kl", "kh", "kd")
_PAIR = "l_id bigint, d_id bigint, block bigint, decoy boolean, unnamed boolean, l_len float, d_len float, dt double, dl float, dh float, alike float"
AROUND_S = 2.0  # candidates stand at most so far outside a label's span


def _codes(x: np.ndarray, planes: np.ndarray, tables: int) -> np.ndarray:
    """The side of each hyperplane as the bits of one code per table."""
    bits = planes.shape[1] // tables
    return ((x @ planes > 0).reshape(len(x), tables, bits) @ (1 << np.arange(bits, dtype=np.int64))).astype(np.int64)


def _prober(vectors: Vectors, place_tables: int, full_tables: int, bits: int, step: float, least: float, seed: int, reach: float = AROUND_S):
    """Pairs that agree in all bits of a table, slab by slab, with their exact cosines.

    Rows come sorted by slab, labels before detections, so only the labels of the current
    slab are kept while its detections stream by.
    """
    rng = np.random.default_rng(seed)
    dim_p, dim_w = vectors.place.shape[1], vectors.what.shape[1]
    place_planes = rng.standard_normal((dim_p, place_tables * bits))
    full_planes = rng.standard_normal((dim_p + dim_w, full_tables * bits))
    tables = place_tables + full_tables

    def hashed(t: np.ndarray, what: np.ndarray) -> np.ndarray:
        parts = []
        p = vectors.of_place(t) if place_tables else np.zeros((len(t), dim_p))  # without place tables places don't count
        if place_tables:
            parts.append(_codes(p, place_planes, place_tables))
        if full_tables:
            parts.append(_codes(np.concatenate([p, what], axis=1), full_planes, full_tables))
        return np.concatenate(parts, axis=1)

    def pairs(lab: pd.DataFrame, det: pd.DataFrame) -> pd.DataFrame:
        tokens = lambda df: [df[c].to_numpy(np.int64) for c in ("sp", "kl", "kh", "kd")]
        lt, le, dt = lab["t"].to_numpy(float), lab["e"].to_numpy(float), det["t"].to_numpy(float)
        lw, dw = vectors.of_what(*tokens(lab)), vectors.of_what(*tokens(det))
        # a label is looked up at places along its span, as far as the slab goes
        low = lab["slab"].to_numpy(float) * SLAB_S
        a = np.maximum(lt, low - step)
        z = np.minimum(np.where(np.isnan(le), lt, le), low + SLAB_S + step)
        n = np.maximum(1, np.floor(np.maximum(z - a, 0) / step).astype(np.int64) + 1) if place_tables else np.ones(len(lt), np.int64)
        of = np.repeat(np.arange(len(lt)), n)
        at = a[of] + (np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)) * step
        lc, dc = hashed(at, lw[of]), hashed(dt, dw)
        table = np.arange(tables, dtype=np.int64)
        lkey = ((lab["_g"].to_numpy(np.int64)[of][:, None] * tables + table) << bits | lc).ravel()
        dkey = ((det["_g"].to_numpy(np.int64)[:, None] * tables + table) << bits | dc).ravel()
        order = np.argsort(lkey, kind="stable")
        lkey, owner = lkey[order], np.repeat(of, tables)[order]
        lo, hi = np.searchsorted(lkey, dkey, "left"), np.searchsorted(lkey, dkey, "right")
        many = hi - lo
        di = np.repeat(np.repeat(np.arange(len(dt)), tables), many)
        li = owner[np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many) + np.repeat(lo, many)]
        both = np.unique(di * len(lt) + li)
        di, li = both // len(lt), both % len(lt)
        L, D = {c: lab[c].to_numpy()[li] for c in lab.columns}, {c: det[c].to_numpy()[di] for c in det.columns}
        alike = (vectors.what[L["sp"].astype(np.int64)] * vectors.what[D["sp"].astype(np.int64)]).sum(axis=1)
        what = (lw[li] * dw[di]).sum(axis=1)
        place = (vectors.of_place(L["t"].astype(float)) * vectors.of_place(D["t"].astype(float))).sum(axis=1)
        out = pd.DataFrame({
            "l_id": L["id"], "d_id": D["id"], "block": L["block"], "decoy": L["decoy"].astype(bool), "unnamed": (D["sp"] == _DET) | (L["sp"] == _NAME),
            "l_len": L["e"] - L["t"], "d_len": D["e"] - D["t"], "dt": D["t"] - L["t"], "dl": D["lo"] - L["lo"], "dh": D["hi"] - L["hi"], "alike": alike,
        })
        if not place_tables:
            return out[(what >= least) & (out["dt"].abs() <= reach) & ((out["l_len"] - out["d_len"]).abs() < 0.3)]
        outside = np.maximum(-out["dt"], out["dt"] - np.nan_to_num(out["l_len"].to_numpy(float)))
        return out[(outside <= AROUND_S) & ((place >= least) | (out["l_len"] > AROUND_S))]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept, last = None, None
        for df in batches:
            if not len(df):
                continue
            key, slab = df["key"].to_numpy(), df["slab"].to_numpy()
            fresh = np.ones(len(df), bool)
            fresh[1:] = (key[1:] != key[:-1]) | (slab[1:] != slab[:-1])
            df["_g"] = np.cumsum(fresh)
            is_lab = df["src"].to_numpy() == 0
            lab, det = df[is_lab], df[~is_lab]
            if kept is not None and last == (key[0], slab[0]):
                lab = pd.concat([kept.assign(_g=1), lab])
            if len(lab) and len(det):
                for first in range(0, len(det), 20_000):  # bounds the arrays of a step only
                    found = pairs(lab, det.iloc[first : first + 20_000])
                    if len(found):
                        yield found
            last = (key[-1], slab[-1])
            kept = lab[lab["_g"] == df["_g"].iloc[-1]]

    return run


def _probe(det: DataFrame, lab: DataFrame, run) -> DataFrame:
    """Runs a prober over detections and labels (with ``decoy, block``) that share ``key, slab``."""
    own = [F.col(c) for c in _RECORD]
    rows = lab.select("key", "slab", F.lit(0).alias("src"), "decoy", "block", *own).unionByName(
        det.select("key", "slab", F.lit(1).alias("src"), F.lit(False).alias("decoy"), F.lit(0).cast("long").alias("block"), *own)
    )
    ordered = rows.repartition("key", "slab").sortWithinPartitions("key", "slab", "src", "t", "id")
    return ordered.mapInPandas(run, _PAIR)


# --- clocks --------------------------------------------------------------------------------


def _clocks(votes: DataFrame, reach: float, cell: float = 0.1) -> DataFrame:
    """``file, slab, clock``: by how much a file's labels of a stretch are early, where votes are clear.

    Annotators name one recording in different ways and have clocks of their own, so labels
    vote together by the name as written.

    Every pair of a label with a similar detection votes for its difference in time; right
    pairs of a stretch agree, others spread over all differences. A shift other than 0 must
    beat what chance gives its best cell and what speaks for 0.
    """
    cells = 2 * reach / cell
    at = F.round(F.col("dt") / cell).cast("int")
    # a label votes once for a shift, in its own stretch and those beside it; neighbouring cells share votes
    cast = (
        votes.select("l_id", "place", F.explode(F.array(at - 1, at, at + 1)).alias("c"), F.when(F.abs(F.col("dt") / cell - at) <= 0.5, F.col("dt")).alias("dt"))
        .groupBy("place", "l_id", "c").agg(F.avg("dt").alias("dt"))
        .withColumn("slab", F.explode(F.array(F.col("place.slab") - 1, F.col("place.slab"), F.col("place.slab") + 1)))
        .groupBy(F.col("place.file").alias("file"), "slab", "c").agg(F.count(F.lit(1)).alias("n"), F.avg("dt").alias("dt"))
    )
    # at most as many rows a stretch as there are cells
    w = Window.partitionBy("file", "slab")
    chance = F.greatest(F.sum("n").over(w) / F.lit(cells), F.lit(0.02))
    gain = F.when(F.col("n") > F.col("_m"), F.col("n") * F.log(F.col("n") / F.col("_m")) - (F.col("n") - F.col("_m"))).otherwise(F.lit(0.0))
    scored = cast.withColumn("_m", chance).withColumn("gain", gain)
    best = scored.groupBy("file", "slab").agg(
        F.max(F.when(F.abs("c") <= 1, F.col("gain"))).alias("still"),
        F.max(F.when(F.abs("c") > 1, F.struct("gain", (-F.abs(F.col("c"))).alias("near"), "dt", "n"))).alias("b"),
    )
    clear = (F.col("b.gain") - F.lit(float(np.log(cells))) > F.coalesce("still", F.lit(0.0))) & (F.col("b.n") >= 2)
    return best.where(clear).select("file", "slab", F.col("b.dt").alias("clock"))


# --- calibration ---------------------------------------------------------------------------

#: Features of a pair: column, width of a cell, cells on each side.
_FEATURES = (("dt", 0.05, 30), ("de", 0.05, 30), ("dl", 100.0, 16), ("dh", 150.0, 16), ("alike", 0.1, 10))


def _cells() -> dict[str, Column]:
    out = {}
    for name, width, most in _FEATURES:
        c = F.col(name)
        if name == "alike":
            c = F.when(~F.col("unnamed"), c)
        out[name] = F.when(c.isNull() | F.isnan(c), F.lit(most + 1)).otherwise(F.greatest(F.lit(-most), F.least(F.lit(most), F.round(c / width)))).cast("int")
    return out


def _weights(found: np.ndarray, false: np.ndarray) -> np.ndarray:
    """Log odds per cell of right pairs, the surplus of found over decoy ones, against false ones."""
    right = np.maximum(found - false, 0.0)
    cells = len(found)
    return np.log((right + 0.5) / (right.sum() + 0.5 * cells)) - np.log((false + 0.5) / (false.sum() + 0.5 * cells))


def _learned(counts: pd.DataFrame) -> dict[str, dict[int, float]]:
    """Weights of every feature's cells from counts ``feature, cell, found, false``.

    A difference weighs less the greater it is, a cosine more; cells are pooled where counts say otherwise.
    """
    out: dict[str, dict[int, float]] = {}
    for name, rows in counts.groupby("feature"):
        w = pd.Series(_weights(rows["found"].to_numpy(float), rows["false"].to_numpy(float)).clip(-6, 6), rows["cell"].astype(int))
        n = pd.Series(rows["found"].to_numpy(float) + rows["false"].to_numpy(float) + 1, w.index)
        unknown = w.index > {f: most for f, _, most in _FEATURES}[str(name)]
        table = dict(w[unknown])
        if str(name) == "alike":
            parts = [w[~unknown].sort_index()]
        else:
            parts = [w[~unknown & (w.index <= 0)].sort_index(), w[~unknown & (w.index >= 0)].sort_index(ascending=False)]
        for part in parts:
            table |= dict(zip(part.index, isotonic(part.to_numpy(), n[part.index].to_numpy())))
        out[str(name)] = table
    return out


def _lookup(table: dict[int, float], cell: Column) -> Column:
    """The weight of a cell; one that never occurred weighs nothing."""
    if not table:
        return F.lit(0.0)
    low = min(table)
    values = F.array(*[F.lit(float(table.get(k, 0.0))) for k in range(low, max(table) + 1)])  # an array: looked up by place
    return F.coalesce(F.get(values, cell - low), F.lit(0.0))


def isotonic(value: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The rising sequence with the least weighted squared distance (pool adjacent violators)."""
    pools: list[list[float]] = []
    for v, w in zip(value, weight):
        pools.append([v, w, 1])
        while len(pools) > 1 and pools[-2][0] >= pools[-1][0]:
            b, a = pools.pop(), pools.pop()
            w_ = a[1] + b[1]
            pools.append([(a[0] * a[1] + b[0] * b[1]) / w_ if w_ else a[0], w_, a[2] + b[2]])
    return np.concatenate([np.full(int(n), v) for v, _, n in pools]) if pools else np.empty(0)


def _calibrated(scored: DataFrame, kind: str, score: str) -> dict[int, float]:
    """Probability that a pair is right, per half of the score: found pairs against as many decoys."""
    cell = F.floor(F.greatest(F.lit(-20.0), F.least(F.lit(40.0), F.col(score))) * 2).cast("int")
    counts = (
        scored.where(F.col(kind)).groupBy(cell.alias("cell")).agg(F.count(F.when(~F.col("decoy"), 1)).alias("found"), F.count(F.when(F.col("decoy"), 1)).alias("false")).toPandas().sort_values("cell")
    )  # at most 121 rows
    found, false = counts["found"].to_numpy(float), counts["false"].to_numpy(float)
    chance = 1 - np.minimum(1, (false + 0.25) / (found + 0.5))
    return dict(zip(counts["cell"].astype(int), isotonic(chance, found + false))) if len(counts) else {}


def match(
    detections: DataFrame, labels: DataFrame, place_tables: int = 6, full_tables: int = 4, bits: int = 9, step: float = 0.4, clock_reach: float = 30.0, least: float = 0.4, seed: int = 5
) -> DataFrame:
    """``det_id, label_id, confidence`` of all pairs with at least the confidence ``least``.

    detections need ``det_id, filename, file_path``, labels ``label_id, filename``, both
    ``species, time_start, time_end, freq_low_hz, freq_high_hz``; other columns are ignored.
    Rows without id, recording or finite start don't count. A missing, infinite or earlier
    end and missing bands are unknown and judged by the rest; exchanged bands are put right.
    Rows delivered twice match as often. Clocks of labels are found if they're off by at most
    ``clock_reach`` seconds, by name as written and stretch by stretch. Empty tables give no rows.
    """
    lab = cut(_with_tokens(_keyed(labels, "label_id", "filename"), _NAME, _LOW - _NAME))
    det = _keyed(detections, "det_id", "filename", "file_path").drop("file").withColumn("slab", _slab(F.col("t")))
    # detections in a slab that a label can reach; the others are left out before anything else
    span = F.sequence(_slab(F.col("t") - clock_reach), F.least(_slab(F.coalesce(F.col("e"), F.col("t")) + clock_reach), _slab(F.col("t")) + 3))
    near = lab.select("key", F.explode(span).alias("slab")).distinct()
    long = lab.where(_slab(F.coalesce(F.col("e"), F.col("t")) + clock_reach) > _slab(F.col("t")) + 3).select("key").distinct().withColumn("_long", F.lit(True))
    reached = det.join(near.withColumn("_near", F.lit(True)), ["key", "slab"], "left").join(long, "key", "left").where(F.col("_near") | F.col("_long")).drop("_near", "_long")
    names = ["id", "key", "t", "e", "lo", "hi", "sp", "kl", "kh", "kd"]
    det = cut(_with_tokens(reached, _DET, _NAME).select(*names, _slab(F.col("t")).alias("slab")))
    places = cut(det.select("key", "slab").distinct())
    vectors = train(det, lab)

    # clocks: pairs alike in what they are, whatever the time within reach
    lab = lab.withColumn("decoy", F.lit(False)).withColumn("block", _slab(F.col("t")))
    wide = _probe(det, _at_slabs(lab, places, clock_reach), _prober(vectors, 0, 8, 6, step, 0.5, seed, clock_reach))
    similar = (F.abs(F.col("dl")) < 700) & (F.abs(F.col("dh")) < 1200)
    votes = wide.where(similar).join(lab.select(F.col("id").alias("l_id"), F.struct("file", F.col("block").alias("slab")).alias("place")), "l_id").select("l_id", "place", "dt")
    clocks = _clocks(votes, clock_reach)
    lab = lab.join(clocks, (lab["file"] == clocks["file"]) & (lab["block"] == clocks["slab"]), "left").select(*[lab[c] for c in lab.columns], F.coalesce("clock", F.lit(0.0)).alias("_clock"))
    lab = lab.withColumn("t", F.col("t") + F.col("_clock")).withColumn("e", F.col("e") + F.col("_clock")).drop("_clock")

    # every label once more beside its place, past its own length: what decoys meet is chance, in the same bout of calls
    beside = F.coalesce(F.least(F.col("e") - F.col("t"), F.lit(SLAB_S)), F.lit(1.0)) + F.lit(DECOY_S)
    away = F.when((F.col("t") >= beside) & (F.pmod(F.xxhash64("id"), F.lit(2)) == 0), -beside).otherwise(beside)
    decoys = lab.withColumn("_away", away).withColumn("t", F.col("t") + F.col("_away")).withColumn("e", F.col("e") + F.col("_away")).withColumn("decoy", F.lit(True)).drop("_away")
    found = _probe(det, _at_slabs(lab.unionByName(decoys), places, AROUND_S), _prober(vectors, place_tables, full_tables, bits, step, 0.0, seed + 1))
    # a label over a slab's end meets a detection once, since a detection is in one slab
    return _judged(cut(found.drop("block")), least)


def _ends(c: str) -> Column:
    """In which of five cells the distance between an end of a series and its label's lies."""
    d = F.abs(F.col(c))
    return F.when(d <= 0.12, 0).when(d <= 0.25, 1).when(d <= 0.5, 2).when(d <= 0.8, 3).otherwise(4)


def _series_odds(counts: pd.DataFrame) -> dict[int, float]:
    """Probability of a series by cell, from counts ``cell, beside, found, false`` of labels.

    Decoys have no series of their own, found labels mostly have one; how many have none is
    read from the series that fit at neither end. Beside a box that fits the label as a whole
    a series must outnumber all decoys.
    """
    found = counts[~counts["beside"]].set_index("cell")["found"]
    false = counts[~counts["beside"]].set_index("cell")["false"]
    share = {}
    for kind in range(3):
        far = [c for c in found.index if c // 100 >= 3 and c // 10 % 10 >= 3 and c % 10 == kind]
        share[kind] = min(1.0, (found[far].sum() + 1) / (false[far].sum() + 1))
    out = {}
    for cell, beside, n in counts[["cell", "beside", "found"]].itertuples(index=False):
        chance = float(false.get(cell, 0)) * (1.0 if beside else share[int(cell) % 10])
        out[int(cell) * 2 + int(beside)] = (max(n - chance, 0.0) + 0.5) / (n + 1.0)
    return out


def _judged(pairs: DataFrame, least: float) -> DataFrame:
    """Confidence of candidates by calibrated weights of cosines and exact differences."""
    short = F.coalesce(F.col("d_len") * 1.2 < F.col("l_len"), F.lit(False))  # can be no more than a part of the label
    # but of two short ones the lengths may differ by rounding
    pairs = pairs.withColumn("is_whole", ~short | (F.col("l_len") - F.col("d_len") <= 0.35)).withColumn("de", F.col("dt") + F.col("d_len") - F.col("l_len"))
    cells = _cells()
    both = (F.count(F.when(~F.col("decoy"), 1)).alias("found"), F.count(F.when(F.col("decoy"), 1)).alias("false"))
    weights: dict[str, dict[int, float]] = {}
    one = lambda n: _lookup(weights.get(n, {}), cells[n])
    total = lambda names: sum((one(n) for n in names), F.lit(0.0))
    for round_ in (1, 2):
        # at first over all candidates, then for each feature over those that the others speak for
        asked = [F.struct(F.lit(n).alias("feature"), c.alias("cell"), (total([m for m in cells if m != n]) > 0 if round_ == 2 else F.lit(True)).alias("of")) for n, c in cells.items()]
        each = pairs.where("is_whole").select("decoy", F.explode(F.array(*asked)).alias("x")).where("x.of")
        learned = _learned(each.groupBy("x.feature", "x.cell").agg(*both).toPandas())  # a few hundred rows
        # cells that no such candidate is in keep their first weight
        weights = {n: weights.get(n, {}) | learned.get(n, {}) for n in cells}
    pairs = pairs.withColumn("whole", F.when(F.col("is_whole"), total(cells)))

    # series: short calls of one length inside a label; a call without end counts if the others make a series
    within = (F.col("dt") >= -0.3) & (F.coalesce(F.col("de"), F.col("dt") - F.col("l_len")) <= 0.3) & (one("dl") + one("dh") > -2.5)
    w = Window.partitionBy("l_id", "decoy")
    length = F.round(F.col("d_len") * 64).cast("int")
    alike = F.when(F.col("unnamed"), 2).when(F.col("alike") > 0.5, 1).otherwise(0)
    pairs = pairs.withColumns({"_in": F.coalesce(within, F.lit(False)), "_alike": alike, "_beside": F.coalesce(F.max(F.when(~short, F.col("whole"))).over(w) > 2, F.lit(False))})
    likely = F.col("_in") & short
    pairs = pairs.withColumn("_own", F.mode(F.when(likely & (F.col("_alike") > 0), length), deterministic=True).over(w))
    # a second series, of calls by another name, where they have another length
    pairs = pairs.withColumn("_own", F.coalesce("_own", F.lit(-99))).withColumn("_else", F.mode(F.when(likely & (F.col("_alike") == 0) & (F.abs(length - F.col("_own")) > 2), length), deterministic=True).over(w))
    for n, mode in (("1", "_own"), ("0", "_else")):
        call = f"_call{n}"
        pairs = pairs.withColumn(call, F.coalesce(likely & (F.abs(length - F.col(mode)) <= 2), F.lit(False)))
        first, last = F.min(F.when(F.col(call), F.col("dt"))).over(w), F.max(F.when(F.col(call), F.col("de"))).over(w)
        pairs = pairs.withColumns({"_from": first, "_to": last, "_best": F.max(F.when(F.col(call), F.col("_alike"))).over(w), "_head": F.col("d_id") == F.min(F.when(F.col(call), F.col("d_id"))).over(w)})
        cell = F.when(F.col("_from").isNotNull(), _ends("_from") * 100 + _ends("_to") * 10 + F.col("_best")).cast("int")
        open_ended = F.col("_in") & F.col("d_len").isNull() & F.col("l_len").isNotNull()
        pairs = pairs.withColumn(f"_series{n}", F.struct(cell.alias("cell"), F.coalesce("_head", F.lit(False)).alias("head"), (F.col(call) | open_ended & cell.isNotNull()).alias("part")))
    pairs = cut(pairs.select("l_id", "d_id", "decoy", "is_whole", "whole", "_series1", "_series0", "_beside"))
    heads = pairs.select("decoy", "_beside", F.explode(F.array("_series1", "_series0")).alias("x")).where("x.head")
    series = heads.groupBy(F.col("x.cell").alias("cell"), F.col("_beside").alias("beside")).agg(*both).toPandas()  # at most 150 rows
    by_whole, by_series = _calibrated(pairs, "is_whole", "whole"), _series_odds(series)
    half = F.floor(F.greatest(F.lit(-20.0), F.least(F.lit(40.0), F.col("whole"))) * 2).cast("int")
    in_series = [F.when(F.col(f"{n}.part"), _lookup(by_series, F.col(f"{n}.cell") * 2 + F.col("_beside").cast("int"))) for n in ("_series1", "_series0")]
    sure = F.greatest(F.when(F.col("is_whole"), _lookup(by_whole, half)), *in_series)
    return pairs.where(~F.col("decoy")).select(F.col("d_id").alias("det_id"), F.col("l_id").alias("label_id"), sure.alias("confidence")).where(F.col("confidence") >= least)
