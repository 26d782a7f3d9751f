"""Passages of test items inside documents: size-partitioned MinHash containment, then exact.

Every item is indexed by the MinHash values of all its passages (30 successive words).
A document is cut into overlapping stretches such that every passage lies whole in one
of them. Stretches are classed by size; from a class's upper size and the least
containment that a passage can have, the class gets its number of hash functions, so that
a passage is missed with at most the stated probability whatever the document's length. A
stretch with a value in common with an item's passage is a candidate. Candidates are
verified: first by the shingles that stretch and item share on one alignment, then word
by word.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from html import unescape

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from tonewright.llm.visible import transducer

SHINGLE = 5
#: A tag has a name and attributes with values; other angle brackets are text.
_TAG = re.compile(r"""<!--.*?-->|<!doctype[^<>]*>|</?([a-z][a-z0-9]*)(?:\s+[\w:-]+\s*=\s*(?:"[^"]*"|'[^']*'|[^\s"'=<>`]+))*\s*/?>""", re.I | re.S)
#: Tags that don't part what stands before and behind them.
_INLINE = frozenset("a abbr b bdi bdo big cite code del dfn em font i ins kbd mark q s samp small span strike strong sub sup tt u var wbr".split())
_WORD = re.compile(r"[^\W_]+")
_JOINED = re.compile(r"[^\W_]+(?:['’‐‑-][^\W_]+)*")


def visible_words(text: str, joined: bool = False) -> list[str]:
    """The words as a reader sees them: consistent characters, no case, markup or punctuation.

    Entities are read as their characters. Apostrophes and hyphens part words, and so does
    every tag; ``joined`` is the other reading, in which words with either are one and tags
    within a line don't part.
    """
    if "<" in text:
        text = _TAG.sub(lambda m: "" if joined and (m[1] or "").lower() in _INLINE else " ", text)
    if "&" in text:
        text = unescape(text)
    return (_JOINED if joined else _WORD).findall(transducer()(text).casefold())


def _two_readings(text: str) -> bool:
    """Whether tags or entities let the two readings differ in more than apostrophes and hyphens."""
    return "<" in text


class _Codes(dict):
    """Stable 64-bit codes of words, kept while they are few."""

    def __missing__(self, word: str) -> int:
        code = xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        if len(self) > 500_000:
            self.clear()
        self[word] = code
        return code


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _shingles(codes: np.ndarray) -> np.ndarray:
    """Hash of the SHINGLE words from each position on (shorter than codes by SHINGLE - 1)."""
    n = len(codes) - SHINGLE + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(SHINGLE):
        out = _mix(out + codes[i : i + n])
    return out


class Index:
    """The items' side: MinHash values of all passages, and all shingles with their places."""

    def __init__(self, items: list[tuple[int, str]], passage: int, replaced: int, miss: float, seed: int = 7):
        if passage < SHINGLE * (replaced + 1) + replaced:
            raise ValueError("a passage must keep a whole shingle whatever words are replaced")
        self.passage, self.replaced = passage, replaced
        self.window = passage - SHINGLE + 1
        self.least = self.window - SHINGLE * replaced  # shingles that survive the replacements at least
        self.step = passage + SHINGLE - 1
        self.stretch = self.step + self.window - 1  # shingles of a full stretch
        # sizes of the classes, and hash functions for each
        self.sizes = [round(self.window + (self.stretch - self.window) * k / 3) for k in range(4)]
        alike = [self.least / (self.window + u - self.least) for u in self.sizes]
        self.hashes = [int(np.ceil(np.log(miss) / np.log(1 - j))) for j in alike]
        rng = np.random.default_rng(seed)
        self.factors = rng.integers(1, 2**63, max(self.hashes), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.masks = rng.integers(0, 2**63, max(self.hashes), dtype=np.uint64)

        codes = _Codes()
        self.ids, self.words, self.whole, sh, owner, place = [], [], [], [], [], []
        for item, text in items:
            w = np.array([codes[x] for x in visible_words(text)], np.uint64)
            if len(w) < passage:
                continue
            s = _shingles(w)
            sh.append(s)
            owner.append(np.full(len(s), len(self.ids)))
            place.append(np.arange(len(s)))
            self.ids.append(item)
            self.words.append(w)
            self.whole.append(np.array([codes[x] for x in visible_words(text, joined=True)], np.uint64))
        self.shingles = np.concatenate(sh) if sh else np.empty(0, np.uint64)
        self.owner = np.concatenate(owner) if sh else np.empty(0, np.int64)
        self.place = np.concatenate(place) if sh else np.empty(0, np.int64)
        # per hash function: sorted values and the items that have them
        self.tables = []
        for a, b in zip(self.factors, self.masks):
            keys, items_of = [], []
            for i, s in enumerate(sh):
                h = s * a ^ b
                low = np.lib.stride_tricks.sliding_window_view(h, self.window).min(axis=1)
                u = np.unique(low)
                keys.append(u)
                items_of.append(np.full(len(u), i))
            k = np.concatenate(keys) if keys else np.empty(0, np.uint64)
            o = np.concatenate(items_of) if keys else np.empty(0, np.int64)
            order = np.argsort(k, kind="stable")
            self.tables.append((k[order], _flags(k), o[order]))
        order = np.argsort(self.shingles, kind="stable")
        self.shingles, self.owner, self.place = self.shingles[order], self.owner[order], self.place[order]
        self.flags = _flags(self.shingles)


_TAIL = np.uint64((1 << 17) - 1)


def _flags(keys: np.ndarray) -> np.ndarray:
    """Which tails of 17 bits occur: rules most values out before the search among the keys."""
    out = np.zeros(1 << 17, bool)
    out[keys & _TAIL] = True
    return out


def _spread(keys: np.ndarray, flags: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each wanted value all places in the sorted keys: index into wanted, index into keys."""
    maybe = np.flatnonzero(flags[wanted & _TAIL])
    w = wanted[maybe]
    lo = np.searchsorted(keys, w, "left")
    real = np.flatnonzero(keys[np.minimum(lo, len(keys) - 1)] == w)
    maybe, lo, hi = maybe[real], lo[real], np.searchsorted(keys, w[real], "right")
    n = hi - lo
    return np.repeat(maybe, n), np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)


def _passage(item: np.ndarray, text: np.ndarray, index: Index) -> bool:
    """Whether the text carries a passage of the item, on any alignment with two successive words in common."""
    order = np.argsort(item, kind="stable")
    lo, hi = np.searchsorted(item[order], text, "left"), np.searchsorted(item[order], text, "right")
    n = hi - lo
    at = np.repeat(np.arange(len(text)), n)
    of = order[np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)]
    shifts, count = np.unique(at - of, return_counts=True)
    for s in shifts[count >= index.passage - index.replaced].tolist():
        a, b = max(0, -s), min(len(item), len(text) - s)
        if b - a < index.passage:
            continue
        same = np.cumsum(np.r_[0, (item[a:b] == text[a + s : b + s]).astype(np.int64)])
        if (same[index.passage :] - same[: -index.passage]).max() >= index.passage - index.replaced:
            return True
    return False


def _search(index: Index, docs: list[list[str]], codes: _Codes, texts: list[str]) -> list[tuple[int, int]]:
    """(document, item) positions of all documents with a passage of an item.

    Where shingles agree on alignments a few words apart, words with apostrophes or hyphens
    may have been replaced; these few candidates are read again with such words as one.
    """
    sizes = np.array([len(d) for d in docs])
    usable = np.flatnonzero(sizes >= index.passage)
    if not len(usable) or not index.ids:
        return []
    sizes = sizes[usable]
    words = np.fromiter((codes[w] for i in usable for w in docs[i]), np.uint64, int(sizes.sum()))
    begin = np.cumsum(sizes) - sizes
    sh = _shingles(words)  # those across two documents are never inside a stretch
    per = np.maximum(1, -(-(sizes - SHINGLE + 1 - (index.window - 1)) // index.step))
    doc = np.repeat(np.arange(len(usable)), per)
    k = np.arange(len(doc)) - np.repeat(np.cumsum(per) - per, per)
    start = begin[doc] + k * index.step
    end = np.minimum(start + index.stretch, begin[doc] + sizes[doc] - SHINGLE + 1)
    kind = np.searchsorted(index.sizes, end - start)
    pairs, many = [], len(index.ids)
    seen = np.zeros(len(doc) * many if len(doc) * many <= 50_000_000 else 0, bool)  # else sorted
    for c, hashes in enumerate(index.hashes):
        own = np.flatnonzero(kind == c)
        if not len(own):
            continue
        # the class's shingles side by side, so that nothing else is hashed
        n = end[own] - start[own]
        first = np.cumsum(n) - n
        flat = sh[np.arange(int(n.sum())) - np.repeat(first, n) + np.repeat(start[own], n)]
        for f in range(hashes):
            low = np.minimum.reduceat(flat * index.factors[f] ^ index.masks[f], first)
            keys, flags, items = index.tables[f]
            at, of = _spread(keys, flags, low)
            if len(seen):
                seen[own[at] * many + items[of]] = True
            else:
                pairs.append(np.unique(own[at] * many + items[of]))
    found = np.flatnonzero(seen) if len(seen) else np.unique(np.concatenate(pairs)) if pairs else np.empty(0, np.int64)
    if not len(found):
        return []
    # exact shingles of the candidate stretches, by alignment
    stretch = np.unique(found // many)
    n = end[stretch] - start[stretch]
    pos = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(start[stretch], n)
    of_stretch = np.repeat(stretch, n)
    at, of = _spread(index.shingles, index.flags, sh[pos])
    item, shift = index.owner[of], pos[at] - index.place[of]
    keep = seen[of_stretch[at] * many + item] if len(seen) else np.isin(of_stretch[at] * many + item, found)
    d, item, shift, pos = doc[of_stretch[at]][keep], item[keep], shift[keep], pos[at][keep]
    if not len(d):
        return []
    order = np.lexsort((pos, shift, item, d))
    d, item, shift, pos = d[order], item[order], shift[order], pos[order]
    fresh = np.ones(len(d), bool)
    fresh[1:] = (d[1:] != d[:-1]) | (item[1:] != item[:-1]) | (shift[1:] != shift[:-1])
    again = ~fresh & (pos == np.r_[-1, pos[:-1]])  # the same place in two stretches
    count = np.add.reduceat((~again).astype(np.int64), np.flatnonzero(fresh))
    starts = np.flatnonzero(fresh)
    heads = starts[count >= index.least]
    out = set()
    for h in heads:
        pair = (int(usable[d[h]]), int(item[h]))
        if pair in out:
            continue
        w, text = index.words[item[h]], words[begin[d[h]] : begin[d[h]] + sizes[d[h]]]
        s = int(shift[h] - begin[d[h]])
        a, b = max(0, -s), min(len(w), len(text) - s)
        if b - a < index.passage:
            continue
        same = np.cumsum(np.r_[0, (w[a:b] == text[a + s : b + s]).astype(np.int64)])
        if (same[index.passage :] - same[: -index.passage]).max() >= index.passage - index.replaced:
            out.add(pair)
    # alignments of one document and item within four words of each other, enough only together
    d, item, shift, last = d[starts], item[starts], shift[starts], pos[np.r_[starts[1:], len(pos)] - 1]
    beside = (d[1:] == d[:-1]) & (item[1:] == item[:-1]) & (shift[1:] - shift[:-1] <= 4) & (count[1:] + count[:-1] >= index.least) & (np.abs(last[1:] - last[:-1]) < 2 * index.passage)
    again_: dict[int, np.ndarray] = {}
    for h in np.flatnonzero(beside):
        at, pair = int(usable[d[h]]), (int(usable[d[h]]), int(item[h]))
        if pair not in out:
            if at not in again_:
                again_[at] = np.array([codes[w] for w in visible_words(texts[at], joined=True)], np.uint64)
            if _passage(index.whole[item[h]], again_[at], index):
                out.add(pair)
    return sorted(out)


def _finder(indexes: list[Index], chars: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codes = _Codes()

        def part(ids: list, docs: list[list[str]], texts: list[str]) -> pd.DataFrame:
            # a text is read once for all blocks of items
            hits = [(ids[i], index.ids[j]) for index in indexes for i, j in _search(index, docs, codes, texts)]
            return pd.DataFrame(hits, columns=["id", "item_id"], dtype="int64")

        for batch in batches:
            ids, docs, texts, size = [], [], [], 0
            for i, text in zip(batch["id"], batch["text"]):
                for joined in (False, True)[: 1 + _two_readings(text)]:
                    ids.append(i)
                    docs.append(visible_words(text, joined))
                    texts.append(text)
                size += len(text)
                if size >= chars:  # bounds the arrays of a step, not what is searched
                    yield part(ids, docs, texts)
                    ids, docs, texts, size = [], [], [], 0
            if ids:
                yield part(ids, docs, texts)

    return run


def leaked_passages(
    documents: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "eval_id",
    item_text_col: str = "text",
    passage: int = 30,
    replaced: int = 3,
    miss: float = 1e-3,
    block_chars: int = 4_000_000,
    blocks: int = 8,
) -> DataFrame:
    """``id, item_id`` for every document with a passage of an item.

    A passage is ``passage`` successive words of the item in their order, at most
    ``replaced`` of them replaced by others. ``miss`` bounds the probability that a passage
    at this limit isn't found; whole quotations are found with near certainty. Both ids are
    integers. The items are taken in blocks of about ``block_chars`` characters; up to
    ``blocks`` of them go to the tasks together, and the documents are read once for these.
    More items take further passes over the documents, so the memory of a task stays bounded
    whatever their number; documents are never shuffled. Rows with a NULL id or text don't count;
    repeated document rows give one result row; texts shorter than a passage can't match.
    """
    chosen = items.select(F.col(item_id_col).cast("long").alias("id"), F.col(item_text_col).alias("text")).dropna().distinct()
    rows = documents.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).dropna()
    passes: list[DataFrame] = []
    indexes: list[Index] = []
    block, size = [], 0

    def search() -> None:
        """One pass over the documents for the blocks so far."""
        passes.append(rows.mapInPandas(_finder(list(indexes), 2_000_000), "id bigint, item_id bigint"))
        indexes.clear()

    for r in chosen.toLocalIterator():
        block.append((r["id"], r["text"]))
        size += len(r["text"])
        if size >= block_chars:
            indexes.append(Index(block, passage, replaced, miss))
            block, size = [], 0
            if len(indexes) == blocks:
                search()
    if block or not passes and not indexes:
        indexes.append(Index(block, passage, replaced, miss))
    if indexes:
        search()
    return reduce(DataFrame.unionByName, passes).distinct()
