"""Token vectors from random walks over a graph of records, attributes and tokens.

Two tokens of one record are linked through it; two records of different sources that
start in the same second of a recording are linked through their place. How often a walk
from one token, by way of any record or place, reaches another is a sum over all records
and is counted by Spark, so the walks themselves run on a graph of tokens, whose number is
fixed by hashing. Skip-gram vectors with negative samples are then trained on the walks.
"""

from __future__ import annotations

import numpy as np


def walks(a: np.ndarray, b: np.ndarray, weight: np.ndarray, size: int, per_token: int, length: int, rng: np.random.Generator) -> np.ndarray:
    """Walks over the symmetric weighted graph, one per row, ``per_token`` from each linked token."""
    src, dst, w = np.r_[a, b], np.r_[b, a], np.r_[weight, weight].astype(float)
    order = np.argsort(src, kind="stable")
    src, dst, w = src[order], dst[order], w[order]
    total = np.cumsum(w)
    first = np.searchsorted(src, np.arange(size), "left")
    end = np.searchsorted(src, np.arange(size), "right")
    before = np.r_[0.0, total]
    at = np.repeat(np.flatnonzero(end > first), per_token)
    path = np.empty((len(at), length), np.int64)
    for step in range(length):
        path[:, step] = at
        lo, hi = before[first[at]], before[end[at]]
        pick = np.searchsorted(total, lo + rng.random(len(at)) * (hi - lo), "right")
        at = dst[np.minimum(pick, end[at] - 1)]
    return path


def skip_gram(path: np.ndarray, size: int, dim: int, window: int, negatives: int, epochs: int, rng: np.random.Generator, rate: float = 0.1) -> np.ndarray:
    """Unit vectors (in plus out) of all tokens; tokens on no walk get zeros."""
    centre, context = [], []
    for k in range(1, window + 1):
        if k < path.shape[1]:
            centre += [path[:, :-k].ravel(), path[:, k:].ravel()]
            context += [path[:, k:].ravel(), path[:, :-k].ravel()]
    if not centre or not len(path):
        return np.zeros((size, dim), np.float32)
    centre, context = np.concatenate(centre), np.concatenate(context)
    seen = np.bincount(path.ravel(), minlength=size)
    noise = np.cumsum(seen**0.75)
    u = ((rng.random((size, dim)) - 0.5) / dim).astype(np.float32)
    v = np.zeros((size, dim), np.float32)
    batch = 2048
    for epoch in range(epochs):
        order = rng.permutation(len(centre))
        for i in range(0, len(order), batch):
            c, o = centre[order[i : i + batch]], context[order[i : i + batch]]
            neg = np.searchsorted(noise, rng.random((len(c), negatives)) * noise[-1], "right")
            targets = np.concatenate([o[:, None], neg], axis=1)
            truth = np.zeros(targets.shape, np.float32)
            truth[:, 0] = 1
            cu, tv = u[c], v[targets]
            score = 1 / (1 + np.exp(-np.clip(np.einsum("bd,bnd->bn", cu, tv), -8, 8)))
            step = ((truth - score) * rate * (1 - epoch / (epochs + 1))).astype(np.float32)
            # a token met k times in a batch moves by the sum over the root of k: steady for hubs
            for matrix, at, move in ((v, targets.ravel(), (step[:, :, None] * cu[:, None, :]).reshape(-1, dim)), (u, c, np.einsum("bn,bnd->bd", step, tv))):
                total = np.zeros_like(matrix)
                np.add.at(total, at, move)
                matrix += total / np.sqrt(np.maximum(np.bincount(at, minlength=size), 1))[:, None].astype(np.float32)
    out = u + v
    out[seen == 0] = 0
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return (out / np.where(norm == 0, 1, norm)).astype(np.float32)
