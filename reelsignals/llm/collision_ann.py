"""Operator 6: nearest neighbours by collision counting.

Vectors are scaled to length 1, where nearness by cosine is nearness by distance. The index
of a block is ``PROJECTIONS`` sorted arrays, each of all vectors projected on one random
direction. A query's own projection is the centre of a window in each array; virtual
rehashing widens all windows by ``GROWTH`` a round. A vector found in ``THRESHOLD`` windows
is verified with its exact cosine. The widening ends when ``SHARE`` of the block's vectors
(and k at least) pass the threshold, or when the windows hold everything.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tiles import search, top, usable

PROJECTIONS = 64
THRESHOLD = 0.8
SHARE = 0.03
GROWTH = 1.12
FIRST_WIDTH = 0.13
SEED = 7


def directions(dim: int) -> np.ndarray:
    """Random directions, orthogonal as far as the dimension allows."""
    rng = np.random.default_rng(SEED)
    blocks = [np.linalg.qr(rng.standard_normal((dim, dim)))[0] for _ in range(-(-PROJECTIONS // dim))]
    return np.concatenate(blocks, axis=1)[:, :PROJECTIONS]


def _scaled(v: np.ndarray) -> np.ndarray:
    """Rows brought near 1 by powers of two, which changes no cosine."""
    return np.ldexp(v, -np.frexp(np.abs(v).max(axis=1, keepdims=True))[1])


def _norms(v: np.ndarray) -> np.ndarray:
    return np.sqrt((v * v).sum(axis=1))


def collision_search(qid, queries, vid, vectors, k):
    n = len(vectors)
    queries, vectors = _scaled(queries), _scaled(vectors)
    q_norm, v_norm = _norms(queries), _norms(vectors)
    a = directions(vectors.shape[1])
    projected = ((vectors / v_norm[:, None]) @ a).T
    order = np.argsort(projected, axis=1)
    arrays = np.take_along_axis(projected, order, axis=1)
    centres = ((queries / q_norm[:, None]) @ a).T
    need, enough = int(np.ceil(THRESHOLD * PROJECTIONS)), max(k, int(SHARE * n))
    widths = FIRST_WIDTH * GROWTH ** np.arange(int(np.ceil(np.log(2 / FIRST_WIDTH) / np.log(GROWTH))) + 1)
    low = np.stack([np.searchsorted(x, c[None, :] - widths[:, None], "left") for x, c in zip(arrays, centres)])
    high = np.stack([np.searchsorted(x, c[None, :] + widths[:, None], "right") for x, c in zip(arrays, centres)])
    out_q, out_v, out_s = [], [], []
    for j, name in enumerate(qid):
        counts = np.zeros(n, np.int64)
        found = np.zeros(0, np.int64)
        left = right = low[:, 0, j]
        for r in range(len(widths)):
            lo, hi = low[:, r, j], high[:, r, j]
            new = [order[i, x:y] for i, (x, y) in enumerate(zip(lo, left))] + [order[i, x:y] for i, (x, y) in enumerate(zip(right, hi))]
            counts += np.bincount(np.concatenate(new), minlength=n)
            left, right = lo, hi
            found = np.flatnonzero(counts >= need)
            found = found[vid[found] != name]
            if len(found) >= enough:
                break
        else:
            found = np.flatnonzero(vid != name)
        scores = vectors[found] @ queries[j] / v_norm[found]
        found = found[top(vid[found], scores, 4 * k)]
        scores = (vectors[found] * queries[j]).sum(axis=1) / (v_norm[found] * q_norm[j])
        best = top(vid[found], scores, k)
        out_q.append(np.full(len(best), name))
        out_v.append(vid[found][best])
        out_s.append(scores[best])
    return np.concatenate(out_q), np.concatenate(out_v), np.concatenate(out_s)


def approximate_neighbours(table: DataFrame, every: int = 50, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score (cosine) for the rows whose vec_id is divisible by ``every``.

    Vectors null, empty, zero, or with null or non-finite components take no part, nor do
    rows without an id; vectors of different lengths are never compared. Rows that repeat
    an id are separate candidates. An empty table gives no row; other columns are ignored.
    """
    rows = usable(table, nonzero=True)
    out = search(rows.where(F.col("vec_id") % every == 0), rows, k, collision_search, "double")
    return out.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
