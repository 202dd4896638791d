"""Operator 1: exact top-k by inner product with the threshold algorithm.

In every block the vectors have one sorted list per dimension. A query reads all lists from
its favourable end (largest values for a positive component, smallest for a negative one),
each batch of depths twice as deep as the one before. New vectors are scored in full. No unseen
vector can beat the sum, over the dimensions, of the query's component times the last value
read; the search ends when this bound is below the kth score found (an equal bound goes
on, as an equal score may have a smaller id) or when all vectors are seen.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tiles import search, top, usable

FIRST_DEPTH = 64


def scaled(rows: DataFrame, factor: int = 256) -> DataFrame:
    return rows.withColumn("v", F.transform("v", lambda x: F.floor(x * factor).cast("double")))


def threshold_search(qid, queries, vid, vectors, k):
    """Exact integer scores: sums up to 2^53 in float64, else in Python integers modulo 2^64."""
    n, dim = vectors.shape
    exact = dim * float(np.abs(vectors).max()) * float(np.abs(queries).max()) < 2**53
    values, own = (vectors, queries) if exact else (vectors.astype(np.int64), queries.astype(np.int64))
    lists = np.argsort(values, axis=0, kind="stable").T.copy()
    ladder = np.take_along_axis(values.T, lists, axis=1)
    out_q, out_v, out_s = [], [], []
    for name, q in zip(qid, own):
        up, down = np.flatnonzero(q > 0), np.flatnonzero(q < 0)
        seen = np.zeros(n, bool)
        ids, scores = vid[:0], np.zeros(0, q.dtype)
        low, high = 0, min(n, FIRST_DEPTH)
        while True:
            if len(up) or len(down):
                fresh = np.zeros(n, bool)
                fresh[lists[up, n - high : n - low]] = True
                fresh[lists[down, low:high]] = True
                new = np.flatnonzero(fresh & ~seen)
                seen |= fresh
            else:
                new, high = np.arange(n), n
            new = new[vid[new] != name]
            ids, scores = np.r_[ids, vid[new]], np.r_[scores, values[new] @ q]
            best = top(ids, scores, k)
            ids, scores = ids[best], scores[best]
            if high >= n or seen.all():
                break
            bound = q[up] @ ladder[up, n - high] + q[down] @ ladder[down, high - 1]
            if len(scores) == k and bound < scores[-1]:
                break
            low, high = high, min(n, 2 * high)
        out_q.append(np.full(len(ids), name))
        out_v.append(ids)
        out_s.append(scores.astype(np.int64))
    return np.concatenate(out_q), np.concatenate(out_v), np.concatenate(out_s)


def exact_top_k(table: DataFrame, every: int = 50, k: int = 5, factor: int = 256) -> DataFrame:
    """query_id, rank, vec_id, score for the rows whose vec_id is divisible by ``every``.

    Vectors null, empty, or with null or non-finite components take no part, nor do rows
    without an id; vectors of different lengths are never compared. Rows that repeat an
    id are separate candidates. An empty table gives no row; other columns are ignored.
    """
    rows = scaled(usable(table), factor)
    out = search(rows.where(F.col("vec_id") % every == 0), rows, k, threshold_search, "long")
    return out.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
