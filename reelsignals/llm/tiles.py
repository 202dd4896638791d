"""A stated query set against all vectors, in blocks.

Queries and vectors are dealt into blocks by a hash of their row; a task gets one block
of each kind, and only each query's best rows of a block leave it. Blocks are packed
before they are copied to the other side's blocks, so a copy is one row.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

VECTORS = 16384
QUERIES = 2048


def usable(table: DataFrame, nonzero: bool = False) -> DataFrame:
    """(vec_id, v: array<double>, dim) without null or empty vectors, those that hold null,
    infinite or not-a-number components, and rows without an id."""
    v = F.col("embedding").cast("array<double>")
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = table.select("vec_id", v.alias("v")).where(F.col("vec_id").isNotNull() & (F.size("v") > 0)).where(good)
    if nonzero:
        rows = rows.where(F.exists("v", lambda x: x != 0))
    return rows.withColumn("dim", F.size("v"))


def _packed(rows: DataFrame, size: int, spread: int) -> DataFrame:
    """One row per (dim, block, portion): the block's ids and components as bytes. Blocks have about ``size`` rows."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ids = pdf["vec_id"].to_numpy(np.int64)
        data = np.stack(pdf["v"].to_list()).astype(np.float64)
        return pd.DataFrame({"dim": pdf["dim"].iloc[:1], "block": pdf["block"].iloc[:1], "ids": [ids.tobytes()], "data": [data.tobytes()]})

    blocks = max(1, -(-rows.count() // size))
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks))).withColumn("portion", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(spread)))
    out = dealt.groupBy("dim", "block", "portion").applyInPandas(lambda p: run(p), "dim int, block long, ids binary, data binary")
    return out.withColumn("blocks", F.lit(blocks).cast("long"))


def search(queries: DataFrame, vectors: DataFrame, k: int, find: Callable, kind: str) -> DataFrame:
    """The ``k`` best (query_id, rank, vec_id, score) per query row.

    ``find(query_ids, queries, vec_ids, vectors, k)`` returns arrays (query, vec_id, score) of
    one pair of blocks, for vectors of one dimension. Repeated query rows give one answer;
    a row is no candidate of a query with its own id.
    """
    q = _packed(queries.dropDuplicates(["vec_id"]), QUERIES, 4)
    v = _packed(vectors, VECTORS, 16)
    qn, vn = q.select(F.max("blocks")).first()[0] or 1, v.select(F.max("blocks")).first()[0] or 1
    number = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    q = q.select("dim", F.col("block").alias("qb"), number(vn).alias("vb"), "ids", "data", F.lit(True).alias("is_query"))
    v = v.select("dim", number(qn).alias("qb"), F.col("block").alias("vb"), "ids", "data", F.lit(False).alias("is_query"))

    def unpack(pdf: pd.DataFrame, dim: int):
        ids = np.frombuffer(b"".join(pdf["ids"]), np.int64)
        return ids, np.frombuffer(b"".join(pdf["data"]), np.float64).reshape(len(ids), dim)

    def tile(pdf: pd.DataFrame) -> pd.DataFrame:
        dim, mine = int(pdf["dim"].iloc[0]), pdf["is_query"].to_numpy(bool)
        if mine.all() or not mine.any():
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        qid, qv = unpack(pdf[mine], dim)
        vid, vv = unpack(pdf[~mine], dim)
        order = np.argsort(vid, kind="stable")
        a, b, s = find(qid, qv, vid[order], vv[order], k)
        return pd.DataFrame({"query_id": a, "vec_id": b, "score": s})

    best = q.unionByName(v).groupBy("dim", "qb", "vb").applyInPandas(tile, f"query_id long, vec_id long, score {kind}")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def top(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores, ties to the smaller id; ``ids`` must be sorted or the ties few."""
    if len(scores) > 4 * k:
        bar = np.partition(scores, len(scores) - k)[len(scores) - k]
        some = np.flatnonzero(scores >= bar)
    else:
        some = np.arange(len(scores))
    return some[np.lexsort((ids[some], -scores[some]))[:k]]
