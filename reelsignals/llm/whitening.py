"""Operator 12: whitening of embeddings with MLlib's BlockMatrix.

Components become whole numbers first, so that counts, sums and deviations are exact. The rows
are numbered densely from the counts of the scan's partitions and centred: n * x - S is exact
and is divided once. Indexed rows go into distributed blocks; transpose times itself gives the
scatter matrix, its middle dimension cut so that a task multiplies ``BLOCKS`` blocks and one small
product leaves it. The dim x dim matrix is the only thing the driver gets; its eigenvectors, scaled,
are multiplied from the right to project all rows, and the same product checks the result.
"""

from __future__ import annotations

import numpy as np
from pyspark import StorageLevel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import DenseMatrix
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import stored

ROWS = 1024
BLOCKS = 16
LONG = 2**63


def whole_rows(table: DataFrame, factor: int, shift: int) -> DataFrame:
    """(vec_id, x: array<long>) of vectors that hold only finite components, of the commonest length (ties to the longer one)."""
    v = F.col("embedding").cast("array<double>")
    good = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = table.select("vec_id", v.alias("v")).where(F.size("v") > 0).where(good)
    common = rows.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    rows = rows.where(F.size("v") == (common["dim"] if common else 0))
    return rows.select("vec_id", F.transform("v", lambda c: F.floor(c * factor).cast("long") + shift).alias("x"))


def numbered(rows: DataFrame) -> DataFrame:
    """``rows``, written, with a dense row number ``at`` from 0: the place in the written part after the counts of the parts before."""
    rows = stored(rows.withColumn("place", F.monotonically_increasing_id())).withColumn("part", F.shiftright("place", 33))
    counts = rows.groupBy("part").count()
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))
    return rows.join(starts, "part").withColumn("at", F.col("start") + F.col("place").bitwiseAND(2**33 - 1)).drop("part", "start", "place")


def block_matrix(rows: DataFrame, column: str, dim: int) -> BlockMatrix:
    """The distributed blocks of the array column, by the row number ``at``."""
    vectors = rows.select(F.col("at").alias("index"), array_to_vector(column).alias("vector"))
    return IndexedRowMatrix(MLUtils.convertVectorColumnsFromML(vectors, "vector")).toBlockMatrix(ROWS, dim).persist(StorageLevel.DISK_ONLY)


def dropped(blocks: BlockMatrix) -> None:
    """Give back the disk of a ``block_matrix``."""
    blocks._java_matrix_wrapper._java_model.blocks().unpersist(False)


def scatter(blocks: BlockMatrix, n: int) -> np.ndarray:
    """Transpose times itself; the middle dimension is dealt to tasks of ``BLOCKS`` blocks."""
    left, right = blocks.transpose(), blocks
    splits = max(1, -(-n // (ROWS * BLOCKS)))
    product = left._java_matrix_wrapper.call("multiply", right._java_matrix_wrapper._java_model, splits)
    return BlockMatrix(product, left.rowsPerBlock, right.colsPerBlock).toLocalMatrix().toArray()


def projected(spark: SparkSession, blocks: BlockMatrix, weights: np.ndarray) -> DataFrame:
    """(at, z: array<double>): the rows of ``blocks`` times ``weights``."""
    dim, k = weights.shape
    local = DenseMatrix(dim, k, weights.ravel(order="F"))
    right = BlockMatrix(spark.sparkContext.parallelize([((0, 0), local)], 1), dim, k)
    rows = callMLlibFunc("getIndexedRows", blocks.multiply(right).toIndexedRowMatrix()._java_matrix_wrapper._java_model)
    return rows.select(F.col("index").alias("at"), vector_to_array(F.col("vector")).alias("z"))


def sums(rows: DataFrame, column: str, dim: int):
    """Count, and per dimension sum, least and greatest entry."""
    each = [f(F.get(column, F.lit(i))) for i in range(dim) for f in (F.sum, F.min, F.max)]
    row = rows.agg(F.count("*"), *each).first()
    return row[0], [row[1 + 3 * i : 4 + 3 * i] for i in range(dim)]


def whiten(table: DataFrame, components: int = 8, factor: int = 1024, shift: int = 100_000) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: one row for every vector and
    component up to ``components``, or as many as the vectors have dimensions.

    Vectors that are null or empty or hold null or non-finite entries are dropped, as are those
    of another length than the commonest. Rows without an id and repeated rows count as any other. A
    component without variance (vectors that are all equal, fewer vectors than dimensions) has a null ``whitened``,
    and ``explained`` is null where nothing varies; ``identity_error`` covers the other components, and is null
    without any. A deviation beyond 64 bits is null. An empty table gives no row; other columns are ignored.
    """
    spark = table.sparkSession
    raw = whole_rows(table, factor, shift)
    first = raw.first()
    kind = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if first is None:
        return spark.createDataFrame([], kind)
    dim = len(first["x"])
    rows = numbered(raw)
    n, stats = sums(rows, "x", dim)
    total = F.array(*[F.lit(s[0]).cast("long") for s in stats])
    off = F.zip_with("x", total, lambda x, s: x * n - s)
    most = max(max(abs(n * lo - s), abs(n * hi - s)) for s, lo, hi in stats)
    if dim * most * most < LONG:
        deviation = F.aggregate(off, F.lit(0).cast("long"), lambda a, d: a + d * d)
    else:
        deviation = F.aggregate(off, F.lit(0).cast("decimal(38,0)"), lambda a, d: (a + d.cast("decimal(19,0)") * d.cast("decimal(19,0)")).cast("decimal(38,0)")).try_cast("long")
    centred = rows.select("at", F.transform(off, lambda d: d / F.lit(float(n))).alias("c"))
    blocks = block_matrix(centred, "c", dim)
    values, vectors = np.linalg.eigh(scatter(blocks, n) / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    k = min(components, dim)
    alive = int((values[:k] > max(values[0], 0) * dim * np.finfo(float).eps).sum())
    error = None
    if alive:
        z = stored(projected(spark, blocks, vectors[:, :alive] / np.sqrt(values[:alive])))
        means = [s[0] / n for s in sums(z, "z", alive)[1]]
        again = z.select("at", F.zip_with("z", F.array(*map(F.lit, means)), lambda a, m: a - m).alias("c"))
        checked = block_matrix(again, "c", alive)
        error = float(np.abs(scatter(checked, n) / n - np.eye(alive)).max())
        dropped(checked)
        rows = rows.join(z, "at")
    else:
        rows = rows.withColumn("z", F.array().cast("array<double>"))
    dropped(blocks)
    trace = float(values.sum())
    share = [float(v) / trace if alive else None for v in values[:k]]
    each = F.transform(F.array(*[F.lit(v).cast("double") for v in share]), lambda e, i: F.struct((i + 1).alias("component"), F.get("z", i).alias("whitened"), e.alias("explained")))
    out = rows.select("vec_id", deviation.alias("deviation"), F.explode(each).alias("e"))
    return out.select("vec_id", "e.component", F.lit(n).cast("long").alias("n"), "deviation", "e.whitened", "e.explained", F.lit(error).cast("double").alias("identity_error"))
