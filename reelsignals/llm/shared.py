"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import contextlib
import ctypes
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_root

WORD = r"[^\x20\x09-\x0D]+"


def shared_root(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``. Only a local master may do without."""
    return checkpoint_root(spark)


def stored(df: DataFrame, rows_per_file: int = 0) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage, so that a
    lost executor costs the tasks it ran and nothing before them. ``rows_per_file`` (0: no bound)
    bounds what a reader holds of very large rows, as it takes thousands of a file's rows at once."""
    path = f"{shared_root(df.sparkSession)}/llm-{uuid.uuid4().hex}"
    with shuffles_dropped(df.sparkSession):
        df.write.option("maxRecordsPerFile", rows_per_file).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def shuffles_dropped(spark: SparkSession):
    """Shuffle files of the queries run inside go when the query ends. Nothing reads them again, but they would stay
    until the driver happens to collect its garbage, beside those of all steps that follow."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before) if before is not None else spark.conf.unset(CLEANUP)


def forget(df: DataFrame) -> None:
    """Delete the files of a ``stored`` table that nothing reads any more."""
    spark = df.sparkSession
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        if "/llm-" in folder:
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


BATCH_BYTES = 1 << 23


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, with Arrow batches to Python bounded to ``BATCH_BYTES`` in its session (results stay the same).

    A batch lies in the executor and in the worker at once, in buffers that double as they fill.
    """
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df


def release() -> None:
    """Give freed memory of this Python worker back to the system; a worker lives on from task to task."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


KEPT = {-3: 1 << 24, -1: 1 << 26, -2: 1 << 22}  # glibc's M_MMAP_THRESHOLD, M_TRIM_THRESHOLD, M_TOP_PAD


def keep_memory() -> bool:
    """Let this Python worker keep freed memory (64 MB of it at most at the heap's end) and use it again, until ``release``.

    Else each array of a few hundred kB is mapped anew, and its page faults cost more than the array's arithmetic.
    """
    try:
        libc = ctypes.CDLL("libc.so.6")
        return all([libc.mallopt(name, value) for name, value in KEPT.items()])
    except (OSError, AttributeError):  # another C library
        return False


def lean(run):
    """``run`` over a task's batches, with freed memory given back at the end."""

    def inner(batches):
        yield from run(batches)
        release()

    return inner


def with_uid(docs: DataFrame, name: str = "__uid") -> DataFrame:
    """A number for every row of a table scan, the same in each reading of the same files.

    Rows may share a doc_id or have none, so doc_id is not used to find a row again.
    """
    return docs.withColumn(name, F.monotonically_increasing_id())


def as_rows(table: DataFrame) -> DataFrame:
    """(__uid, row): the whole row as one struct, so that its column names clash with nothing."""
    return table.select(F.monotonically_increasing_id().alias("__uid"), F.struct("*").alias("row"))


def fold_of(doc_id: Column, folds: int) -> Column:
    """crc32 of the id's decimal text modulo ``folds``; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
