"""Batch sinks. Spark's commit protocol makes each write appear as a whole."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_caption_files(blocks: DataFrame, path: str, clip: str, order: str, text: str, mode: str = "overwrite") -> None:
    """Text files in one folder per clip, lines in order.

    Rows are range-partitioned by (clip, order), so a long clip is cut into several
    files whose names follow the order, and no clip is collected.
    """
    d = blocks.select(F.col(clip).alias("clip"), order, F.col(text).alias("value"))
    d = d.repartitionByRange("clip", order).sortWithinPartitions("clip", order)
    d.select("clip", "value").write.mode(mode).option("lineSep", "\n").partitionBy("clip").text(path)


def write_json(df: DataFrame, path: str, partition_by: list[str] | None = None, mode: str = "overwrite") -> None:
    """Briefs, transcripts, edit lists, plans, reports and run metadata as JSON lines."""
    w = df.write.mode(mode)
    (w.partitionBy(*partition_by) if partition_by else w).json(path)


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None, mode: str = "overwrite") -> None:
    w = df.write.mode(mode)
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)
