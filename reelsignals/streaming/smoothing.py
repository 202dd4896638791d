"""The batch folds of tracks on a frame stream, one state per key."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordered import ordered_fold_stream

#: Seconds of frame 0, so that no watermark lies before the epoch, where Spark keeps none.
CLOCK_START = 1_000_000_000.0


def fold_stream(frames: DataFrame, keys: Sequence[str], order: str, make: Callable[[], object], schema: str, fps: float = 30.0, late: str = "10 seconds", ttl: str = "1 day") -> DataFrame:
    """Run a fold class over the frames of each key on the clock of ``fps`` frames a second.

    Frames may come up to ``late`` of that clock out of order; one that comes later is reported (``late``), not folded.
    """
    at = F.timestamp_micros(((F.lit(CLOCK_START) + F.col(order).cast("double") / fps) * 1_000_000).cast("bigint"))
    return ordered_fold_stream(frames.withColumn("__ts", at), keys, "__ts", order, make, schema, late, ttl)
