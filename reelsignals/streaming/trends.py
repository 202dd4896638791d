"""Trend streams: sources, sinks, super trends, windowed and running scores, velocity."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import signals as T
from .ordered import ordered_fold_stream


def file_stream(spark: SparkSession, path: str, schema, fmt: str = "parquet", glob: str | None = None, files_per_trigger: int = 64) -> DataFrame:
    r = spark.readStream.schema(schema).format(fmt).option("maxFilesPerTrigger", files_per_trigger)
    return (r.option("pathGlobFilter", glob) if glob else r).load(path)


def kafka_stream(spark: SparkSession, servers: str, topic: str, schema: str) -> DataFrame:
    """Events appended from now on; the checkpoint, not memory, holds the position."""
    raw = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).option("startingOffsets", "latest").load()
    return raw.select(F.from_json(F.col("value").cast("string"), schema).alias("e")).select("e.*")


def append_sink(df: DataFrame, path: str, checkpoint: str, fmt: str = "parquet", once: bool = True) -> StreamingQuery:
    w = df.writeStream.outputMode("append").format(fmt).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w).start(path)


def deduplicated(events: DataFrame, key: str = "event_id", ts: str = "ts", late: str = "10 minutes") -> DataFrame:
    """Each event once, also after a replay, with state bounded by the watermark."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


def super_trend_stream(events: DataFrame, threshold: float = 1.5) -> DataFrame:
    return T.super_trends(events, threshold)


def hourly_stats_stream(events: DataFrame, late: str = "1 hour") -> DataFrame:
    return T.hourly_platform_stats(events.withWatermark("ts", late))


def running_scores(spark: SparkSession, events: DataFrame, out: str, state: str, checkpoint: str) -> StreamingQuery:
    """z-score of each event against all earlier micro-batches of its platform.

    A stateful operator per platform would send a hot platform to one task. Here a
    batch is aggregated with map-side combine, the moments (one row per platform)
    are merged and written under the batch number, so a rerun gives the same files.
    """
    shape = "platform string, n bigint, mean double, m2 double"
    of_platform = Window.partitionBy("platform")

    def step(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        old = spark.read.schema(shape).parquet(f"{state}/{number - 1}") if number > 0 else spark.createDataFrame([], shape)
        std = F.sqrt(F.col("m2") / F.col("n"))
        scored = batch.join(old, "platform", "left").withColumn("z", F.coalesce(F.try_divide(F.col("velocity") - F.col("mean"), std), F.lit(0.0)))
        scored.drop("n", "mean", "m2").write.mode("overwrite").parquet(f"{out}/batch={number}")
        new = batch.groupBy("platform").agg(F.count("velocity").alias("n"), F.coalesce(F.avg("velocity"), F.lit(0.0)).alias("mean"),
                                            F.coalesce(F.var_pop("velocity") * F.count("velocity"), F.lit(0.0)).alias("m2"))
        # two rows per platform at most; squares of distances to the common mean, so nothing cancels
        both = old.unionByName(new).withColumn("all", F.sum("n").over(of_platform))
        both = both.withColumn("centre", F.coalesce(F.try_divide(F.sum(F.col("n") * F.col("mean")).over(of_platform), F.col("all")), F.lit(0.0)))
        far = F.col("mean") - F.col("centre")
        total = both.groupBy("platform").agg(F.max("all").alias("n"), F.max("centre").alias("mean"), F.sum(F.col("m2") + F.col("n") * far * far).alias("m2"))
        total.write.mode("overwrite").parquet(f"{state}/{number}")
        batch.unpersist()

    return events.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


VELOCITY = "video_id bigint, poll_id bigint, views_per_hour double, acceleration double"


class Acceleration:
    """Change of views per hour against the poll before; 0 for the first."""

    def __init__(self):
        self.last = None

    def step(self, row) -> list[tuple]:
        change = 0.0 if self.last is None or row.views_per_hour is None else row.views_per_hour - self.last
        self.last = row.views_per_hour
        return [(row.poll_id, row.views_per_hour, change)]

    def dump(self) -> str:
        return json.dumps(self.last)

    def load(self, text: str):
        self.last = json.loads(text)
        return self


def acceleration_stream(polls: DataFrame, ttl: str = "7 days", late: str = "1 day") -> DataFrame:
    """Acceleration against the last snapshot of the same video, polls in any order up to ``late``.

    A poll that comes later has no values and ``late`` set. The snapshot is state that ends ``ttl`` of event time
    after the last poll. ``polls``: video_id, poll_id (rising in time), poll_ts (timestamp), views_per_hour.
    """
    return ordered_fold_stream(polls.select("video_id", "poll_id", "views_per_hour", "poll_ts"), ["video_id"], "poll_ts", "poll_id", Acceleration, VELOCITY, late, ttl)
