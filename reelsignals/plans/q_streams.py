"""Streaming queries, run to the end of the given tables and compared with their batch twins."""

import uuid

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import edl as E
from ..operators import folds
from ..operators import runs as N
from ..operators import signals as T
from ..operators import tracks as K
from ..operators import transcripts as W
from ..session import checkpoint_root
from ..sources import sinks
from ..streaming import progress as GP
from ..streaming import smoothing as GS
from ..streaming import trends as GT
from . import fixtures as X
from .q_runs import _PROGRESS
from .q_signals import _HOURLY, _SUPER
from .q_tracks import BAND, BOX_EMA, CAMERA, LOCK, LOCK_FPS, camera_frames, lock_lengths, main_points, points, spine
from .registry import query


def _room(spark) -> str:
    return f"{checkpoint_root(spark)}/streams/{uuid.uuid4().hex}"


def raw_events(spark, d):
    return GT.file_stream(spark, d, X.table(spark, d, "events").schema, glob="events.parquet")


def settle(spark, stream, mode="append", ids=None):
    """Run a stream to its end and read back what it wrote.

    In update mode each micro-batch goes to its own folder and ``ids`` picks the latest row.
    """
    room = _room(spark)
    if mode == "append":
        GT.append_sink(stream, f"{room}/out", f"{room}/ckpt").awaitTermination()
        return spark.read.schema(stream.schema).parquet(f"{room}/out")

    def keep(batch, number):
        batch.write.mode("overwrite").parquet(f"{room}/out/batch={number}")

    stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{room}/ckpt").trigger(availableNow=True).start().awaitTermination()
    d = spark.read.parquet(f"{room}/out")
    rest = [c for c in stream.columns if c not in ids]
    return d.groupBy(*ids).agg(F.max_by(F.struct(*rest), "batch").alias("r")).select(*ids, "r.*")


@query("t01_super_trends_stream", _SUPER)
def _(spark, d):
    s = GT.super_trend_stream(X.signals(spark, d, raw_events(spark, d)))
    return settle(spark, s.select("arrival_idx", "title", "platform", "score"))


T02_PARTS = 4


@query("t02_running_scores_stream", """SELECT s.arrival_idx, coalesce(round(CASE WHEN p.std > 0 THEN (s.velocity - p.mean) / p.std END, 6), 0e0) AS z FROM f_signals s
  LEFT JOIN (SELECT b.part, platform, avg(velocity) AS mean, stddev_pop(velocity) AS std FROM f_signals, (VALUES (1), (2), (3)) AS b(part) WHERE arrival_idx % 4 < b.part GROUP BY 1, 2) p
  ON p.part = s.arrival_idx % 4 AND p.platform = s.platform""")
def _(spark, d):
    # the signals arrive in four parts; the stream is stopped and resumed between them
    room = _room(spark)
    s = X.signals(spark, d).select("arrival_idx", "platform", "velocity")
    for part in range(T02_PARTS):
        s.where(F.col("arrival_idx") % T02_PARTS == part).write.mode("append").parquet(f"{room}/in")
        stream = GT.file_stream(spark, f"{room}/in", s.schema, files_per_trigger=1_000_000)
        GT.running_scores(spark, stream, f"{room}/out", f"{room}/state", f"{room}/ckpt").awaitTermination()
    return spark.read.parquet(f"{room}/out").select("arrival_idx", F.round("z", 6).alias("z"))


@query("t02_hourly_stats_stream", _HOURLY)
def _(spark, d):
    s = X.signals(spark, d, raw_events(spark, d))
    s = GT.hourly_stats_stream(s.withColumn("ts", F.col("ts").cast("timestamp")))
    start = F.floor(S.ntz_micros(F.col("window.start").cast("timestamp_ntz")) / 1_000_000)
    stats = settle(spark, s.select("platform", start.alias("hour_start"), "n", "mean", "std"), "update", ["platform", "hour_start"])
    return stats.select("platform", "hour_start", "n", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


def shuffled_files(spark, rows, tick, parts=3):
    """Write ``rows`` in ``parts`` files that hold rows of any time, then ``tick``, whose time is past all others."""
    room = _room(spark)
    rows.repartition(parts, F.xxhash64(*rows.columns[:3])).write.parquet(f"{room}/rows")
    tick.coalesce(1).write.mode("append").parquet(f"{room}/rows")
    return f"{room}/rows"


@query("t03_acceleration_stream", "SELECT poll_id, video_id, round(accel, 6) AS acceleration FROM f_polls_s")
def _(spark, d):
    polls = T.add_velocity(X.video_polls(spark, d), S.ntz_micros("poll_ts")).select(
        "video_id", "poll_id", F.col("poll_ts").cast("timestamp").alias("poll_ts"), "views_per_hour")
    # one file a batch, in no order; the last poll of all closes the clock
    tick = polls.agg((F.max("poll_ts") + F.expr("INTERVAL '500' DAY")).alias("poll_ts")).select(
        F.lit(-1).cast("bigint").alias("video_id"), F.lit(-1).cast("bigint").alias("poll_id"), "poll_ts", F.lit(0.0).alias("views_per_hour"))
    path = shuffled_files(spark, polls, tick)
    s = GT.acceleration_stream(GT.file_stream(spark, path, polls.schema, files_per_trigger=1), ttl="900 days", late="490 days")
    return settle(spark, s).where("video_id >= 0 AND NOT late").select("poll_id", "video_id", F.round("acceleration", 6).alias("acceleration"))


def progress(spark, d):
    e = X.progress_events(spark, d, raw_events(spark, d))
    line = N.log_lines(e.withColumns({"step": F.lit("s"), "error": F.lit("e")}))
    return line.select("run_id", "seq", "type", "stage", "current", "total", "line")


@query("t04_progress_stream", _PROGRESS)
def _(spark, d):
    out = settle(spark, GP.rollup_stream(progress(spark, d)), "update", ["run_id"])
    return out.withColumn("overall_pct", F.round("overall_pct", 6)).drop("log", "errors")


@query("t04_progress_log_stream", """SELECT run_id, coalesce(string_agg(line, chr(10) ORDER BY seq) FILTER (WHERE age <= 100), '') AS log, coalesce(string_agg(line, chr(10) ORDER BY seq) FILTER (WHERE type = 'error' AND nth <= 100), '') AS errors
  FROM (SELECT *, row_number() OVER (PARTITION BY run_id, type ORDER BY seq DESC) AS nth FROM f_loglines) GROUP BY 1""")
def _(spark, d):
    out = settle(spark, GP.rollup_stream(progress(spark, d)), "update", ["run_id"])
    return out.select("run_id", F.array_join("log", "\n").alias("log"), F.array_join("errors", "\n").alias("errors"))


def fold_files(spark, rows, keys, make, schema):
    """Write ``rows`` as files that hold frames of any time, and a last frame of all, then fold them as a stream."""
    last = rows.agg(F.max("frame_idx").alias("n")).select(*[
        (F.col("n") + 100_000).cast(f.dataType).alias(f.name) if f.name == "frame_idx" else F.lit(-999_999).cast(f.dataType).alias(f.name) if f.name in keys else F.lit(None).cast(f.dataType).alias(f.name)
        for f in rows.schema])
    path = shuffled_files(spark, rows, last)
    s = GS.fold_stream(GT.file_stream(spark, path, rows.schema, files_per_trigger=1), keys, "frame_idx", make, schema, late="3000 seconds")
    return settle(spark, s).where((F.col(keys[0]) != -999_999) & ~F.col("late")).drop("late")


@query("t06_box_smoothing_stream", BOX_EMA)
def _(spark, d):
    p = points(spark, d).select("media_id", "track_id", "frame_idx", "cx", "cy", "w", "h")
    return fold_files(spark, p, K.KEYS, lambda: folds.DeadZoneEma(1920, 1080), "media_id bigint, track_id int, frame_idx int, cx int, cy int, w int, h int")


@query("t06_target_lock_stream", LOCK)
def _(spark, d):
    frames = K.boxes_by_frame(X.detections(spark, d), lock_lengths(spark, d))
    return fold_files(spark, frames, ["media_id"], lambda: folds.TargetLock(LOCK_FPS), "media_id bigint, frame_idx int, state string, target int")


@query("t06_dead_band_stream", BAND)
def _(spark, d):
    return fold_files(spark, K.look_ahead_start(spine(spark, d), main_points(spark, d)).select("media_id", "frame_idx", "target_cx", "target_cy", "init_x", "init_y"),
                      ["media_id"], lambda: folds.DeadBand(1920, 1080), "media_id bigint, frame_idx int, x int, y int")


@query("t06_camera_stream", CAMERA)
def _(spark, d):
    smooth = fold_files(spark, K.camera_signals(camera_frames(spark, d)), K.CAMERA_KEYS, K.camera_filter, K.CAMERA_ROWS)
    return K.crop_windows(smooth).select("media_id", "frame_idx", "crop_x", "crop_y", "out_w", "out_h")


@query("t07_deduplicated_stream", "SELECT event_id, user_id FROM f_ev")
def _(spark, d):
    room = _room(spark)
    e = X.table(spark, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id")
    e.union(e).write.parquet(f"{room}/twice")
    s = GT.deduplicated(GT.file_stream(spark, f"{room}/twice", e.schema, files_per_trigger=1000), late="60 days")
    return settle(spark, s).select("event_id", "user_id")


@query("s05_event_stream_source", "SELECT event_id, user_id, event_type FROM f_ev")
def _(spark, d):
    return settle(spark, raw_events(spark, d).select("event_id", "user_id", "event_type"))


@query("s06_normalized_stream_sink", """SELECT title AS query, (velocity - 0.5e0) / 0.2e0 * CASE platform WHEN 'tiktok' THEN 1.2e0 ELSE 1e0 END AS score, platform AS original_source FROM f_signals
  WHERE (velocity - 0.5e0) / 0.2e0 * CASE platform WHEN 'tiktok' THEN 1.2e0 ELSE 1e0 END > 1.5e0""")
def _(spark, d):
    s = GT.super_trend_stream(X.signals(spark, d, raw_events(spark, d)))
    return settle(spark, s.select(F.col("title").alias("query"), "score", F.col("platform").alias("original_source")))


@query("s16_json_sink", "SELECT media_id, moment_idx, start_time, source_end, output_duration FROM f_clamped")
def _(spark, d):
    path = f"{_room(spark)}/edl"
    edl = E.clamp_moments(X.moments(spark, d)).select("media_id", "moment_idx", "start_time", "source_end", "output_duration")
    sinks.write_json(edl, path)
    return spark.read.schema(edl.schema).json(path)


@query("s15_caption_file_sink", """SELECT media_id AS clip, line_idx, CAST(line_idx + 1 AS VARCHAR) || ' ' || text AS line FROM f_lines3""")
def _(spark, d):
    path = f"{_room(spark)}/captions"
    lines = W.fixed_groups(X.conv_words(spark, d), 3).select(
        "media_id", "line_idx", F.concat((F.col("line_idx") + 1).cast("string"), F.lit(" "), "text").alias("line"))
    sinks.write_caption_files(lines, path, "media_id", "line_idx", "line")
    back = spark.read.text(path)
    number = F.regexp_extract("value", "^([0-9]+) ", 1).cast("bigint")
    return back.select(F.col("clip").cast("bigint").alias("clip"), (number - 1).alias("line_idx"), F.col("value").alias("line"))


_STALLED = """SELECT run_id, max(seq) AS last_seq FROM f_progress GROUP BY 1 HAVING max(ts) < (SELECT max(ts) FROM f_progress) - INTERVAL 6 HOUR
  AND arg_max(type || '/' || stage, seq) <> 'stage_complete/Quality Assurance'"""


@query("t05_stalled_runs", _STALLED)
def _(spark, d):
    return GP.stalled_runs(X.progress_events(spark, d), F.expr("INTERVAL '6' HOUR"))


@query("t05_watchdog_stream", _STALLED)
def _(spark, d):
    e = X.progress_events(spark, d, raw_events(spark, d))
    return settle(spark, GP.silence_stream(e.select("run_id", "seq", F.col("ts").cast("timestamp").alias("ts"), "type", "stage"), "6 hours"))
