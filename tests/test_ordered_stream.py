"""Streams with buffers and timers: order restored, late rows reported, silent runs told."""

import datetime as dt
import uuid

from pyspark.sql import functions as F

from reelsignals.operators import folds
from reelsignals.streaming import progress as GP
from reelsignals.streaming import smoothing as GS
from reelsignals.streaming import trends as GT

START = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


def run(spark, tmp_path, stream, mode="append"):
    room = tmp_path / uuid.uuid4().hex
    GT.append_sink(stream, str(room / "out"), str(room / "ckpt")).awaitTermination()
    return spark.read.schema(stream.schema).parquet(str(room / "out")).collect()


def arriving(spark, tmp_path, schema, *batches):
    """A stream of one file a batch, in the given order."""
    import os
    import time

    folder = tmp_path / uuid.uuid4().hex
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(folder / f"b={i}"))
        for f in (folder / f"b={i}").glob("*.parquet"):
            os.utime(f, (time.time() - 1000 + i, time.time() - 1000 + i))
    return GT.file_stream(spark, str(folder / "*"), schema, files_per_trigger=1)


def poll(video, n, hour, vph):
    return (video, n, START + dt.timedelta(hours=hour), vph)


def test_polls_out_of_order_and_too_late(spark, tmp_path):
    kind = spark.createDataFrame([], "video_id bigint, poll_id bigint, poll_ts timestamp, views_per_hour double").schema
    s = arriving(spark, tmp_path, kind,
                 [poll(1, 3, 3, 30.0), poll(1, 1, 1, 10.0)],
                 [poll(1, 2, 2, 14.0), poll(2, 9, 5, 7.0)],
                 [poll(1, 5, 30, 90.0)],
                 [poll(1, 4, 20, 50.0)],
                 [poll(9, 100, 900, 0.0)])
    got = sorted(tuple(r) for r in run(spark, tmp_path, GT.acceleration_stream(s, ttl="100 days", late="6 hours")) if r.video_id < 9)
    assert got == [(1, 1, 10.0, 0.0, False), (1, 2, 14.0, 4.0, False), (1, 3, 30.0, 16.0, False), (1, 4, 50.0, 20.0, False), (1, 5, 90.0, 40.0, False), (2, 9, 7.0, 0.0, False)]
    # poll 4 comes after poll 5 was folded
    s = arriving(spark, tmp_path, kind, [poll(1, 1, 1, 10.0)], [poll(1, 5, 9, 90.0)], [poll(9, 8, 16, 0.0)], [poll(9, 9, 17, 0.0)], [poll(1, 4, 5.5, 50.0)], [poll(9, 99, 900, 0.0)])
    got = sorted(tuple(r) for r in run(spark, tmp_path, GT.acceleration_stream(s, ttl="100 days", late="6 hours")) if r.video_id < 9)
    assert got == [(1, 1, 10.0, 0.0, False), (1, 4, None, None, True), (1, 5, 90.0, 80.0, False)]


def test_shuffled_frames_give_the_batch_result(spark, tmp_path):
    rows = [(1, f, 500 + f * 37 % 400, 300 + f * 11 % 300, 960, 540) for f in range(60)]
    kind = spark.createDataFrame(rows, "media_id bigint, frame_idx int, target_cx int, target_cy int, init_x int, init_y int").schema
    s = arriving(spark, tmp_path, kind, rows[40:], rows[:20] + [(7, 20_000, None, None, 0, 0)], rows[20:40], [(7, 90_000, None, None, 0, 0)])
    make = lambda: folds.DeadBand()
    got = sorted((r.frame_idx, r.x, r.y) for r in run(spark, tmp_path, GS.fold_stream(s, ["media_id"], "frame_idx", make, "media_id bigint, frame_idx int, x int, y int", late="1000 seconds")) if r.media_id == 1)
    whole = folds.sorted_fold(spark.createDataFrame(rows, kind), ["media_id"], ["frame_idx"], make, "media_id bigint, frame_idx int, x int, y int")
    assert got == sorted((r.frame_idx, r.x, r.y) for r in whole.collect())


def test_keys_of_one_bucket_stay_apart(spark, tmp_path):
    from reelsignals.streaming import ordered as GO

    rows = [(m, f, None if (m or 0) + f == 9 else 500 + f * 37 * (m or 1) % 400, 300, 960, 540) for m in (None, 1, 2, 3) for f in range(40)]
    schema = "media_id bigint, frame_idx int, target_cx int, target_cy int, init_x int, init_y int"
    kind = spark.createDataFrame(rows, schema).schema
    ticks = [(8, 30_000, None, None, 0, 0), (8, 31_000, None, None, 0, 0), (8, 90_000, None, None, 0, 0)]
    late = (1, 3, 9, 9, 0, 0)
    s = arriving(spark, tmp_path, kind, rows[1::2], rows[::2], [ticks[0]], [ticks[1]], [late], [ticks[2]])
    s = s.withColumn("ts", F.timestamp_seconds(F.lit(1e9) + F.col("frame_idx") / 30))
    out = GO.ordered_fold_stream(s, ["media_id"], "ts", "frame_idx", lambda: folds.DeadBand(), "media_id bigint, frame_idx int, x int, y int", late="900 seconds", buckets=1)
    got = [tuple(r) for r in run(spark, tmp_path, out) if r.media_id != 8]
    assert [r for r in got if r[4]] == [(1, 3, None, None, True)]
    want = []
    for m in (None, 1, 2, 3):
        whole = folds.sorted_fold(spark.createDataFrame([r for r in rows if r[0] == m], kind).fillna({"media_id": -1}), ["media_id"], ["frame_idx"], lambda: folds.DeadBand(), "media_id bigint, frame_idx int, x int, y int")
        want += [(m, r.frame_idx, r.x, r.y, False) for r in whole.collect()]
    order = lambda r: (r[0] or -1, r[1])
    assert sorted((r for r in got if not r[4]), key=order) == sorted(want, key=order)


def test_silent_runs_are_told(spark, tmp_path):
    at = lambda m: START + dt.timedelta(minutes=m)
    kind = spark.createDataFrame([], "run_id bigint, seq bigint, ts timestamp, type string, stage string").schema
    s = arriving(spark, tmp_path, kind, [(1, 1, at(0), "step", "Editing"), (2, 2, at(1), "step", "Editing"), (3, 3, at(1), "step", "Editing")],
                 [(2, 4, at(50), "step", "Editing"), (3, 5, at(30), "stage_complete", "Quality Assurance")], [(2, 6, at(100), "step", "Editing")])
    assert [tuple(r) for r in run(spark, tmp_path, GP.silence_stream(s, "60 minutes"))] == [(1, 1)]


def test_log_is_bounded():
    state = GP.RunState(3)
    for i in range(9):
        state.apply("error" if i % 2 else "step", "Editing", i, 10, f"l{i}")
    assert state.log == ["l6", "l7", "l8"] and state.failures == ["l3", "l5", "l7"] and state.errors == 4
