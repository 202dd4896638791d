"""Who speaks when: attribution joins, turns, totals, speech and motion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import intervals as I
from . import ordered as O
from .transcripts import ordered_text


def attribute_words(words: DataFrame, turns: DataFrame, key: str = "media_id", reach: float = 1.0,
                    default: str = "SPEAKER_00", width: float = 10.0) -> DataFrame:
    """Speaker with the greatest overlap; a gap below ``reach`` seconds still counts.

    ``turns`` has (key, turn_idx, speaker, t_start, t_end). Ties go to the first turn; repeated words stay.
    """
    overlap = F.least("end", "t_end") - F.greatest("start", "t_start")
    rank = F.when(F.col("turn_idx").isNotNull(), F.struct((-overlap).alias("o"), F.col("turn_idx").alias("t")))
    d = I.best_match(
        words, turns.select(key, "turn_idx", "speaker", "t_start", "t_end"), [key], (F.col("start"), F.col("end")),
        (F.col("t_start") - reach, F.col("t_end") + reach), overlap > -reach, width, "speaker", rank, "speaker")
    return d.withColumn("speaker", F.coalesce("speaker", F.lit(default)))


def speaker_at(points: DataFrame, turns: DataFrame, at: Column, key: str = "media_id", width: float = 10.0) -> DataFrame:
    """First turn that holds the instant (both ends inclusive), else null."""
    d = I.best_match(points.withColumn("__at", at), turns.select(key, "turn_idx", "speaker", "t_start", "t_end"), [key], (F.col("__at"), F.col("__at")),
                     (F.col("t_start"), F.col("t_end")), F.col("__at").between(F.col("t_start"), F.col("t_end")), width, "speaker", F.col("turn_idx"), "speaker")
    return d.drop("__at")


def merge_turns(words: DataFrame, key: str = "media_id") -> DataFrame:
    """Consecutive words of one speaker become one segment with its text."""
    d = O.islands(words, [key], "word_idx", F.col("speaker"), "seg_idx")
    return ordered_text(d, [key, "seg_idx", "speaker"], "word_idx", "word", "text",
                        {"start": ("start", F.min), "end": ("end", F.max)})


def speaking_time(segments: DataFrame, key: str = "media_id", start: str = "start", end: str = "end") -> DataFrame:
    """Seconds per speaker, rounded because a distributed sum has no fixed order."""
    return segments.groupBy(key, "speaker").agg(
        F.round(F.sum(F.col(end) - F.col(start)), 6).alias("seconds"), F.min(start).alias("first_start"))


def speaker_summary(totals: DataFrame, key: str = "media_id") -> DataFrame:
    """Number of speakers, the dominant one (first heard on ties) and all names."""
    return totals.groupBy(key).agg(
        F.count(F.lit(1)).alias("num_speakers"),
        F.min_by("speaker", F.struct((-F.col("seconds")).alias("s"), "first_start")).alias("dominant"),
        F.array_sort(F.collect_set("speaker")).alias("speakers"))


def reference_point(df_pose: str = "pose") -> Column:
    """Nose, else the middle of both eyes (integer halves), else null."""
    p = F.col(df_pose)
    mid = lambda a: F.floor((p["left_eye"][a].cast("bigint") + p["right_eye"][a].cast("bigint")) / 2).cast("double")
    eyes = F.when(p["left_eye"].isNotNull() & p["right_eye"].isNotNull(), F.struct(mid("x").alias("x"), mid("y").alias("y")))
    return F.coalesce(p["nose"], eyes)


def step_length(points: DataFrame, keys: list[str]) -> DataFrame:
    """Distance to the previous point of the track: nose to nose, head centre to head
    centre, otherwise box centre to box centre. The head centre is the nose where there is one."""
    d = O.shifted(points.withColumn("__now", reference_point()), keys, "frame_idx", {
        "__head": F.col("__now"), "__cx": F.col("cx"), "__cy": F.col("cy"), "__has": F.lit(True)})
    dist = lambda x0, y0, x1, y1: F.sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0))
    now, prev = F.col("__now"), F.col("__head")
    step = (F.when(now.isNotNull() & prev.isNotNull(), dist(prev["x"], prev["y"], now["x"], now["y"]))
            .otherwise(dist(F.col("__cx"), F.col("__cy"), F.col("cx"), F.col("cy"))))
    return d.withColumn("step", F.when(F.col("__has"), step)).drop("__now", "__head", "__cx", "__cy", "__has")


def track_motion(points: DataFrame, keys: list[str]) -> DataFrame:
    """Mean step per track, 0 for a single point."""
    return step_length(points, keys).groupBy(*keys).agg(
        F.coalesce(F.round(F.avg("step"), 6), F.lit(0.0)).alias("motion"), F.count(F.lit(1)).alias("points"))


def active_speakers(segments: DataFrame, points: DataFrame, energy: DataFrame, fps: float = 30.0,
                    key: str = "media_id", bucket_frames: int = 300) -> DataFrame:
    """Best moving track per speech segment.

    ``segments`` (key, seg_idx, s_start, s_end), ``energy`` (key, seg_idx, mean_rms).
    Score = mean step inside the segment x mean energy; at least two points. The step
    into the first point of a segment is left out. Segments are matched with the frames that have points, and the points then join these.
    """
    f0, f1 = (F.col("s_start") * fps).cast("bigint"), (F.col("s_end") * fps).cast("bigint")
    s = segments.select(key, "seg_idx", f0.alias("__f0"), f1.alias("__f1"))
    steps = step_length(points, [key, "track_id"]).select(key, "track_id", "frame_idx", "step")
    frames = I.point_join(points.select(key, "frame_idx").distinct(), s, [key], F.col("frame_idx"), (F.col("__f0"), F.col("__f1")),
                          F.col("frame_idx").between(F.col("__f0"), F.col("__f1")), bucket_frames)
    d = steps.join(frames.select(key, "frame_idx", "seg_idx"), [key, "frame_idx"])
    per_track = d.groupBy(key, "seg_idx", "track_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("step", F.lit(0.0))).alias("total"),
        F.coalesce(F.min_by("step", "frame_idx"), F.lit(0.0)).alias("__into"))
    per_track = per_track.where("n >= 2").withColumn("motion", (F.col("total") - F.col("__into")) / (F.col("n") - 1))
    score = F.round(F.col("motion") * F.col("mean_rms"), 6)
    ranked = per_track.join(energy, [key, "seg_idx"]).withColumn("score", score)
    best = ranked.groupBy(key, "seg_idx").agg(
        F.min_by("track_id", F.struct((-F.col("score")).alias("s"), "track_id")).alias("speaker_id"), F.max("score").alias("score"))
    d = segments.join(best, [key, "seg_idx"], "left")
    conf = F.when(F.col("score") > 0, F.least(F.col("score") / 10, F.lit(1.0))).otherwise(0.5)
    return d.withColumns({"confidence": conf, "speaker_id": F.coalesce("speaker_id", F.lit(0))})
