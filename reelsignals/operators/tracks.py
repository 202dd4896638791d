"""Detections and tracks: geometry, scores, targets, crops, smoothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import folds
from . import ordered as O
from .chunked import chunk_fold

KEYS = ["media_id", "track_id"]


def geometry(detections: DataFrame, frame_w: int = 1920, min_conf: float | None = None) -> DataFrame:
    """Integer box centre and size, eye line and how it was found."""
    d = detections if min_conf is None else detections.where(F.col("conf") >= min_conf)
    i = lambda c: c.cast("int")
    d = d.withColumns({"cx": i((F.col("x1") + F.col("x2")) / 2), "cy": i((F.col("y1") + F.col("y2")) / 2),
                       "w": i(F.col("x2") - F.col("x1")), "h": i(F.col("y2") - F.col("y1"))})
    left, right, nose = F.col("pose.left_eye.y"), F.col("pose.right_eye.y"), F.col("pose.nose.y")
    found = F.when((left > 0) & (right > 0), (left + right) / 2).when(nose > 0, nose)
    return d.withColumns({
        "eyes_y": i(F.coalesce(found, F.col("cy") - F.col("h") * 0.30)),
        "framing": F.when(found.isNotNull(), "pose").otherwise("estimated"), "frame_center_offset": F.col("cx") - frame_w // 2})


def padded_region(frame_w: int = 1920, frame_h: int = 1080, pad: float = 0.2) -> tuple[Column, Column, Column, Column]:
    """Person box with padding on each side, clamped to the frame."""
    def side(c: str, size: str, limit: int) -> tuple[Column, Column]:
        half, p = F.floor(F.col(size) / 2), (F.col(size) * pad).cast("int")
        return F.greatest(F.lit(0), F.col(c) - half - p), F.least(F.lit(limit), F.col(c) + half + p)

    (x1, x2), (y1, y2) = side("cx", "w", frame_w), side("cy", "h", frame_h)
    return x1, y1, x2, y2


def target_score(frame_w: int = 1920, frame_h: int = 1080) -> Column:
    """Half normalised area, half closeness to the upper centre."""
    area = (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))
    cx, cy = (F.col("x1") + F.col("x2")) / 2, (F.col("y1") + F.col("y2")) / 2
    off_x, off_y = F.abs(cx - frame_w / 2) / (frame_w / 2), F.abs(cy - frame_h * 0.4) / (frame_h * 0.5)
    near = F.greatest(F.lit(0.0), 1.0 - (off_x * 0.6 + off_y * 0.4))
    return 0.50 * F.least(area / float(frame_w * frame_h), F.lit(1.0)) + 0.50 * near


def crop_dims(src_w: Column, src_h: Column, out_w: int = 1080, out_h: int = 1920) -> tuple[Column, Column]:
    """Largest crop of the output's shape: full height, or full width when that is too wide."""
    aspect = out_h / out_w
    w = (src_h / aspect).cast("int")
    return F.when(w > src_w, src_w).otherwise(w), F.when(w > src_w, (src_w * aspect).cast("int")).otherwise(src_h)


def clamp_window(pos: Column, size: Column, limit: Column) -> Column:
    return F.greatest(F.lit(0), F.least(pos, limit - size))


def vertical_x(src_w: Column, src_h: Column, centre: Column | float = 0.5) -> tuple[Column, Column]:
    """Left edge and width of a 9:16 cut at a relative centre."""
    w = (src_h * 9 / 16).cast("int")
    c = centre if isinstance(centre, Column) else F.lit(centre)
    return clamp_window(((src_w - w) * c).cast("int"), w, src_w), w


def thirds_target(points: DataFrame, crop_h: int) -> DataFrame:
    """Target that puts the eye line on the upper third of the crop."""
    eyes = (F.col("pose.left_eye.y") + F.col("pose.right_eye.y")) / 2
    guess = F.col("cy") - F.col("h") * F.when(F.col("label") == "person", 0.35).otherwise(0.2)
    eye_y = F.coalesce(eyes, F.col("pose.nose.y"), guess)
    return points.withColumns({"target_cx": F.col("cx"), "target_cy": (eye_y + int(crop_h * 0.17)).cast("int")})


def track_summary(points: DataFrame) -> DataFrame:
    """Points, mean area and score per track."""
    g = points.groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("points"), F.sum(F.col("w").cast("bigint") * F.col("h")).alias("area"),
        F.min("frame_idx").alias("first_frame"), F.min_by("label", "frame_idx").alias("label"))
    return g.withColumns({"mean_area": F.col("area") / F.col("points"), "score": F.col("points") + F.col("area") / F.col("points") / 1000.0})


def lasting_tracks(summary: DataFrame, more_than: int = 10) -> DataFrame:
    return summary.where(F.col("points") > more_than)


def best_track(summary: DataFrame, key: str = "media_id") -> DataFrame:
    """Highest score per media among faces and persons; the earlier track on ties."""
    rank = F.struct((-F.col("score")).alias("s"), "first_frame", "track_id")
    return summary.where(F.col("label").isin("face", "person")).groupBy(key).agg(
        F.min_by("track_id", rank).alias("track_id"), F.max("score").alias("score"))


def frame_spine(media: DataFrame, n: str = "n_frames", key: str = "media_id") -> DataFrame:
    return media.where(F.col(n) > 0).select(key, F.explode(F.sequence(F.lit(0), (F.col(n) - 1).cast("int"))).alias("frame_idx"))


def hold_last(spine: DataFrame, points: DataFrame, frame_w: int = 1920, frame_h: int = 1080, key: str = "media_id") -> DataFrame:
    """Target per frame: the last point, before any the first usable later one, else the centre."""
    d = spine.join(points.select(key, "frame_idx", "target_cx", "target_cy"), [key, "frame_idx"], "left")
    here = F.when(F.col("target_cx").isNotNull(), F.struct(F.col("target_cx").cast("int").alias("x"), F.col("target_cy").cast("int").alias("y")))
    usable = F.when(F.col("target_cx").between(-1000, frame_w + 1000), here)
    centre = F.struct(F.lit(frame_w // 2).alias("x"), F.lit(frame_h // 2).alias("y"))
    d = O.last_known(d, [key], "frame_idx", here, "__h", fallback=centre, first_value=usable)
    return d.withColumns({"held_cx": F.col("__h.x"), "held_cy": F.col("__h.y")}).drop("__h")


def look_ahead_start(spine: DataFrame, points: DataFrame, frame_w: int = 1920, frame_h: int = 1080, key: str = "media_id") -> DataFrame:
    """Frames with their target (null where lost) and the media's first usable target."""
    usable = F.when(F.col("target_cx").between(-1000, frame_w + 1000), F.col("frame_idx"))
    init = points.groupBy(key).agg(F.min_by(F.struct("target_cx", "target_cy"), usable).alias("i"))
    d = spine.join(points.select(key, "frame_idx", "target_cx", "target_cy"), [key, "frame_idx"], "left").join(init, key, "left")
    return d.withColumns({"init_x": F.coalesce("i.target_cx", F.lit(frame_w // 2)), "init_y": F.coalesce("i.target_cy", F.lit(frame_h // 2))}).drop("i")


def smooth_boxes(points: DataFrame, frame_w: int = 1920, frame_h: int = 1080, frames: int | None = None, **limits) -> DataFrame:
    """Boxes smoothed along their track, a track's chunks of ``frames`` in parallel."""
    return chunk_fold(points.select(*KEYS, "frame_idx", "cx", "cy", "w", "h"), KEYS, "frame_idx",
                      lambda: folds.DeadZoneEma(frame_w, frame_h, **limits),
                      "media_id bigint, track_id int, frame_idx int, cx int, cy int, w int, h int", frames)


def smooth_centres(points: DataFrame, kalman: bool = False, fps: float = 30.0, alpha: float = 0.15, frames: int | None = None) -> DataFrame:
    """Smoothed box centres per track: a Kalman filter, or exponential means in built-in expressions, whose whole
    part is taken after rounding to nine decimals, so that no rounding noise lies beside a whole number."""
    p = points.select(*KEYS, "frame_idx", "x1", "y1", "x2", "y2")
    if kalman:
        gains = folds.CentreKalman.gain_list(fps)
        return chunk_fold(p, KEYS, "frame_idx", lambda: folds.CentreKalman(gains), "media_id bigint, track_id int, frame_idx int, x int, y int", frames)
    d = O.exponential_means(p, KEYS, "frame_idx", {"sx": (F.col("x1") + F.col("x2")) / 2, "sy": (F.col("y1") + F.col("y2")) / 2}, alpha, chunk_rows=frames)
    return d.select(*KEYS, "frame_idx", F.round("sx", 9).cast("int").alias("x"), F.round("sy", 9).cast("int").alias("y"))


def dead_band(frames: DataFrame, frame_w: int = 1920, frame_h: int = 1080, pct: float = 0.05, chunk: int | None = None) -> DataFrame:
    """Accepted target per frame, chunks of a media item in parallel; ``frames`` comes from :func:`look_ahead_start`."""
    return chunk_fold(frames.select("media_id", "frame_idx", "target_cx", "target_cy", "init_x", "init_y"), ["media_id"], "frame_idx",
                      lambda: folds.DeadBand(frame_w, frame_h, pct), "media_id bigint, frame_idx int, x int, y int", chunk)


CAMERA_KEYS = ["media_id", "scene"]
CAMERA_ROWS = "media_id bigint, scene bigint, frame_idx int, crop_w int, crop_h int, smooth_cx double, smooth_cy double, smooth_zoom double"


def camera_filter() -> folds.OneEuro:
    return folds.OneEuro(["target_cx", "target_cy", "zoom"], carry=["crop_w", "crop_h"])


def camera_signals(frames: DataFrame, src_w: int = 1920) -> DataFrame:
    """Frames with their scene number and the zoom that their crop width means."""
    d = O.running_sum(frames, ["media_id"], "frame_idx", F.col("is_cut").cast("int"), "scene")
    zoom = F.lit(float(src_w)) / F.greatest(F.lit(1), F.col("crop_w"))
    return d.select(*CAMERA_KEYS, "frame_idx", "target_cx", "target_cy", "crop_w", "crop_h", zoom.alias("zoom"))


def crop_windows(smooth: DataFrame, src_w: int = 1920, src_h: int = 1080) -> DataFrame:
    """Crop of each frame around the smoothed centre, kept inside the picture; the height
    shrinks with the width (and stays where the given width is 0)."""
    wide = (F.lit(src_w) / F.greatest(F.lit(1.0), F.col("smooth_zoom"))).cast("int")
    d = smooth.withColumn("out_w", wide)
    scale = F.when(F.col("crop_w") > 0, F.col("out_w") / F.col("crop_w")).otherwise(1.0)
    d = d.withColumn("tall", (F.col("crop_h") * scale).cast("int")).withColumn("out_h", F.least(F.col("tall"), F.lit(src_h)))
    x = clamp_window((F.col("smooth_cx") - F.col("out_w") / 2).cast("int"), F.col("out_w"), F.lit(src_w))
    y = clamp_window((F.col("smooth_cy") - F.col("tall") / 2).cast("int"), F.col("out_h"), F.lit(src_h))
    return d.select(*CAMERA_KEYS, "frame_idx", x.alias("crop_x"), y.alias("crop_y"), "out_w", "out_h")


def camera_path(frames: DataFrame, src_w: int = 1920, src_h: int = 1080) -> DataFrame:
    """Smoothed crop per frame. Only the three smoothed values are folded, and the filters
    restart at each cut, so scenes fold in parallel.

    ``frames``: media_id, frame_idx, target_cx, target_cy, crop_w, crop_h, is_cut.
    """
    smooth = folds.sorted_fold(camera_signals(frames, src_w), CAMERA_KEYS, ["frame_idx"], camera_filter, CAMERA_ROWS)
    return crop_windows(smooth, src_w, src_h)


def boxes_by_frame(detections: DataFrame, lengths: DataFrame, frame_w: int = 1920, frame_h: int = 1080) -> DataFrame:
    """Every frame of every media item of ``lengths`` (media_id, n_frames) with its boxes'
    track ids and scores, by track; empty lists where there is no box."""
    item = F.struct("track_id", target_score(frame_w, frame_h).alias("score"))
    boxes = detections.groupBy("media_id", "frame_idx").agg(F.array_sort(F.collect_list(item)).alias("b"))
    d = frame_spine(lengths).join(boxes, ["media_id", "frame_idx"], "left")
    part = lambda n, kind: F.coalesce(F.transform("b", lambda x: x[n]), F.array().cast(f"array<{kind}>"))
    return d.select("media_id", "frame_idx", part("track_id", "bigint").alias("ids"), part("score", "double").alias("scores"))


def target_lock(detections: DataFrame, lengths: DataFrame, fps: float = 30.0, hysteresis: float = 3.0, hold: float = 2.0,
                frame_w: int = 1920, frame_h: int = 1080, frames: int | None = None) -> DataFrame:
    """Followed track per frame, for media items without any box as well. Chunks of ``frames`` of a media item
    are folded in parallel."""
    d = boxes_by_frame(detections, lengths, frame_w, frame_h)
    return chunk_fold(d, ["media_id"], "frame_idx", lambda: folds.TargetLock(fps, hysteresis, hold),
                      "media_id bigint, frame_idx int, state string, target int", frames)
