"""Effect triggers and pacing on the frame clock."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import durable
from . import folds
from . import ordered as O
from .signals import union_sources

EFFECTS = ["zoom", "zoom_punch", "shake", "flash", "emphasize", "vignette_pulse"]
TRIGGER = "timestamp double, effect_type string, intensity double, duration double, source string, source_idx bigint"


def all_triggers(*parts: DataFrame) -> DataFrame:
    """Trigger tables in order of precedence for equal times."""
    return union_sources(*[p.withColumn("part", F.lit(i)) for i, p in enumerate(parts)])


def dedupe_triggers(triggers: DataFrame, key: str = "media_id", gap: float = 0.1) -> DataFrame:
    """Greedy dedupe of nearby triggers.

    A trigger more than ``gap`` after its predecessor is kept whatever came before,
    so the fold restarts there; each stretch streams through the rule row by row.
    """
    sec = F.floor(F.col("timestamp") / 600.0).cast("bigint")
    d = durable(triggers).withColumn("__o", F.struct("timestamp", "part", "source_idx"))
    d = O.shifted(d, [key], "__o", {"__prev": F.col("timestamp")}, chunk=sec)
    fresh = F.when(F.col("__prev").isNull() | (F.col("timestamp") - F.col("__prev") > gap), 1).otherwise(0)
    d = durable(d.withColumn("__new", fresh).drop("__prev"))
    d = O.running_sum(d, [key], "__o", F.col("__new"), "stretch", chunk=sec).drop("__new", "__o")
    key_type = triggers.schema[key].dataType.simpleString()
    return folds.sorted_fold(d, [key, "stretch"], ["timestamp", "part", "source_idx"], lambda: folds.KeepStrongest(gap),
                             f"{key} {key_type}, stretch bigint, {TRIGGER}").drop("stretch")


def trigger_frames(triggers: DataFrame, fps: float = 30.0) -> DataFrame:
    """One row per frame of each trigger: from int(t*fps), at least one frame."""
    first = (F.col("timestamp") * fps).cast("bigint")
    n = F.greatest(F.lit(1).cast("bigint"), (F.col("duration") * fps).cast("bigint"))
    return triggers.withColumn("frame_idx", F.explode(F.sequence(first, first + n - 1)))


def frames_with_triggers(frames: DataFrame, triggers: DataFrame, fps: float = 30.0, key: str = "media_id") -> DataFrame:
    """Frames with every trigger that covers them: an equi-join on the frame number."""
    return frames.join(trigger_frames(triggers, fps), [key, "frame_idx"])


def timed_trigger_frames(frames: DataFrame, triggers: DataFrame, fps: float, key: str = "media_id") -> DataFrame:
    """The variant by time: start <= frame/fps <= start + duration, both inclusive."""
    lo = F.greatest(F.lit(0).cast("bigint"), F.floor(F.col("timestamp") * fps) - 1)
    hi = F.ceil((F.col("timestamp") + F.col("duration")) * fps) + 1
    t = triggers.withColumn("frame_idx", F.explode(F.sequence(lo, hi)))
    now = F.col("frame_idx") / F.lit(fps)
    t = t.where((F.col("timestamp") <= now) & (now <= F.col("timestamp") + F.col("duration")))
    return frames.join(t, [key, "frame_idx"])


def effect_value(fps: float) -> Column:
    """Parameter of the effect at its frame."""
    p = F.when(F.col("duration") > 0, (F.col("frame_idx") / F.lit(fps) - F.col("timestamp")) / F.col("duration")).otherwise(0.0)
    eased, i = 0.5 - 0.5 * F.cos(p * F.pi()), F.col("intensity")
    kind = F.col("effect_type")
    # fixed values: strength of each effect
    return (F.when(kind == "zoom", 1.0 + 0.25 * i * eased)
            .when(kind == "zoom_punch", 1.0 + 0.30 * i * F.greatest(F.lit(0.0), F.exp(-3.0 * p) * F.sin(p * F.pi() * 2)))
            .when(kind == "shake", i * 0.05 * (1 - eased))
            .when(kind == "flash", i * 0.35 * (1 - F.sqrt(p)))
            .when(kind == "emphasize", 1.0 + 0.08 * i * F.sin(p * F.pi()))
            .when(kind == "vignette_pulse", 0.3 + 0.4 * i * (1 - p)))


def pacing_zoom(frames: DataFrame, actions: DataFrame, fps: float = 30.0, key: str = "media_id") -> DataFrame:
    """Zoom per frame: the last action that covers it (both ends included), else 1.0."""
    a = actions.where(F.col("type") == "zoom")
    first, last = (F.col("start_time") * fps).cast("bigint"), (F.col("end_time") * fps).cast("bigint")
    steps = F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))
    a = a.withColumn("frame_idx", F.explode(steps)).groupBy(key, "frame_idx").agg(F.max_by("value", "action_idx").alias("zoom"))
    return frames.join(a, [key, "frame_idx"], "left").withColumn("zoom", F.coalesce("zoom", F.lit(1.0)))


def emphasis_zoom(energy: Column, threshold: float = 0.5, max_zoom: float = 1.15) -> Column:
    return F.when(energy < threshold, 1.0).otherwise(1.0 + (energy - threshold) * (max_zoom - 1.0) / (1.0 - threshold))


def impact_shake(frames: DataFrame, impacts: DataFrame, intensity: float = 0.3, length: int = 5, key: str = "media_id") -> DataFrame:
    """Decaying shake after each impact frame; the first listed impact wins."""
    span = F.sequence(F.col("impact_frame"), F.col("impact_frame") + length - 1)
    cover = impacts.withColumn("frame_idx", F.explode(span)).groupBy(key, "frame_idx").agg(
        F.min_by("impact_frame", "impact_idx").alias("impact_frame"))
    d = frames.join(cover, [key, "frame_idx"])
    f = F.col("frame_idx")
    return d.withColumns({
        "shake": intensity * (1 - (f - F.col("impact_frame")) / length),
        "offset_x": F.sin(f * 7.3) * 2 - 1, "offset_y": F.cos(f * 11.7) * 2 - 1})


def plan_summary(triggers: DataFrame, series: DataFrame, key: str = "media_id") -> DataFrame:
    """Triggers per effect type with the mean energy."""
    counts = triggers.groupBy(key).pivot("effect_type", EFFECTS).count().na.fill(0)
    energy = series.groupBy(key).agg(F.round(F.avg("rms"), 6).alias("average_energy"))
    return energy.join(counts, key, "left").na.fill(0, EFFECTS)


def plan_totals(triggers: DataFrame, key: str = "media_id") -> DataFrame:
    """Counts per media and type with subtotals."""
    return triggers.rollup(key, "effect_type").agg(F.count(F.lit(1)).alias("n"))
