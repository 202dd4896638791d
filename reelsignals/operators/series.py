"""Per-frame series: thresholds, segments, peaks, onsets, resampling, frame statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..session import durable
from . import ordered as O


def flagged_segments(series: DataFrame, flag: Column, key: str = "media_id", order: str = "frame_idx", *aggs: Column) -> DataFrame:
    """Runs of true frames as [first_frame, end_frame), with further aggregates per run."""
    d = O.islands(series.withColumn("__flag", F.coalesce(flag, F.lit(False))), [key], order, F.col("__flag"))
    return d.where("__flag").groupBy(key, "island").agg(
        F.min(order).alias("first_frame"), (F.max(order) + 1).alias("end_frame"), *aggs).drop("island")


def voice_segments(series: DataFrame, speech: Column, frame_sec: float, key: str = "media_id", min_sec: float | None = None,
                   ends: DataFrame | None = None) -> DataFrame:
    """Speech intervals in seconds. ``min_sec`` drops short ones (energy flavour);
    ``ends`` (key, n_frames, audio_end) closes a trailing run at the end of the audio."""
    d = flagged_segments(series, speech, key)
    d = d.withColumns({"start_time": F.col("first_frame") * F.lit(frame_sec), "end_time": F.col("end_frame") * F.lit(frame_sec)})
    if ends is not None:
        d = d.join(ends, key).withColumn(
            "end_time", F.when(F.col("end_frame") == F.col("n_frames"), F.col("audio_end")).otherwise(F.col("end_time"))).drop("n_frames", "audio_end")
    if min_sec is not None:
        d = d.where(F.col("end_time") - F.col("start_time") > min_sec)
    return d.drop("first_frame", "end_frame")


def energy_voice_segments(series: DataFrame, frame_sec: float, key: str = "media_id", value: str = "rms") -> DataFrame:
    """Speech where the energy exceeds twice the median, kept when longer than 0.1 s."""
    med = O.exact_percentiles(series, [key], value, {"__med": 0.5})
    return voice_segments(O.join_stats(series, med, [key], "frame_idx"), F.col(value) > F.col("__med") * 2, frame_sec, key, min_sec=0.1)


def low_activity(ti: Column, ae: Column, ti_max: float = 5.0, ae_max: float = 0.5, mode: str = "or") -> Column:
    low_ti, low_ae = ti < ti_max, ae < ae_max
    return (low_ti | low_ae) if mode == "or" else (low_ti & low_ae)


def low_activity_zones(series: DataFrame, fps: float = 30.0, min_sec: float = 2.0, zoom: float = 1.15, mode: str = "or",
                       key: str = "media_id") -> DataFrame:
    """Long calm stretches as zoom actions; one still open at the end is closed there."""
    d = flagged_segments(series, low_activity(F.col("ti"), F.col("ae"), mode=mode), key, "frame_idx", F.avg("ti").alias("mean_ti"))
    d = d.where((F.col("end_frame") - F.col("first_frame")) / F.lit(fps) > min_sec)
    return d.select(
        key, F.lit("zoom").alias("type"), (F.col("first_frame") / F.lit(fps)).alias("start_time"), (F.col("end_frame") / F.lit(fps)).alias("end_time"),
        F.lit(zoom).alias("value"), "mean_ti", F.concat(F.lit("Low TI ("), S.fixed("mean_ti"), F.lit(")")).alias("reason"))


def thresholds(series: DataFrame, key: str = "media_id") -> DataFrame:
    """Per media: bounds of RMS, P85 of its min-max norm, P90 and maximum of onset strength, twice the median RMS."""
    p = O.exact_percentiles(series, [key], "rms", {"__p85": 0.85, "__med": 0.5})
    q = O.exact_percentiles(series, [key], "onset", {"onset_p90": 0.9})
    b = series.groupBy(key).agg(F.min("rms").alias("rms_min"), F.max("rms").alias("rms_max"), F.max("onset").alias("onset_max"))
    d = b.join(p, key).join(q, key)
    # the norm is monotone and linear, so its percentile is the norm of the percentile
    return d.select(key, "rms_min", "rms_max", "onset_max", "onset_p90", rms_norm("__p85").alias("peak_threshold"),
                    (F.col("__med") * 2).alias("speech_threshold"))


def rms_norm(value: str | Column = "rms") -> Column:
    v = F.col(value) if isinstance(value, str) else value
    return (v - F.col("rms_min")) / (F.col("rms_max") - F.col("rms_min") + 1e-8)


def hysteresis_peaks(series: DataFrame, limits: DataFrame, frame_sec: float, key: str = "media_id", min_sec: float = 0.1) -> DataFrame:
    """Peaks of the normalised energy: entered above the threshold, left below 0.8 of it.

    A peak still open at the last frame is dropped.
    """
    d = O.join_stats(series, limits, [key], "frame_idx").withColumn("e", rms_norm())
    hi = F.col("peak_threshold")
    change = F.when(F.col("e") > hi, True).when(F.col("e") < hi * 0.8, False)
    d = O.last_known(d, [key], "frame_idx", change, "in_peak", fallback=F.lit(False))
    d = durable(d.select(key, "frame_idx", "e", "in_peak"))
    runs = flagged_segments(d, F.col("in_peak"), key, "frame_idx", F.max_by("e", "frame_idx").alias("intensity"))
    last = d.groupBy(key).agg((F.max("frame_idx") + 1).alias("__n"))
    runs = runs.join(last, key).where(F.col("end_frame") < F.col("__n")).drop("__n")
    runs = runs.withColumns({"timestamp": F.col("first_frame") * F.lit(frame_sec),
                             "duration": F.col("end_frame") * F.lit(frame_sec) - F.col("first_frame") * F.lit(frame_sec)})
    return runs.where(F.col("duration") > min_sec).drop("end_frame")


def peak_triggers(peaks: DataFrame, key: str = "media_id", limit: int = 20) -> DataFrame:
    """The first peaks of each media as zoom triggers of at most one second."""
    d = O.top_n(peaks, [key], [F.col("first_frame")], limit)
    return d.select(key, "timestamp", F.lit("zoom").alias("effect_type"), "intensity", F.least("duration", F.lit(1.0)).alias("duration"),
                    F.lit("rms_peak").alias("source"), F.col("first_frame").alias("source_idx"))


def onset_triggers(series: DataFrame, limits: DataFrame, frame_sec: float, key: str = "media_id") -> DataFrame:
    """Onsets stronger than the 90th percentile as short shakes."""
    d = O.join_stats(series, limits, [key], "frame_idx").where(F.col("onset") > F.col("onset_p90"))
    return d.select(key, (F.col("frame_idx") * F.lit(frame_sec)).alias("timestamp"), F.lit("shake").alias("effect_type"),
                    (F.col("onset") / F.col("onset_max")).alias("intensity"), F.lit(0.15).alias("duration"),
                    F.lit("onset_strong").alias("source"), F.col("frame_idx").alias("source_idx"))


def beat_triggers(beats: DataFrame, key: str = "media_id") -> DataFrame:
    """Every fourth beat as a slight emphasis."""
    return beats.where(F.col("beat_idx") % 4 == 0).select(
        key, F.col("time").alias("timestamp"), F.lit("emphasize").alias("effect_type"), F.lit(0.3).alias("intensity"),
        F.lit(0.1).alias("duration"), F.lit("downbeat").alias("source"), F.col("beat_idx").alias("source_idx"))


def resample(values: DataFrame, frames: DataFrame, value: str, key: str = "media_id", idx: str = "sample_idx") -> DataFrame:
    """Linear resampling of a series of length L onto n frames: x = i*L/(n-1), held at the end."""
    size_v = values.groupBy(key).agg((F.max(idx) + 1).alias("__l"))
    size_f = frames.groupBy(key).agg((F.max("frame_idx") + 1).alias("__n"))
    d = frames.join(size_v.join(size_f, key), key)
    step = F.when(F.col("__n") > 1, F.col("__l") / (F.col("__n") - 1)).otherwise(0.0)
    d = d.withColumn("__x", F.when(F.col("frame_idx") == F.col("__n") - 1, F.when(F.col("__n") > 1, F.col("__l").cast("double")).otherwise(0.0))
                     .otherwise(F.col("frame_idx") * step))
    last = F.col("__l") - 1
    d = d.withColumns({"__k": F.least(F.floor("__x"), last), "__k1": F.least(F.floor("__x") + 1, last)})
    lo = values.select(F.col(key), F.col(idx).alias("__k"), F.col(value).alias("__a"))
    hi = values.select(F.col(key), F.col(idx).alias("__k1"), F.col(value).alias("__b"))
    d = d.join(lo, [key, "__k"]).join(hi, [key, "__k1"])
    out = (F.col("__b") - F.col("__a")) * (F.col("__x") - F.col("__k")) + F.col("__a")
    return d.withColumn(f"{value}_resampled", out).drop("__x", "__k", "__k1", "__a", "__b", "__l", "__n")


def moving_average3(series: DataFrame, value: str, out: str, key: str = "media_id", order: str = "frame_idx") -> DataFrame:
    """Three-frame mean with repeated edges; series shorter than three stay raw."""
    whole = lambda w: w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    d = O.chunked(series, order)
    d = O.with_carry(
        d, [key], {"__a": F.min_by(value, order), "__b": F.max_by(value, order), "__n": F.count(F.lit(1))},
        {"__lo": lambda w: F.lag("__b").over(w), "__hi": lambda w: F.lead("__a").over(w), "__len": lambda w: F.sum("__n").over(whole(w))})
    w = O.chunk_window([order])
    v = F.col(value)
    prev = F.coalesce(F.lag(value).over(w), F.col("__lo"), v)
    nxt = F.coalesce(F.lead(value).over(w), F.col("__hi"), v)
    return d.withColumn(out, F.when(F.col("__len") >= 3, (prev + v + nxt) / 3).otherwise(v)).drop(O.CHUNK, "__lo", "__hi", "__len")


def look_ahead_mean(series: DataFrame, value: str, out: str, k: int, key: str = "media_id", order: str = "frame_idx",
                    chunk_rows: int | None = None) -> DataFrame:
    """Centred mean over k rows to each side. Rows near a chunk border are also sent to the
    neighbouring chunk, so the window never spans a whole key."""
    d = series.withColumn("__home", O.dense_chunk(order, chunk_rows))
    near = F.array_distinct(F.array(
        O.dense_chunk(F.col(order) - k, chunk_rows), F.col("__home"), O.dense_chunk(F.col(order) + k, chunk_rows)))
    d = O.keyed(d.withColumn(O.CHUNK, F.explode(near)), [key])
    w = O.chunk_window([order]).rowsBetween(-k, k)
    return d.withColumn(out, F.avg(value).over(w)).where(F.col(O.CHUNK)["__no"] == F.col("__home")).drop(O.CHUNK, "__home")


def histogram(pixels: str | Column = "pixels", bins: int = 32) -> Column:
    """Normalised histogram of values in [0,1], built inside the row."""
    p = F.col(pixels) if isinstance(pixels, str) else pixels
    inside = F.filter(p, lambda x: (x >= 0) & (x <= 1))
    slot = F.transform(inside, lambda x: F.least(F.lit(bins - 1), F.floor(x * bins)))
    return F.transform(F.sequence(F.lit(0), F.lit(bins - 1)),
                       lambda b: F.size(F.filter(slot, lambda s: s == b)) / (F.size(inside) + F.lit(1e-8)))


def _sum(arr: Column) -> Column:
    return F.aggregate(arr, F.lit(0.0), lambda a, x: a + x)


def scene_cuts(frames: DataFrame, threshold: float = 0.35, key: str = "media_id") -> DataFrame:
    """Histogram distance to the previous frame; a cut where it exceeds the threshold."""
    d = O.shifted(frames.withColumn("hist", histogram()), [key], "frame_idx", {"__prev": F.col("hist")})
    diff = F.coalesce(_sum(F.zip_with("hist", "__prev", lambda a, b: F.abs(a - b))), F.lit(0.0))
    return d.withColumn("hist_diff", diff).withColumn("is_cut", F.col("hist_diff") > threshold).drop("__prev")


def temporal_information(frames: DataFrame, key: str = "media_id") -> DataFrame:
    """Population deviation of the difference to the previous frame, 0 for the first."""
    d = O.shifted(frames, [key], "frame_idx", {"__prev": F.col("pixels")})
    d = d.withColumn("__d", F.zip_with("pixels", "__prev", lambda a, b: a - b))
    d = d.withColumn("__m", _sum(F.col("__d")) / F.size("__d"))
    var = _sum(F.transform("__d", lambda x: (x - F.col("__m")) * (x - F.col("__m")))) / F.size("__d")
    return d.withColumn("ti", F.coalesce(F.sqrt(var), F.lit(0.0))).drop("__prev", "__d", "__m")


def frame_rms(samples: DataFrame, hop: int, key: str = "media_id") -> DataFrame:
    """Root mean square per hop of samples."""
    return samples.groupBy(key, F.floor(F.col("sample_idx") / hop).alias("frame_idx")).agg(F.sqrt(F.avg(F.col("x") * F.col("x"))).alias("rms"))
