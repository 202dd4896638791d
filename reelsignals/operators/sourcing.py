"""Candidate and media gates, attempts, failure classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from . import ordered as O

# fixed values: gate limits and indicator words
MIN_SEC, MAX_SEC, MIN_VIEWS = 900, 1800, 10_000
INDICATORS = ["highlights", "shorts", "clip", "reaction", "tiktok compilation", "instagram", "viral compilation"]
FAILURE_WORDS = ["error", "unavailable", "private", "age", "copyright", "blocked", "removed", "terminated", "sign in"]
MEMORY_WORDS = ["out of memory", "cuda oom", "cublas", "alloc", "cudnn", "not enough memory"]
VIDEO_EXTENSIONS = ["mp4", "mkv", "webm", "mov", "avi"]


def enrich(hits: DataFrame, stats: DataFrame, on: str = "video_id") -> DataFrame:
    """Search hits with their statistics; hits without any vanish."""
    return hits.join(stats, on, "inner")


def _first_word(words: list[str], text: Column) -> Column:
    return F.get(F.filter(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(text, w)), F.lit(0))


def quality_gate(candidates: DataFrame) -> DataFrame:
    """Duration, views and watermark gates with their notes in order."""
    dur, views = F.col("duration_seconds"), F.col("view_count")
    label = S.format_duration(dur)
    hit = _first_word(INDICATORS, F.lower("title"))
    notes = F.array(
        F.when(dur < MIN_SEC, F.concat(F.lit("Too short ("), label, F.lit(" < 15 min)")))
        .when(dur > MAX_SEC, F.concat(F.lit("Too long ("), label, F.lit(" > 60 min)")))
        .otherwise(F.concat(F.lit("Duration OK ("), label, F.lit(")"))),
        F.when(views < MIN_VIEWS, F.concat(F.lit("Too few views ("), F.format_number(views, 0), F.lit(" < 10,000)")))
        .otherwise(F.concat(F.lit("Views OK ("), F.format_number(views, 0), F.lit(")"))),
        F.when(hit.isNotNull(), F.concat(F.lit("Watermark indicator: '"), hit, F.lit("' in title")))
        .otherwise("No watermark indicators"))
    return candidates.withColumns({
        "passes_quality": dur.between(MIN_SEC, MAX_SEC) & (views >= MIN_VIEWS) & hit.isNull(), "quality_notes": notes})


def select_candidates(gated: DataFrame, relaxed_limit: int = 5) -> DataFrame:
    """Passing candidates by views; where a query has none, the first few of fitting duration.

    Whether a query has any is one aggregated flag per query, joined back to its
    candidates in several places, so a hot query's candidates do not meet in one task.
    """
    any_pass = gated.groupBy("query_id").agg(F.bool_or("passes_quality").alias("__any"))
    d = O.join_stats(gated, any_pass, ["query_id"], "video_id")
    strict = d.where("__any AND passes_quality").withColumn("relaxed", F.lit(False))
    fits = d.where(~F.col("__any") & F.col("duration_seconds").between(MIN_SEC, MAX_SEC))
    relaxed = O.top_n(fits, ["query_id"], [F.col("view_count").desc(), F.col("video_id")], relaxed_limit, "__rn").drop("__rn")
    return strict.unionByName(relaxed.withColumn("relaxed", F.lit(True))).drop("__any")


def queue(selected: DataFrame, attempts: int = 3) -> DataFrame:
    """The first few per query in the order they are tried."""
    return O.top_n(selected, ["query_id"], [F.col("view_count").desc(), F.col("video_id")], attempts, "rank")


def first_valid(queued: DataFrame, attempts: DataFrame) -> DataFrame:
    """Lowest-ranked candidate that downloaded and validated, else an error row."""
    d = queued.join(attempts, "video_id", "left")
    ok = F.coalesce(F.col("download_ok") & F.col("valid"), F.lit(False))
    g = d.groupBy("query_id").agg(
        F.min_by("video_id", F.when(ok, F.col("rank"))).alias("video_id"), F.min(F.when(ok, F.col("rank"))).alias("attempt"),
        F.count(F.lit(1)).alias("tried"))
    return g.withColumn("error", F.when(F.col("attempt").isNull(), F.concat(
        F.lit("All "), F.col("tried").cast("string"), F.lit(" download/validation attempts failed."))))


def media_gates(probes: DataFrame) -> DataFrame:
    """Resolution, frame rate, duration and audio gates of a scanned probe."""
    audio_ok = F.col("has_audio") & (F.col("channels") >= 1) & ~((F.col("audio_kbps") > 0) & (F.col("audio_kbps") < 64.0))
    d = probes.withColumns({
        "passes_resolution": F.col("height") >= 720, "passes_framerate": F.col("fps") >= 24.0,
        "passes_duration": F.col("duration").between(900.0, 1800.0), "passes_audio": audio_ok})
    valid = F.col("passes_resolution") & F.col("passes_framerate") & F.col("passes_duration") & F.col("passes_audio")
    why = F.when(~F.col("has_audio"), "No audio stream found").when(F.col("channels") < 1, "No audio channels").when(
        ~audio_ok, "Bitrate too low").otherwise(S.channel_label("channels"))
    return d.withColumns({"valid": valid, "resolution": S.size_label("width", "height"), "audio_note": why})


def file_gates(files: DataFrame, min_bytes: int = 10_240) -> DataFrame:
    """First failing reason per file (extension, then size), null when it may be used."""
    ext = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    reason = F.coalesce(
        F.when(~ext.isin(VIDEO_EXTENSIONS), F.concat(F.lit("Unsupported format: ."), ext)),
        F.when(F.col("length") < min_bytes, F.concat(F.lit("File too small ("), F.col("length").cast("string"), F.lit(" bytes)"))))
    return files.withColumn("reason", reason)


def failure_line(stderr) -> Column:
    """First output line holding one of the failure words, stripped."""
    c = F.col(stderr) if isinstance(stderr, str) else stderr
    hit = lambda line: F.exists(F.array(*[F.lit(w) for w in FAILURE_WORDS]), lambda w: F.contains(F.lower(line), w))
    return F.trim(F.get(F.filter(F.split(c, "\n"), hit), F.lit(0)))


def is_memory_failure(text) -> Column:
    c = F.lower(F.col(text) if isinstance(text, str) else text)
    return F.exists(F.array(*[F.lit(w) for w in MEMORY_WORDS]), lambda w: F.contains(c, w))
