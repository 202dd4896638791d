"""Scans of stored JSON and text documents into typed rows (explicit schemas, no inference)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S

THUMBS = "maxres: struct<url: string>, high: struct<url: string>, default: struct<url: string>"
ITEM = (
    "id: string, snippet: struct<title: string, channelTitle: string, publishedAt: string, categoryId: string, "
    f"tags: array<string>, description: string, thumbnails: struct<{THUMBS}>>, "
    "statistics: struct<viewCount: string, likeCount: string, commentCount: string>, "
    "contentDetails: struct<duration: string>"
)
VIDEO_LIST = f"items array<struct<{ITEM}>>"
SEARCH_LIST = "items array<struct<id: struct<kind: string, videoId: string>>>"
STREAM = (
    "codec_type: string, codec_name: string, width: int, height: int, r_frame_rate: string, channels: int, "
    "sample_rate: string, bit_rate: string, start_time: string, duration: string"
)
PROBE = f"streams array<struct<{STREAM}>>, format struct<duration: string>"


def scan_video_lists(pages: DataFrame, column: str = "response", *keep: str) -> DataFrame:
    """``items[]`` to rows; counts to integers, missing ones 0, malformed items dropped."""
    d = pages.select(*keep, F.explode(F.from_json(column, VIDEO_LIST)["items"]).alias("v"))
    s, st = F.col("v.snippet"), F.col("v.statistics")
    count = lambda c: F.when(c.isNull(), F.lit(0).cast("bigint")).otherwise(c.try_cast("bigint"))
    blank = lambda c: F.coalesce(c, F.lit(""))
    d = d.select(
        *keep, F.col("v.id").alias("video_id"), blank(s["title"]).alias("title"), blank(s["channelTitle"]).alias("channel"),
        blank(s["publishedAt"]).alias("published_at"), F.coalesce(s["tags"], F.array().cast("array<string>")).alias("all_tags"),
        count(st["viewCount"]).alias("view_count"), count(st["likeCount"]).alias("like_count"),
        count(st["commentCount"]).alias("comment_count"), S.thumbnail_url(s["thumbnails"]).alias("thumbnail_url"),
        S.parse_iso_duration(F.coalesce(F.col("v.contentDetails.duration"), F.lit("PT0S"))).alias("duration_seconds"))
    d = d.where("video_id IS NOT NULL AND view_count IS NOT NULL AND like_count IS NOT NULL AND comment_count IS NOT NULL")
    return d.withColumns({"topic": S.topic_words("all_tags", "title"), "tags": F.slice("all_tags", 1, 10)}).drop("all_tags")


def scan_search_hits(pages: DataFrame, column: str = "response", *keep: str) -> DataFrame:
    """Ids of search hits; hits without a video id (channels, playlists) vanish."""
    d = pages.select(*keep, F.posexplode(F.from_json(column, SEARCH_LIST)["items"]).alias("pos", "hit"))
    return d.select(*keep, "pos", F.col("hit.id.videoId").alias("video_id")).where("coalesce(video_id, '') <> ''")


def scan_probes(docs: DataFrame, column: str = "probe", *keep: str) -> DataFrame:
    """First video and first audio stream with the container duration."""
    d = docs.select(*keep, F.from_json(column, PROBE).alias("p"))
    first = lambda kind: F.get(F.filter(F.col("p.streams"), lambda x: x["codec_type"] == kind), F.lit(0))
    d = d.select(*keep, F.col("p.streams").alias("streams"), first("video").alias("video"), first("audio").alias("audio"),
                 F.coalesce(F.col("p.format.duration").try_cast("double"), F.lit(0.0)).alias("duration"))
    bits = F.col("audio.bit_rate")
    return d.select(
        *keep, "streams", F.col("video").isNotNull().alias("has_video"), F.col("audio").isNotNull().alias("has_audio"),
        F.coalesce("video.width", F.lit(0)).alias("width"), F.coalesce("video.height", F.lit(0)).alias("height"),
        F.col("video.r_frame_rate").alias("fps_text"), S.parse_fps("video.r_frame_rate").alias("fps"), "duration",
        F.coalesce("audio.channels", F.lit(0)).alias("channels"), F.col("audio.codec_name").alias("audio_codec"),
        F.coalesce(F.when(bits.rlike("^[0-9]+$"), bits.try_cast("bigint") / 1000), F.lit(0.0)).alias("audio_kbps"))


def last_stream(streams: Column, kind: str) -> Column:
    return F.try_element_at(F.filter(streams, lambda x: x["codec_type"] == kind), F.lit(-1))


# --- transcripts ----------------------------------------------------------

WORD = "word: string, text: string, start: double, end: double, start_time: double, end_time: double, confidence: double, score: double, speaker: string"
SEGMENT = f"text: string, start: double, end: double, score: double, speaker: string, words: array<struct<{WORD}>>"
TRANSCRIPT = f"result struct<words: array<struct<{WORD}>>>, segments array<struct<{SEGMENT}>>, words array<struct<{WORD}>>"


def _alignment_schema() -> str:
    return f"segments array<struct<{SEGMENT}>>, alignments array<struct<{SEGMENT}>>, text string, start double, `end` double, score double, speaker string, words array<struct<{WORD}>>"


def scan_words(transcripts: DataFrame, column: str = "blob", key: str = "media_id") -> DataFrame:
    """Words of a transcript in any of the three layouts; alternate keys coalesced.

    A segment without words yields one entry with the segment's text and times.
    """
    d = transcripts.select(key, F.from_json(column, TRANSCRIPT).alias("t"))

    def norm(w):
        return F.struct(F.coalesce(w["word"], w["text"], F.lit("")).alias("word"),
                        F.coalesce(w["start_time"], w["start"], F.lit(0.0)).alias("start"),
                        F.coalesce(w["end_time"], w["end"], F.lit(0.0)).alias("end"))

    def seg_words(s):
        whole = F.array(F.struct(F.coalesce(s["text"], F.lit("")).alias("word"), F.coalesce(s["start"], F.lit(0.0)).alias("start"),
                                 F.coalesce(s["end"], F.lit(0.0)).alias("end")))
        return F.when(s["words"].isNull(), whole).otherwise(F.transform(s["words"], norm))

    words = F.coalesce(
        F.transform(F.col("t.result.words"), norm), F.flatten(F.transform(F.col("t.segments"), seg_words)),
        F.transform(F.col("t.words"), norm))
    d = d.select(key, F.posexplode(words).alias("word_idx", "w"))
    return d.select(key, "word_idx", "w.word", "w.start", "w.end")


def scan_alignment(docs: DataFrame, column: str = "blob", key: str = "media_id") -> DataFrame:
    """Alignment output (a dict with ``segments`` or ``alignments``, one bare segment, or a list) to segments."""
    as_dict = F.from_json(column, _alignment_schema())
    as_list = F.from_json(column, f"array<struct<{SEGMENT}>>")
    d = docs.select(key, F.when(F.ltrim(F.col(column)).startswith("["), as_list).alias("l"), as_dict.alias("o"))
    bare = F.array(F.struct(*[F.col(f"o.{n}").alias(n) for n in ("text", "start", "end", "score", "speaker", "words")]))
    segs = F.coalesce("l", "o.segments", "o.alignments", bare)
    last = F.try_element_at(segs, F.lit(-1))["end"]
    d = d.select(key, F.coalesce(last, F.lit(0.0)).alias("duration"), F.posexplode(segs).alias("seg_idx", "s"))
    return d.select(
        key, "duration", "seg_idx", S.strip(F.coalesce("s.text", F.lit(""))).alias("text"), F.coalesce("s.start", F.lit(0.0)).alias("start"),
        F.coalesce("s.end", F.lit(0.0)).alias("end"), F.coalesce("s.score", F.lit(1.0)).alias("score"), F.col("s.speaker").alias("speaker"),
        F.transform(F.coalesce("s.words", F.array().cast(f"array<struct<{WORD}>>")), lambda w: F.struct(
            S.strip(F.coalesce(w["text"], F.lit(""))).alias("word"), F.coalesce(w["start"], F.lit(0.0)).alias("start"),
            F.coalesce(w["end"], F.lit(0.0)).alias("end"), F.coalesce(w["score"], F.lit(1.0)).alias("score"))).alias("words"))


def scan_rttm(lines: DataFrame, column: str = "value", *keep: str) -> DataFrame:
    """Speaker turns from RTTM lines; other line kinds and short lines are skipped."""
    d = lines.select(*keep, S.split_words(column).alias("f"))
    d = d.where((F.size("f") >= 9) & (F.get("f", F.lit(0)) == "SPEAKER"))
    start, dur = F.get("f", F.lit(3)).try_cast("double"), F.get("f", F.lit(4)).try_cast("double")
    return d.select(*keep, F.get("f", F.lit(1)).alias("file"), S.py_round(start, 3).alias("start"),
                    S.py_round(start + dur, 3).alias("end"), F.get("f", F.lit(7)).alias("speaker"))


# --- model and tool output ------------------------------------------------

MOMENT = "array<struct<start_time: double, end_time: double, hook: string, reason: string, viral_score: double>>"


def scan_model_moments(texts: DataFrame, column: str = "response", key: str = "media_id", duration: str = "duration") -> DataFrame:
    """Moments from free model text: the array between the outer brackets.

    No brackets give no rows; an unreadable array gives three even fallback spans.
    """
    body = S.json_between(column, "[", "]")
    d = texts.select(key, duration, body.alias("body"), F.from_json(body, MOMENT, {"mode": "PERMISSIVE"}).alias("parsed"))
    good = F.transform("parsed", lambda m: F.struct(
        F.coalesce(m["start_time"], F.lit(0.0)).alias("start_time"), F.coalesce(m["end_time"], F.lit(30.0)).alias("end_time"),
        F.coalesce(m["hook"], F.lit("")).alias("hook"), F.coalesce(m["reason"], F.lit("")).alias("reason"),
        F.coalesce(m["viral_score"], F.lit(0.5)).alias("viral_score")))
    span = F.least(F.lit(60.0), F.col(duration) / 3)
    # fixed values: the three fallback rows
    spare = F.transform(F.array(F.lit(0), F.lit(1), F.lit(2)), lambda i: F.struct(
        (i * span).alias("start_time"), F.least(i * span + span, F.col(duration)).alias("end_time"),
        F.concat(F.lit("Segment "), (i + 1).cast("string")).alias("hook"), F.lit("Auto-generated segment").alias("reason"),
        F.lit(0.3).alias("viral_score")))
    rows = F.when(F.col("body").isNull(), F.array().cast(MOMENT)).otherwise(F.coalesce(good, spare))
    return d.select(key, F.posexplode(rows).alias("moment_idx", "m")).select(key, "moment_idx", "m.*")


def scan_theme(texts: DataFrame, column: str = "response", key: str = "media_id") -> DataFrame:
    """Overall theme object from free model text, with the default pair."""
    o = F.from_json(S.json_between(column), "theme string, audience string")
    return texts.select(key, F.coalesce(o["theme"], F.lit("Unknown")).alias("theme"),
                        F.coalesce(o["audience"], F.lit("General")).alias("audience"))


def scan_tool_logs(lines: DataFrame, column: str = "line", key: str = "media_id") -> DataFrame:
    """Black time, last-seconds volume and the start-of-clip check from tool output lines."""
    c = F.col(column)
    number = r"(-?[0-9]+(?:\.[0-9]+)?)"
    num = lambda tag: F.when(F.contains(c, F.lit(tag)), F.regexp_extract(c, rf"{tag}:\s*{number}", 1).try_cast("double"))
    parsed = lines.select(key, "line_idx", num("black_duration").alias("black"), num("black_start").alias("start"), num("mean_volume").alias("db"))
    black, start, db = F.col("black"), F.col("start"), F.col("db")
    hookless = (start < 0.05) & (black >= 2.95)
    return parsed.where("black IS NOT NULL OR start IS NOT NULL OR db IS NOT NULL").groupBy(key).agg(
        F.coalesce(F.sum(black), F.lit(0.0)).alias("black_seconds"),
        F.min_by(db, F.when(db.isNotNull(), F.col("line_idx"))).alias("mean_db"),
        F.coalesce(F.bool_or(hookless), F.lit(False)).alias("black_opening"))


def black_intervals(lines: DataFrame, column: str = "line", key: str = "media_id") -> DataFrame:
    """Black intervals named in tool output, one row each."""
    pat = r"black_start:\s*([0-9.]+)\s+black_end:\s*([0-9.]+)"
    part = lambda i: F.regexp_extract(column, pat, i).try_cast("double")
    return lines.where(F.contains(column, F.lit("black_start"))).select(key, part(1).alias("b_start"), part(2).alias("b_end")).where("b_start IS NOT NULL")


def scan_sidecars(docs: DataFrame, column: str = "info") -> DataFrame:
    """Download sidecar to its clean projection."""
    schema = ("title string, uploader string, uploader_id string, webpage_url string, duration double, view_count bigint, "
              "like_count bigint, upload_date string, description string, tags array<string>, categories array<string>, "
              "width int, height int, fps double")
    d = docs.select(F.from_json(column, schema).alias("i")).select("i.*")
    blank, zero = (lambda c: F.coalesce(c, F.lit(""))), (lambda c: F.coalesce(c, F.lit(0)))
    empty = F.array().cast("array<string>")
    return d.select(
        "title", blank("uploader").alias("channel"), blank("uploader_id").alias("uploader_id"), F.col("webpage_url").alias("url"),
        zero("duration").cast("int").alias("duration_sec"), zero("view_count").alias("view_count"), zero("like_count").alias("like_count"),
        blank("upload_date").alias("upload_date"), F.substring(blank("description"), 1, 1000).alias("description"),
        F.slice(F.coalesce("tags", empty), 1, 10).alias("tags"), F.coalesce("categories", empty).alias("categories"),
        S.size_label(zero("width"), zero("height")).alias("resolution"), zero("fps").alias("fps"))
