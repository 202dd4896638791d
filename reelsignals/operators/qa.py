"""Quality reports, drift, black frames, thumbnails and contract checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..sources.documents import last_stream
from . import intervals as I

# fixed values: checks that fail a report on their own, and thumbnail offsets
CRITICAL = ["Resolution", "Duration", "Audio Sync"]
THUMB_OFFSETS = [0.0, 0.5, 1.0, 1.5, 2.0, 3.0, 5.0]


def av_drift(streams: Column) -> Column:
    """Larger of start gap and duration gap; the last stream of each type counts."""
    num = lambda s, f: F.coalesce(s[f].try_cast("double"), F.lit(0.0))
    v, a = last_stream(streams, "video"), last_stream(streams, "audio")
    vd, ad = num(v, "duration"), num(a, "duration")
    return F.greatest(F.abs(num(a, "start_time") - num(v, "start_time")), F.when((vd > 0) & (ad > 0), F.abs(vd - ad)).otherwise(0.0))


def black_fraction(black_seconds: Column, duration: Column) -> Column:
    return F.when(duration > 0, F.coalesce(black_seconds, F.lit(0.0)) / duration).otherwise(0.0)


def ratio_fps(text: Column) -> Column:
    """Frame rate of a ``num/den`` text only; anything else is 0."""
    two = F.split(text, "/")
    ratio = F.try_divide(F.get(two, F.lit(0)).try_cast("double"), F.get(two, F.lit(1)).try_cast("double"))
    return F.when(F.size(two) == 2, F.coalesce(ratio, F.lit(0.0))).otherwise(0.0)


def qa_checks(probes: DataFrame, logs: DataFrame, captions: DataFrame, key: str = "media_id", min_sec: float = 30.0,
              max_sec: float = 90.0, strict: bool = False) -> DataFrame:
    """Checks of each clip as an array, in report order.

    ``probes`` is a scanned probe table, ``logs`` a scanned tool log, ``captions``
    (key, n_words). A missing stream leaves out its checks; with ``strict`` the
    checks of a missing video stream count as failed instead.
    """
    # computed before the joins, so that each is evaluated once per clip
    d = probes.withColumns({"drift": av_drift(F.col("streams")), "qa_fps": ratio_fps(F.col("fps_text"))}).drop("streams")
    d = d.join(logs, key, "left").join(captions, key, "left")
    d = d.withColumn("black", black_fraction(F.col("black_seconds"), F.col("duration")))
    check = lambda name, ok, value: F.struct(F.lit(name).alias("name"), F.coalesce(ok, F.lit(False)).alias("passed"), value.alias("value"))
    none = F.lit(None).cast("string")
    video, audio = F.col("has_video"), F.col("has_audio")
    shown = F.lit(True) if strict else video
    fps, drift, black = F.col("qa_fps"), F.col("drift"), F.col("black")
    size_ok = video & (F.col("width") == 1080) & (F.col("height") == 1920)
    words = F.coalesce("n_words", F.lit(0))
    checks = F.array(
        F.when(shown, check("Resolution", size_ok, S.size_label("width", "height"))),
        F.when(shown, check("Frame Rate", video & (fps >= 29.0), F.concat(S.fixed(fps), F.lit("fps")))),
        check("Duration", F.col("duration").between(min_sec, max_sec), F.concat(S.fixed("duration"), F.lit("s"))),
        F.when(audio & video, check("Audio Sync", drift < 0.1, F.concat(S.fixed(drift, 3), F.lit("s")))).when(
            ~audio | F.lit(strict), check("Audio Sync", F.lit(False), none)),
        check("Black Frames", black < 0.02, F.concat(S.fixed(black * 100), F.lit("%"))),
        check("Hook (First 3s)", ~F.coalesce("black_opening", F.lit(False)), none),
        check("Natural Ending", F.coalesce(F.col("mean_db") > -60.0, F.lit(True)), none),
        F.when(words > 0, check("Captions", words > 0, F.concat(words.cast("string"), F.lit(" words")))))
    return d.select(key, F.array_compact(checks).alias("checks"))


def check_rows(checks: DataFrame, key: str = "media_id") -> DataFrame:
    return checks.select(key, F.posexplode("checks").alias("check_idx", "c")).select(key, "check_idx", "c.*")


def qa_report(checks: DataFrame, key: str = "media_id") -> DataFrame:
    """Score and verdict per clip, computed inside the row."""
    passed = F.size(F.filter("checks", lambda c: c["passed"]))
    bad = F.exists("checks", lambda c: ~c["passed"] & c["name"].isin(CRITICAL))
    d = checks.withColumn("score", F.when(F.size("checks") > 0, passed / F.size("checks") * 100).otherwise(0.0))
    return d.withColumn("overall_passed", ~bad & (F.col("score") >= 70))


def batch_verdict(reports: DataFrame, *by: str) -> DataFrame:
    """All reports passed; an empty batch counts as passed."""
    return reports.groupBy(*by).agg(
        F.coalesce(F.bool_and("overall_passed"), F.lit(True)).alias("all_passed"), F.count(F.lit(1)).alias("n"),
        F.count_if("overall_passed").alias("n_passed"))


def thumbnail_times(media: DataFrame, black: DataFrame, key: str = "media_id", width: float = 30.0) -> DataFrame:
    """Suggested time, else the 25 % mark moved past black frames, else the middle.

    ``media``: key, duration, ai_ts, meta_ts; ``black``: key, b_start, b_end.
    """
    dur = F.when(F.col("duration") > 0, F.col("duration")).otherwise(60.0)
    d = media.select(key, dur.alias("dur"), F.coalesce("ai_ts", "meta_ts").alias("given"))
    tries = d.where("given IS NULL").select(key, "dur", F.posexplode(F.array(*[F.lit(o) for o in THUMB_OFFSETS])).alias("pos", "off"))
    tries = tries.withColumn("ts", F.col("dur") * 0.25 + F.col("off")).where((F.col("pos") == 0) | (F.col("ts") < F.col("dur")))
    hit = I.point_join(tries, black, [key], F.col("ts"), (F.col("b_start"), F.col("b_end")), F.col("ts").between(F.col("b_start"), F.col("b_end")), width, how="left")
    clear = hit.groupBy(key, "pos", "ts").agg(F.count("b_start").alias("n")).where("n = 0")
    best = clear.groupBy(key).agg(F.min_by("ts", "pos").alias("found"))
    d = d.join(best, key, "left").withColumn("ts", F.coalesce("given", "found", F.col("dur") * 0.5))
    return d.select(key, F.greatest(F.lit(0.0), F.least("ts", F.col("dur") - 0.1)).alias("thumbnail_ts"))


def violations(rules: list[tuple[Column, str]]) -> Column:
    """Messages of the rules a row breaks; a rule is (must hold, message)."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(m)) for ok, m in rules]))


def in_range(col: str, lo: float, hi: float) -> tuple[Column, str]:
    return F.col(col).between(lo, hi), f"{col} outside [{lo:g}, {hi:g}]"


def max_len(col: str, n: int) -> tuple[Column, str]:
    return F.length(col) <= n, f"{col} longer than {n}"


def max_items(col: str, n: int) -> tuple[Column, str]:
    return F.size(col) <= n, f"{col} has more than {n} items"


def required(col: str) -> tuple[Column, str]:
    return F.col(col).isNotNull(), f"{col} missing"


# fixed values: the constraints of the model outputs
CONTRACTS = {
    "trend_score": [("range", "score", 0, 100), ("required", "reason")],
    "brief": [("required", "topic"), ("items", "keywords", 8), ("range", "viral_score", 0, 100), ("range", "confidence", 0, 1)],
    "moment": [("required", "start_time"), ("required", "end_time"), ("range", "viral_score", 0, 100)],
    "metadata": [("len", "title", 100), ("len", "description", 5000), ("items", "tags", 30), ("items", "hashtags", 10)],
    "qa_result": [("required", "passes"), ("range", "overall_score", 0, 100)],
    "hook_score": [("range", "score", 0, 100)],
    "plan": [("items", "segments", 6)],
}
_RULES = {"range": in_range, "len": max_len, "items": max_items, "required": required}


def contract(name: str) -> Column:
    return violations([_RULES[kind](*args) for kind, *args in CONTRACTS[name]])
