"""Places where a caller plugs in a model or handler."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from . import ordered as O
from . import qa

JOB_RESULT = "job_id bigint, job_type string, status string, result string, error string"


def run_jobs(jobs: DataFrame, handler: Callable[[str, str], str], types: list[str]) -> DataFrame:
    """Call ``handler(job_type, payload)`` per pending job; a failure becomes a row, not a crash."""
    todo = jobs.where(F.col("job_type").isin(types) & (F.col("status") == "pending")).select("job_id", "job_type", "payload")

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for job_id, kind, payload in pdf.itertuples(index=False):
                try:
                    rows.append((job_id, kind, "completed", handler(kind, payload), None))
                except Exception as e:  # noqa: BLE001
                    rows.append((job_id, kind, "failed", None, str(e)))
            yield pd.DataFrame(rows, columns=["job_id", "job_type", "status", "result", "error"])

    return todo.mapInPandas(work, JOB_RESULT)


def rank_trends(signals: DataFrame, scorer: Callable[..., Column] | None = None, *inputs: str) -> DataFrame:
    """Score signals 0-100 with a caller's pandas UDF, or by bounded virality, and check the contract."""
    by_rule = F.least(F.lit(100.0), F.greatest(F.lit(0.0), F.col("score") * 20 + 50))
    value = by_rule if scorer is None else scorer(*[F.col(c) for c in inputs])
    d = signals.withColumn("viral_score", value)
    return d.withColumn("violations", qa.violations([qa.in_range("viral_score", 0, 100), qa.required("title")]))


def _answered(d: DataFrame, by_rule: Column, scorer: Callable[..., Column] | None, inputs: tuple[str, ...], contract: str) -> DataFrame:
    """The fields of the scorer's struct (of the rule's where it gave none), with the violations of ``contract``."""
    value = by_rule if scorer is None else with_default(scorer(*[F.col(c) for c in inputs]), by_rule)
    return d.withColumn("__answer", value).select("*", "__answer.*").drop("__answer").withColumn("violations", qa.contract(contract))


def plan_cuts(moments: DataFrame, scorer: Callable[..., Column] | None = None, *inputs: str, key: str = "media_id", order: str = "moment_idx",
              most: int = 6, max_sec: float = 90.0) -> DataFrame:
    """key, segment_idx, order, start_time, end_time, viral_score, violations: at most ``most`` segments per source,
    best first, each ``max_sec`` long at most.

    ``moments``: key, order, start_time, end_time, viral_score. A scorer, for example a pandas UDF over ``inputs``,
    returns a struct of the last three; by rule the moment itself, its score bounded to 0-100 (null: 0).
    The plan stays long, one row per segment, so a source's plan is never one value.
    """
    bounded = F.least(F.lit(100.0), F.greatest(F.lit(0.0), F.coalesce(F.col("viral_score").cast("double"), F.lit(0.0))))
    by_rule = F.struct(F.col("start_time").cast("double").alias("start_time"), F.col("end_time").cast("double").alias("end_time"), bounded.alias("viral_score"))
    value = by_rule if scorer is None else with_default(scorer(*[F.col(c) for c in inputs]), by_rule)
    d = moments.select(key, order, value.alias("__answer")).select(key, order, "__answer.*")
    d = d.withColumn("end_time", F.least("end_time", F.col("start_time") + max_sec))
    d = O.top_n(d, [key], [F.col("viral_score").desc(), F.col(order)], most, "segment_idx").withColumn("segment_idx", F.col("segment_idx") - 1)
    return d.withColumn("violations", qa.contract("moment"))


def generate_metadata(segments: DataFrame, scorer: Callable[..., Column] | None = None, *inputs: str, theme: str = "theme", text: str = "text") -> DataFrame:
    """Adds title, description, tags and hashtags to segments, with violations of their lengths.

    A scorer returns a struct of these four fields. By rule the title is the theme, else the start of the
    text, cut to 100 letters, the description the text cut to 5000; tags are the stock ones, and so is all where there is no text.
    ``segments`` has none of the four columns yet.
    """
    stock = default_enhancement()
    filled = lambda c: F.when(S.strip(c) != "", S.strip(c))
    by_rule = F.struct(
        F.substring(F.coalesce(filled(theme), filled(text), stock["title"]), 1, 100).alias("title"),
        F.substring(F.coalesce(filled(text), stock["description"]), 1, 5000).alias("description"), stock["tags"].alias("tags"), stock["hashtags"].alias("hashtags"))
    return _answered(segments, by_rule, scorer, inputs, "metadata")


def check_quality(clips: DataFrame, scorer: Callable[..., Column] | None = None, *inputs: str, transcript: str = "transcript", captions: str = "captions",
                  hook_start: str = "hook_start") -> DataFrame:
    """passes, the four single checks, issues and overall_score (0-100) per clip, with violations.

    A scorer returns a struct of these fields. By rule: speech begins within three seconds, the transcript has
    20 letters or more, it ends with a full stop, question or exclamation mark, and the captions are the transcript but for case;
    each check is worth 25 points, 75 or more pass. A null fails its check.
    """
    said = F.col(transcript)
    tests = {
        "hook_present": F.col(hook_start) <= 3.0, "coherent": F.length(said) >= 20, "natural_ending": said.rlike(r"[.!?][ \n]*$"),
        "captions_accurate": F.lower(captions) == F.lower(said)}
    tests = {name: F.coalesce(ok, F.lit(False)) for name, ok in tests.items()}
    score = sum((F.when(ok, 25.0).otherwise(0.0) for ok in tests.values()), F.lit(0.0))
    issues = F.array_compact(F.array(*[F.when(~ok, F.lit(name)) for name, ok in tests.items()]))
    by_rule = F.struct((score >= 75).alias("passes"), *[ok.alias(name) for name, ok in tests.items()], issues.alias("issues"), score.alias("overall_score"))
    return _answered(clips, by_rule, scorer, inputs, "qa_result")


def with_default(scored: Column, default: Column) -> Column:
    """Scorer output, or the default where the scorer gave none."""
    return F.coalesce(scored, default)


def default_enhancement() -> Column:
    # fixed values: what a short gets when no scorer answered
    words = lambda *w: F.array(*[F.lit(x) for x in w])
    return F.struct(
        F.lit("\U0001f525 Must Watch!").alias("title"), F.lit("Check out this amazing content.").alias("description"),
        words("viral", "trending", "shorts").alias("tags"), words("#viral", "#fyp", "#trending").alias("hashtags"),
        F.lit(50).alias("hook_score"), F.lit(True).alias("passed"), F.lit(70).alias("qc_score"), F.lit("tiktok").alias("caption_style"),
        F.lit(3.0).alias("thumbnail_ts"))


def default_brief() -> Column:
    # fixed values: the brief used when there is no signal at all
    return F.struct(
        F.lit("AI technology").alias("topic"), F.array(F.lit("AI"), F.lit("technology"), F.lit("2026")).alias("keywords"),
        F.lit("AI technology latest developments explained 2026").alias("search_query"), F.lit(20.0).alias("viral_score"),
        F.lit(0.1).alias("confidence"), F.lit(False).alias("is_breakout"))


def segment_info(theme: str, hook: str, start: str, end: str, audience: str) -> Column:
    """Text handed to a metadata model."""
    return F.concat(
        F.lit("Topic: "), F.coalesce(theme, F.lit("Unknown")), F.lit("\nHook: "), F.coalesce(hook, F.lit("")), F.lit("\nDuration: "),
        S.fixed(F.col(end) - F.col(start), 0), F.lit("s\nAudience: "), F.coalesce(audience, F.lit("General")))
