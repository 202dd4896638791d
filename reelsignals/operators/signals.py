"""Trend signals: union, dedupe, velocity, scores, ranking."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from . import ordered as O


def union_sources(*sources: DataFrame) -> DataFrame:
    """One wide signals table from sources with different columns."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), sources)


def normalize_crawled(items: DataFrame) -> DataFrame:
    """Alternate keys to one schema; rows without any title are dropped."""
    d = items.select(
        "platform", S.first_filled("title", "name", "text").alias("title"),
        F.coalesce(S.first_filled("engagement", "tweet_count", "views"), F.lit("")).alias("engagement_text"),
        F.coalesce("url", F.lit("")).alias("url"), F.coalesce("category", F.lit("")).alias("category"),
        S.split_hashtags("hashtag").alias("hashtags"))
    return d.where(F.col("title").isNotNull()).withColumn("engagement", S.parse_engagement("engagement_text"))


def first_seen(df: DataFrame, key: str | Column, arrival: str = "arrival_idx") -> DataFrame:
    """First-wins dedupe in arrival order (``dropDuplicates`` keeps any row)."""
    if isinstance(key, str):
        return O.first_by(df, [key], [F.col(arrival)])
    return O.first_by(df.withColumn("__k", key), ["__k"], [F.col(arrival)]).drop("__k")


def similar_title(title="title", chars: int = 30) -> Column:
    return F.substring(F.lower(F.col(title)), 1, chars)


def keyword_batches(df: DataFrame, keyword: str, arrival: str, size: int = 5) -> DataFrame:
    """Distinct keywords in order of appearance, numbered into request batches."""
    firsts = df.groupBy(keyword).agg(F.min(arrival).alias("first_idx"))
    d = O.number_rows(firsts, [], ["first_idx"], "pos", chunk=O.dense_chunk("first_idx", 1 << 20))
    return d.withColumn("batch", F.floor(F.col("pos") / size))


def add_velocity(df: DataFrame, as_of_micros: Column, published="published_at", views="view_count") -> DataFrame:
    """Views per hour since publication (at least 0.1 h); 0.0 when unparseable."""
    hours = F.greatest(F.lit(0.1), (as_of_micros - S.iso_micros(published)) / 1e6 / 3600)
    return df.withColumn("views_per_hour", F.coalesce(F.col(views) / hours, F.lit(0.0)))


def add_acceleration(polls: DataFrame, key: str = "video_id", order: str = "poll_id") -> DataFrame:
    """Velocity minus the velocity of the previous poll of the same video."""
    d = O.shifted(polls, [key], order, {"__prev": F.col("views_per_hour")})
    return d.withColumn(
        "acceleration", F.coalesce(F.col("views_per_hour") - F.col("__prev"), F.lit(0.0))).drop("__prev")


def virality() -> Column:
    # fixed values: weights of velocity, acceleration and engagement
    engagement = (F.col("like_count") + F.col("comment_count")) / F.greatest(F.lit(1), F.col("view_count"))
    return F.col("views_per_hour") * 0.6 + F.col("acceleration") * 0.3 + engagement * 100000 * 0.1


def emerging(videos: DataFrame, published_micros: Column, as_of_micros: Column, hours_back: float, min_views: int) -> DataFrame:
    cutoff = as_of_micros - F.lit(int(hours_back * 3600 * 1_000_000))
    return videos.where((F.col("view_count") >= min_views) & (published_micros >= cutoff))


def interest_stats(interest: DataFrame, order: str = "ts_idx") -> DataFrame:
    """Mean, peak and rising flag per keyword."""
    d = interest.groupBy("keyword").agg(
        F.avg("interest").alias("m"), F.max("interest").alias("p"), F.max_by("interest", order).alias("last_value"))
    return d.select("keyword", S.py_round("m", 1).alias("interest_7d"), S.py_round("p", 1).alias("peak_interest"),
                    "last_value", (F.col("last_value") >= F.col("m") * 0.8).alias("rising"))


def related_topics(related: DataFrame, n: int = 5) -> DataFrame:
    """First ``n`` rising topics per keyword; breakout when the first one says so."""
    top = O.top_n(related, ["keyword"], [F.col("rank")], n, "pos")
    return top.groupBy("keyword").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "topic_title"))), lambda r: r["topic_title"]).alias("related_topics"),
        F.coalesce(F.bool_or(F.when(F.col("pos") == 1, F.col("value").contains("Breakout"))), F.lit(False)).alias("breakout"))


def with_neutral(requested: DataFrame, stats: DataFrame) -> DataFrame:
    """Requested keywords; the ones without data get the neutral row."""
    d = requested.join(stats, "keyword", "left")
    # fixed values: the neutral score
    return d.withColumns({
        "interest_7d": F.coalesce("interest_7d", F.lit(50.0)),
        "peak_interest": F.coalesce("peak_interest", F.lit(50.0)),
        "rising": F.coalesce("rising", F.lit(False))})


def rank_by_interest(stats: DataFrame, min_interest: float = 20.0) -> DataFrame:
    return stats.where(F.col("interest_7d") >= min_interest).orderBy(F.col("interest_7d").desc(), "keyword")


GRAM = 3


def flag_breakouts(signals: DataFrame, keywords: DataFrame) -> DataFrame:
    """Mark signals whose title holds any breakout keyword, ignoring case.

    Each distinct title gives one row per letter with the three letters from there on. A keyword is anchored at that one
    of its three-letter pieces that is rarest in the titles; an equi-join on the anchor finds the titles that
    can hold it, which are then compared in full. Keywords of one or two letters meet the beginnings of the pieces.
    """
    kws = keywords.select(F.lower("keyword").alias("kw")).where(F.length("kw") > 0).distinct()
    low = signals.select("title").distinct().select("title", F.lower("title").alias("low")).where(F.length("low") > 0)
    piece = lambda text, at: F.substring(text, at, F.lit(GRAM))
    grams = low.select("title", "low", F.explode(F.sequence(F.lit(1), F.length("low"))).alias("at")).select(
        "title", "low", piece(F.col("low"), F.col("at")).alias("gram"))
    counts = grams.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    steps = F.sequence(F.lit(1), F.length("kw") - (GRAM - 1))
    parts = kws.where(F.length("kw") >= GRAM).select("kw", F.explode(steps).alias("at")).select("kw", piece(F.col("kw"), F.col("at")).alias("gram")).distinct()
    ranked = parts.join(counts, "gram", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    anchors = ranked.groupBy("kw").agg(F.min_by("gram", F.struct("n", "gram")).alias("gram"))
    hits = grams.join(anchors, "gram").where(F.contains("low", F.col("kw"))).select("title")
    for n in range(1, GRAM):
        short = kws.where(F.length("kw") == n)
        hits = hits.unionByName(grams.withColumn("kw", F.substring("gram", 1, n)).join(short, "kw").select("title"))
    return signals.join(hits.distinct().withColumn("__hit", F.lit(True)), "title", "left").withColumn(
        "google_breakout", F.coalesce("__hit", F.lit(False))).drop("__hit")


def platform_weighted_score(df: DataFrame, velocity="velocity", platform="platform") -> DataFrame:
    """Weighted z-score; a missing velocity counts as the mean."""
    weight = F.when(F.col(platform) == "tiktok", 1.2).otherwise(1.0)
    return df.withColumn("score", S.z_score(F.coalesce(velocity, F.lit(0.5)), weight=weight))


def super_trends(df: DataFrame, threshold: float = 1.5) -> DataFrame:
    """Signals over the threshold: stateless, so it serves batch and streams alike."""
    return platform_weighted_score(df).where(F.col("score") > threshold)


def platform_z(df: DataFrame, value: str = "velocity") -> DataFrame:
    """z-score within each platform; one aggregate row per platform joined back."""
    stats = df.groupBy("platform").agg(F.avg(value).alias("__m"), F.stddev_pop(value).alias("__s"))
    return O.join_stats(df, stats, ["platform"], value).withColumn(
        "z", F.coalesce(F.try_divide(F.col(value) - F.col("__m"), F.col("__s")), F.lit(0.0))).drop("__m", "__s")


def hourly_platform_stats(df: DataFrame, ts: str = "ts", value: str = "velocity") -> DataFrame:
    """Mean and deviation per platform and hour (streaming: set a watermark first)."""
    return df.groupBy("platform", F.window(ts, "1 hour")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))


def candidate_lines(ranked: DataFrame, position: str = "pos") -> DataFrame:
    """Numbered text block per candidate, as handed to a ranking model."""
    tags = F.nullif(F.array_join("tags", ", "), F.lit(""))
    mark = F.when(F.col("google_breakout"), " [BREAKOUT]").otherwise("")
    text = F.concat(
        F.col(position).cast("string"), F.lit(". '"), "title", F.lit("'"), mark,
        F.lit("\n   Platform: "), "platform", F.lit(" | Engagement: "), F.format_number("engagement", 0),
        F.lit(" | Velocity: "), F.coalesce("velocity_text", F.lit("N/A")),
        F.lit("\n   Tags: "), F.coalesce(tags, F.lit("N/A")), F.lit("\n"))
    return ranked.select(position, text.alias("line"))


def rank_desc(df: DataFrame, by: str, arrival: str, keys: Sequence[str] = ()) -> DataFrame:
    """Stable descending order; ties keep their arrival order."""
    if keys:
        w = Window.partitionBy(*keys).orderBy(F.col(by).desc(), arrival)
        return df.withColumn("rank", F.row_number().over(w))
    return df.orderBy(F.col(by).desc(), arrival)
