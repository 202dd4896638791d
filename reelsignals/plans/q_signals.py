"""Queries over trend signals, polls and interest."""

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import ordered as O
from ..operators import signals as T
from . import fixtures as X
from .registry import CTES, query

R6 = lambda c: F.round(c, 6)


def polls_scored(spark, d):
    p = T.add_velocity(X.video_polls(spark, d), S.ntz_micros("poll_ts"))
    p = T.add_acceleration(p)
    return p.withColumn("virality", T.virality())


CTES["f_polls_v"] = """SELECT *, view_count / greatest(0.1e0, (epoch_us(poll_ts) - epoch_us(published_at)) / 1e6 / 3600) AS vph FROM f_polls"""
CTES["f_polls_s"] = """SELECT *, coalesce(vph - lag(vph) OVER (PARTITION BY video_id ORDER BY poll_id), 0e0) AS accel FROM f_polls_v"""
_VIRAL = "vph * 0.6e0 + accel * 0.3e0 + (like_count + comment_count) / greatest(1, view_count) * 100000 * 0.1e0"


@query("p04_velocity", "SELECT poll_id, video_id, round(vph, 6) AS views_per_hour FROM f_polls_v")
def _(spark, d):
    p = T.add_velocity(X.video_polls(spark, d), S.ntz_micros("poll_ts"))
    return p.select("poll_id", "video_id", R6("views_per_hour").alias("views_per_hour"))


@query("p05_virality_score", f"SELECT poll_id, round({_VIRAL}, 6) AS virality FROM f_polls_s")
def _(spark, d):
    return polls_scored(spark, d).select("poll_id", R6("virality").alias("virality"))


@query("j01_acceleration", "SELECT poll_id, video_id, round(accel, 6) AS acceleration FROM f_polls_s")
def _(spark, d):
    return polls_scored(spark, d).select("poll_id", "video_id", R6("acceleration").alias("acceleration"))


@query("u02_first_seen_video", f"""SELECT video_id, poll_id, view_count, round({_VIRAL}, 6) AS virality FROM
  (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY poll_id) AS rn FROM f_polls_s) WHERE rn = 1""")
def _(spark, d):
    return T.first_seen(polls_scored(spark, d), "video_id", "poll_id").select(
        "video_id", "poll_id", "view_count", R6("virality").alias("virality"))


@query("k01_trend_ranking", """SELECT arrival_idx, title, platform, round(score, 6) AS score FROM (
  SELECT *, (velocity - 0.5e0) / 0.2e0 * CASE platform WHEN 'tiktok' THEN 1.2e0 ELSE 1e0 END AS score FROM f_signals)
  ORDER BY score DESC, arrival_idx""")
def _(spark, d):
    return T.rank_desc(T.platform_weighted_score(X.signals(spark, d)), "score", "arrival_idx").select(
        "arrival_idx", "title", "platform", R6("score").alias("score"))


@query("k01_by_velocity", "SELECT arrival_idx, title, velocity FROM f_signals ORDER BY velocity DESC, arrival_idx")
def _(spark, d):
    return T.rank_desc(X.signals(spark, d), "velocity", "arrival_idx").select("arrival_idx", "title", "velocity")


@query("k01_by_virality", f"SELECT poll_id, video_id, round({_VIRAL}, 6) AS virality FROM f_polls_s ORDER BY 3 DESC, poll_id")
def _(spark, d):
    p = polls_scored(spark, d).withColumn("virality", R6("virality"))
    return T.rank_desc(p, "virality", "poll_id").select("poll_id", "video_id", "virality")


@query("k01_by_views", "SELECT poll_id, video_id, view_count FROM f_polls_s ORDER BY view_count DESC, poll_id")
def _(spark, d):
    return T.rank_desc(polls_scored(spark, d), "view_count", "poll_id").select("poll_id", "video_id", "view_count")


@query("u03_similar_title_dedupe", """SELECT arrival_idx, title, platform FROM (SELECT *,
  row_number() OVER (PARTITION BY substr(lower(title), 1, 30) ORDER BY arrival_idx) AS rn FROM f_signals) WHERE rn = 1""")
def _(spark, d):
    return T.first_seen(X.signals(spark, d), T.similar_title()).select("arrival_idx", "title", "platform")


@query("u01_union_sources", """SELECT platform, title, engagement, CAST(NULL AS DOUBLE) AS velocity, 'crawl' AS source FROM f_signals
  UNION ALL SELECT 'youtube_api', 'video ' || video_id, view_count, round(vph, 6), 'youtube_api' FROM f_polls_v
  UNION ALL SELECT 'youtube_search', title, view_count, NULL, 'youtube_search' FROM f_candidates""")
def _(spark, d):
    crawl = X.signals(spark, d).select("platform", "title", "engagement", F.lit("crawl").alias("source"))
    api = T.add_velocity(X.video_polls(spark, d), S.ntz_micros("poll_ts")).select(
        F.lit("youtube_api").alias("platform"), F.concat(F.lit("video "), F.col("video_id").cast("string")).alias("title"),
        F.col("view_count").cast("double").alias("engagement"), R6("views_per_hour").alias("velocity"),
        F.lit("youtube_api").alias("source"))
    found = X.candidates(spark, d).select(
        F.lit("youtube_search").alias("platform"), "title", F.col("view_count").cast("double").alias("engagement"),
        F.lit("youtube_search").alias("source"))
    return T.union_sources(crawl, api, found)


@query("u04_keyword_batches", """SELECT keyword, CAST(pos AS BIGINT) AS pos, CAST(floor(pos / 5) AS BIGINT) AS batch FROM (
  SELECT title AS keyword, row_number() OVER (ORDER BY min(arrival_idx)) - 1 AS pos FROM f_signals GROUP BY title)""")
def _(spark, d):
    return T.keyword_batches(X.signals(spark, d), "title", "arrival_idx").select(
        F.col("title").alias("keyword"), "pos", "batch")


@query("k03_prompt_top30", """SELECT title, arrival_idx FROM (SELECT *,
  row_number() OVER (PARTITION BY substr(lower(title), 1, 30) ORDER BY arrival_idx) AS rn FROM f_signals)
  WHERE rn = 1 ORDER BY arrival_idx LIMIT 30""")
def _(spark, d):
    return T.first_seen(X.signals(spark, d), T.similar_title()).orderBy("arrival_idx").limit(30).select("title", "arrival_idx")


@query("k03_title_prefix_top20", """SELECT substr(title, 1, 50) AS keyword FROM f_signals GROUP BY 1 ORDER BY min(arrival_idx) LIMIT 20""")
def _(spark, d):
    g = X.signals(spark, d).groupBy(F.substring("title", 1, 50).alias("keyword")).agg(F.min("arrival_idx").alias("a"))
    return g.orderBy("a").limit(20).select("keyword")


@query("p02_engagement_parse", """SELECT arrival_idx, engagement_text, coalesce(TRY_CAST(regexp_extract(t, '([0-9.]+)\\s*([KMBT])?', 1) AS DOUBLE)
  * CASE regexp_extract(t, '([0-9.]+)\\s*([KMBT])?', 2) WHEN 'K' THEN 1e3 WHEN 'M' THEN 1e6 WHEN 'B' THEN 1e9 WHEN 'T' THEN 1e12 ELSE 1e0 END, 0e0)
  AS engagement FROM (SELECT *, upper(replace(engagement_text, ',', '')) AS t FROM f_signals)""")
def _(spark, d):
    return X.signals(spark, d).select("arrival_idx", "engagement_text", S.parse_engagement("engagement_text").alias("engagement"))


@query("p01_first_filled", """SELECT arrival_idx, title, CASE WHEN k % 3 = 0 THEN '' WHEN k % 3 = 1 THEN engagement_text ELSE CAST(k AS VARCHAR) END AS engagement_text
  FROM (SELECT *, coalesce(nullif(CASE WHEN k % 2 = 0 THEN title ELSE '  ' END, '  '), CASE WHEN k % 5 > 0 THEN platform END) AS title2 FROM f_signals)
  AS q(arrival_idx, ts, video_id, platform, title0, engagement_text, velocity, engagement, likes, comments, k, title) WHERE title IS NOT NULL""")
def _(spark, d):
    null_s = F.lit(None).cast("string")
    items = X.signals(spark, d).select(
        "arrival_idx", "platform", F.when(F.col("k") % 2 == 0, F.col("title")).otherwise("  ").alias("title"),
        null_s.alias("name"), F.when(F.col("k") % 5 > 0, F.col("platform")).alias("text"),
        F.when(F.col("k") % 3 == 1, F.col("engagement_text")).otherwise(" ").alias("engagement"), null_s.alias("tweet_count"),
        F.when(F.col("k") % 3 == 2, F.col("k").cast("string")).alias("views"))
    title = S.first_filled("title", "name", "text")
    out = items.withColumn("t", title).where(F.col("t").isNotNull())
    return out.select("arrival_idx", F.col("t").alias("title"), F.coalesce(
        S.first_filled("engagement", "tweet_count", "views"), F.lit("")).alias("engagement_text"))


@query("p03_hashtag_split", """SELECT arrival_idx, list_aggregate(list_filter(list_transform(string_split('#' || title || ' # ' || platform || '#', '#'),
  lambda h: trim(h)), lambda h: h <> ''), 'string_agg', '|') AS hashtags FROM f_signals""")
def _(spark, d):
    text = F.concat(F.lit("#"), "title", F.lit(" # "), "platform", F.lit("#"))
    return X.signals(spark, d).select("arrival_idx", F.array_join(S.split_hashtags(text), "|").alias("hashtags"))


@query("p06_engagement_rate_url", """SELECT video_id, CASE WHEN view_count = 0 THEN 0e0 ELSE (like_count + comment_count) / view_count END AS rate,
  'https://www.youtube.com/watch?v=' || CAST(video_id AS VARCHAR) AS url FROM f_candidates""")
def _(spark, d):
    return X.candidates(spark, d).select(
        "video_id", S.engagement_rate("like_count", "comment_count", "view_count").alias("rate"), S.watch_url("video_id").alias("url"))


@query("p07_topic_inference", """SELECT video_id, array_to_string(list_slice(tags || list_slice(string_split_regex(trim(title), '\\s+'), 1, 5), 1, 6), ' ') AS topic,
  array_to_string(list_slice(tags || list_slice(string_split_regex(trim(title), '\\s+'), 1, 4), 1, 5), ' ') AS search_topic FROM
  (SELECT video_id, title, list_slice([query_id, p_type, 'size' || CAST(p_size AS VARCHAR), 'extra'], 1, 3) AS tags FROM f_candidates JOIN part ON p_partkey = video_id)""")
def _(spark, d):
    p = X.table(spark, d, "part").select(
        F.col("p_partkey").alias("video_id"),
        F.array("p_brand", "p_type", F.concat(F.lit("size"), F.col("p_size").cast("string")), F.lit("extra")).alias("tags"))
    c = X.candidates(spark, d).join(p, "video_id")
    return c.select("video_id", S.topic_words("tags", "title").alias("topic"), S.topic_words("tags", "title", 4, 5).alias("search_topic"))


@query("p13_emerging_gate", """SELECT poll_id, video_id, view_count FROM f_polls
  WHERE view_count >= 10000 AND epoch_us(poll_ts) >= epoch_us(TIMESTAMP '2024-01-31 00:00:00') - 72 * 3600000000""")
def _(spark, d):
    as_of = S.ntz_micros(F.expr("TIMESTAMP_NTZ'2024-01-31 00:00:00'"))
    return T.emerging(X.video_polls(spark, d), S.ntz_micros("poll_ts"), as_of, 72, 10_000).select("poll_id", "video_id", "view_count")


_STATS = """SELECT keyword, CAST(printf('%.1f', avg(interest)) AS DOUBLE) AS interest_7d, CAST(printf('%.1f', max(interest)) AS DOUBLE) AS peak_interest,
  arg_max(interest, ts_idx) AS last_value, arg_max(interest, ts_idx) >= avg(interest) * 0.8e0 AS rising FROM f_interest GROUP BY keyword"""
CTES["f_stats"] = _STATS


@query("a01_interest_stats", "SELECT * FROM f_stats")
def _(spark, d):
    return T.interest_stats(X.interest(spark, d))


@query("k02_rank_by_interest", "SELECT keyword, interest_7d FROM f_stats WHERE interest_7d >= 20 ORDER BY interest_7d DESC, keyword")
def _(spark, d):
    return T.rank_by_interest(T.interest_stats(X.interest(spark, d))).select("keyword", "interest_7d")


def _wanted(spark, d):
    nation = X.table(spark, d, "nation").select(F.col("n_name").alias("keyword"))
    seen = X.interest(spark, d).select("keyword").distinct()
    return nation.union(seen)


@query("p14_interest_filter_neutral", """SELECT keyword, coalesce(interest_7d, 50e0) AS interest_7d, coalesce(peak_interest, 50e0) AS peak_interest,
  coalesce(rising, false) AS rising FROM (SELECT n_name AS keyword FROM nation UNION ALL SELECT DISTINCT keyword FROM f_interest)
  LEFT JOIN f_stats USING (keyword) WHERE coalesce(interest_7d, 50e0) >= 20""")
def _(spark, d):
    s = T.with_neutral(_wanted(spark, d), T.interest_stats(X.interest(spark, d)))
    return T.rank_by_interest(s).select("keyword", "interest_7d", "peak_interest", "rising")


@query("s04_interest_series_scan", """SELECT keyword, coalesce(m, 50e0) AS interest_7d, n FROM (SELECT DISTINCT event_type AS keyword FROM f_ev UNION ALL SELECT r_name FROM region)
  LEFT JOIN (SELECT keyword, CAST(printf('%.1f', avg(v)) AS DOUBLE) AS m, count(*) AS n FROM (SELECT event_type AS keyword, date_trunc('day', ts) AS day,
  CAST(sum(k) AS DOUBLE) AS v FROM f_ev GROUP BY 1, 2) GROUP BY 1) USING (keyword)""")
def _(spark, d):
    ev = X.events(spark, d)
    kinds = sorted(X.PLATFORM)
    wide = ev.groupBy(F.date_trunc("day", "ts").alias("ts_idx")).pivot("event_type", kinds).agg(F.sum("k").cast("double"))
    long = wide.unpivot(["ts_idx"], kinds, "keyword", "interest").where(F.col("interest").isNotNull())
    stats = T.interest_stats(long).join(long.groupBy("keyword").agg(F.count(F.lit(1)).alias("n")), "keyword")
    asked = ev.select(F.col("event_type").alias("keyword")).distinct().union(X.table(spark, d, "region").select("r_name"))
    return T.with_neutral(asked, stats).select("keyword", "interest_7d", "n")


def _related(spark, d):
    return X.interest(spark, d).select(
        "keyword", F.col("ts_idx").alias("rank"), F.concat(F.lit("topic "), F.col("k").cast("string")).alias("topic_title"),
        F.when(F.col("k") > 90, "Breakout").otherwise(F.col("k").cast("string")).alias("value"))


CTES["f_related"] = """SELECT keyword, ts_idx AS rank, 'topic ' || CAST(k AS VARCHAR) AS topic_title,
  CASE WHEN k > 90 THEN 'Breakout' ELSE CAST(k AS VARCHAR) END AS value, row_number() OVER (PARTITION BY keyword ORDER BY ts_idx) AS pos FROM f_interest"""


@query("j17_related_topics", """SELECT keyword, interest_7d, string_agg(topic_title, '|' ORDER BY pos) AS related_topics,
  bool_or(pos = 1 AND contains(value, 'Breakout')) AS breakout FROM f_stats JOIN f_related USING (keyword) WHERE pos <= 5 GROUP BY 1, 2""")
def _(spark, d):
    s = T.interest_stats(X.interest(spark, d)).join(T.related_topics(_related(spark, d)), "keyword", "left")
    return s.select("keyword", "interest_7d", F.array_join("related_topics", "|").alias("related_topics"), "breakout")


CTES["f_breakout_kw"] = "SELECT DISTINCT 'TOPIC ' || CAST((k * k) % 40 AS VARCHAR) AS keyword FROM f_ev"
CTES["f_short_kw"] = "SELECT DISTINCT CASE WHEN k < 90 THEN 'C ' || CAST(k AS VARCHAR) || ' V' ELSE CAST(k % 7 AS VARCHAR) || CASE WHEN k % 2 = 0 THEN 'p' ELSE '' END END AS keyword FROM f_ev"


def _breakout_keywords(spark, d):
    return X.events(spark, d).select(F.concat(F.lit("TOPIC "), (F.col("k") * F.col("k") % 40).cast("string")).alias("keyword"))


def _short_keywords(spark, d):
    k = F.col("k")
    short = F.concat((k % 7).cast("string"), F.when(k % 2 == 0, "p").otherwise(""))
    return X.events(spark, d).select(F.when(k < 90, F.concat(F.lit("C "), k.cast("string"), F.lit(" V"))).otherwise(short).alias("keyword"))


@query("j03_breakout_flag", """SELECT arrival_idx, title, EXISTS (SELECT 1 FROM f_breakout_kw WHERE contains(lower(title), lower(keyword))) AS google_breakout FROM f_signals""")
def _(spark, d):
    return T.flag_breakouts(X.signals(spark, d), _breakout_keywords(spark, d)).select("arrival_idx", "title", "google_breakout")


@query("j03_breakout_flag_short_keywords", """SELECT arrival_idx, title, EXISTS (SELECT 1 FROM f_short_kw WHERE contains(lower(title), lower(keyword))) AS google_breakout FROM f_signals""")
def _(spark, d):
    return T.flag_breakouts(X.signals(spark, d), _short_keywords(spark, d)).select("arrival_idx", "title", "google_breakout")


@query("a10_platform_sources", "SELECT array_to_string(list_sort(list(DISTINCT platform)), ',') AS platforms, count(*) AS n FROM f_signals")
def _(spark, d):
    return X.signals(spark, d).groupBy().agg(F.array_join(F.array_sort(F.collect_set("platform")), ",").alias("platforms"),
                                            F.count(F.lit(1)).alias("n"))


@query("f16_z_score", "SELECT arrival_idx, (velocity - 0.5e0) / 0.2e0 AS z FROM f_signals")
def _(spark, d):
    return X.signals(spark, d).select("arrival_idx", S.z_score("velocity").alias("z"))


_SUPER = """SELECT arrival_idx, title, platform, (coalesce(velocity, 0.5e0) - 0.5e0) / 0.2e0 * CASE platform WHEN 'tiktok' THEN 1.2e0 ELSE 1e0 END AS score
  FROM f_signals WHERE (coalesce(velocity, 0.5e0) - 0.5e0) / 0.2e0 * CASE platform WHEN 'tiktok' THEN 1.2e0 ELSE 1e0 END > 1.5e0"""


@query("t01_super_trends_batch", _SUPER)
def _(spark, d):
    return T.super_trends(X.signals(spark, d)).select("arrival_idx", "title", "platform", "score")


_HOURLY = """SELECT platform, CAST(epoch(date_trunc('hour', ts)) AS BIGINT) AS hour_start, count(*) AS n, round(avg(velocity), 6) AS mean,
  round(stddev_pop(velocity), 6) AS std FROM f_signals GROUP BY 1, 2"""


@query("t02_hourly_platform_stats", _HOURLY)
def _(spark, d):
    s = T.hourly_platform_stats(X.signals(spark, d))
    return s.select("platform", F.floor(S.ntz_micros(F.col("window.start")) / 1_000_000).alias("hour_start"), "n",
                    R6("mean").alias("mean"), R6("std").alias("std"))


@query("x08_platform_z", """SELECT arrival_idx, round((velocity - m) / s, 5) AS z FROM f_signals JOIN
  (SELECT platform, avg(velocity) AS m, stddev_pop(velocity) AS s FROM f_signals GROUP BY 1) USING (platform)""")
def _(spark, d):
    return T.platform_z(X.signals(spark, d)).select("arrival_idx", F.round("z", 5).alias("z"))


@query("x01_not_already_trending", """SELECT video_id, title FROM f_candidates WHERE video_id NOT IN (SELECT video_id FROM f_polls)""")
def _(spark, d):
    return X.candidates(spark, d).join(X.video_polls(spark, d).select("video_id"), "video_id", "left_anti").select("video_id", "title")


@query("p31_candidate_lines", """SELECT pos, CAST(pos AS VARCHAR) || '. ''' || title || '''' || CASE WHEN k = 99 THEN ' [BREAKOUT]' ELSE '' END || chr(10) || '   Platform: ' || platform
  || ' | Engagement: ' || format('{:,}', CAST(round_even(engagement * 1000, 0) AS BIGINT)) || ' | Velocity: ' || CASE WHEN k % 2 = 0 THEN CAST(k AS VARCHAR) ELSE 'N/A' END
  || chr(10) || '   Tags: ' || CASE WHEN k % 3 = 0 THEN 'N/A' ELSE platform || ', k' || CAST(k AS VARCHAR) END || chr(10) AS line FROM (SELECT *, row_number() OVER (ORDER BY arrival_idx) AS pos FROM
  (SELECT *, row_number() OVER (PARTITION BY substr(lower(title), 1, 30) ORDER BY arrival_idx) AS rn FROM f_signals) WHERE rn = 1)""")
def _(spark, d):
    s = T.first_seen(X.signals(spark, d), T.similar_title())
    s = O.number_rows(s, [], ["arrival_idx"], "pos", chunk=O.dense_chunk("arrival_idx", 1 << 20), start=1)
    tags = F.when(F.col("k") % 3 == 0, F.array().cast("array<string>")).otherwise(
        F.array("platform", F.concat(F.lit("k"), F.col("k").cast("string"))))
    s = s.withColumns({"tags": tags, "google_breakout": F.col("k") == 99, "engagement": F.col("engagement") * 1000,
                       "velocity_text": F.when(F.col("k") % 2 == 0, F.col("k").cast("string"))})
    return T.candidate_lines(s)
