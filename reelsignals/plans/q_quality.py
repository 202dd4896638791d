"""Queries on quality reports, drift, black frames, thumbnails and contracts."""

import pandas as pd
from pyspark.sql import functions as F

from ..operators import hooks as H
from ..operators import qa as QA
from ..operators import signals as T
from ..sources import documents as D
from . import fixtures as X
from .q_sourcing import probes
from .registry import CTES, query

R6 = lambda c: F.round(c, 6)


@query("a05_av_drift", """SELECT media_id, round(greatest(CASE WHEN has_audio THEN audio_start ELSE 0e0 END, CASE WHEN has_video AND has_audio AND duration > 0 THEN abs(duration - audio_duration) ELSE 0e0 END), 6) AS drift,
  greatest(CASE WHEN has_audio THEN audio_start ELSE 0e0 END, CASE WHEN has_video AND has_audio AND duration > 0 THEN abs(duration - audio_duration) ELSE 0e0 END) < 0.1e0 AS passed FROM f_probes""")
def _(spark, d):
    p = probes(spark, d).withColumn("x", QA.av_drift(F.col("streams")))
    return p.select("media_id", R6("x").alias("drift"), (F.col("x") < 0.1).alias("passed"))


def tool_lines(spark, d):
    """Five tool output lines per order."""
    k = F.col("o_orderkey")
    dur = F.element_at(F.array(*[F.lit(v) for v in ("3.01", "0.2", "1.5", "2.96")]), (k % 4 + 1).cast("int"))
    start = F.when(k % 3 == 0, "0").when(k % 3 == 1, "0.04").otherwise("12.5")
    lines = F.array(
        F.lit("Stream mapping:"),
        F.concat(F.lit("[blackdetect @ 0x1] black_start:"), start, F.lit(" black_end:20.5 black_duration:"), dur),
        F.when(k % 5 == 0, "[blackdetect @ 0x1] black_start:30 black_end:31 black_duration:0.75").otherwise("frame= 100"),
        F.when(k % 6 == 1, "[Parsed_volumedetect_0] mean_volume: n/a dB").otherwise("size= 4"),
        F.when(k % 2 == 0, F.concat(F.lit("[Parsed_volumedetect_0] mean_volume: -"), (k % 90).cast("string"), F.lit(".5 dB"))).otherwise("done"))
    return X.table(spark, d, "orders").select(k.alias("media_id"), F.posexplode(lines).alias("line_idx", "line"))


CTES["f_logs"] = """SELECT o_orderkey AS media_id, CASE o_orderkey % 4 WHEN 0 THEN 3.01e0 WHEN 1 THEN 0.2e0 WHEN 2 THEN 1.5e0 ELSE 2.96e0 END + CASE WHEN o_orderkey % 5 = 0 THEN 0.75e0 ELSE 0e0 END AS black_seconds,
  CASE WHEN o_orderkey % 2 = 0 THEN -(o_orderkey % 90 + 0.5e0) END AS mean_db, o_orderkey % 3 < 2 AND o_orderkey % 4 IN (0, 3) AS black_opening FROM orders"""


@query("s11_tool_log_scan", "SELECT media_id, round(black_seconds, 6) AS black_seconds, mean_db, black_opening FROM f_logs")
def _(spark, d):
    return D.scan_tool_logs(tool_lines(spark, d)).select("media_id", R6("black_seconds").alias("black_seconds"), "mean_db", "black_opening")


@query("a06_black_fraction", """SELECT media_id, round(CASE WHEN duration > 0 THEN black_seconds / duration ELSE 0e0 END, 6) AS fraction, CASE WHEN duration > 0 THEN black_seconds / duration ELSE 0e0 END < 0.02e0 AS passed FROM f_logs JOIN f_probes USING (media_id)""")
def _(spark, d):
    j = probes(spark, d).join(D.scan_tool_logs(tool_lines(spark, d)), "media_id", "left")
    x = QA.black_fraction(F.col("black_seconds"), F.col("duration"))
    return j.select("media_id", R6(x).alias("fraction"), (x < 0.02).alias("passed"))


CTES["f_checks"] = """SELECT media_id, [CASE WHEN has_video THEN width = 1080 AND height = 1920 END, CASE WHEN has_video THEN (CASE WHEN fps_text = '24' THEN 0e0 ELSE fps END) >= 29 END, duration BETWEEN 30 AND 3000,
  CASE WHEN has_audio AND has_video THEN greatest(audio_start, abs(duration - audio_duration)) < 0.1e0 WHEN NOT has_audio THEN false END, (CASE WHEN duration > 0 THEN black_seconds / duration ELSE 0e0 END) < 0.02e0, NOT black_opening,
  coalesce(mean_db > -60, true), CASE WHEN n_words > 0 THEN true END] AS c FROM f_probes JOIN f_logs USING (media_id) LEFT JOIN (SELECT doc_id AS media_id, n_chars AS n_words FROM documents) USING (media_id)"""
_NAMES = "['Resolution', 'Frame Rate', 'Duration', 'Audio Sync', 'Black Frames', 'Hook (First 3s)', 'Natural Ending', 'Captions']"


def checks(spark, d):
    words = X.table(spark, d, "documents").select(F.col("doc_id").alias("media_id"), F.col("n_chars").alias("n_words"))
    return QA.qa_checks(probes(spark, d), D.scan_tool_logs(tool_lines(spark, d)), words, max_sec=3000.0)


@query("a04_qa_checks", f"SELECT media_id, name, passed FROM (SELECT media_id, unnest({_NAMES}) AS name, unnest(c) AS passed FROM f_checks) WHERE passed IS NOT NULL")
def _(spark, d):
    return QA.check_rows(checks(spark, d)).select("media_id", "name", "passed")


CTES["f_reports"] = """SELECT media_id, score, coalesce(c[1], true) AND c[3] AND coalesce(c[4], true) AND score >= 70 AS overall_passed FROM (SELECT *, len(list_filter(c, lambda x: x)) / len(list_filter(c, lambda x: x IS NOT NULL)) * 100 AS score FROM f_checks)"""


@query("a04_qa_report", "SELECT media_id, round(score, 6) AS score, overall_passed FROM f_reports")
def _(spark, d):
    return QA.qa_report(checks(spark, d)).select("media_id", R6("score").alias("score"), "overall_passed")


@query("a07_batch_verdict", "SELECT o_orderpriority AS batch, bool_and(overall_passed) AS all_passed, count(*) AS n, count(*) FILTER (WHERE overall_passed) AS n_passed FROM f_reports JOIN orders ON o_orderkey = media_id GROUP BY 1")
def _(spark, d):
    o = X.table(spark, d, "orders").select(F.col("o_orderkey").alias("media_id"), F.col("o_orderpriority").alias("batch"))
    return QA.batch_verdict(QA.qa_report(checks(spark, d)).join(o, "media_id"), "batch")


@query("p27_thumbnail_time", """WITH m AS (SELECT o_orderkey AS media_id, CASE WHEN o_totalprice / 100 > 0 THEN o_totalprice / 100 ELSE 60e0 END AS dur, CASE WHEN o_orderstatus = 'P' THEN 5e0 END AS given FROM orders),
  t AS (SELECT media_id, pos, dur * 0.25e0 + off AS ts FROM m, (VALUES (0, 0e0), (1, 0.5e0), (2, 1e0), (3, 1.5e0), (4, 2e0), (5, 3e0), (6, 5e0)) AS v(pos, off) WHERE pos = 0 OR dur * 0.25e0 + off < dur),
  ok AS (SELECT media_id, arg_min(ts, pos) AS found FROM t WHERE NOT EXISTS (SELECT 1 FROM f_black b WHERE b.media_id = t.media_id AND ts BETWEEN b_start AND b_end) GROUP BY 1)
  SELECT media_id, greatest(0e0, least(coalesce(given, found, dur * 0.5e0), dur - 0.1e0)) AS thumbnail_ts FROM m LEFT JOIN ok USING (media_id)""")
def _(spark, d):
    m = X.table(spark, d, "orders").select(
        F.col("o_orderkey").alias("media_id"), (F.col("o_totalprice") / 100).alias("duration"), F.lit(None).cast("double").alias("ai_ts"),
        F.when(F.col("o_orderstatus") == "P", 5.0).alias("meta_ts"))
    return QA.thumbnail_times(m, X.black_intervals(spark, d))


@query("p24_contract_check", """SELECT doc_id, CASE WHEN length(text) > 5000 THEN 'description longer than 5000' ELSE '' END || '|' || CASE WHEN length(text) > 100 THEN 'title longer than 100' ELSE '' END AS found FROM documents""")
def _(spark, d):
    t = X.table(spark, d, "documents").select(
        "doc_id", F.col("text").alias("title"), F.col("text").alias("description"),
        F.array("lang").alias("tags"), F.array("source").alias("hashtags"))
    v = t.withColumn("v", QA.contract("metadata"))
    has = lambda m: F.when(F.array_contains("v", m), m).otherwise("")
    return v.select("doc_id", F.concat(has("description longer than 5000"), F.lit("|"), has("title longer than 100")).alias("found"))


@query("h02_pluggable_ranker", """SELECT arrival_idx, round(least(100e0, greatest(0e0, (velocity - 0.5e0) / 0.2e0 * CASE platform WHEN 'tiktok' THEN 1.2e0 ELSE 1e0 END * 20 + 50)), 6) AS viral_score, 0 AS n_violations FROM f_signals""")
def _(spark, d):
    r = H.rank_trends(T.platform_weighted_score(X.signals(spark, d)))
    return r.select("arrival_idx", R6("viral_score").alias("viral_score"), F.size("violations").alias("n_violations"))


@query("h02_plugged_scorer", """SELECT arrival_idx, round(velocity * 150 - 10, 6) AS viral_score, CASE WHEN velocity * 150 - 10 BETWEEN 0 AND 100 THEN 0 ELSE 1 END AS n_violations FROM f_signals""")
def _(spark, d):
    @F.pandas_udf("double")
    def scorer(velocity: pd.Series) -> pd.Series:
        return velocity * 150 - 10

    r = H.rank_trends(X.signals(spark, d), scorer, "velocity")
    return r.select("arrival_idx", R6("viral_score").alias("viral_score"), F.size("violations").alias("n_violations"))


@query("h02_planned_cuts", """SELECT media_id, row_number() OVER (PARTITION BY media_id ORDER BY viral_score DESC, moment_idx) - 1 AS segment_idx, moment_idx, start_time,
  least(end_time, start_time + 90) AS end_time, viral_score, 0 AS n_violations FROM f_moments""")
def _(spark, d):
    p = H.plan_cuts(X.moments(spark, d))
    return p.select("media_id", F.col("segment_idx").cast("long").alias("segment_idx"), "moment_idx", "start_time", "end_time", "viral_score", F.size("violations").alias("n_violations"))


@query("h02_generated_metadata", r"""SELECT doc_id, substr(CASE WHEN trim(source) <> '' THEN trim(source) WHEN t <> '' THEN t ELSE chr(128293) || ' Must Watch!' END, 1, 100) AS title,
  substr(CASE WHEN t <> '' THEN t ELSE 'Check out this amazing content.' END, 1, 5000) AS description, 'viral|trending|shorts' AS tags, 0 AS n_violations
  FROM (SELECT *, regexp_replace(text, '^\s+|\s+$', '', 'g') AS t FROM documents)""")
def _(spark, d):
    g = H.generate_metadata(X.table(spark, d, "documents").select("doc_id", F.col("source").alias("theme"), "text"))
    return g.select("doc_id", "title", "description", F.array_join("tags", "|").alias("tags"), F.size("violations").alias("n_violations"))


@query("h02_checked_quality", """SELECT doc_id, a + b + c + e >= 3 AS passes, (a + b + c + e) * 25e0 AS overall_score, concat_ws('|', CASE WHEN a = 0 THEN 'hook_present' END,
  CASE WHEN b = 0 THEN 'coherent' END, CASE WHEN c = 0 THEN 'natural_ending' END, CASE WHEN e = 0 THEN 'captions_accurate' END) AS issues, 0 AS n_violations FROM (SELECT doc_id,
  CASE WHEN n_chars % 7 <= 3 THEN 1 ELSE 0 END AS a, CASE WHEN length(text) >= 20 THEN 1 ELSE 0 END AS b, CASE WHEN regexp_matches(text, '[.!?][ \n]*$') THEN 1 ELSE 0 END AS c,
  CASE WHEN doc_id % 3 <> 0 OR lower(source) = lower(text) THEN 1 ELSE 0 END AS e FROM documents)""")
def _(spark, d):
    c = X.table(spark, d, "documents").select(
        "doc_id", F.col("text").alias("transcript"), F.when(F.col("doc_id") % 3 != 0, F.col("text")).otherwise(F.col("source")).alias("captions"),
        (F.col("n_chars") % 7).cast("double").alias("hook_start"))
    q = H.check_quality(c)
    return q.select("doc_id", "passes", "overall_score", F.array_join("issues", "|").alias("issues"), F.size("violations").alias("n_violations"))


@query("h01_job_handler", """SELECT o_orderkey AS job_id, CASE WHEN o_orderstatus = 'P' THEN 'failed' ELSE 'completed' END AS status, CASE WHEN o_orderstatus <> 'P' THEN upper(o_orderpriority) END AS result,
  CASE WHEN o_orderstatus = 'P' THEN 'cannot handle P' END AS error FROM orders""")
def _(spark, d):
    def handler(kind, payload):
        if kind == "P":
            raise ValueError(f"cannot handle {kind}")
        return payload.upper()

    jobs = X.table(spark, d, "orders").select(
        F.col("o_orderkey").alias("job_id"), F.col("o_orderstatus").alias("job_type"), F.lit("pending").alias("status"), F.col("o_orderpriority").alias("payload"))
    return H.run_jobs(jobs, handler, ["F", "O", "P"]).select("job_id", "status", "result", "error")


@query("h03_default_enhancement", """SELECT doc_id, CASE WHEN quality = 1 THEN 'Doc ' || doc_id ELSE '🔥 Must Watch!' END AS title, CASE WHEN quality = 1 THEN 90 ELSE 50 END AS hook_score FROM documents LEFT JOIN labels USING (doc_id)""")
def _(spark, d):
    t = X.table(spark, d, "documents").select("doc_id").join(X.table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    std = H.default_enhancement()
    scored = F.when(F.col("quality") == 1, F.struct(F.concat(F.lit("Doc "), F.col("doc_id").cast("string")).alias("title"), F.lit(90).alias("hook_score")))
    e = H.with_default(scored, F.struct(std["title"].alias("title"), std["hook_score"].alias("hook_score")))
    return t.select("doc_id", e.alias("e")).select("doc_id", "e.title", "e.hook_score")


@query("p31_segment_info", """SELECT media_id, moment_idx, 'Topic: t' || media_id || chr(10) || 'Hook: ' || chr(10) || 'Duration: ' || CAST(CAST(end_time - start_time AS BIGINT) AS VARCHAR) || 's' || chr(10) || 'Audience: General' AS info FROM f_moments""")
def _(spark, d):
    m = X.moments(spark, d).withColumns({"theme": F.concat(F.lit("t"), F.col("media_id").cast("string")), "hook": F.lit(None).cast("string"), "audience": F.lit(None).cast("string")})
    return m.select("media_id", "moment_idx", H.segment_info("theme", "hook", "start_time", "end_time", "audience").alias("info"))
