"""Queries on moments, edit decisions and model output."""

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import edl as E
from ..operators import transcripts as W
from ..sources import documents as D
from . import fixtures as X
from .registry import CTES, query

CTES["f_clamped"] = "SELECT *, least(end_time, start_time + 90) AS source_end, least(end_time, start_time + 90) - start_time AS output_duration FROM f_moments"


@query("p30_clip_clamp", "SELECT media_id, moment_idx, source_end, output_duration, 'normal' AS pacing, 0.5e0 AS hook_score FROM f_clamped")
def _(spark, d):
    return E.clamp_moments(X.moments(spark, d)).select("media_id", "moment_idx", "source_end", "output_duration", "pacing", "hook_score")


@query("w11_timeline_offsets", """SELECT media_id, moment_idx, coalesce(sum(output_duration) OVER (PARTITION BY media_id ORDER BY moment_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0e0) AS output_start,
  sum(output_duration) OVER (PARTITION BY media_id) AS total_output_duration, count(*) OVER (PARTITION BY media_id) AS segments_count FROM f_clamped""")
def _(spark, d):
    return E.timeline(E.clamp_moments(X.moments(spark, d))).select("media_id", "moment_idx", "output_start", "total_output_duration", "segments_count")


@query("k04_first_moments", "SELECT media_id, moment_idx FROM f_moments WHERE moment_idx < 2")
def _(spark, d):
    return E.timeline(E.clamp_moments(X.moments(spark, d)), num_shorts=2).select("media_id", "moment_idx")


@query("k07_needed_frames", """SELECT d.media_id, frame_idx, track_id FROM f_dets d JOIN (SELECT media_id, CAST(trunc(max(end_time) * 30) AS BIGINT) + 150 AS last FROM
  (SELECT doc_id AS media_id, (doc_id % 7) * 0.5e0 AS end_time FROM documents) GROUP BY 1) USING (media_id) WHERE frame_idx <= last""")
def _(spark, d):
    spans = X.table(spark, d, "documents").select(F.col("doc_id").alias("media_id"), ((F.col("doc_id") % 7) * 0.5).alias("end_time"))
    return E.frames_needed(spans, X.detections(spark, d)).select("media_id", "frame_idx", "track_id")


@query("x03_snap_to_words", """SELECT m.media_id, moment_idx, start_time, coalesce(arg_min(w."start", abs(w."start" - start_time) * 1e6 + w."start" / 1e6), start_time) AS start_time_snapped
  FROM f_moments m LEFT JOIN f_doc_words w ON m.media_id = w.media_id GROUP BY 1, 2, 3""")
def _(spark, d):
    return E.snap_to(X.moments(spark, d), X.doc_words(spark, d), "start_time", "start").select("media_id", "moment_idx", "start_time", "start_time_snapped")


@query("x02_best_moments", """WITH RECURSIVE ranked AS (SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY viral_score DESC, moment_idx) AS r FROM f_moments),
  picks AS (SELECT media_id, r, [{'s': start_time, 'e': end_time, 'i': moment_idx}] AS kept FROM ranked WHERE r = 1
    UNION ALL SELECT p.media_id, m.r, CASE WHEN len(list_filter(kept, lambda k: m.start_time < k.e AND k.s < m.end_time)) > 0 THEN kept ELSE list_append(kept, {'s': m.start_time, 'e': m.end_time, 'i': m.moment_idx}) END
    FROM picks p JOIN ranked m ON m.media_id = p.media_id AND m.r = p.r + 1)
  SELECT media_id, k.i AS moment_idx FROM (SELECT media_id, unnest(kept) AS k FROM picks WHERE r = 3)""")
def _(spark, d):
    return E.best_moments(X.moments(spark, d)).select("media_id", "moment_idx")


def model_texts(spark, d):
    k = F.col("o_orderkey")
    st = (k % 50).cast("double")
    item = F.struct(st.alias("start_time"), F.when(k % 2 == 0, st + 20).alias("end_time"), F.lit("h").alias("hook"), F.when(k % 3 == 0, k % 10 / 10).alias("viral_score"))
    good = F.concat(F.lit("Sure: "), F.to_json(F.array(item, item)), F.lit(" done"))
    text = F.when(k % 5 == 3, "nothing here").when(k % 5 == 4, "see [1, broken} ]").otherwise(good)
    return X.table(spark, d, "orders").select(k.alias("media_id"), (F.col("o_totalprice") / 1000).alias("duration"), text.alias("response"))


@query("s12_model_moments", """SELECT o_orderkey AS media_id, i AS moment_idx, CAST(o_orderkey % 50 AS DOUBLE) AS start_time, CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_orderkey % 50 AS DOUBLE) + 20 ELSE 30e0 END AS end_time,
  'h' AS hook, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % 10 / 10 ELSE 0.5e0 END AS viral_score FROM orders, (VALUES (0), (1)) AS v(i) WHERE o_orderkey % 5 < 3
  UNION ALL SELECT o_orderkey, i, i * least(60e0, o_totalprice / 1000 / 3), least(i * least(60e0, o_totalprice / 1000 / 3) + least(60e0, o_totalprice / 1000 / 3), o_totalprice / 1000), 'Segment ' || (i + 1), 0.3e0
  FROM orders, (VALUES (0), (1), (2)) AS v(i) WHERE o_orderkey % 5 = 4""")
def _(spark, d):
    return D.scan_model_moments(model_texts(spark, d)).select("media_id", "moment_idx", "start_time", "end_time", "hook", "viral_score")


@query("f18_json_extraction", """SELECT o_orderkey AS media_id, CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority ELSE 'Unknown' END AS theme, CASE WHEN o_orderkey % 3 = 0 THEN o_orderstatus ELSE 'General' END AS audience FROM orders""")
def _(spark, d):
    k = F.col("o_orderkey")
    js = F.concat(F.lit("Here {"), F.lit('"theme": "'), "o_orderpriority", F.lit('", "audience": "'), "o_orderstatus", F.lit('"} ok'))
    t = X.table(spark, d, "orders").select(k.alias("media_id"), F.when(k % 3 == 0, js).when(k % 3 == 1, "no object").otherwise("{bad").alias("response"))
    return D.scan_theme(t).select("media_id", "theme", "audience")


@query("p28_frame_samples", """SELECT media_id, CAST(i AS INTEGER) AS sample_idx, round(i * (duration - 0.1e0) / 15, 6) AS at, i >= 4 AND i % 4 = 0 AS scene_sample, i % 2 = 0 AS viral_sample
  FROM (SELECT o_orderkey AS media_id, o_totalprice / 100 AS duration, unnest(range(16)) AS i FROM orders)""")
def _(spark, d):
    m = X.table(spark, d, "orders").select(F.col("o_orderkey").alias("media_id"), (F.col("o_totalprice") / 100).alias("duration"))
    return E.sample_times(m, 16).select("media_id", "sample_idx", F.round("at", 6).alias("at"), "scene_sample", "viral_sample")


@query("h04_scene_responses", """SELECT media_id, sample_idx, response FROM (SELECT o_custkey AS media_id, o_orderkey AS sample_idx, o_orderpriority || CASE WHEN o_orderstatus = 'F' THEN ' same' ELSE ' new' END AS response FROM orders)
  WHERE sample_idx >= 4 AND sample_idx % 4 = 0 AND NOT contains(upper(response), 'SAME')""")
def _(spark, d):
    r = X.table(spark, d, "orders").select(F.col("o_custkey").alias("media_id"), F.col("o_orderkey").alias("sample_idx"), F.concat(
        "o_orderpriority", F.when(F.col("o_orderstatus") == "F", " same").otherwise(" new")).alias("response"))
    return E.scene_changes(r)
