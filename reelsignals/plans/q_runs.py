"""Queries on runs, progress, inventories and stored pages."""

import uuid

from pyspark.sql import functions as F

from ..operators import runs as N
from ..session import checkpoint_root
from ..sources import files, sinks
from ..sources import pages as G
from . import fixtures as X
from .q_sourcing import stored_files
from .registry import CTES, query


@query("a08_run_rollup", """SELECT c_nationkey AS run_id, bool_or(c_acctbal > 0) AS success, count(*) FILTER (WHERE c_acctbal > 0) AS n_shorts, round(sum(abs(c_acctbal)), 4) AS duration,
  count(*) FILTER (WHERE NOT c_acctbal > 0) AS n_errors, count(*) AS n_videos FROM customer GROUP BY 1""")
def _(spark, d):
    return N.run_rollup(X.run_results(spark, d))


@query("a08_run_errors", "SELECT c_nationkey AS run_id, c_custkey AS video_idx, 0 AS pos, c_mktsegment AS item FROM customer WHERE NOT c_acctbal > 0")
def _(spark, d):
    return N.run_items(X.run_results(spark, d), "errors")


CTES["f_applied"] = """SELECT *, CASE WHEN type = 'step' THEN coalesce(last_value(CASE WHEN type = 'stage_start' THEN stage END IGNORE NULLS) OVER (PARTITION BY run_id ORDER BY seq), 'Unknown') ELSE stage END AS on_stage,
  CASE type WHEN 'stage_start' THEN 0e0 WHEN 'stage_complete' THEN 100e0 WHEN 'step' THEN "current" / total * 100 END AS pct FROM f_progress"""
_W = " ".join(f"WHEN '{k}' THEN {v}" for k, v in N.WEIGHTS.items())
CTES["f_stages"] = f"""SELECT run_id, on_stage, bool_or(type = 'stage_complete') AS done, arg_max(pct, seq) FILTER (WHERE pct IS NOT NULL) AS pct, max(seq) FILTER (WHERE type = 'stage_start') AS started,
  count(*) FILTER (WHERE type = 'error') AS n_errors, CASE on_stage {_W} ELSE 0 END AS weight FROM f_applied GROUP BY 1, 2"""
_PROGRESS = """SELECT run_id, arg_max(on_stage, started) AS current_stage, count(*) FILTER (WHERE done) AS n_completed, CAST(sum(n_errors) AS BIGINT) AS n_errors,
  round(least(100e0, coalesce(sum(weight) FILTER (WHERE done), 0) + coalesce(arg_max(CASE WHEN done THEN 0e0 ELSE weight * pct / 100 END, started), 0e0)), 6) AS overall_pct FROM f_stages GROUP BY 1"""


@query("a14_overall_progress", _PROGRESS)
def _(spark, d):
    p = N.overall_progress(X.progress_events(spark, d))
    return p.withColumn("overall_pct", F.round("overall_pct", 6))


# Limits that are the feature: log lines kept and shown of a run, errors kept.
LOG_KEPT, LOG_SHOWN, ERRORS_KEPT = 1000, 100, 100

CTES["f_loglines"] = """SELECT run_id, seq, CASE type WHEN 'stage_start' THEN '[STAGE] ' || stage WHEN 'step' THEN '  [' || "current" || '/100] (' || "current" || '%) s' WHEN 'stage_complete' THEN '  ✅ ' || stage || ' complete'
  ELSE '  ❌ Error in ' || stage || ': e' END AS line, type, row_number() OVER (PARTITION BY run_id ORDER BY seq DESC) AS age FROM f_progress"""


def lines(spark, d):
    return N.log_lines(X.progress_events(spark, d).withColumns({"step": F.lit("s"), "error": F.lit("e")}))


@query("k06_last_log_lines", "SELECT run_id, seq, line FROM f_loglines WHERE age <= 1000")
def _(spark, d):
    return N.last_entries(lines(spark, d), LOG_KEPT).select("run_id", "seq", "line")


@query("k06_snapshot_log_lines", "SELECT run_id, seq, line FROM f_loglines WHERE age <= 100")
def _(spark, d):
    return N.last_entries(lines(spark, d), LOG_SHOWN).select("run_id", "seq", "line")


@query("k06_last_errors", "SELECT run_id, seq, line FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY seq DESC) AS r FROM f_loglines WHERE type = 'error') WHERE r <= 100")
def _(spark, d):
    return N.last_entries(lines(spark, d).where(F.col("type") == "error"), ERRORS_KEPT).select("run_id", "seq", "line")


@query("s13_file_inventory", """SELECT path, dir AS directory, regexp_extract(path, '([^/]+)$', 1) AS name, CAST(printf('%.1f', length / 1048576e0) AS DOUBLE) AS size_mb FROM f_files WHERE ext IN ('mp4', 'mkv', 'mov')""")
def _(spark, d):
    return N.video_inventory(stored_files(spark, d)).select("path", "directory", "name", "size_mb")


@query("s13_directory_counts", "SELECT dir AS directory, count(*) AS video_count FROM f_files WHERE ext IN ('mp4', 'mkv', 'mov') GROUP BY 1")
def _(spark, d):
    return N.directory_counts(N.video_inventory(stored_files(spark, d)))


def written_files(spark, d):
    """The part table as JSON lines in one folder per bucket of sizes."""
    path = f"{checkpoint_root(spark)}/files/{uuid.uuid4().hex}"
    part = X.table(spark, d, "part").select("p_partkey", "p_name", (F.col("p_size") % 5).alias("bucket"))
    sinks.write_json(part, path, ["bucket"])
    return path


@query("s13_listed_folders", "SELECT CAST(p_size % 5 AS VARCHAR) AS bucket, true AS has_files FROM part GROUP BY 1")
def _(spark, d):
    listed = files.list_files(spark, written_files(spark, d), "*.json")
    return listed.groupBy(F.regexp_extract("path", "/bucket=([^/]+)/", 1).alias("bucket")).agg(F.bool_or(F.col("length") > 0).alias("has_files"))


@query("s13_text_lines", "SELECT CAST(p_size % 5 AS VARCHAR) AS bucket, p_partkey, p_name FROM part")
def _(spark, d):
    read = files.text_lines(spark, written_files(spark, d))
    row = F.from_json("value", "p_partkey bigint, p_name string")
    return read.select(F.regexp_extract("file", "/bucket=([^/]+)/", 1).alias("bucket"), row.alias("r")).select("bucket", "r.*")


@query("j15_output_inventory", """SELECT p_brand AS output, 's' || p_partkey AS short, p_size >= 10 AS has_video, CASE WHEN p_size >= 30 THEN p_brand || '/s' || p_partkey || '/reframed.mp4' WHEN p_size >= 10 THEN p_brand || '/s' || p_partkey || '/a.mp4' END AS video_path,
  CASE WHEN p_retailprice > 1000 THEN p_name END AS metadata, CASE WHEN p_type = 'PROMO' THEN p_type END AS ai FROM part""")
def _(spark, d):
    p = X.table(spark, d, "part").withColumnsRenamed({"p_brand": "output"}).withColumn("short", F.concat(F.lit("s"), F.col("p_partkey").cast("string")))
    names = F.when(F.col("p_size") >= 30, F.array(F.lit("a.mp4"), F.lit("reframed.mp4"), F.lit("b.txt"))).when(F.col("p_size") >= 10, F.array(F.lit("b.mp4"), F.lit("a.mp4"))).otherwise(F.array(F.lit("b.txt")))
    r = N.short_inventory(p.select("output", "short"), p.select("output", "short", F.explode(names).alias("file")),
                          p.where("p_retailprice > 1000").select("output", "short", F.col("p_name").alias("metadata")),
                          p.where("p_type = 'PROMO'").select("output", "short", F.col("p_type").alias("ai")))
    return r.select("output", "short", "has_video", "video_path", "metadata", "ai")


@query("a18_resume_state", """SELECT c_custkey AS run_id, CASE WHEN seg >= 4 AND c_acctbal > 5000 THEN 0 WHEN seg >= 3 THEN 2 WHEN seg >= 2 THEN 1 ELSE 0 END AS phase, CASE WHEN seg >= 3 AND NOT (seg >= 4 AND c_acctbal > 5000) THEN 'dl/x/video.mp4' END AS video_path
  FROM (SELECT *, CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 1 WHEN 'BUILDING' THEN 2 WHEN 'FURNITURE' THEN 3 ELSE 4 END AS seg FROM customer)""")
def _(spark, d):
    c = X.table(spark, d, "customer")
    seg = F.when(F.col("c_mktsegment") == "AUTOMOBILE", 1).when(F.col("c_mktsegment") == "BUILDING", 2).when(F.col("c_mktsegment") == "FURNITURE", 3).otherwise(4)
    paths = F.slice(F.array(F.lit("log.txt"), F.lit("content_brief.json"), F.lit("dl/x/video.mp4"), F.lit("pipeline_run.json")), F.lit(1), seg)
    files = c.select(F.col("c_custkey").alias("run_id"), F.explode(paths).alias("path"))
    metas = c.select(F.col("c_custkey").alias("run_id"), F.when(F.col("c_acctbal") > 5000, F.array(F.lit("output_qa"))).otherwise(F.array(F.lit("sourcing"))).alias("phases_completed"))
    return N.resume_state(files, metas)


@query("x07_quarantine", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P' GROUP BY 1 HAVING count(*) > 2)")
def _(spark, d):
    o = X.table(spark, d, "orders")
    return N.quarantine(o.select("o_orderkey", "o_custkey"), o.where("o_orderstatus = 'P'").select("o_custkey"), "o_custkey")


_ARTICLE = G.element(G.tag("article"))
_FIELDS = {"title": (G.element(G.tag("h1")), None), "url": (G.element(G.tag("a")), "href")}
CTES["f_items"] = """SELECT page_id, 0 AS item_idx, replace(replace(replace(replace(replace(regexp_replace(regexp_extract(html, '(?s)<article[^>]*>.*?<h1[^>]*>(.*?)</h1>', 1), '<[^>]*>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&nbsp;', ' '), '&amp;', '&') AS title,
  replace(regexp_extract(html, '(?s)<article[^>]*>.*?<a [^>]*href="([^"]*)"', 1), '&amp;', '&') AS url, regexp_extract(url, '://([^/]+)', 1) AS host FROM pages WHERE contains(html, '<article')"""


@query("s01_page_extraction", "SELECT page_id, item_idx, trim(title) AS title, nullif(url, '') AS url FROM f_items")
def _(spark, d):
    return G.extract_pages(X.table(spark, d, "pages"), _ARTICLE, _FIELDS)


@query("s01_first_nonempty_page", "SELECT host, page_id FROM (SELECT host, page_id, row_number() OVER (PARTITION BY host ORDER BY page_id) AS rn FROM f_items) WHERE rn = 1")
def _(spark, d):
    p = X.table(spark, d, "pages")
    items = G.extract_pages(p, _ARTICLE, _FIELDS).join(p.select("page_id", F.regexp_extract("url", "://([^/]+)", 1).alias("host")), "page_id")
    return G.first_nonempty(items, "host", "page_id").select("host", "page_id").distinct()
