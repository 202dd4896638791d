"""Queries over video lists, candidates, probes and attempts."""

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import signals as T
from ..operators import sourcing as Q
from ..sources import documents as D
from . import fixtures as X
from .registry import CTES, query


def video_pages(spark, d):
    """One stored list response per part, with odd items that must vanish."""
    p = X.table(spark, d, "part").join(X.candidates(spark, d).withColumnRenamed("video_id", "p_partkey"), "p_partkey")
    k = F.col("p_partkey")
    views = F.when(k % 17 == 0, F.lit(None)).when(k % 19 == 0, "many").otherwise(F.col("view_count").cast("string"))
    url = lambda kind: F.struct(F.concat(F.lit(f"http://img/{kind}/"), k.cast("string")).alias("url"))
    item = F.struct(
        F.when(k % 23 > 0, F.concat(F.lit("v"), k.cast("string"))).alias("id"),
        F.struct(F.col("title"), F.lit("2023-12-31T00:00:00Z").alias("publishedAt"), F.array("p_brand", "p_type").alias("tags"),
                 F.struct(F.when(k % 2 == 0, url("maxres")).alias("maxres"), F.when(k % 3 == 0, url("high")).alias("high"),
                          url("default").alias("default")).alias("thumbnails")).alias("snippet"),
        F.struct(views.alias("viewCount"), F.col("like_count").cast("string").alias("likeCount")).alias("statistics"),
        F.struct(F.format_string("PT%dM%dS", F.floor(F.col("duration_seconds") / 60), F.col("duration_seconds") % 60).alias("duration")).alias("contentDetails"))
    return p.select(k.alias("page_id"), F.to_json(F.struct(F.array(item).alias("items"))).alias("response"))


CTES["f_video_list"] = """SELECT video_id AS page_id, 'v' || CAST(video_id AS VARCHAR) AS video_id, title, CASE WHEN video_id % 17 = 0 THEN 0 ELSE view_count END AS view_count,
  like_count, 0 AS comment_count, 'http://img/' || CASE WHEN video_id % 2 = 0 THEN 'maxres' WHEN video_id % 3 = 0 THEN 'high' ELSE 'default' END || '/' || CAST(video_id AS VARCHAR) AS thumbnail_url,
  duration_seconds, p_brand || ' ' || p_type || ' ' || array_to_string(list_slice(string_split(title, ' '), 1, 4), ' ') AS topic
  FROM f_candidates JOIN part ON p_partkey = video_id WHERE video_id % 23 > 0 AND (video_id % 17 = 0 OR video_id % 19 > 0)"""


@query("s02_video_list_scan", "SELECT video_id, title, view_count, like_count, comment_count, duration_seconds, topic FROM f_video_list")
def _(spark, d):
    return D.scan_video_lists(video_pages(spark, d)).select(
        "video_id", "title", "view_count", "like_count", "comment_count", "duration_seconds", "topic")


@query("p08_thumbnail_preference", "SELECT video_id, thumbnail_url FROM f_video_list")
def _(spark, d):
    return D.scan_video_lists(video_pages(spark, d)).select("video_id", "thumbnail_url")


def search_pages(spark, d):
    li = X.table(spark, d, "orders")
    hit = lambda v: F.struct(F.struct(F.lit("x").alias("kind"), v.cast("string").alias("videoId")).alias("id"))
    k = F.col("o_orderkey")
    items = F.array(hit(k), hit(F.when(k % 3 > 0, k + 1)), hit(F.when(k % 5 > 0, k + 2)))
    return li.select(k.alias("page_id"), F.to_json(F.struct(items.alias("items"))).alias("response"))


CTES["f_hits"] = """SELECT o_orderkey AS page_id, pos, CASE pos WHEN 0 THEN o_orderkey WHEN 1 THEN CASE WHEN o_orderkey % 3 > 0 THEN o_orderkey + 1 END
  ELSE CASE WHEN o_orderkey % 5 > 0 THEN o_orderkey + 2 END END AS video_id FROM orders, (VALUES (0), (1), (2)) AS v(pos)"""


@query("s03_search_hit_scan", "SELECT page_id, pos, CAST(video_id AS VARCHAR) AS video_id FROM f_hits WHERE video_id IS NOT NULL")
def _(spark, d):
    return D.scan_search_hits(search_pages(spark, d), "response", "page_id").select("page_id", "pos", "video_id")


@query("j02_id_enrichment", "SELECT page_id, h.video_id, title, view_count FROM f_hits h JOIN f_candidates c ON h.video_id = c.video_id")
def _(spark, d):
    hits = D.scan_search_hits(search_pages(spark, d), "response", "page_id").select("page_id", F.col("video_id").cast("bigint").alias("video_id"))
    return Q.enrich(hits, X.candidates(spark, d)).select("page_id", "video_id", "title", "view_count")


@query("f01_iso_duration", """SELECT page_id, CAST(duration_seconds AS INTEGER) AS seconds, CAST(page_id % 3600 * 60 + page_id % 60 AS INTEGER) AS seconds2, 0 AS junk FROM f_video_list""")
def _(spark, d):
    v = D.scan_video_lists(video_pages(spark, d), "response", "page_id")
    k = F.col("page_id")
    iso = F.format_string("pt%dh%dM%ds", F.floor((k % 3600) / 60), (k % 3600) % 60, k % 60)
    return v.select("page_id", F.col("duration_seconds").alias("seconds"), S.parse_iso_duration(iso).alias("seconds2"),
                    S.parse_iso_duration(F.concat(F.lit("P1D"), iso)).alias("junk"))


@query("f02_duration_label", """SELECT video_id, CASE WHEN s >= 3600 THEN printf('%d:%02d:%02d', s // 3600, (s % 3600) // 60, s % 60) ELSE printf('%d:%02d', s // 60, s % 60) END AS label
  FROM (SELECT video_id, CAST(duration_seconds * 7 AS BIGINT) AS s FROM f_candidates)""")
def _(spark, d):
    return X.candidates(spark, d).select("video_id", S.format_duration(F.col("duration_seconds") * 7).alias("label"))


_HIT = """CASE WHEN contains(lower(title), 'highlights') THEN 'highlights' WHEN contains(lower(title), 'shorts') THEN 'shorts' WHEN contains(lower(title), 'clip') THEN 'clip'
  WHEN contains(lower(title), 'reaction') THEN 'reaction' END"""
CTES["f_gated"] = f"""SELECT *, duration_seconds BETWEEN 900 AND 1800 AND view_count >= 10000 AND hit IS NULL AS passes_quality FROM (SELECT *, {_HIT} AS hit,
  printf('%d:%02d', CAST(duration_seconds // 60 AS BIGINT), CAST(duration_seconds % 60 AS BIGINT)) AS lbl FROM f_candidates)"""


@query("p09_quality_gate", """SELECT video_id, passes_quality, CASE WHEN duration_seconds < 900 THEN 'Too short (' || lbl || ' < 15 min)' WHEN duration_seconds > 1800 THEN 'Too long (' || lbl || ' > 60 min)'
  ELSE 'Duration OK (' || lbl || ')' END || ';' || CASE WHEN view_count < 10000 THEN 'Too few views (' || format('{:,}', view_count) || ' < 10,000)' ELSE 'Views OK (' || format('{:,}', view_count) || ')' END
  || ';' || CASE WHEN hit IS NULL THEN 'No watermark indicators' ELSE 'Watermark indicator: ''' || hit || ''' in title' END AS notes FROM f_gated""")
def _(spark, d):
    return Q.quality_gate(X.candidates(spark, d)).select("video_id", "passes_quality", F.array_join("quality_notes", ";").alias("notes"))


def _queries_by_brand_and_size(spark, d):
    """Search queries fine enough for some to have no passing candidate."""
    c = X.candidates(spark, d)
    return c.withColumn("query_id", F.concat("query_id", F.lit("/"), F.col("duration_seconds").cast("string")))


CTES["f_sel"] = """SELECT *, bool_or(passes_quality) OVER (PARTITION BY qid) AS any_pass, row_number() OVER (PARTITION BY qid ORDER BY view_count DESC, video_id) AS rn FROM
  (SELECT *, query_id || '/' || CAST(duration_seconds AS VARCHAR) AS qid FROM f_gated WHERE duration_seconds BETWEEN 900 AND 1800)"""
CTES["f_selected"] = "SELECT qid AS query_id, video_id, view_count, NOT any_pass AS relaxed FROM f_sel WHERE (any_pass AND passes_quality) OR (NOT any_pass AND rn <= 5)"
CTES["f_queue"] = """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY view_count DESC, video_id) AS rank FROM f_selected) WHERE rank <= 3"""


@query("p10_relaxed_gate", "SELECT query_id, video_id, relaxed FROM f_selected")
def _(spark, d):
    return Q.select_candidates(Q.quality_gate(_queries_by_brand_and_size(spark, d))).select("query_id", "video_id", "relaxed")


@query("k04_attempt_queue", "SELECT query_id, video_id, rank FROM f_queue")
def _(spark, d):
    return Q.queue(Q.select_candidates(Q.quality_gate(_queries_by_brand_and_size(spark, d)))).select("query_id", "video_id", "rank")


@query("j16_first_valid_candidate", """SELECT query_id, arg_min(video_id, rank) FILTER (WHERE ok) AS video_id, min(rank) FILTER (WHERE ok) AS attempt,
  CASE WHEN NOT bool_or(ok) THEN 'All ' || CAST(count(*) AS VARCHAR) || ' download/validation attempts failed.' END AS error
  FROM (SELECT *, video_id % 3 <> 0 AND video_id % 2 = 0 AS ok FROM f_queue) GROUP BY 1""")
def _(spark, d):
    q = Q.queue(Q.select_candidates(Q.quality_gate(_queries_by_brand_and_size(spark, d))))
    k = F.col("p_partkey")
    attempts = X.table(spark, d, "part").select(k.alias("video_id"), (k % 3 != 0).alias("download_ok"), (k % 2 == 0).alias("valid"))
    return Q.first_valid(q, attempts).select("query_id", "video_id", "attempt", "error")


def probes(spark, d):
    return D.scan_probes(X.probe_texts(spark, d), "probe", "media_id")


@query("s10_probe_scan", """SELECT media_id, has_video, has_audio, CASE WHEN has_video THEN width ELSE 0 END AS width, CASE WHEN has_video THEN height ELSE 0 END AS height,
  CASE WHEN has_video THEN fps ELSE 0e0 END AS fps, duration, CASE WHEN has_audio THEN channels ELSE 0 END AS channels, CASE WHEN has_audio THEN kbps ELSE 0e0 END AS audio_kbps FROM f_probes""")
def _(spark, d):
    return probes(spark, d).select("media_id", "has_video", "has_audio", "width", "height", "fps", "duration", "channels", "audio_kbps")


@query("f03_parse_fps", "SELECT media_id, fps AS fps0, CASE WHEN fps_text = '0/0' THEN 30e0 ELSE fps END AS fps30 FROM f_probes WHERE has_video")
def _(spark, d):
    return probes(spark, d).where("has_video").select("media_id", S.parse_fps("fps_text").alias("fps0"), S.parse_fps("fps_text", 30.0).alias("fps30"))


@query("p11_media_gates", """SELECT media_id, r AS passes_resolution, f AS passes_framerate, dd AS passes_duration, a AS passes_audio, r AND f AND dd AND a AS valid,
  CASE WHEN has_video THEN CAST(width AS VARCHAR) || 'x' || CAST(height AS VARCHAR) ELSE '0x0' END AS resolution,
  CASE WHEN NOT has_audio THEN 'No audio stream found' WHEN channels < 1 THEN 'No audio channels' WHEN NOT a THEN 'Bitrate too low' WHEN channels = 2 THEN 'stereo' ELSE CAST(channels AS VARCHAR) || 'ch' END AS audio_note
  FROM (SELECT *, has_video AND height >= 720 AS r, has_video AND fps >= 24 AS f, duration BETWEEN 900 AND 1800 AS dd,
  has_audio AND channels >= 1 AND NOT (kbps > 0 AND kbps < 64) AS a FROM f_probes)""")
def _(spark, d):
    return Q.media_gates(probes(spark, d)).select(
        "media_id", "passes_resolution", "passes_framerate", "passes_duration", "passes_audio", "valid", "resolution", "audio_note")


def stored_files(spark, d):
    """File listing rows built from the part table."""
    ext = F.element_at(F.array(*[F.lit(e) for e in ("mp4", "MKV", "txt", "mov", "json")]), F.col("p_size") % 5 + 1)
    return X.table(spark, d, "part").select(
        F.concat(F.lit("/videos/"), "p_brand", F.lit("/"), F.col("p_partkey").cast("string"), F.lit("."), ext).alias("path"),
        F.floor(F.col("p_retailprice") * F.col("p_size")).alias("length"))


CTES["f_files"] = """SELECT '/videos/' || p_brand || '/' || CAST(p_partkey AS VARCHAR) || '.' || list_extract(['mp4', 'MKV', 'txt', 'mov', 'json'], p_size % 5 + 1) AS path,
  lower(list_extract(['mp4', 'MKV', 'txt', 'mov', 'json'], p_size % 5 + 1)) AS ext, CAST(floor(p_retailprice * p_size) AS BIGINT) AS length, '/videos/' || p_brand AS dir FROM part"""


@query("p12_file_gates", """SELECT path, CASE WHEN ext NOT IN ('mp4', 'mkv', 'webm', 'mov', 'avi') THEN 'Unsupported format: .' || ext
  WHEN length < 10240 THEN 'File too small (' || CAST(length AS VARCHAR) || ' bytes)' END AS reason FROM f_files""")
def _(spark, d):
    return Q.file_gates(stored_files(spark, d)).select("path", "reason")


CTES["f_stderr"] = """SELECT o_orderkey AS media_id, 'start ' || o_orderstatus || chr(10) || '  ' || CASE o_orderpriority WHEN '1-URGENT' THEN 'ERROR: gone' WHEN '2-HIGH' THEN 'Video is Private now'
  WHEN '3-MEDIUM' THEN 'CUDA OOM seen' ELSE 'fine' END || ' ' || chr(10) || CASE WHEN o_orderstatus = 'F' THEN 'please sign in' ELSE 'done' END AS err FROM orders"""


@query("p29_failure_class", """SELECT media_id, trim(list_extract(list_filter(string_split(err, chr(10)), lambda l: regexp_matches(lower(l), 'error|unavailable|private|age|copyright|blocked|removed|terminated|sign in')), 1)) AS detail,
  regexp_matches(lower(err), 'out of memory|cuda oom|cublas|alloc|cudnn|not enough memory') AS is_oom FROM f_stderr""")
def _(spark, d):
    pr = F.col("o_orderpriority")
    mid = F.when(pr == "1-URGENT", "ERROR: gone").when(pr == "2-HIGH", "Video is Private now").when(pr == "3-MEDIUM", "CUDA OOM seen").otherwise("fine")
    err = F.concat(F.lit("start "), "o_orderstatus", F.lit("\n  "), mid, F.lit(" \n"),
                   F.when(F.col("o_orderstatus") == "F", "please sign in").otherwise("done"))
    return X.table(spark, d, "orders").select(F.col("o_orderkey").alias("media_id"), err.alias("err")).select(
        "media_id", Q.failure_line("err").alias("detail"), Q.is_memory_failure("err").alias("is_oom"))


@query("f08_sanitize_name", r"""SELECT doc_id, substr(regexp_replace(regexp_replace(text, '[<>:"/\\|?*\x00-\x1f]', '_', 'g'), '^[ ._]+|[ ._]+$', '', 'g'), 1, 60) AS name FROM documents""")
def _(spark, d):
    return X.table(spark, d, "documents").select("doc_id", S.sanitize_name("text").alias("name"))


@query("f09_overlay_text", r"""SELECT doc_id, CASE WHEN length(t) > 100 THEN substr(t, 1, 97) || '...' ELSE t END AS overlay FROM (SELECT doc_id, replace(replace(text, '''', '\'''), ':', '\:') AS t FROM documents)""")
def _(spark, d):
    return X.table(spark, d, "documents").select("doc_id", S.overlay_text("text").alias("overlay"))


@query("f10_query_variants", """SELECT doc_id, array_to_string(list_slice(list_filter(string_split_regex(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), '\\s+'), lambda w: w <> ''), 1, 3), ' ') AS broad,
  source || ' analysis deep dive 2026|' || source || ' explained|' || source || ' full video' AS variants FROM documents""")
def _(spark, d):
    return X.table(spark, d, "documents").select("doc_id", S.broaden_query("text").alias("broad"), F.array_join(S.query_variants("source"), "|").alias("variants"))


@query("f17_labels", """SELECT media_id, CAST(width AS VARCHAR) || 'x' || CAST(height AS VARCHAR) AS size, CASE WHEN channels = 2 THEN 'stereo' ELSE CAST(channels AS VARCHAR) || 'ch' END AS audio,
  CAST(printf('%.1f', duration * 1e5 / 1048576e0) AS DOUBLE) AS mb FROM f_probes WHERE has_video AND has_audio""")
def _(spark, d):
    return probes(spark, d).where("has_video AND has_audio").select(
        "media_id", S.size_label("width", "height").alias("size"), S.channel_label("channels").alias("audio"), S.size_mb(F.col("duration") * 1e5).alias("mb"))


@query("s14_sidecar_scan", """SELECT title, 'up ' || CAST(doc_id AS VARCHAR) AS channel, substr(text, 1, 1000) AS description, CAST(n_chars AS INTEGER) AS duration_sec,
  lang || '|' || source AS tags, '1920x' || CAST(doc_id AS VARCHAR) AS resolution, n_chars AS view_count, 0 AS like_count FROM (SELECT *, 'doc ' || CAST(doc_id AS VARCHAR) AS title FROM documents)""")
def _(spark, d):
    k = F.col("doc_id").cast("string")
    info = F.to_json(F.struct(
        F.concat(F.lit("doc "), k).alias("title"), F.concat(F.lit("up "), k).alias("uploader"), F.col("text").alias("description"),
        F.col("n_chars").cast("double").alias("duration"), F.col("n_chars").alias("view_count"), F.array("lang", "source").alias("tags"),
        F.lit(1920).alias("width"), F.col("doc_id").cast("int").alias("height")))
    s = D.scan_sidecars(X.table(spark, d, "documents").select(info.alias("info")))
    return s.select("title", "channel", "description", "duration_sec", F.array_join("tags", "|").alias("tags"), "resolution", "view_count", "like_count")
