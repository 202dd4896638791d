"""Media tables derived from the given tables, in Spark and (``CTES``) in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import ordered as O
from .registry import CTES


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark, sf_dir, raw: DataFrame | None = None) -> DataFrame:
    return (table(spark, sf_dir, "events") if raw is None else raw).select(
        "event_id", "ts", "user_id", "event_type", "value",
        F.regexp_extract("props", "([0-9]+)", 1).cast("int").alias("k"),
    )


CTES["f_ev"] = """SELECT event_id, ts, user_id, event_type, value,
  CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k FROM events"""

PLATFORM = {"click": "tiktok", "view": "youtube_api", "purchase": "youtube_search",
            "signup": "twitter", "error": "youtube"}


def signals(spark, sf_dir, raw: DataFrame | None = None) -> DataFrame:
    platform = F.create_map(*[F.lit(x) for kv in PLATFORM.items() for x in kv])
    number = F.concat(F.floor("value").cast("string"), F.lit("."), (F.col("k") % 10).cast("string"))
    unit = F.element_at(F.array(*[F.lit(u) for u in ("K", " m", " views", "B+")]), F.col("k") % 4 + 1)
    return events(spark, sf_dir, raw).select(
        F.col("event_id").alias("arrival_idx"), "ts", F.col("user_id").alias("video_id"),
        platform[F.col("event_type")].alias("platform"),
        F.concat(F.lit("Topic "), (F.col("user_id") % 40).cast("string"), F.lit(" "), "event_type").alias("title"),
        F.concat(number, unit).alias("engagement_text"),
        (F.col("value") / 250).alias("velocity"), F.col("value").alias("engagement"),
        (F.col("event_id") % 97).alias("likes"), (F.col("event_id") % 31).alias("comments"), "k",
    )


CTES["f_signals"] = """SELECT event_id AS arrival_idx, ts, user_id AS video_id,
  CASE event_type WHEN 'click' THEN 'tiktok' WHEN 'view' THEN 'youtube_api'
    WHEN 'purchase' THEN 'youtube_search' WHEN 'signup' THEN 'twitter' ELSE 'youtube' END AS platform,
  'Topic ' || CAST(user_id % 40 AS VARCHAR) || ' ' || event_type AS title,
  CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) || '.' || CAST(k % 10 AS VARCHAR)
    || CASE k % 4 WHEN 0 THEN 'K' WHEN 1 THEN ' m' WHEN 2 THEN ' views' ELSE 'B+' END AS engagement_text,
  value / 250 AS velocity, value AS engagement, event_id % 97 AS likes, event_id % 31 AS comments, k
  FROM f_ev"""

PUBLISHED = "2023-12-31T00:00:00Z"


def video_polls(spark, sf_dir) -> DataFrame:
    ev = events(spark, sf_dir)
    d = O.running_sum(ev, ["user_id"], "event_id", F.floor(F.col("value") * 100), "view_count")
    return d.select(
        F.col("event_id").alias("poll_id"), F.col("user_id").alias("video_id"), F.col("ts").alias("poll_ts"),
        F.lit(PUBLISHED).alias("published_at"), "view_count",
        (F.col("event_id") % 97).alias("like_count"), (F.col("event_id") % 31).alias("comment_count"),
    )


CTES["f_polls"] = """SELECT event_id AS poll_id, user_id AS video_id, ts AS poll_ts,
  TIMESTAMP '2023-12-31 00:00:00' AS published_at,
  CAST(SUM(CAST(floor(value * 100) AS BIGINT)) OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT) AS view_count,
  event_id % 97 AS like_count, event_id % 31 AS comment_count FROM f_ev"""


def spread(df: DataFrame, *by: str) -> DataFrame:
    """Texts dealt over the stated number of tasks before they become words: a file split of texts is many times as
    many bytes of words, more than a task's sorts hold without spilling."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


def doc_words(spark, sf_dir) -> DataFrame:
    d = spread(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text").select(
        F.col("doc_id").alias("media_id"), F.posexplode(S.split_words("text")).alias("word_idx", "word"))
    return _timed(d)


def _timed(words: DataFrame, *more: str) -> DataFrame:
    return words.select(
        "media_id", "word_idx", "word",
        (F.col("word_idx") * 400 / F.lit(1000.0)).alias("start"),
        ((F.col("word_idx") * 400 + 350) / F.lit(1000.0)).alias("end"), *more,
    )


def laid_doc_words(spark, sf_dir) -> DataFrame:
    """``doc_words`` that lie by document and chunk of words (``ordered.is_laid``). A document is moved as one text per
    chunk, an eighth of ``CHUNK_ROWS`` words, so its words need not be moved to meet again."""
    rows = max(1, O.CHUNK_ROWS // 8)
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("media_id"), S.split_words("text").alias("ws")).where(F.size("ws") > 0)
    last = F.floor((F.size("ws") - 1) / F.lit(rows)).cast("bigint")
    d = d.select("media_id", "ws", F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias(O.CHUNK))
    piece = F.array_join(F.slice("ws", (F.col(O.CHUNK) * rows + 1).cast("int"), F.lit(rows)), " ")
    d = spread(O.keyed(d.withColumn("piece", piece), ["media_id"]).select(O.CHUNK, "piece"), O.CHUNK)
    d = d.select(O.CHUNK, F.posexplode(F.split("piece", " ")).alias("p", "word"))
    at = F.col(O.CHUNK)
    return _timed(d.select(at["media_id"].alias("media_id"), (at["__no"] * rows + F.col("p")).cast("int").alias("word_idx"), "word", at), O.CHUNK)


_SPLIT = r"string_split_regex(regexp_replace({0}, '^\s+|\s+$', '', 'g'), '\s+')"
CTES["f_doc_words"] = rf"""SELECT doc_id AS media_id, idx - 1 AS word_idx, word,
  CAST((idx - 1) * 400 AS DOUBLE) / 1e3 AS "start", CAST((idx - 1) * 400 + 350 AS DOUBLE) / 1e3 AS "end"
  FROM (SELECT doc_id, unnest(a) AS word, generate_subscripts(a, 1) AS idx
    FROM (SELECT doc_id, {_SPLIT.format('text')} AS a FROM documents)) WHERE word <> ''"""


def _turn_sizes(spark, sf_dir) -> DataFrame:
    d = table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", "role", S.split_words("text").alias("ws"))
    return O.running_sum(d, ["conv_id"], "turn", F.size("ws").cast("bigint"), "first_word", inclusive=False)


def conv_words(spark, sf_dir) -> DataFrame:
    d = spread(_turn_sizes(spark, sf_dir).select("conv_id", "first_word", "ws"), "conv_id", "first_word")
    d = d.select("conv_id", "first_word", F.posexplode("ws").alias("p", "word"))
    idx = F.col("first_word") + F.col("p")
    return d.select(
        F.col("conv_id").alias("media_id"), idx.alias("word_idx"), "word",
        (idx * 400 / F.lit(1000.0)).alias("start"), ((idx * 400 + 350) / F.lit(1000.0)).alias("end"))


def turns(spark, sf_dir) -> DataFrame:
    d = _turn_sizes(spark, sf_dir).where(F.size("ws") > 0)
    speaker = F.when(F.col("role") == "user", "SPEAKER_00").when(
        F.col("role") == "assistant", "SPEAKER_01").otherwise("SPEAKER_02")
    cut = F.when(F.col("turn") % 3 == 2, 500).otherwise(0)
    last = F.col("first_word") + F.size("ws") - 1
    return d.select(
        F.col("conv_id").alias("media_id"), F.col("turn").alias("turn_idx"), speaker.alias("speaker"),
        ((F.col("first_word") * 400 + 150) / F.lit(1000.0)).alias("t_start"),
        ((last * 400 + 500 - cut) / F.lit(1000.0)).alias("t_end"))


CTES["f_turn_sizes"] = rf"""SELECT conv_id, turn, role, ws, n,
  CAST(SUM(n) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) - n AS first_word
  FROM (SELECT conv_id, turn, role, ws, len(ws) AS n FROM (SELECT conv_id, turn, role,
    list_filter({_SPLIT.format('text')}, lambda w: w <> '') AS ws FROM conversations))"""
CTES["f_conv_words"] = """SELECT conv_id AS media_id, w AS word_idx, word,
  CAST(w * 400 AS DOUBLE) / 1e3 AS "start", CAST(w * 400 + 350 AS DOUBLE) / 1e3 AS "end"
  FROM (SELECT conv_id, first_word + p - 1 AS w, word FROM (SELECT conv_id, first_word,
    unnest(ws) AS word, generate_subscripts(ws, 1) AS p FROM f_turn_sizes))"""
CTES["f_turns"] = """SELECT conv_id AS media_id, turn AS turn_idx,
  CASE role WHEN 'user' THEN 'SPEAKER_00' WHEN 'assistant' THEN 'SPEAKER_01' ELSE 'SPEAKER_02' END AS speaker,
  CAST(first_word * 400 + 150 AS DOUBLE) / 1e3 AS t_start,
  CAST((first_word + n - 1) * 400 + 500 - CASE WHEN turn % 3 = 2 THEN 500 ELSE 0 END AS DOUBLE) / 1e3 AS t_end
  FROM f_turn_sizes WHERE n > 0"""


def series(spark, sf_dir) -> DataFrame:
    d = O.number_rows(events(spark, sf_dir), ["event_type"], ["event_id"], "frame_idx",
                      chunk=O.dense_chunk("event_id", 65536))
    return d.select(
        F.col("event_type").alias("media_id"), "frame_idx", (F.col("value") / 20).alias("ti"),
        (F.col("k") / F.lit(100.0)).alias("ae"), (F.col("value") / 400).alias("rms"),
        (F.col("k") / F.lit(50.0)).alias("onset"))


CTES["f_series"] = """SELECT event_type AS media_id,
  row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS frame_idx,
  value / 20 AS ti, k / 100e0 AS ae, value / 400 AS rms, k / 50e0 AS onset FROM f_ev"""


def beats(spark, sf_dir) -> DataFrame:
    d = O.number_rows(events(spark, sf_dir), ["user_id"], ["event_id"], "beat_idx",
                      chunk=O.dense_chunk("event_id", 65536))
    return d.select(F.col("user_id").alias("media_id"), "beat_idx",
                    (F.col("beat_idx") * F.lit(0.5)).alias("time"))


CTES["f_beats"] = """SELECT media_id, beat_idx, beat_idx * 0.5e0 AS "time" FROM (SELECT user_id AS media_id,
  row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS beat_idx FROM f_ev)"""

FRAME_W, FRAME_H, FPS = 1920, 1080, 30.0


def detections(spark, sf_dir) -> DataFrame:
    order = ["l_orderkey", "l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
             "l_shipdate", "l_returnflag", "l_linestatus"]
    d = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("media_id"), (F.col("l_orderkey") % 300).cast("int").alias("frame_idx"),
        *order)
    d = d.withColumn("track_id", F.row_number().over(Window.partitionBy("media_id", "frame_idx").orderBy(*order)))
    w = 100 + F.col("l_tax") * 2000
    x1, y1 = F.col("l_quantity") * 20, F.col("l_discount") * 5000
    pt = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    nose = F.when(F.col("l_returnflag").isin("A", "R"), pt(x1 + w * 0.5, y1 + w * 0.3))
    eye = lambda f: F.when(F.col("l_returnflag") == "A", pt(x1 + w * f, y1 + w * 0.25))
    return d.select(
        "media_id", "frame_idx", "track_id", x1.alias("x1"), y1.alias("y1"),
        (x1 + w).alias("x2"), (y1 + w * 1.2).alias("y2"), (0.3 + F.col("l_tax") * 8).alias("conf"),
        F.struct(nose.alias("nose"), eye(0.35).alias("left_eye"), eye(0.65).alias("right_eye")).alias("pose"),
        F.when(F.col("l_linestatus") == "O", "person").otherwise("face").alias("label"),
    )


CTES["f_det0"] = """SELECT l_suppkey AS media_id, CAST(l_orderkey % 300 AS INTEGER) AS frame_idx,
  row_number() OVER (PARTITION BY l_suppkey, l_orderkey % 300 ORDER BY l_orderkey, l_partkey,
    l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate, l_returnflag, l_linestatus) AS track_id, l_quantity * 20 AS x1, l_discount * 5000 AS y1, 100 + l_tax * 2000 AS w0,
  l_returnflag AS rf, l_linestatus AS ls, l_tax FROM lineitem"""
CTES["f_dets"] = """SELECT media_id, frame_idx, track_id, x1, y1, x1 + w0 AS x2, y1 + w0 * 1.2e0 AS y2,
  0.3e0 + l_tax * 8 AS conf,
  CASE WHEN rf IN ('A', 'R') THEN x1 + w0 * 0.5e0 END AS nose_x, CASE WHEN rf IN ('A', 'R') THEN y1 + w0 * 0.3e0 END AS nose_y,
  CASE WHEN rf = 'A' THEN x1 + w0 * 0.35e0 END AS leye_x, CASE WHEN rf = 'A' THEN y1 + w0 * 0.25e0 END AS leye_y,
  CASE WHEN rf = 'A' THEN x1 + w0 * 0.65e0 END AS reye_x, CASE WHEN rf = 'A' THEN y1 + w0 * 0.25e0 END AS reye_y,
  CASE WHEN ls = 'O' THEN 'person' ELSE 'face' END AS label FROM f_det0"""


def candidates(spark, sf_dir) -> DataFrame:
    # titles of two part types carry a watermark indicator
    tail = F.when(F.col("p_type") == "PROMO", " Highlights").when(
        F.col("p_type") == "SMALL", " Clip Reaction").otherwise("")
    return table(spark, sf_dir, "part").select(
        F.col("p_brand").alias("query_id"), F.col("p_partkey").alias("video_id"),
        F.concat("p_name", tail).alias("title"), (F.col("p_size") * 40).alias("duration_seconds"),
        F.floor(F.col("p_retailprice") * F.col("p_size")).alias("view_count"),
        (F.col("p_partkey") % 89).alias("like_count"), (F.col("p_partkey") % 13).alias("comment_count"))


CTES["f_candidates"] = """SELECT p_brand AS query_id, p_partkey AS video_id,
  p_name || CASE p_type WHEN 'PROMO' THEN ' Highlights' WHEN 'SMALL' THEN ' Clip Reaction' ELSE '' END AS title,
  p_size * 40 AS duration_seconds, CAST(floor(p_retailprice * p_size) AS BIGINT) AS view_count,
  p_partkey % 89 AS like_count, p_partkey % 13 AS comment_count FROM part"""


def probe_texts(spark, sf_dir) -> DataFrame:
    """Probe documents as JSON text, one per order."""
    k = F.col("o_orderkey")
    height = F.element_at(F.array(F.lit(1920), F.lit(1080), F.lit(720)), (k % 3 + 1).cast("int"))
    fps = F.element_at(F.array(*[F.lit(v) for v in ("30000/1001", "25/1", "0/0", "24")]), (k % 4 + 1).cast("int"))
    dur = F.col("o_totalprice") / 100
    audio_dur = F.when(k % 5 == 0, dur + 0.5).otherwise(dur)
    stream = lambda **kw: F.struct(*[v.alias(n) for n, v in kw.items()])
    none_s = F.lit(None).cast("string")
    video = stream(codec_type=F.lit("video"), codec_name=F.lit("h264"), width=F.when(k % 3 == 0, 1080).otherwise(1280),
                   height=height, r_frame_rate=fps, channels=F.lit(None).cast("int"), sample_rate=none_s,
                   bit_rate=none_s, start_time=F.lit("0.0"), duration=dur.cast("string"))
    audio = stream(codec_type=F.lit("audio"), codec_name=F.lit("aac"), width=F.lit(None).cast("int"),
                   height=F.lit(None).cast("int"), r_frame_rate=none_s, channels=(k % 3).cast("int"),
                   sample_rate=F.lit("48000"),
                   bit_rate=F.when(k % 4 == 1, "32000").when(k % 4 == 2, "N/A").otherwise("128000"),
                   start_time=F.when(k % 7 == 0, "0.25").otherwise("0.0"), duration=audio_dur.cast("string"))
    streams = F.when(k % 11 == 0, F.array(video)).when(k % 13 == 0, F.array(audio)).otherwise(F.array(audio, video))
    doc = F.to_json(F.struct(streams.alias("streams"), F.struct(dur.cast("string").alias("duration")).alias("format")))
    return table(spark, sf_dir, "orders").select(k.alias("media_id"), doc.alias("probe"))


CTES["f_probes"] = """SELECT o_orderkey AS media_id, NOT (o_orderkey % 11 <> 0 AND o_orderkey % 13 = 0) AS has_video,
  o_orderkey % 11 <> 0 AS has_audio,
  CASE WHEN o_orderkey % 3 = 0 THEN 1080 ELSE 1280 END AS width,
  CASE o_orderkey % 3 WHEN 0 THEN 1920 WHEN 1 THEN 1080 ELSE 720 END AS height,
  CASE o_orderkey % 4 WHEN 0 THEN '30000/1001' WHEN 1 THEN '25/1' WHEN 2 THEN '0/0' ELSE '24' END AS fps_text,
  CASE o_orderkey % 4 WHEN 0 THEN 30000e0/1001e0 WHEN 1 THEN 25e0 WHEN 2 THEN 0e0 ELSE 24e0 END AS fps,
  o_totalprice / 100 AS duration,
  CASE WHEN o_orderkey % 5 = 0 THEN o_totalprice / 100 + 0.5e0 ELSE o_totalprice / 100 END AS audio_duration,
  CASE WHEN o_orderkey % 7 = 0 THEN 0.25e0 ELSE 0e0 END AS audio_start,
  CAST(o_orderkey % 3 AS INTEGER) AS channels,
  CASE o_orderkey % 4 WHEN 1 THEN 32e0 WHEN 2 THEN 0e0 ELSE 128e0 END AS kbps FROM orders"""


def frame_vectors(spark, sf_dir) -> DataFrame:
    d = O.number_rows(table(spark, sf_dir, "embeddings"), ["label"], ["vec_id"], "frame_idx",
                      chunk=O.dense_chunk("vec_id", 65536))
    pixel = lambda x: F.least(F.lit(1.0), F.greatest(F.lit(0.0), (x.cast("double") + 1) / 2))
    return d.select(F.col("label").alias("media_id"), "frame_idx", F.transform("embedding", pixel).alias("pixels"))


CTES["f_frames"] = """SELECT label AS media_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS frame_idx,
  list_transform(embedding, lambda x: least(1e0, greatest(0e0, (CAST(x AS DOUBLE) + 1) / 2))) AS pixels FROM embeddings"""


def moments(spark, sf_dir) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.array(*[F.lit(i) for i in range(3)])).alias("i"))
    start = ((F.col("doc_id") % 7) * 10 + F.col("i") * 60).cast("double")
    return d.select(F.col("doc_id").alias("media_id"), F.col("i").alias("moment_idx"), start.alias("start_time"),
                    (start + 30 + F.col("doc_id") % 75).alias("end_time"),
                    ((F.col("doc_id") * 31 + F.col("i") * 17) % 101).cast("double").alias("viral_score"))


CTES["f_moments"] = """SELECT media_id, moment_idx, start_time, start_time + 30 + media_id % 75 AS end_time,
  CAST((media_id * 31 + moment_idx * 17) % 101 AS DOUBLE) AS viral_score FROM (SELECT doc_id AS media_id, i AS moment_idx,
  CAST((doc_id % 7) * 10 + i * 60 AS DOUBLE) AS start_time FROM documents, (VALUES (0), (1), (2)) AS v(i))"""


def interest(spark, sf_dir) -> DataFrame:
    return events(spark, sf_dir).select(
        F.concat("event_type", F.lit("-"), (F.col("user_id") % 8).cast("string")).alias("keyword"),
        F.col("event_id").alias("ts_idx"), (F.col("value") / 2).alias("interest"), "k")


CTES["f_interest"] = """SELECT event_type || '-' || CAST(user_id % 8 AS VARCHAR) AS keyword, event_id AS ts_idx,
  value / 2 AS interest, k FROM f_ev"""


def samples(spark, sf_dir) -> DataFrame:
    """Audio samples: position within the supplier's line items gives the clock."""
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate"]
    d = O.number_rows(table(spark, sf_dir, "lineitem").select("l_suppkey", *order), ["l_suppkey"], order, "sample_idx",
                      chunk=O.dense_chunk("l_orderkey", 16384))
    return d.select(F.col("l_suppkey").alias("media_id"), "sample_idx", (F.col("l_discount") * 10 - 0.5).alias("x"))


CTES["f_samples"] = """SELECT l_suppkey AS media_id, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey,
  l_linenumber, l_partkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate) - 1 AS sample_idx,
  l_discount * 10 - 0.5e0 AS x FROM lineitem"""


def black_intervals(spark, sf_dir) -> DataFrame:
    k, dur = F.col("o_orderkey"), F.col("o_totalprice") / 100
    start = dur * 0.25 - 0.5 + (k % 5)
    return table(spark, sf_dir, "orders").select(
        k.alias("media_id"), start.alias("b_start"), (start + 1 + k % 4).alias("b_end"))


CTES["f_black"] = """SELECT media_id, b_start, b_start + 1 + media_id % 4 AS b_end FROM (SELECT o_orderkey AS media_id,
  (o_totalprice / 100) * 0.25e0 - 0.5e0 + (o_orderkey % 5) AS b_start FROM orders)"""

STAGES = ["Transcription", "Audio Transcription", "Video Analysis", "Subject Tracking", "Tracking",
          "Short Generation", "Editing", "Metadata Generation", "Export", "Thumbnail Extraction", "Quality Assurance"]


def progress_events(spark, sf_dir, raw: DataFrame | None = None) -> DataFrame:
    kind = F.when(F.col("event_type") == "view", "stage_start").when(F.col("event_type") == "purchase", "stage_complete").when(
        F.col("event_type") == "error", "error").otherwise("step")
    stage = F.element_at(F.array(*[F.lit(s) for s in STAGES]), F.col("k") % 11 + 1)
    return events(spark, sf_dir, raw).select(
        F.col("user_id").alias("run_id"), F.col("event_id").alias("seq"), "ts", kind.alias("type"),
        stage.alias("stage"), F.col("k").alias("current"), F.lit(100).alias("total"))


CTES["f_progress"] = """SELECT user_id AS run_id, event_id AS seq, ts, CASE event_type WHEN 'view' THEN 'stage_start'
  WHEN 'purchase' THEN 'stage_complete' WHEN 'error' THEN 'error' ELSE 'step' END AS type,
  list_extract([""" + ", ".join(f"'{s}'" for s in STAGES) + """], k % 11 + 1) AS stage, k AS "current", 100 AS total FROM f_ev"""


def run_results(spark, sf_dir) -> DataFrame:
    ok = F.col("c_acctbal") > 0
    return table(spark, sf_dir, "customer").select(
        F.col("c_nationkey").alias("run_id"), F.col("c_custkey").alias("video_idx"), ok.alias("success"),
        F.when(ok, F.array("c_name")).otherwise(F.array().cast("array<string>")).alias("shorts"),
        F.abs("c_acctbal").alias("duration"),
        F.when(ok, F.array().cast("array<string>")).otherwise(F.array("c_mktsegment")).alias("errors"))
