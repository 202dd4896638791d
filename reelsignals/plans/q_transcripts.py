"""Queries over transcripts and words."""

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import transcripts as W
from ..sources import documents as D
from . import fixtures as X
from .registry import CTES, query

R3 = lambda c: S.py_round(c, 3)


def transcript_blobs(spark, d):
    """Documents as transcript JSON in three layouts; the segment layout has one segment without words."""
    words = S.split_words("text")
    at = lambda i, plus: (i * 400 + plus) / F.lit(1000.0)
    item = lambda w, i, word, a, b: F.struct(w.alias(word), at(i, 0).alias(a), at(i, 350).alias(b))
    lay = F.col("doc_id") % 3
    full = F.transform("ws", lambda w, i: item(w, i, "word", "start_time", "end_time"))
    seg = F.array(
        F.struct(F.lit("head").alias("text"), F.lit(0.0).alias("start"), F.lit(1.0).alias("end"),
                 F.transform("ws", lambda w, i: item(w, i, "text", "start", "end")).alias("words")),
        F.struct(F.lit("tail").alias("text"), F.lit(2.0).alias("start"), F.lit(3.0).alias("end"), F.lit(None).alias("words")))
    flat = F.transform("ws", lambda w, i: item(w, i, "text", "start", "end"))
    blob = F.when(lay == 0, F.to_json(F.struct(F.struct(full.alias("words")).alias("result")))).when(
        lay == 1, F.to_json(F.struct(seg.alias("segments")))).otherwise(F.to_json(F.struct(flat.alias("words"))))
    return X.table(spark, d, "documents").select("doc_id", words.alias("ws")).select(F.col("doc_id").alias("media_id"), blob.alias("blob"))


@query("s07_transcript_scan", """SELECT media_id, word_idx, word, "start", "end" FROM f_doc_words
  UNION ALL SELECT doc_id, (SELECT count(*) FROM f_doc_words w WHERE w.media_id = doc_id), 'tail', 2e0, 3e0 FROM documents WHERE doc_id % 3 = 1""")
def _(spark, d):
    return D.scan_words(transcript_blobs(spark, d))


def alignment_blobs(spark, d):
    words = F.transform(S.split_words("text"), lambda w, i: F.struct(
        F.concat(F.lit(" "), w).alias("text"), (i * 400 / F.lit(1000.0)).alias("start"), ((i * 400 + 350) / F.lit(1000.0)).alias("end")))
    k = F.col("turn")
    seg = F.struct(F.concat(F.lit("  "), "text", F.lit("\n")).alias("text"), k.cast("double").alias("start"), (k + 1.5).alias("end"), words.alias("words"))
    two = F.array(seg, F.struct(F.lit("x ").alias("text"), (k + 2.0).alias("start"), (k + 2.5).alias("end"), words.alias("words")))
    blob = F.when(k % 4 == 0, F.to_json(F.struct(two.alias("segments")))).when(k % 4 == 1, F.to_json(F.struct(two.alias("alignments")))).when(
        k % 4 == 2, F.to_json(seg)).otherwise(F.to_json(two))
    return X.table(spark, d, "conversations").select((F.col("conv_id") * 1000 + k).alias("media_id"), blob.alias("blob"))


CTES["f_align"] = r"""SELECT conv_id * 1000 + turn AS media_id, turn % 4 = 2 AS bare, CAST(turn AS DOUBLE) AS t, regexp_replace(text, '^\s+|\s+$', '', 'g') AS text, n
  FROM (SELECT conv_id, turn, text FROM conversations) JOIN (SELECT conv_id, turn, n FROM f_turn_sizes) USING (conv_id, turn)"""


@query("s08_alignment_scan", """SELECT media_id, 0 AS seg_idx, text, t AS "start", t + 1.5e0 AS "end", n AS n_words, CASE WHEN bare THEN t + 1.5e0 ELSE t + 2.5e0 END AS duration FROM f_align
  UNION ALL SELECT media_id, 1, 'x', t + 2, t + 2.5e0, n, t + 2.5e0 FROM f_align WHERE NOT bare""")
def _(spark, d):
    s = D.scan_alignment(alignment_blobs(spark, d))
    return s.select("media_id", "seg_idx", "text", "start", "end", F.size("words").alias("n_words"), "duration")


@query("s09_rttm_scan", """SELECT CAST(media_id AS VARCHAR) AS file, t_start AS "start", CAST(printf('%.3f', t_start + (t_end - t_start)) AS DOUBLE) AS "end", speaker FROM f_turns WHERE turn_idx % 4 <> 3""")
def _(spark, d):
    t = X.turns(spark, d)
    kind = F.when(F.col("turn_idx") % 4 == 3, "SPKR-INFO").otherwise("SPEAKER")
    line = F.concat_ws(" ", kind, F.col("media_id").cast("string"), F.lit("1 "), F.col("t_start").cast("string"),
                       (F.col("t_end") - F.col("t_start")).cast("string"), F.lit("<NA> <NA>"), "speaker", F.lit("<NA> <NA> "))
    return D.scan_rttm(t.select(line.alias("value"))).select("file", "start", "end", "speaker")


@query("p25_absolute_times", """SELECT media_id, word_idx, CAST(printf('%.3f', word_idx * 0.08e0 + media_id * 60) AS DOUBLE) AS "start",
  CAST(printf('%.3f', (word_idx + 3) * 0.08e0 + media_id * 60) AS DOUBLE) AS "end" FROM f_conv_words""")
def _(spark, d):
    w = X.conv_words(spark, d).select("media_id", "word_idx", F.col("word_idx").alias("start_offset"), (F.col("word_idx") + 3).alias("end_offset"),
                                     (F.col("media_id") * 60).alias("chunk_start"))
    return W.absolute_times(w).select("media_id", "word_idx", "start", "end")


@query("p26_open_ended_words", """SELECT media_id, word_idx, word, "start", CASE WHEN word_idx % 10 = 9 THEN "start" + 0.1e0 ELSE "end" END AS "end" FROM f_doc_words WHERE word_idx % 50 <> 7""")
def _(spark, d):
    w = X.doc_words(spark, d)
    w = w.withColumns({"start": F.when(F.col("word_idx") % 50 != 7, F.col("start")), "end": F.when(F.col("word_idx") % 10 != 9, F.col("end"))})
    return W.close_open_words(w).select("media_id", "word_idx", "word", "start", "end")


@query("w09_fixed_word_groups", """SELECT media_id, word_idx // 3 AS line_idx, count(*) AS n_words, min("start") AS "start", max("end") AS "end", string_agg(word, ' ' ORDER BY word_idx) AS text FROM f_doc_words GROUP BY 1, 2""")
def _(spark, d):
    return W.fixed_groups(X.doc_words(spark, d), 3).select("media_id", "line_idx", "n_words", "start", "end", "text")


def _groups_sql(src, n, closers):
    return f"""SELECT media_id, min(word_idx) AS first_idx, min("start") AS "start", max("end") AS "end", string_agg(word, ' ' ORDER BY word_idx) AS text FROM
  (SELECT *, (word_idx - min(word_idx) OVER (PARTITION BY media_id, island)) // {n} AS part FROM
   (SELECT *, coalesce(sum(c) OVER (PARTITION BY media_id ORDER BY word_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS island FROM
    (SELECT *, CASE WHEN right(word, 1) IN ({closers}) THEN 1 ELSE 0 END AS c FROM {src}))) GROUP BY media_id, island, part"""


@query("w10_punctuation_segments", _groups_sql("f_doc_words", 10, "'.', '!', '?', ','") + """
  UNION ALL SELECT conv_id + 1000000, 0, 0e0, 0e0, role FROM conversations""")
def _(spark, d):
    texts = X.table(spark, d, "conversations").select((F.col("conv_id") + 1000000).alias("media_id"), F.col("role").alias("text"))
    return W.segments_or_whole(X.doc_words(spark, d), texts).select("media_id", "first_idx", "start", "end", "text")


@query("w10_caption_lines", _groups_sql("f_conv_words", 6, "'.', '!', '?'"))
def _(spark, d):
    return W.punctuation_groups(X.conv_words(spark, d), 6, ".!?").select("media_id", "first_idx", "start", "end", "text")


@query("w12_audio_chunks", """SELECT media_id, CAST(i AS INTEGER) AS chunk_idx, i * 60e0 AS chunk_start, least((i + 1) * 60e0, duration) AS chunk_end
  FROM (SELECT media_id, duration, unnest(range(CAST(ceil(duration / 60e0) AS BIGINT))) AS i FROM f_probes)""")
def _(spark, d):
    m = X.table(spark, d, "orders").select(F.col("o_orderkey").alias("media_id"), (F.col("o_totalprice") / 100).alias("duration"))
    return W.audio_chunks(m).select("media_id", "chunk_idx", "chunk_start", "chunk_end")


@query("w12_uniform_words", """SELECT conv_id, turn, CAST(p - 1 AS INTEGER) AS pos, word, CAST(printf('%.3f', turn * 60e0 + (p - 1) * (60e0 / n)) AS DOUBLE) AS "start",
  CAST(printf('%.3f', turn * 60e0 + p * (60e0 / n)) AS DOUBLE) AS "end", 0.5e0 AS confidence FROM
  (SELECT conv_id, turn, n, unnest(ws) AS word, generate_subscripts(ws, 1) AS p FROM f_turn_sizes)""")
def _(spark, d):
    c = X.table(spark, d, "conversations").withColumns({
        "chunk_start": F.col("turn") * F.lit(60.0), "chunk_end": F.col("turn") * F.lit(60.0) + 60.0})
    return W.uniform_words(c).select("conv_id", "turn", "pos", "word", "start", "end", "confidence")


@query("a13_transcript_rollup", """SELECT media_id, string_agg(word, ' ' ORDER BY word_idx) AS full_text, count(*) AS word_count, max("end") AS duration FROM f_conv_words GROUP BY 1""")
def _(spark, d):
    return W.rollup(X.conv_words(spark, d)).select("media_id", "full_text", "word_count", "duration")


@query("j07_transcript_slice", """SELECT m.media_id, moment_idx, coalesce(string_agg(word, ' ' ORDER BY word_idx), '') AS text FROM f_moments m LEFT JOIN f_doc_words w
  ON m.media_id = w.media_id AND w."start" BETWEEN m.start_time AND m.end_time GROUP BY 1, 2""")
def _(spark, d):
    return W.slice_text(X.doc_words(spark, d), X.moments(spark, d)).select("media_id", "moment_idx", "text")


CTES["f_segments"] = _groups_sql("f_doc_words", 10, "'.', '!', '?', ','")


@query("j07_segment_slice", """SELECT m.media_id, moment_idx, string_agg(text, ' ' ORDER BY first_idx) AS slice FROM f_moments m JOIN f_segments s
  ON m.media_id = s.media_id AND s."start" >= m.start_time AND s."end" <= m.end_time GROUP BY 1, 2""")
def _(spark, d):
    segs = W.punctuation_groups(X.laid_doc_words(spark, d)).select("media_id", F.col("first_idx").alias("seg_idx"), "start", "end", "text")
    return W.slice_segments(segs, X.moments(spark, d)).select("media_id", "moment_idx", "slice")


def clips(spark, d):
    return X.moments(spark, d).select("media_id", F.col("moment_idx").alias("clip_idx"), F.col("start_time").alias("clip_start"), F.col("end_time").alias("clip_end"))


_RETIME = """SELECT m.media_id, moment_idx AS clip_idx, word_idx, greatest(0e0, "start" - start_time) AS out_start, least(end_time - start_time, "end" - start_time) AS out_end
  FROM f_moments m JOIN f_doc_words w ON m.media_id = w.media_id AND w."start" <= end_time AND w."end" >= start_time"""


@query("j08_clip_retime_words", _RETIME)
def _(spark, d):
    return W.retime(X.doc_words(spark, d), clips(spark, d), "start", "end").select("media_id", "clip_idx", "word_idx", "out_start", "out_end")


@query("x05_clip_retime_min_length", f"SELECT * FROM ({_RETIME}) WHERE out_end - out_start > 0.1e0")
def _(spark, d):
    return W.retime(X.doc_words(spark, d), clips(spark, d), "start", "end", min_len=0.1).select("media_id", "clip_idx", "word_idx", "out_start", "out_end")


@query("j08_clip_retime_segments", """SELECT m.media_id, moment_idx AS clip_idx, first_idx, greatest(0e0, "start" - start_time) AS out_start, least(end_time - start_time, "end" - start_time) AS out_end
  FROM f_moments m JOIN f_segments w ON m.media_id = w.media_id AND w."start" <= end_time AND w."end" >= start_time""")
def _(spark, d):
    segs = W.punctuation_groups(X.doc_words(spark, d))
    return W.retime(segs, clips(spark, d), "start", "end").select("media_id", "clip_idx", "first_idx", "out_start", "out_end")


@query("j08_clip_retime_frames", """SELECT m.media_id, moment_idx AS clip_idx, track_id, frame_idx - CAST(trunc(start_time * 30) AS BIGINT) AS clip_frame FROM f_moments m JOIN f_dets d ON m.media_id = d.media_id
  AND frame_idx >= CAST(trunc(start_time * 30) AS BIGINT) AND frame_idx - CAST(trunc(start_time * 30) AS BIGINT) < CAST(trunc((end_time - start_time) * 30) AS BIGINT) + 30""")
def _(spark, d):
    return W.retime_frames(X.detections(spark, d), clips(spark, d)).select("media_id", "clip_idx", "track_id", "clip_frame")


@query("x04_word_error_rate", """SELECT conv_id, turn, round((len(list_filter(ws, lambda w, i: i % 7 = 4)) + CASE WHEN turn % 2 = 1 THEN len(list_filter(ws, lambda w, i: i % 5 = 3)) ELSE 0 END) / len(ws), 9) AS wer FROM f_turn_sizes WHERE n > 0""")
def _(spark, d):
    c = X.table(spark, d, "conversations").select("conv_id", "turn", S.split_words("text").alias("ref")).where(F.size("ref") > 0)
    # every seventh word is lost; in odd turns it is misheard instead, and a noise comes before every fifth
    heard = lambda w, i: F.array_compact(F.array(F.when(i % 5 == 2, "\u00a7"), F.when(i % 7 == 3, "\u00a7").otherwise(w)))
    lost, noisy = F.filter("ref", lambda w, i: i % 7 != 3), F.flatten(F.transform("ref", heard))
    c = c.withColumn("hyp", F.when(F.col("turn") % 2 == 1, noisy).otherwise(lost))
    return c.select("conv_id", "turn", F.round(W.word_error_rate("ref", "hyp"), 9).alias("wer"))


@query("p31_transcript_lines", """SELECT media_id, first_idx, '[' || printf('%.1f', "start") || 's - ' || printf('%.1f', "end") || 's] ' || text AS line FROM f_segments""")
def _(spark, d):
    s = W.punctuation_groups(X.doc_words(spark, d))
    return W.transcript_lines(s).select("media_id", "first_idx", "line")


@query("h05_words_from_layouts", """SELECT media_id, count(*) AS n FROM (SELECT media_id FROM f_doc_words UNION ALL SELECT doc_id FROM documents WHERE doc_id % 3 = 1) GROUP BY 1""")
def _(spark, d):
    return D.scan_words(transcript_blobs(spark, d)).groupBy("media_id").agg(F.count(F.lit(1)).alias("n"))
