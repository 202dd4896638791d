"""Queries on speaker attribution, turns and speech with motion."""

from pyspark.sql import functions as F

from ..operators import speakers as P
from . import fixtures as X
from .q_transcripts import W
from .registry import CTES, query

CTES["f_attr"] = """SELECT media_id, word_idx, word, "start", "end", coalesce(arg_min(speaker, k) FILTER (WHERE k IS NOT NULL), 'SPEAKER_00') AS speaker FROM
  (SELECT w.*, t.speaker, CASE WHEN t.turn_idx IS NOT NULL THEN row_number() OVER (PARTITION BY w.media_id, w.word_idx ORDER BY least(w."end", t.t_end) - greatest(w."start", t.t_start) DESC, t.turn_idx) END AS k
   FROM f_conv_words w LEFT JOIN f_turns t ON w.media_id = t.media_id AND least(w."end", t.t_end) - greatest(w."start", t.t_start) > -1e0) GROUP BY ALL"""


@query("j04_speaker_attribution", "SELECT media_id, word_idx, word, speaker FROM f_attr")
def _(spark, d):
    return P.attribute_words(X.conv_words(spark, d), X.turns(spark, d)).select("media_id", "word_idx", "word", "speaker")


CTES["f_merged"] = """SELECT media_id, speaker, CAST(island AS BIGINT) AS seg_idx, min("start") AS "start", max("end") AS "end", string_agg(word, ' ' ORDER BY word_idx) AS text FROM
  (SELECT *, sum(c) OVER (PARTITION BY media_id ORDER BY word_idx) AS island FROM (SELECT *, CASE WHEN lag(speaker) OVER (PARTITION BY media_id ORDER BY word_idx) <> speaker THEN 1 ELSE 0 END AS c FROM f_attr)) GROUP BY 1, 2, 3"""


def merged(spark, d):
    return P.merge_turns(P.attribute_words(X.conv_words(spark, d), X.turns(spark, d)))


@query("w08_speaker_turn_merge", "SELECT * FROM f_merged")
def _(spark, d):
    return merged(spark, d).select("media_id", "speaker", "seg_idx", "start", "end", "text")


CTES["f_lines3"] = """SELECT media_id, word_idx // 3 AS line_idx, min("start") AS "start", max("end") AS "end", string_agg(word, ' ' ORDER BY word_idx) AS text FROM f_conv_words GROUP BY 1, 2"""


@query("j05_midpoint_attribution", """SELECT l.media_id, line_idx, arg_min(speaker, turn_idx) AS speaker FROM f_lines3 l LEFT JOIN f_turns t
  ON l.media_id = t.media_id AND ("start" + "end") / 2 BETWEEN t_start AND t_end GROUP BY 1, 2""")
def _(spark, d):
    lines = W.fixed_groups(X.conv_words(spark, d), 3).select("media_id", "line_idx", "start", "end")
    return P.speaker_at(lines, X.turns(spark, d), (F.col("start") + F.col("end")) / 2).select("media_id", "line_idx", "speaker")


@query("j12_speaker_at_time", """SELECT w.media_id, word_idx, arg_min(speaker, turn_idx) AS speaker FROM f_conv_words w LEFT JOIN f_turns t
  ON w.media_id = t.media_id AND w."start" + 0.15e0 BETWEEN t_start AND t_end GROUP BY 1, 2""")
def _(spark, d):
    p = X.conv_words(spark, d).select("media_id", "word_idx", (F.col("start") + 0.15).alias("t"))
    return P.speaker_at(p, X.turns(spark, d), F.col("t")).select("media_id", "word_idx", "speaker")


CTES["f_spoken"] = """SELECT media_id, speaker, round(sum(t_end - t_start), 6) AS seconds, min(t_start) AS first_start FROM f_turns GROUP BY 1, 2"""


@query("a02_speaking_time", "SELECT media_id, speaker, seconds FROM f_spoken")
def _(spark, d):
    return P.speaking_time(X.turns(spark, d), start="t_start", end="t_end").select("media_id", "speaker", "seconds")


@query("a02_dominant_speaker", """SELECT media_id, num_speakers, dominant FROM (SELECT media_id, count(*) OVER (PARTITION BY media_id) AS num_speakers, speaker AS dominant,
  row_number() OVER (PARTITION BY media_id ORDER BY seconds DESC, first_start) AS rn FROM f_spoken) WHERE rn = 1""")
def _(spark, d):
    t = P.speaking_time(X.turns(spark, d), start="t_start", end="t_end")
    return P.speaker_summary(t).select("media_id", "num_speakers", "dominant")


@query("a03_distinct_speakers", "SELECT media_id, array_to_string(list_sort(list(DISTINCT speaker)), ',') AS speakers FROM f_attr GROUP BY 1")
def _(spark, d):
    a = P.attribute_words(X.conv_words(spark, d), X.turns(spark, d))
    return a.groupBy("media_id").agg(F.array_join(F.array_sort(F.collect_set("speaker")), ",").alias("speakers"))
