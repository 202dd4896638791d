"""Queries that produce caption lines, events and documents."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import captions as C
from ..operators import transcripts as W
from . import fixtures as X
from .q_transcripts import clips
from .registry import CTES, query

_NAMES = ["tiktok", "hormozi", "mrbeast", "minimal", "neon", "unknown"]


def styled_words(spark, d):
    pick = F.element_at(F.array(*[F.lit(n) for n in _NAMES]), (F.col("media_id") % 6 + 1).cast("int"))
    return C.with_style(X.conv_words(spark, d), pick)


def _values():
    rows = ", ".join("(" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in s) + ")" for s in C.STYLES)
    return (f"SELECT * FROM (VALUES {rows}) AS v(style, font, size, primary_c, highlight, outline, shadow, outline_width, shadow_depth, alignment, "
            "margin_v, bold, animation, words_per_line, npo)")


CTES["f_styles"] = _values()
CTES["f_swords"] = """SELECT w.*, s.* FROM (SELECT *, list_extract(['tiktok', 'hormozi', 'mrbeast', 'minimal', 'neon', 'tiktok'], media_id % 6 + 1) AS st FROM f_conv_words) w
  JOIN f_styles s ON s.style = w.st"""
CTES["f_slines"] = """SELECT media_id, word_idx // words_per_line AS line_idx, any_value(animation) AS animation, any_value(highlight) AS highlight, any_value(npo) AS npo, min("start") AS "start",
  max("end") AS "end", list(word ORDER BY word_idx) AS ws, list("start" ORDER BY word_idx) AS ss, list("end" ORDER BY word_idx) AS es FROM f_swords GROUP BY 1, 2"""


def _ass(x):
    return f"printf('%d:%02d:%02d.%02d', CAST(floor(({x}) / 3600e0) AS BIGINT), CAST(floor((({x}) % 3600e0) / 60e0) AS BIGINT), CAST(trunc(({x}) % 60e0) AS BIGINT), CAST(trunc((({x}) % 1e0) * 100e0) AS BIGINT))"


def _row(a, b, style, text):
    off = lambda v: f"greatest(0e0, {v} + npo / 1e3)"
    return f"'Dialogue: 0,' || {_ass(off(a))} || ',' || {_ass(off(b))} || ',{style},,0,0,0,,' || {text}"


CTES["f_color"] = "SELECT style, '&H00' || substr(highlight, 5, 2) || substr(highlight, 3, 2) || substr(highlight, 1, 2) AS hc, highlight AS h FROM f_styles"
_HL = "array_to_string(list_transform(ws, lambda w, j: CASE WHEN j = p THEN '{\\c' || '&H00' || substr(highlight, 5, 2) || substr(highlight, 3, 2) || substr(highlight, 1, 2) || '\\fscx110\\fscy110}' || w || '{\\r}' ELSE w END), ' ')"
_POP = "'{\\fscx80\\fscy80\\t(0,50,\\fscx110\\fscy110)\\t(50,100,\\fscx100\\fscy100)}' || list_extract(ws, p)"
_WAVE = ("array_to_string(list_transform(string_split(array_to_string(ws, ' '), ''), lambda c, i: CASE WHEN c = ' ' THEN c ELSE '{\\t(' || CAST((i - 1) * 50 AS VARCHAR) || ',' || CAST((i - 1) * 50 + 100 AS VARCHAR) "
         "|| ',\\frz10)\\t(' || CAST((i - 1) * 50 + 100 AS VARCHAR) || ',' || CAST((i - 1) * 50 + 200 AS VARCHAR) || ',\\frz0)}' || c END), '')")
CTES["f_per_word"] = "SELECT *, unnest(range(1, CAST(len(ws) AS BIGINT) + 1)) AS p FROM f_slines"
CTES["f_events"] = f"""SELECT media_id, line_idx, p - 1 AS event_idx, {_row('list_extract(ss, p)', 'list_extract(es, p)', 'Default', _HL)} AS event FROM f_per_word WHERE animation = 'highlight'
  UNION ALL SELECT media_id, line_idx, p - 1, {_row('list_extract(ss, p)', 'list_extract(es, p)', 'Highlight', _POP)} FROM f_per_word WHERE animation = 'pop'
  UNION ALL SELECT media_id, line_idx, 0, {_row('"start"', '"end"', 'Default', _WAVE)} FROM f_slines WHERE animation = 'wave'"""


def _events(spark, d):
    return C.events(C.styled_lines(styled_words(spark, d)))


for _name, _media in (("f11_highlight_events", "media_id % 6 IN (0, 2, 3, 5)"), ("f12_pop_events", "media_id % 6 = 1"), ("f13_wave_events", "media_id % 6 = 4")):
    # the animation of a media item follows its style, so this names the kind of event
    def _one(spark, d, kind=_name):
        anim = {"f11": "highlight", "f12": "pop", "f13": "wave"}[kind[:3]]
        lines = C.styled_lines(styled_words(spark, d)).where(F.col("animation") == anim)
        return C.events(lines).select("media_id", "line_idx", "event_idx", "event")

    query(_name, f"SELECT media_id, line_idx, event_idx, event FROM f_events WHERE {_media}")(_one)


@query("w09_styled_lines", """SELECT media_id, line_idx, animation, "start", "end", array_to_string(ws, ' ') AS text FROM f_slines""")
def _(spark, d):
    return C.styled_lines(styled_words(spark, d)).select("media_id", "line_idx", "animation", "start", "end", "text")


@query("f04_ass_time", f"""SELECT media_id, word_idx, {_ass('"start" * 37')} AS t FROM f_conv_words""")
def _(spark, d):
    return X.conv_words(spark, d).select("media_id", "word_idx", S.ass_time(F.col("start") * 37).alias("t"))


def _srt(x):
    us = f"CAST(round_even(({x}) * 1e6, 0) AS BIGINT)"
    return f"printf('%02d:%02d:%02d,%03d', ({us} // 1000000) % 86400 // 3600, ({us} // 1000000) % 3600 // 60, ({us} // 1000000) % 60, ({us} % 1000000) // 1000)"


@query("f05_srt_time", f"""SELECT media_id, word_idx, {_srt('"start" * 371')} AS t FROM f_conv_words""")
def _(spark, d):
    return X.conv_words(spark, d).select("media_id", "word_idx", S.srt_time(F.col("start") * 371).alias("t"))


@query("f06_clock_time", """SELECT media_id, word_idx, printf('%02d:%02d:%02d.%03d', CAST(floor(x / 3600) AS BIGINT), CAST(floor((x % 3600e0) / 60) AS BIGINT), CAST(trunc(x % 60e0) AS BIGINT),
  CAST(trunc((x % 1e0) * 1e3) AS BIGINT)) AS t FROM (SELECT media_id, word_idx, "start" * 37 AS x FROM f_conv_words)""")
def _(spark, d):
    return X.conv_words(spark, d).select("media_id", "word_idx", S.clock_time(F.col("start") * 37).alias("t"))


@query("f07_ass_color", """SELECT vec_id, '&H00' || substr(h, 5, 2) || substr(h, 3, 2) || substr(h, 1, 2) AS color FROM (SELECT vec_id, printf('%06X', (vec_id * 7919) % 16777216) AS h FROM embeddings)""")
def _(spark, d):
    hexed = F.concat(F.lit("#"), F.lower(F.lpad(F.hex((F.col("vec_id") * 7919) % 16777216), 6, "0")))
    return X.table(spark, d, "embeddings").select("vec_id", S.hex_to_ass_color(hexed).alias("color"))


_HEAD = """'[Script Info]' || chr(10) || 'Title: Animated Captions' || chr(10) || 'ScriptType: v4.00+' || chr(10) || 'PlayResX: 1080' || chr(10) || 'PlayResY: 1920' || chr(10) || 'WrapStyle: 0' || chr(10) || chr(10)
  || '[V4+ Styles]' || chr(10) || 'Format: Name, Fontname, Fontsize, PrimaryColour, SecondaryColour, OutlineColour, BackColour, Bold, Italic, Underline, StrikeOut, ScaleX, ScaleY, Spacing, Angle, BorderStyle, Outline, Shadow, Alignment, MarginL, MarginR, MarginV, Encoding' || chr(10)
  || 'Style: Default,' || font || ',' || size || ',' || pc || ',' || hc || ',' || oc || ',' || sc || ',' || CASE WHEN bold THEN '1' ELSE '0' END || ',0,0,0,100,100,0,0,1,' || outline_width || ',' || shadow_depth || ',' || alignment || ',10,10,' || margin_v || ',1' || chr(10)
  || 'Style: Highlight,' || font || ',' || CAST(trunc(size * 1.1e0) AS INTEGER) || ',' || hc || ',' || pc || ',' || oc || ',' || sc || ',' || CASE WHEN bold THEN '1' ELSE '0' END || ',0,0,0,100,100,0,0,1,' || outline_width || ',' || shadow_depth || ',' || alignment || ',10,10,' || margin_v || ',1' || chr(10)"""
_BGR = lambda c: f"'&H00' || substr({c}, 5, 2) || substr({c}, 3, 2) || substr({c}, 1, 2)"
CTES["f_heads"] = f"""SELECT style, {_HEAD} AS head FROM (SELECT *, {_BGR('primary_c')} AS pc, {_BGR('highlight')} AS hc, {_BGR('outline')} AS oc, {_BGR('shadow')} AS sc FROM f_styles)"""


@query("f14_ass_header", "SELECT media_id, head FROM (SELECT DISTINCT media_id, style FROM f_swords) JOIN f_heads USING (style)")
def _(spark, d):
    m = styled_words(spark, d).drop("word_idx", "word", "start", "end").distinct()
    return m.select("media_id", C.ass_header().alias("head"))


@query("s15_ass_documents", """SELECT media_id, head || chr(10) || '[Events]' || chr(10) || 'Format: Layer, Start, End, Style, Name, MarginL, MarginR, MarginV, Effect, Text' || chr(10) || body AS document
  FROM (SELECT media_id, string_agg(event || chr(10), '' ORDER BY line_idx, event_idx) AS body FROM f_events GROUP BY 1)
  JOIN (SELECT DISTINCT media_id, style FROM f_swords) USING (media_id) JOIN f_heads USING (style)""")
def _(spark, d):
    w = styled_words(spark, d)
    rows = C.events(C.styled_lines(w)).withColumns({
        "pos": F.col("line_idx") * 8 + F.col("event_idx"), "event": F.concat("event", F.lit("\n"))})
    head = w.drop("word_idx", "word", "start", "end").distinct().select("media_id", C.ass_header().alias("head"))
    return C.clip_documents(rows, ["media_id"], "pos", "event", head).select("media_id", "document")


CTES["f_clip_words"] = """SELECT m.media_id * 10 + moment_idx AS clip_id, row_number() OVER (PARTITION BY m.media_id, moment_idx ORDER BY word_idx) - 1 AS word_idx, word,
  greatest(0e0, "start" - start_time) AS "start", least(end_time - start_time, "end" - start_time) AS "end" FROM f_moments m JOIN f_doc_words w
  ON m.media_id = w.media_id AND w."start" <= end_time AND w."end" >= start_time"""


@query("s15_srt_documents", f"""SELECT clip_id, string_agg(CAST(line_idx + 1 AS VARCHAR) || chr(10) || {_srt('a')} || ' --> ' || {_srt('b')} || chr(10) || text || chr(10) || chr(10), '' ORDER BY line_idx) AS document
  FROM (SELECT clip_id, word_idx // 3 AS line_idx, min("start") AS a, max("end") AS b, string_agg(word, ' ' ORDER BY word_idx) AS text FROM f_clip_words GROUP BY 1, 2) GROUP BY 1""")
def _(spark, d):
    w = W.retime(X.laid_doc_words(spark, d), clips(spark, d), "start", "end").select(
        (F.col("media_id") * 10 + F.col("clip_idx")).alias("clip_id"), "word_idx", "word", F.col("out_start").alias("start"), F.col("out_end").alias("end"))
    # a clip's words are moved once, by clip; lines and the document are gathered where they lie
    w = w.withColumn("word_idx", F.col("word_idx") - F.min("word_idx").over(Window.partitionBy("clip_id")))
    return C.clip_documents(C.srt_blocks(w, "clip_id"), ["clip_id"], "line_idx", "block")


@query("p23_perceptual_shift", """SELECT media_id, word_idx, greatest(0e0, "start" + -50 / 1e3) AS "start", greatest(0e0, "end" + -50 / 1e3) AS "end" FROM f_conv_words""")
def _(spark, d):
    return X.conv_words(spark, d).select("media_id", "word_idx", S.perceptual_shift("start", -50).alias("start"), S.perceptual_shift("end", -50).alias("end"))


@query("j11_active_caption_line", """SELECT media_id, t, line_idx, text AS line_text, wp AS word_pos FROM (SELECT f.media_id, f.t, l.line_idx, text,
  (SELECT min(i) FROM (SELECT unnest(range(0, CAST(len(ss) AS BIGINT))) AS i) WHERE f.t + 0.05e0 BETWEEN list_extract(ss, i + 1) AND list_extract(es, i + 1)) AS wp,
  row_number() OVER (PARTITION BY f.media_id, f.t ORDER BY l.line_idx) AS rn
  FROM (SELECT media_id, "start" * 0.7e0 AS t FROM f_conv_words) f JOIN (SELECT media_id, word_idx // 4 AS line_idx, min("start") AS a, max("end") AS b, string_agg(word, ' ' ORDER BY word_idx) AS text,
  list("start" ORDER BY word_idx) AS ss, list("end" ORDER BY word_idx) AS es FROM f_conv_words GROUP BY 1, 2) l ON f.media_id = l.media_id AND f.t + 0.05e0 BETWEEN a AND b) WHERE rn = 1""")
def _(spark, d):
    words = X.conv_words(spark, d)
    return C.active_line(words.select("media_id", (F.col("start") * 0.7).alias("t")), W.fixed_groups(words, 4)).select(
        "media_id", "t", "line_idx", "line_text", "word_pos")


@query("f15_safe_zone", """SELECT media_id, CAST(trunc(l + (r - l) // 2 - tw / 2) AS INTEGER) AS x, least(1670, h - 250) - 180 AS y FROM (SELECT media_id, CASE WHEN w >= 1080 THEN 35 ELSE 10 END AS l,
  CASE WHEN w >= 1080 THEN 1045 ELSE w - 10 END AS r, height AS h, duration % 700e0 AS tw FROM (SELECT *, CASE WHEN media_id % 2 = 0 THEN width ELSE width // 2 END AS w FROM f_probes))""")
def _(spark, d):
    o = X.table(spark, d, "orders")
    k = F.col("o_orderkey")
    w0 = F.when(k % 3 == 0, 1080).otherwise(1280)
    width = F.when(k % 2 == 0, w0).otherwise(F.floor(w0 / 2).cast("int"))
    height = F.element_at(F.array(F.lit(1920), F.lit(1080), F.lit(720)), (k % 3 + 1).cast("int"))
    x, y = C.caption_place((F.col("o_totalprice") / 100) % 700.0, width, height, F.lit(180))
    return o.select(k.alias("media_id"), x.alias("x"), y.alias("y"))
