"""Caption lines, event rows and documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from . import intervals as I
from . import ordered as O
from .transcripts import fixed_groups, ordered_text

STYLE_SCHEMA = (
    "style string, font string, size int, primary string, highlight string, outline string, shadow string, outline_width int, "
    "shadow_depth int, alignment int, margin_v int, bold boolean, animation string, words_per_line int, npo int")
# fixed values: the five caption presets
STYLES = [
    ("tiktok", "Impact", 70, "FFFFFF", "00FF00", "000000", "000000", 6, 4, 2, 180, True, "highlight", 2, -50),
    ("hormozi", "Arial Black", 80, "FFFFFF", "FFFF00", "000000", "000000", 6, 5, 2, 200, True, "pop", 1, -50),
    ("mrbeast", "Impact", 70, "FFFFFF", "FF0000", "000000", "000000", 6, 4, 2, 180, True, "highlight", 3, -50),
    ("minimal", "Helvetica", 64, "FFFFFF", "AAAAFF", "000000", "000000", 4, 3, 2, 150, False, "highlight", 4, 0),
    ("neon", "Arial", 65, "00FFFF", "FF00FF", "000000", "000000", 4, 6, 2, 180, True, "wave", 2, -50),
]
# fixed values: margins of the platform safe zone
SAFE_LEFT, SAFE_RIGHT, SAFE_BOTTOM = 35, 1045, 1670


def styles(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(STYLES, STYLE_SCHEMA)


def with_style(df: DataFrame, style: str | Column = "style") -> DataFrame:
    """Attach the preset columns; an unknown name means the first preset. Five rows: broadcast."""
    name = F.lower(F.col(style) if isinstance(style, str) else style)
    known = F.when(name.isin([s[0] for s in STYLES]), name).otherwise(STYLES[0][0])
    return df.withColumn("style", known).join(F.broadcast(styles(df.sparkSession)), "style")


def styled_lines(words: DataFrame, key: str = "media_id") -> DataFrame:
    """Lines of words_per_line words; ``words`` carries the style columns."""
    keep = ["style", "highlight", "animation", "npo"]
    look = words.select(key, *keep).distinct()
    lines = fixed_groups(words, F.col("words_per_line"), key)
    return O.join_stats(lines, look, [key], "line_idx")


def events(lines: DataFrame, key: str = "media_id") -> DataFrame:
    """Dialogue rows of each line in its animation, numbered within the line."""
    shift = lambda c: S.perceptual_shift(c, F.col("npo"))
    texts = F.transform("words", lambda w: w["word"])
    per_word = lines.where("animation IN ('highlight', 'pop')").select(
        key, "line_idx", "animation", "highlight", "npo", texts.alias("texts"), F.posexplode("words").alias("event_idx", "w"))
    text = F.when(F.col("animation") == "pop", S.pop_text(F.col("w.word"))).otherwise(
        S.highlight_text("texts", F.col("event_idx"), F.col("highlight")))
    a, b = shift(F.col("w.start")), shift(F.col("w.end"))
    row = F.when(F.col("animation") == "pop", S.dialogue(a, b, "Highlight", text)).otherwise(S.dialogue(a, b, "Default", text))
    waves = lines.where("animation = 'wave'").select(
        key, "line_idx", F.lit(0).alias("event_idx"),
        S.dialogue(shift(F.col("start")), shift(F.col("end")), "Default", S.wave_text("text")).alias("event"))
    return per_word.select(key, "line_idx", "event_idx", row.alias("event")).unionByName(waves)


def ass_header(width: Column | int = 1080, height: Column | int = 1920) -> Column:
    """Script header with the Default and Highlight styles of the preset columns."""
    num = lambda v: (v if isinstance(v, Column) else F.lit(v)).cast("string")
    col = lambda c: S.hex_to_ass_color(F.col(c))
    # fixed values: section names and field lists of the format
    fields = ("Format: Name, Fontname, Fontsize, PrimaryColour, SecondaryColour, OutlineColour, BackColour, Bold, Italic, Underline, "
              "StrikeOut, ScaleX, ScaleY, Spacing, Angle, BorderStyle, Outline, Shadow, Alignment, MarginL, MarginR, MarginV, Encoding")

    def style(name: str, size: Column, first: str, second: str) -> Column:
        return F.concat_ws(
            ",", F.concat(F.lit(f"Style: {name}")), "font", size.cast("string"), col(first), col(second), col("outline"), col("shadow"),
            F.col("bold").cast("int").cast("string"), F.lit("0,0,0,100,100,0,0,1"), num(F.col("outline_width")), num(F.col("shadow_depth")),
            num(F.col("alignment")), F.lit("10,10"), num(F.col("margin_v")), F.lit("1"))

    return F.concat(
        F.lit("[Script Info]\nTitle: Animated Captions\nScriptType: v4.00+\nPlayResX: "), num(width), F.lit("\nPlayResY: "), num(height),
        F.lit("\nWrapStyle: 0\n\n[V4+ Styles]\n" + fields + "\n"), style("Default", F.col("size"), "primary", "highlight"), F.lit("\n"),
        style("Highlight", (F.col("size") * 1.1).cast("int"), "highlight", "primary"), F.lit("\n"))


EVENTS_HEAD = "\n[Events]\nFormat: Layer, Start, End, Style, Name, MarginL, MarginR, MarginV, Effect, Text\n"


def srt_blocks(words: DataFrame, key: str = "media_id", n: int = 3) -> DataFrame:
    """Numbered subtitle blocks of ``n`` words."""
    lines = fixed_groups(words, n, key)
    block = F.concat((F.col("line_idx") + 1).cast("string"), F.lit("\n"), S.srt_time("start"), F.lit(" --> "), S.srt_time("end"),
                     F.lit("\n"), "text", F.lit("\n\n"))
    return lines.select(key, "line_idx", block.alias("block"))


def clip_documents(blocks: DataFrame, keys: list[str], order: str, text: str, head: DataFrame | None = None) -> DataFrame:
    """One caption document per clip (a clip is short, so its document is)."""
    d = ordered_text(blocks, keys, order, text, "body", sep="")
    if head is None:
        return d.withColumnRenamed("body", "document")
    return d.join(head, keys).withColumn("document", F.concat("head", F.lit(EVENTS_HEAD), "body")).drop("head", "body")


def active_line(frames: DataFrame, lines: DataFrame, key: str = "media_id", npo_ms: float = -50.0, width: float = 5.0) -> DataFrame:
    """First line on screen at each time ``t`` and the index of its active word, if any."""
    at = F.col("t") - F.lit(npo_ms / 1000.0)
    l = lines.select(key, "line_idx", F.col("start").alias("l_start"), F.col("end").alias("l_end"), F.col("text").alias("line_text"), "words")
    d = I.point_join(I.numbered(frames).withColumn("__at", at), l, [key], F.col("__at"), (F.col("l_start"), F.col("l_end")),
                     F.col("__at").between(F.col("l_start"), F.col("l_end")), width)
    word = F.array_position(F.transform("words", lambda w: F.col("__at").between(w["start"], w["end"])), F.lit(True)) - 1
    pick = F.struct("line_idx", "line_text", F.nullif(word, F.lit(-1)).alias("word_pos"))
    g = d.withColumn("__p", pick).groupBy(I.ROW).agg(*[F.first(c).alias(c) for c in frames.columns], F.min("__p").alias("p"))
    return g.select(*frames.columns, "p.*")


def caption_place(text_width: Column, width: Column, height: Column, margin_v: Column) -> tuple[Column, Column]:
    """Left edge and baseline of a centred line inside the platform safe zone."""
    left = F.when(width >= 1080, SAFE_LEFT).otherwise(10)
    right = F.when(width >= 1080, F.lit(SAFE_RIGHT)).otherwise(width - 10)
    centre = left + F.floor((right - left) / 2)
    return (centre - text_width / 2).cast("int"), F.least(F.lit(SAFE_BOTTOM), height - 250) - margin_v
