"""Words: grouping, slicing, timing repair, roll-ups."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scalars as S
from . import intervals as I
from . import ordered as O


def ordered_text(df: DataFrame, keys: Sequence[str], order: str, text: str, out: str,
                 extremes: dict[str, tuple] | None = None, sep: str = " ") -> DataFrame:
    """Join the texts of each group in order, first within chunks, then across them.

    ``extremes`` maps an output name to (column, F.min or F.max).
    """
    ex = extremes or {}
    join = lambda items, field: F.array_join(F.transform(F.array_sort(F.collect_list(items)), lambda r: r[field]), sep)
    part = O.chunked(df, order).groupBy(*keys, O.CHUNK).agg(
        join(F.struct(order, text), text).alias("__t"), *[fn(c).alias(n) for n, (c, fn) in ex.items()])
    return part.groupBy(*keys).agg(
        join(F.struct(O.CHUNK, "__t"), "__t").alias(out), *[fn(n).alias(n) for n, (_, fn) in ex.items()])


def _as_lines(groups: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Groups with their words in order as lines: first start and last end."""
    return groups.select(
        *keys, F.col("words")[0]["word_idx"].alias("first_idx"), F.size("words").alias("n_words"),
        F.col("words")[0]["start"].alias("start"), F.element_at("words", -1)["end"].alias("end"),
        F.array_join(F.transform("words", lambda w: w["word"]), " ").alias("text"), "words")


def _lines(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per group with its words in order."""
    return _as_lines(df.groupBy(*keys).agg(_in_order().alias("words")), keys)


def _in_order() -> Column:
    return F.array_sort(F.collect_list(F.struct("word_idx", "word", "start", "end")))


def _lines_of_chunks(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The same for rows that lie by chunk already, as behind ``with_carry``, and groups that are runs of words.

    A run is gathered inside its chunk without moving a word; only runs that hold the first or last word of their
    chunk can go on in another one, and only these are moved and joined.
    """
    g = df.groupBy(O.CHUNK, *keys).agg(_in_order().alias("words"))
    a, b, here = F.col("words")[0]["word_idx"], F.element_at("words", -1)["word_idx"], Window.partitionBy(O.CHUNK)
    g = g.withColumn("__open", F.coalesce((a == F.min(a).over(here)) | (b == F.max(b).over(here)), F.lit(True)))
    part = F.struct(F.col(O.CHUNK)["__no"].alias("no"), "words")
    joined = F.flatten(F.transform(F.array_sort(F.collect_list(part)), lambda r: r["words"]))
    rest = g.where("__open").groupBy(*keys).agg(joined.alias("words"))
    return _as_lines(g.where(~F.col("__open")).select(*keys, "words").unionByName(rest), keys)


def fixed_groups(words: DataFrame, n: int | Column, key: str = "media_id") -> DataFrame:
    """Lines of ``n`` words (word_idx counts from 0, so no window is needed)."""
    size = F.lit(n) if isinstance(n, int) else n
    return _lines(words.withColumn("line_idx", F.floor(F.col("word_idx") / size)), [key, "line_idx"])


def punctuation_groups(words: DataFrame, max_words: int = 10, closers: str = ".!?,", key: str = "media_id") -> DataFrame:
    """Lines closed by punctuation or after ``max_words`` words. Words that lie by chunk (``ordered.is_laid``) stay where they are."""
    ends = F.substring("word", -1, 1).isin(list(closers)) & (F.length("word") > 0)
    closing = F.when(ends, 1).otherwise(0)
    at = F.when(closing == 1, F.col("word_idx"))
    kept = [key, "word_idx", "word", "start", "end"]
    d = words.select(*kept, O.CHUNK) if O.is_laid(words, [key]) else O.chunked(words.select(*kept), "word_idx")
    d = O.with_carry(
        d, [key], {"__n": F.sum(closing), "__last": F.max(at)},
        {"__off": lambda w: F.coalesce(F.sum("__n").over(O.before(w)), F.lit(0)),
         "__prev": lambda w: F.max("__last").over(O.before(w))})
    w = O.before(O.chunk_window(["word_idx"]))
    island = F.col("__off") + F.coalesce(F.sum(closing).over(w), F.lit(0))
    first = F.coalesce(F.max(at).over(w), F.col("__prev"), F.lit(-1)) + 1
    d = d.withColumns({"island": island, "part": F.floor((F.col("word_idx") - first) / max_words)})
    return _lines_of_chunks(d, [key, "island", "part"])


def segments_or_whole(words: DataFrame, texts: DataFrame, max_words: int = 10, key: str = "media_id") -> DataFrame:
    """Segments per media; a media without words gives one zero-length segment with its text."""
    segs = punctuation_groups(words, max_words, key=key).select(key, "first_idx", "start", "end", "text")
    bare = texts.join(words.select(key).distinct(), key, "left_anti").select(
        key, F.lit(0).alias("first_idx"), F.lit(0.0).alias("start"), F.lit(0.0).alias("end"), "text")
    return segs.unionByName(bare)


def slice_text(words: DataFrame, spans: DataFrame, key: str = "media_id", span: str = "moment_idx", width: float = 60.0) -> DataFrame:
    """Text of the words that start inside each span; '' when none does."""
    hits = I.point_join(
        words, spans.select(key, span, "start_time", "end_time"), [key], F.col("start"), (F.col("start_time"), F.col("end_time")),
        (F.col("start") >= F.col("start_time")) & (F.col("start") <= F.col("end_time")), width)
    text = ordered_text(hits, [key, span], "word_idx", "word", "text")
    return spans.join(text, [key, span], "left").withColumn("text", F.coalesce("text", F.lit("")))


def slice_segments(segments: DataFrame, spans: DataFrame, key: str = "media_id", span: str = "moment_idx", width: float = 60.0) -> DataFrame:
    """Same for segments without words: they must lie inside the span as a whole."""
    hits = I.point_join(
        segments, spans.select(key, span, "start_time", "end_time"), [key], F.col("start"), (F.col("start_time"), F.col("end_time")),
        (F.col("start") >= F.col("start_time")) & (F.col("end") <= F.col("end_time")), width)
    return ordered_text(hits, [key, span], "seg_idx", "text", "slice")


def rollup(words: DataFrame, key: str = "media_id") -> DataFrame:
    """Full text, word count and duration per media."""
    text = ordered_text(words, [key], "word_idx", "word", "full_text", {"duration": ("end", F.max)})
    return text.join(words.groupBy(key).agg(F.count(F.lit(1)).alias("word_count")), key)


def absolute_times(words: DataFrame, window_stride: float | None = None) -> DataFrame:
    """Chunk-relative offsets to seconds; the stride is 8 windows, 0.08 s when unknown."""
    stride = 0.08 if window_stride is None else 8 * window_stride
    at = lambda c: S.py_round(F.col(c) * F.lit(stride) + F.col("chunk_start"), 3)
    return words.withColumns({"start": at("start_offset"), "end": at("end_offset")})


def close_open_words(words: DataFrame, default: float = 0.1) -> DataFrame:
    """A missing end becomes start + default; no start or blank text drops the word."""
    d = words.withColumns({"word": S.strip("word"), "end": F.coalesce("end", F.col("start") + default)})
    return d.where(F.col("start").isNotNull() & (F.col("word") != ""))


def audio_chunks(media: DataFrame, duration: str = "duration", seconds: float = 60.0) -> DataFrame:
    """Fixed-length chunks that cover each media item."""
    n = F.ceil(F.col(duration) / F.lit(seconds)).cast("int")
    steps = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    d = media.withColumn("chunk_idx", F.explode(steps))
    return d.withColumns({"chunk_start": F.col("chunk_idx") * F.lit(seconds),
                          "chunk_end": F.least((F.col("chunk_idx") + 1) * F.lit(seconds), F.col(duration))})


def uniform_words(chunks: DataFrame, text: str = "text") -> DataFrame:
    """Spread a chunk's words evenly over its duration (confidence 0.5)."""
    d = chunks.withColumn("__w", S.split_words(text)).where(F.size("__w") > 0)
    d = d.withColumn("__d", (F.col("chunk_end") - F.col("chunk_start")) / F.size("__w"))
    d = d.select("*", F.posexplode("__w").alias("pos", "word"))
    at = lambda p: S.py_round(F.col("chunk_start") + p * F.col("__d"), 3)
    return d.withColumns({"start": at(F.col("pos")), "end": at(F.col("pos") + 1), "confidence": F.lit(0.5)}).drop("__w", "__d")


def transcript_lines(segments: DataFrame) -> DataFrame:
    """``[12.3s - 15.0s] text`` per segment."""
    return segments.withColumn("line", F.concat(
        F.lit("["), S.fixed("start"), F.lit("s - "), S.fixed("end"), F.lit("s] "), "text"))


MASKS_KEPT = 256


def word_edits(a: Sequence[str], b: Sequence[str]) -> int:
    """Least substitutions, insertions and deletions between two word lists, bit-parallel.

    A column of the edit table is two bit vectors, which of its vertical steps go up and which go
    down, held in Python integers as long as the longer list, so one word of the shorter list costs about a dozen
    operations on whole vectors. Common ends are cut off first. Masks of at most ``MASKS_KEPT`` words are kept;
    those of rarer words are built when met, so memory grows with the lists' length, not its square.
    """
    low, end = 0, min(len(a), len(b))
    while low < end and a[low] == b[low]:
        low += 1
    tail = 0
    while tail < end - low and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    a, b = a[low : len(a) - tail], b[low : len(b) - tail]
    if len(a) < len(b):
        a, b = b, a
    if not len(b):
        return len(a)
    places: dict[str, list[int]] = {}
    for i, w in enumerate(a):
        places.setdefault(w, []).append(i)
    kept: dict[str, int] = {}
    for w in sorted(places, key=lambda w: -len(places[w]))[:MASKS_KEPT]:
        bits = bytearray(len(a) // 8 + 1)
        for i in places[w]:
            bits[i >> 3] |= 1 << (i & 7)
        kept[w] = int.from_bytes(bits, "little")
    full, top = (1 << len(a)) - 1, 1 << (len(a) - 1)
    up, down, edits = full, 0, len(a)
    for w in b:
        same = kept.get(w)
        if same is None:
            same = 0
            for i in places.get(w, ()):
                same |= 1 << i
        across = (((same & up) + up) ^ up) | same
        plus, minus = down | (full & ~(across | up)), up & across
        if plus & top:
            edits += 1
        elif minus & top:
            edits -= 1
        plus, free = plus << 1 | 1, same | down
        up, down = (minus << 1 | ~(free | plus)) & full, plus & free & full
    return edits


@F.pandas_udf(T.DoubleType())
def word_error_rate(ref: pd.Series, hyp: pd.Series) -> pd.Series:
    """Word edits (substitute, insert, delete) over reference length, per row; null where a side is null."""

    def one(a, b):
        if a is None or b is None:
            return None
        if len(a) == 0:
            return 0.0 if len(b) == 0 else 1.0
        return word_edits(list(a), list(b)) / len(a)

    return pd.Series([one(a, b) for a, b in zip(ref, hyp)], dtype="float64")


def retime(items: DataFrame, clips: DataFrame, start: str, end: str, key: str = "media_id", width: float = 60.0,
           min_len: float | None = None) -> DataFrame:
    """Items that overlap a clip, on the clip's clock and clamped to it.

    ``clips`` has (key, clip_idx, clip_start, clip_end). ``min_len`` drops shorter leftovers. Items that lie by chunk
    (``ordered.is_laid``) stay where they are, and the clips go to them.
    """
    c = clips.select(key, "clip_idx", "clip_start", "clip_end")
    spans = (F.col(start), F.col(end)), (F.col("clip_start"), F.col("clip_end"))
    meet = (F.col(start) <= F.col("clip_end")) & (F.col(end) >= F.col("clip_start"))
    if O.is_laid(items, [key]):
        d = I.overlap_join_laid(items, c, [key], O.CHUNK, *spans, meet, width).drop(O.CHUNK)
    else:
        d = I.overlap_join(items, c, [key], *spans, meet, width)
    d = d.withColumns({
        "out_start": F.greatest(F.lit(0.0), F.col(start) - F.col("clip_start")),
        "out_end": F.least(F.col("clip_end") - F.col("clip_start"), F.col(end) - F.col("clip_start"))})
    return d if min_len is None else d.where(F.col("out_end") - F.col("out_start") > min_len)


def retime_frames(points: DataFrame, clips: DataFrame, fps: float = 30.0, key: str = "media_id", bucket_frames: int = 300) -> DataFrame:
    """Track points moved to each clip's frame count (with one second of padding)."""
    first = (F.col("clip_start") * fps).cast("bigint")
    span = ((F.col("clip_end") - F.col("clip_start")) * fps).cast("bigint") + int(fps)
    c = clips.select(key, "clip_idx", first.alias("__f0"), (first + span - 1).alias("__f1"))
    d = I.point_join(points, c, [key], F.col("frame_idx"), (F.col("__f0"), F.col("__f1")),
                     F.col("frame_idx").between(F.col("__f0"), F.col("__f1")), bucket_frames)
    return d.withColumn("clip_frame", F.col("frame_idx") - F.col("__f0")).drop("__f0", "__f1")
