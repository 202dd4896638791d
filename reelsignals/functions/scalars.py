"""Scalar expressions: every function takes and returns Columns (JVM side only)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# --- time -----------------------------------------------------------------

def ntz_micros(ts) -> Column:
    """Microseconds since 1970 of a TIMESTAMP_NTZ, whatever the session zone."""
    gap = _c(ts).cast("timestamp_ntz") - F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'")
    part = lambda unit: F.extract(F.lit(unit), gap)
    return (
        part("DAY").cast("bigint") * F.lit(86_400_000_000)
        + part("HOUR").cast("bigint") * F.lit(3_600_000_000)
        + part("MINUTE").cast("bigint") * F.lit(60_000_000)
        + (part("SECOND") * F.lit(1_000_000)).cast("bigint")
    )


def iso_micros(text) -> Column:
    """Microseconds since 1970 of an ISO string with zone; null when unusable."""
    t = _c(text)
    return F.when(t.rlike(r"(Z|[+-]\d{2}:?\d{2})$"), F.unix_micros(F.try_to_timestamp(t)))


def parse_iso_duration(text) -> Column:
    """``PT1H24M35S`` -> 5075; anything that does not start that way -> 0."""
    t = F.upper(_c(text))
    pat = r"^PT(?:(\d+)H)?(?:(\d+)M)?(?:(\d+)S)?"
    part = lambda i: F.coalesce(F.regexp_extract(t, pat, i).try_cast("int"), F.lit(0))
    return F.coalesce(part(1) * 3600 + part(2) * 60 + part(3), F.lit(0))


def format_duration(seconds) -> Column:
    """Seconds -> ``H:MM:SS``, or ``M:SS`` below one hour."""
    s = _c(seconds).cast("bigint")
    h, m, sec = F.floor(s / 3600), F.floor((s % 3600) / 60), s % 60
    return F.when(h > 0, F.format_string("%d:%02d:%02d", h, m, sec)).otherwise(
        F.format_string("%d:%02d", m, sec)
    )


def _hms(seconds: Column) -> tuple[Column, Column, Column]:
    return (
        F.floor(seconds / 3600.0),
        F.floor((seconds % 3600.0) / 60.0),
        (seconds % 60.0).cast("bigint"),
    )


def ass_time(seconds) -> Column:
    """``H:MM:SS.cc`` with truncated centiseconds."""
    x = _c(seconds)
    h, m, s = _hms(x)
    return F.format_string("%d:%02d:%02d.%02d", h, m, s, ((x % 1.0) * 100.0).cast("bigint"))


def srt_time(seconds) -> Column:
    """``HH:MM:SS,mmm``: microseconds half-even, milliseconds truncated, wraps at 24 h."""
    us = F.bround(_c(seconds) * 1e6).cast("bigint")
    sec = F.floor(us / 1_000_000) % 86400
    ms = F.floor((us % 1_000_000) / 1000)
    return F.format_string(
        "%02d:%02d:%02d,%03d", F.floor(sec / 3600), F.floor((sec % 3600) / 60), sec % 60, ms
    )


def clock_time(seconds) -> Column:
    """``HH:MM:SS.mmm`` with truncated milliseconds, as cutting tools read it."""
    x = _c(seconds)
    h, m, s = _hms(x)
    return F.format_string("%02d:%02d:%02d.%03d", h, m, s, ((x % 1.0) * 1000.0).cast("bigint"))


def parse_fps(text, default: float = 0.0) -> Column:
    """``30000/1001`` or plain number; junk and zero denominators -> ``default``."""
    t = _c(text)
    two = F.split(t, "/")
    ratio = F.try_divide(F.get(two, F.lit(0)).try_cast("double"), F.get(two, F.lit(1)).try_cast("double"))
    return F.coalesce(
        F.when(F.size(two) == 2, ratio).when(F.size(two) == 1, t.try_cast("double")), F.lit(default)
    )


def py_round(value, digits: int = 3) -> Column:
    """Round to the nearest, judged on the exact binary value (ties to even).

    The product with the power of ten is followed by its exact rounding error
    (splitting the factor in two halves), so that near-ties fall on the right side.
    """
    x, b = _c(value), F.lit(float(10**digits))
    p, c = x * b, x * F.lit(134217729.0)
    near_tie = F.abs(p - F.floor(p) - 0.5) < 1e-4
    high = c - (c - x)
    error = (high * b - p) + (x - high) * b
    k = F.floor(p).cast("double")
    side = (p - k - 0.5) + error
    up = F.when(side > 0, 1.0).when(side < 0, 0.0).otherwise(F.pmod(k, F.lit(2.0)))
    # only near-ties evaluate the long form
    return F.when(near_tie, (k + up) / b).otherwise(F.rint(p) / b)


# --- text -----------------------------------------------------------------

def strip(text) -> Column:
    return F.regexp_replace(_c(text), r"^\s+|\s+$", "")


def fixed(value, digits: int = 1) -> Column:
    """Fixed-point text, rounded on the exact binary value."""
    pattern = "0" if digits == 0 else "0." + "0" * digits
    return F.call_function("format_number", py_round(value, digits), F.lit(pattern))


def split_words(text) -> Column:
    """Whitespace split; blank text gives an empty array."""
    t = F.regexp_replace(_c(text), r"^\s+|\s+$", "")
    return F.when(F.length(t) > 0, F.split(t, r"\s+")).otherwise(F.array().cast("array<string>"))


def parse_engagement(text) -> Column:
    """``1.2M views`` -> 1.2e6; no number -> 0.0."""
    t = F.upper(F.replace(F.coalesce(_c(text), F.lit("")), F.lit(","), F.lit("")))
    pat = r"([0-9.]+)\s*([KMBT])?"
    # fixed values: unit multipliers
    scale = (
        F.when(F.regexp_extract(t, pat, 2) == "K", 1e3)
        .when(F.regexp_extract(t, pat, 2) == "M", 1e6)
        .when(F.regexp_extract(t, pat, 2) == "B", 1e9)
        .when(F.regexp_extract(t, pat, 2) == "T", 1e12)
        .otherwise(1.0)
    )
    return F.coalesce(F.regexp_extract(t, pat, 1).try_cast("double") * scale, F.lit(0.0))


def split_hashtags(text) -> Column:
    parts = F.transform(F.split(F.coalesce(_c(text), F.lit("")), "#"), lambda h: F.trim(h))
    return F.filter(parts, lambda h: h != "")


def first_filled(*cols) -> Column:
    """First alternate that is not blank after trimming."""
    return F.coalesce(*[F.nullif(F.trim(_c(c)), F.lit("")) for c in cols])


def topic_words(tags, title, title_words: int = 5, keep: int = 6) -> Column:
    """First three tags and first title words, cut to ``keep``."""
    joined = F.concat(F.slice(_c(tags), 1, 3), F.slice(split_words(title), 1, title_words))
    return F.array_join(F.slice(joined, 1, keep), " ")


def thumbnail_url(thumbnails) -> Column:
    """maxres, else high, else default; a present entry without url gives ''."""
    t = _c(thumbnails)
    pick = lambda k: F.when(t[k].isNotNull(), F.coalesce(t[k]["url"], F.lit("")))
    return F.coalesce(pick("maxres"), pick("high"), pick("default"), F.lit(""))


def engagement_rate(likes, comments, views) -> Column:
    v = _c(views)
    return F.when(v == 0, F.lit(0.0)).otherwise((_c(likes) + _c(comments)) / v)


def watch_url(video_id) -> Column:
    return F.concat(F.lit("https://www.youtube.com/watch?v="), _c(video_id).cast("string"))


def sanitize_name(text, max_len: int = 60) -> Column:
    """File-safe name: unsafe characters to ``_``, edges stripped, then cut."""
    safe = F.regexp_replace(_c(text), r'[<>:"/\\|?*\x00-\x1f]', "_")
    return F.substring(F.regexp_replace(safe, r"^[ ._]+|[ ._]+$", ""), 1, max_len)


def overlay_text(text) -> Column:
    """Escape quote and colon for the overlay filter, cut long text with dots."""
    t = F.replace(F.replace(_c(text), F.lit("'"), F.lit("\\'")), F.lit(":"), F.lit("\\:"))
    return F.when(F.length(t) > 100, F.concat(F.substring(t, 1, 97), F.lit("..."))).otherwise(t)


def broaden_query(query, words: int = 3) -> Column:
    return F.array_join(F.slice(split_words(query), 1, words), " ")


def query_variants(topic, query=None) -> Column:
    """The primary query and its two fallbacks, blanks left out."""
    t = F.nullif(_c(topic), F.lit(""))
    q = F.nullif(_c(query), F.lit("")) if query is not None else F.lit(None).cast("string")
    primary = F.coalesce(q, F.concat(t, F.lit(" analysis deep dive 2026")))
    return F.array_compact(
        F.array(primary, F.concat(t, F.lit(" explained")), F.concat(t, F.lit(" full video")))
    )


def z_score(value, mean: float | Column = 0.5, std: float | Column = 0.2, weight=1.0) -> Column:
    lit = lambda v: v if isinstance(v, Column) else F.lit(float(v))
    return (_c(value) - lit(mean)) / lit(std) * lit(weight)


def size_label(width, height) -> Column:
    return F.concat(_c(width).cast("string"), F.lit("x"), _c(height).cast("string"))


def channel_label(channels) -> Column:
    return F.when(_c(channels) == 2, F.lit("stereo")).otherwise(
        F.concat(_c(channels).cast("string"), F.lit("ch"))
    )


def size_mb(length) -> Column:
    return py_round(_c(length) / 1048576.0, 1)


def json_between(text, opener: str = "{", closer: str = "}") -> Column:
    """Text from the first opener to the last closer, null when there is none."""
    t = _c(text)
    return F.nullif(F.regexp_extract(t, rf"(?s)(\{opener}.*\{closer})", 1), F.lit(""))


# --- caption markup -------------------------------------------------------

def hex_to_ass_color(text) -> Column:
    """``RRGGBB`` -> ``&H00BBGGRR``."""
    h = F.upper(F.ltrim(_c(text), F.lit("#")))
    return F.concat(F.lit("&H00"), F.substring(h, 5, 2), F.substring(h, 3, 2), F.substring(h, 1, 2))


def perceptual_shift(seconds, offset_ms) -> Column:
    off = offset_ms if isinstance(offset_ms, Column) else F.lit(float(offset_ms))
    return F.greatest(F.lit(0.0), _c(seconds) + off / 1000.0)


def dialogue(start, end, style: str, text) -> Column:
    """One ASS event row."""
    return F.concat(
        F.lit("Dialogue: 0,"), ass_time(start), F.lit(","), ass_time(end),
        F.lit(f",{style},,0,0,0,,"), _c(text),
    )


def highlight_text(words, position, color) -> Column:
    """The line with the word at ``position`` (0-based) wrapped in highlight tags."""
    wrap = F.concat(F.lit("{\\c"), hex_to_ass_color(color), F.lit("\\fscx110\\fscy110}"))
    return F.array_join(
        F.transform(
            _c(words),
            lambda w, j: F.when(j == _c(position), F.concat(wrap, w, F.lit("{\\r}"))).otherwise(w),
        ),
        " ",
    )


def pop_text(word) -> Column:
    # fixed value: the three-step pop tags
    tags = "{\\fscx80\\fscy80\\t(0,50,\\fscx110\\fscy110)\\t(50,100,\\fscx100\\fscy100)}"
    return F.concat(F.lit(tags), _c(word))


def wave_text(text) -> Column:
    """Per character rotation tags, 50 ms apart; blanks keep their place in the count."""
    def mark(ch, i):
        at = lambda plus: (i * 50 + plus).cast("string")
        return F.when(ch == " ", ch).otherwise(
            F.concat(
                F.lit("{\\t("), at(0), F.lit(","), at(100), F.lit(",\\frz10)\\t("),
                at(100), F.lit(","), at(200), F.lit(",\\frz0)}"), ch,
            )
        )

    return F.array_join(F.transform(F.split(_c(text), ""), mark), "")
