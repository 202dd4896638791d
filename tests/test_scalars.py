"""Golden values."""

import pytest
from pyspark.sql import functions as F

from reelsignals.functions import scalars as S
from reelsignals.operators import captions as C


def one(spark, col, value, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(col.alias("o")).collect()[0].o


@pytest.mark.parametrize("text,want", [("1.2M", 1.2e6), ("500K", 5e5), ("3.4B", 3.4e9), ("1.2M views", 1.2e6), ("3400", 3400.0), ("", 0.0), ("1,234", 1234.0)])
def test_engagement(spark, text, want):
    assert one(spark, S.parse_engagement("v"), text) == pytest.approx(want)


def test_durations_and_times(spark):
    assert one(spark, S.parse_iso_duration("v"), "PT1H24M35S") == 5075
    assert one(spark, S.parse_iso_duration("v"), "junk") == 0
    assert one(spark, S.format_duration("v"), 1455, "int") == "24:15"
    assert one(spark, S.format_duration("v"), 5075, "int") == "1:24:35"
    assert one(spark, S.ass_time("v"), 1.5 - 0.05, "double") == "0:00:01.44"
    assert one(spark, S.srt_time("v"), 3661.5, "double") == "01:01:01,500"
    assert one(spark, S.parse_fps("v"), "30000/1001") == pytest.approx(29.97, abs=0.01)
    assert one(spark, S.parse_fps("v", 30.0), "1/0") == 30.0
    assert one(spark, S.hex_to_ass_color("v"), "#FFD700") == "&H0000D7FF"


@pytest.mark.parametrize("x", [1.0015, 2.5, 0.125, 0.35, 12.25, 7.0005, 0.0005])
def test_round_like_exact_binary(spark, x):
    assert one(spark, S.py_round("v", 3), x, "double") == round(x, 3)
    assert one(spark, S.py_round("v", 1), x, "double") == round(x, 1)
    assert one(spark, S.fixed("v", 1), x, "double") == f"{x:.1f}"


def test_caption_golden(spark):
    words = spark.createDataFrame([(1, 0, "Hello", 1.0, 1.5), (1, 1, "World", 1.5, 2.0)], "media_id int, word_idx int, word string, start double, end double")
    rows = C.events(C.styled_lines(C.with_style(words, F.lit("hormozi")))).orderBy("line_idx").collect()
    tags = r"{\fscx80\fscy80\t(0,50,\fscx110\fscy110)\t(50,100,\fscx100\fscy100)}"
    assert [r.event for r in rows] == [
        f"Dialogue: 0,0:00:00.95,0:00:01.44,Highlight,,0,0,0,,{tags}Hello", f"Dialogue: 0,0:00:01.44,0:00:01.95,Highlight,,0,0,0,,{tags}World"]
