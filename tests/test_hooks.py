"""Scorers that a caller plugs in: their answers count, their gaps fall back to the rule."""

import pandas as pd
from pyspark.sql import functions as F

from reelsignals.operators import hooks as H


def test_planned_cuts_by_a_scorer(spark):
    rows = [(1, i, float(i), 200.0 + i, float(i)) for i in range(8)] + [(2, 0, 5.0, 6.0, None)]
    moments = spark.createDataFrame(rows, "media_id int, moment_idx int, start_time double, end_time double, viral_score double")

    @F.pandas_udf("start_time double, end_time double, viral_score double")
    def scorer(start: pd.Series, end: pd.Series) -> pd.DataFrame:
        return pd.DataFrame({"start_time": start, "end_time": end, "viral_score": 110 - start})

    by_rule = H.plan_cuts(moments).collect()
    assert [r["moment_idx"] for r in sorted(by_rule, key=lambda r: (r["media_id"], r["segment_idx"]))] == [7, 6, 5, 4, 3, 2, 0]
    assert {(r["media_id"], r["viral_score"]) for r in by_rule if r["media_id"] == 2} == {(2, 0.0)}
    scored = sorted((r for r in H.plan_cuts(moments, scorer, "start_time", "end_time").collect() if r["media_id"] == 1), key=lambda r: r["segment_idx"])
    assert [r["moment_idx"] for r in scored] == [0, 1, 2, 3, 4, 5]
    assert all(r["end_time"] == r["start_time"] + 90 for r in scored)
    assert [len(r["violations"]) for r in scored] == [1] * 6  # scores beyond 100 are told


def test_metadata_falls_back_and_tells_long_titles(spark):
    rows = [(1, "theme", "some text"), (2, "  ", "some text"), (3, None, None)]
    segments = spark.createDataFrame(rows, "id int, theme string, text string")
    by_rule = {r["id"]: r for r in H.generate_metadata(segments).collect()}
    assert [by_rule[i]["title"] for i in (1, 2)] == ["theme", "some text"]
    assert by_rule[3]["title"].endswith("Must Watch!") and not by_rule[3]["violations"]

    def long_title(theme):
        words = F.array(F.lit("a"))
        answer = F.struct(F.repeat(theme, 50).alias("title"), F.lit("d").alias("description"), words.alias("tags"), words.alias("hashtags"))
        return F.when(theme == "theme", answer)

    scored = {r["id"]: r for r in H.generate_metadata(segments, long_title, "theme").collect()}
    assert len(scored[1]["violations"]) == 1 and scored[2]["title"] == "some text"


def test_quality_with_nulls(spark):
    rows = [(1, "A story that ends well.", "a story that ends well.", 0.5), (2, "A story that ends", "other", 1.0), (3, None, None, None)]
    clips = spark.createDataFrame(rows, "id int, transcript string, captions string, hook_start double")
    out = {r["id"]: r for r in H.check_quality(clips).collect()}
    assert out[1]["passes"] and out[1]["overall_score"] == 100 and not out[1]["issues"]
    assert out[2]["issues"] == ["coherent", "natural_ending", "captions_accurate"] and not out[2]["passes"]
    assert out[3]["overall_score"] == 0 and len(out[3]["issues"]) == 4 and not out[3]["violations"]
