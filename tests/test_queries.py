"""Registered queries against their SQL on the smallest tables."""

import os

import duckdb
import pytest

from reelsignals.plans import catalog, registry  # noqa: F401
from reelsignals.plans.verify import compare

DIR = "/root/testdata/sf0.001"
SOME = ["k01_trend_ranking", "j01_acceleration", "j17_related_topics", "s02_video_list_scan", "p09_quality_gate", "j16_first_valid_candidate", "p11_media_gates",
        "s07_transcript_scan", "j07_transcript_slice", "j04_speaker_attribution", "w08_speaker_turn_merge", "s15_ass_documents", "w11_timeline_offsets",
        "s12_model_moments", "a12_thresholds", "w02_low_activity_zones", "w04_hysteresis_peaks", "j10_pacing_zoom", "j14_hold_last_target", "j06_active_speaker",
        "a04_qa_report", "p27_thumbnail_time", "a14_overall_progress", "s01_page_extraction", "t01_super_trends_stream",
        "w13_dead_zone_ema", "w14_camera_path", "w15_centre_ema", "w15_centre_kalman", "w16_target_lock", "w17_dead_band", "t02_running_scores_stream",
        "t02_hourly_stats_stream", "t06_box_smoothing_stream", "t06_target_lock_stream", "t06_camera_stream"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(DIR):
        c.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{DIR}/{f}'")
    return c


@pytest.mark.parametrize("name", SOME)
def test_query(spark, con, name):
    ok, msg = compare(registry.QUERIES[name](spark, DIR), con, registry.SQL[name])
    assert ok, msg


def test_every_sql_has_its_query():
    assert set(registry.SQL) <= set(registry.QUERIES)
    assert set(SOME) <= set(registry.SQL)
