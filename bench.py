"""Times the headline queries and prints one JSON line.

    BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default all cores),
    BENCH_RUNS (default 3) rounds over all queries, of which the median counts; a further round
    starts only if it should end within BENCH_SECONDS (default 300)
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from reelsignals.plans import catalog, registry  # noqa: E402,F401
from reelsignals.session import local_session  # noqa: E402

HEADLINE = [
    "k01_trend_ranking", "j01_acceleration", "u02_first_seen_video", "j03_breakout_flag", "s02_video_list_scan", "p10_relaxed_gate", "p11_media_gates",
    "s07_transcript_scan", "w09_fixed_word_groups", "w10_punctuation_segments", "j07_transcript_slice", "j08_clip_retime_words", "j04_speaker_attribution",
    "w08_speaker_turn_merge", "s15_ass_documents", "a12_thresholds", "w02_low_activity_zones", "j13_series_resample", "j09_frame_triggers",
    "p15_detection_geometry", "j14_hold_last_target", "j06_active_speaker", "w13_dead_zone_ema", "w16_target_lock", "a15_scene_cuts", "a04_qa_report",
    "p27_thumbnail_time", "a14_overall_progress", "s01_page_extraction", "x02_best_moments", "w04_hysteresis_peaks", "w07_trigger_dedupe", "w14_camera_path", "w15_centre_kalman", "x03_snap_to_words",
    "t03_acceleration_stream",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    runs, seconds = max(1, int(os.environ.get("BENCH_RUNS", "3"))), float(os.environ.get("BENCH_SECONDS", "300"))
    spark = local_session("bench", cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    registry.QUERIES["k01_trend_ranking"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    took: dict[str, list[float]] = {name: [] for name in HEADLINE}
    begin, longest, done = time.time(), 0.0, 0
    while done < runs and time.time() - begin + longest <= seconds:
        at = time.time()
        for name in HEADLINE:
            start = time.time()
            registry.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            took[name].append(time.time() - start)
        longest, done = max(longest, time.time() - at), done + 1
    times = {name: round(statistics.median(t), 3) for name, t in took.items()}
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "rounds": done,
                      "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
