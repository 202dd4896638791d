"""Folds against plain loops over whole media items."""

import math
import random

import pytest
from pyspark.sql import functions as F

from reelsignals.operators import edl as E
from reelsignals.operators import effects as X
from reelsignals.operators import folds
from reelsignals.operators import tracks as K

rng = random.Random(11)


def test_dead_zone_ema(spark):
    pts = [(1, t, f, rng.randint(0, 1920), rng.randint(0, 1080), rng.randint(50, 300), rng.randint(50, 300)) for t in (1, 2) for f in range(60)]
    d = spark.createDataFrame(pts, "media_id bigint, track_id int, frame_idx int, cx int, cy int, w int, h int")
    got = {(r.track_id, r.frame_idx): (r.cx, r.cy, r.w, r.h) for r in K.smooth_boxes(d).collect()}
    for t in (1, 2):
        s = None
        for p in [p for p in pts if p[1] == t]:
            m = list(map(float, p[3:]))
            if s is None:
                s = m
            else:
                dx, dy = m[0] - s[0], m[1] - s[1]
                dx, dy = (0 if abs(dx) < 0.02 * 1920 else dx), (0 if abs(dy) < 0.02 * 1920 else dy)
                dx, dy = max(-0.07 * 1920, min(0.07 * 1920, dx)), max(-0.07 * 1920, min(0.07 * 1920, dy))
                w = s[2] + 0.25 * (m[2] - s[2])
                h = s[3] + 0.25 * (m[3] - s[3])
                s = [s[0] + 0.25 * dx, s[1] + 0.25 * dy, 0.25 * m[2] + 0.75 * w, 0.25 * m[3] + 0.75 * h]
            assert got[(t, p[2])] == tuple(int(v) for v in s)


def _frames_for_lock():
    rows, frame = [], 3
    for _ in range(120):
        frame += rng.choice([1, 1, 1, 2, 5, 14])
        for t in rng.sample(range(5), rng.randint(1, 3)):
            x, y, w = rng.random() * 1500, rng.random() * 700, 100 + rng.random() * 500
            rows.append((1, frame, t, x, y, x + w, y + w))
    return rows, frame + 30


def test_target_lock_split_equals_whole_run(spark):
    rows, n = _frames_for_lock()
    d = spark.createDataFrame(rows, "media_id bigint, frame_idx int, track_id int, x1 double, y1 double, x2 double, y2 double")
    lengths = spark.createDataFrame([(1, n), (2, 7), (3, 0)], "media_id bigint, n_frames int")
    both = K.target_lock(d, lengths, fps=4.0, hysteresis=1.0, hold=2.0).collect()
    got = {r.frame_idx: (r.state, r.target) for r in both if r.media_id == 1}
    # a media item without boxes searches to its end
    assert sorted((r.frame_idx, r.state, r.target) for r in both if r.media_id != 1) == [(f, "SEARCHING", None) for f in range(7)]
    fsm = folds.TargetLock(4.0, 1.0, 2.0)

    def score(x1, y1, x2, y2):
        near = max(0.0, 1 - (abs((x1 + x2) / 2 - 960) / 960 * 0.6 + abs((y1 + y2) / 2 - 432) / 540 * 0.4))
        return 0.5 * min((x2 - x1) * (y2 - y1) / (1920 * 1080), 1.0) + 0.5 * near

    states = set()
    for f in range(n):
        boxes = sorted(r[2:] for r in rows if r[1] == f)
        want = fsm.select([b[0] for b in boxes], [score(*b[1:]) for b in boxes])
        states.add(fsm.state)
        assert got[f] == (fsm.state, want), f
    assert len(got) == n and states == {"SEARCHING", "LOCKED", "SWITCHING", "HOLD_POSITION"}


def test_target_lock_rules():
    fsm = folds.TargetLock(fps=2.0, hysteresis=1.0, hold=2.0)
    assert fsm.select([1, 2], [0.5, 0.4]) == 1 and fsm.state == "LOCKED"
    assert fsm.select([1, 2], [0.2, 0.5]) == 1 and fsm.state == "SWITCHING"
    assert fsm.select([1, 2], [0.2, 0.5]) == 2 and fsm.state == "LOCKED"
    assert fsm.select([], []) == 2 and fsm.state == "HOLD_POSITION"
    assert [fsm.select([], []) for _ in range(3)] == [2, 2, None] and fsm.state == "SEARCHING"
    assert folds.TargetLock().load(fsm.dump()).__dict__ == fsm.__dict__


def _camera_by_clock(rows):
    """The camera with a real clock: it reads 0 until a sample sets it, then runs at 30 fps; a cut forgets the filters only."""
    clock, filters, out = -1.0, None, []
    for _, frame, cx, cy, crop_w, crop_h, cut in rows:
        if cut and frame > 0:
            filters = None
        t = 0.0 if clock < 0 else clock + 1 / 30
        now = [float(cx), float(cy), 1920 / max(1, crop_w)]
        if filters is None:
            filters = [[t, v, 0.0] for v in now]
        else:
            clock = t
            for i, f in enumerate(filters):
                te = t - f[0]
                if te > 1e-9:
                    a = lambda c: 2 * math.pi * c * te / (2 * math.pi * c * te + 1)  # noqa: E731, B023
                    dx = f[2] + a(1.0) * ((now[i] - f[1]) / te - f[2])
                    now[i] = f[1] + a(0.005 + 0.002 * abs(dx)) * (now[i] - f[1])
                    filters[i] = [t, now[i], dx]
        w = int(1920 / max(1.0, now[2]))
        h = int(crop_h * (w / crop_w)) if crop_w > 0 else crop_h
        x, y = int(now[0] - w / 2), int(now[1] - h / 2)
        out.append((max(0, min(x, 1920 - w)), 0 if h > 1080 else max(0, min(y, 1080 - h)), w, min(h, 1080)))
    return out


def test_camera_scenes_equal_whole_run(spark):
    rows = [(1, f, rng.randint(300, 1600), rng.randint(200, 900), rng.choice([0, 400, 500, 607, 2500]) if f > 100 else 607 - f, 1080, f in (0, 40, 41, 90)) for f in range(130)]
    d = spark.createDataFrame(rows, "media_id bigint, frame_idx int, target_cx int, target_cy int, crop_w int, crop_h int, is_cut boolean")
    got = {r.frame_idx: (r.crop_x, r.crop_y, r.out_w, r.out_h) for r in K.camera_path(d).collect()}
    assert len(got) == len(rows)
    for r, want in zip(rows, _camera_by_clock(rows)):
        if r[4]:
            assert all(abs(a - b) <= 2 for a, b in zip(got[r[1]], want)), r
        x, y, w, h = got[r[1]]
        assert 0 <= x <= 1920 - w and 0 <= y <= 1080 - h
    fold = folds.OneEuro(["a"])
    for v in (1.0, 2.0, 4.0):
        fold.update([v])
    assert folds.OneEuro(["a"]).load(fold.dump()).update([3.0]) == fold.update([3.0])


def test_trigger_dedupe(spark):
    rows = sorted((round(rng.random() * 40, 2), p, i, rng.random()) for i, p in enumerate(rng.choices([0, 1, 2], k=300)))
    d = spark.createDataFrame([(1, t, "zoom", x, 0.1, "s", i, p) for t, p, i, x in rows],
                              "media_id int, timestamp double, effect_type string, intensity double, duration double, source string, source_idx bigint, part int")
    got = sorted((r.timestamp, r.source_idx) for r in X.dedupe_triggers(d).collect())
    kept = []
    for t, p, i, x in rows:
        if not kept or t - kept[-1][0] > 0.1:
            kept.append((t, i, x))
        elif x > kept[-1][2]:
            kept[-1] = (t, i, x)
    assert got == [(t, i) for t, i, _ in kept]


def test_best_moments(spark):
    rows = [(1, i, s, s + rng.choice([20.0, 40.0, 90.0]), float(rng.randint(0, 100))) for i, s in enumerate(rng.random() * 3000 for _ in range(80))]
    d = spark.createDataFrame(rows, "media_id int, moment_idx int, start_time double, end_time double, viral_score double")
    got = sorted(r.moment_idx for r in E.best_moments(d).collect())
    kept = []
    for r in sorted(rows, key=lambda r: (-r[4], r[1])):
        if not any(r[2] < k[3] and k[2] < r[3] for k in kept):
            kept.append(r)
    assert got == sorted(k[1] for k in kept)


def test_kalman_settles(spark):
    d = spark.createDataFrame([(1, 1, f, 90.0, 190.0, 110.0, 210.0) for f in range(80)], "media_id bigint, track_id int, frame_idx int, x1 double, y1 double, x2 double, y2 double")
    last = K.smooth_centres(d, kalman=True).where(F.col("frame_idx") == 79).collect()[0]
    assert abs(last.x - 100) <= 1 and abs(last.y - 200) <= 1
