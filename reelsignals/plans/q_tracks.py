"""Queries on detections, tracks and camera paths."""

from pyspark.sql import functions as F

from ..operators import intervals as I
from ..operators import ordered as O
from ..operators import series as R
from ..operators import speakers as P
from ..operators import tracks as K
from ..session import durable
from . import fixtures as X
from .registry import CTES, query

R6 = lambda c: F.round(c, 6)

CTES["f_geo"] = """SELECT *, CAST(trunc(CASE WHEN leye_y > 0 AND reye_y > 0 THEN (leye_y + reye_y) / 2 WHEN nose_y > 0 THEN nose_y ELSE cy - h * 0.3e0 END) AS INTEGER) AS eyes_y,
  CASE WHEN (leye_y > 0 AND reye_y > 0) OR nose_y > 0 THEN 'pose' ELSE 'estimated' END AS framing FROM (SELECT *, CAST(trunc((x1 + x2) / 2) AS INTEGER) AS cx, CAST(trunc((y1 + y2) / 2) AS INTEGER) AS cy,
  CAST(trunc(x2 - x1) AS INTEGER) AS w, CAST(trunc(y2 - y1) AS INTEGER) AS h FROM f_dets)"""


def points(spark, d):
    return K.geometry(X.detections(spark, d))


@query("p15_detection_geometry", "SELECT media_id, frame_idx, track_id, cx, cy, w, h, eyes_y, framing, cx - 960 AS frame_center_offset FROM f_geo WHERE conf >= 0.5e0")
def _(spark, d):
    return K.geometry(X.detections(spark, d), min_conf=0.5).select(
        "media_id", "frame_idx", "track_id", "cx", "cy", "w", "h", "eyes_y", "framing", "frame_center_offset")


@query("p16_head_and_region", """SELECT media_id, frame_idx, track_id, round(coalesce(nose_x, CAST(floor((trunc(leye_x) + trunc(reye_x)) / 2) AS DOUBLE)), 6) AS head_x, greatest(0, cx - w // 2 - CAST(trunc(w * 0.2e0) AS INTEGER)) AS rx1,
  greatest(0, cy - h // 2 - CAST(trunc(h * 0.2e0) AS INTEGER)) AS ry1, least(1920, cx + w // 2 + CAST(trunc(w * 0.2e0) AS INTEGER)) AS rx2, least(1080, cy + h // 2 + CAST(trunc(h * 0.2e0) AS INTEGER)) AS ry2 FROM f_geo""")
def _(spark, d):
    x1, y1, x2, y2 = K.padded_region()
    return points(spark, d).select("media_id", "frame_idx", "track_id", R6(P.reference_point()["x"]).alias("head_x"),
                                   x1.alias("rx1"), y1.alias("ry1"), x2.alias("rx2"), y2.alias("ry2"))


CTES["f_score"] = """SELECT *, 0.5e0 * least((x2 - x1) * (y2 - y1) / 2073600e0, 1e0) + 0.5e0 * greatest(0e0, 1 - (abs((x1 + x2) / 2 - 960e0) / 960e0 * 0.6e0 + abs((y1 + y2) / 2 - 432e0) / 540e0 * 0.4e0)) AS score FROM f_geo"""


@query("p17_target_score", "SELECT media_id, frame_idx, track_id, round(score, 6) AS score FROM f_score")
def _(spark, d):
    return X.detections(spark, d).select("media_id", "frame_idx", "track_id", R6(K.target_score()).alias("score"))


@query("k05_best_target_per_frame", "SELECT media_id, frame_idx, arg_min(track_id, rk) AS track_id FROM (SELECT *, row_number() OVER (PARTITION BY media_id, frame_idx ORDER BY round(score, 9) DESC, track_id) AS rk FROM f_score) GROUP BY 1, 2")
def _(spark, d):
    s = X.detections(spark, d).withColumn("score", F.round(K.target_score(), 9))
    return s.groupBy("media_id", "frame_idx").agg(F.min_by("track_id", F.struct((-F.col("score")).alias("s"), "track_id")).alias("track_id"))


CTES["f_target"] = """SELECT *, cx AS target_cx, CAST(trunc(coalesce((leye_y + reye_y) / 2, nose_y, cy - h * CASE WHEN label = 'person' THEN 0.35e0 ELSE 0.2e0 END) + 183) AS INTEGER) AS target_cy FROM f_geo"""


@query("p18_thirds_target", "SELECT media_id, frame_idx, track_id, target_cx, target_cy FROM f_target")
def _(spark, d):
    return K.thirds_target(points(spark, d), 1080).select("media_id", "frame_idx", "track_id", "target_cx", "target_cy")


@query("p19_crop_windows", """SELECT media_id, crop_w, crop_h, greatest(0, least(CAST(trunc(width * 0.7e0) AS INTEGER), width - crop_w)) AS x, greatest(0, least(CAST(trunc((width - vw) * 0.25e0) AS INTEGER), width - vw)) AS vertical_x, vw AS vertical_w FROM
  (SELECT media_id, width, CASE WHEN cw > width THEN width ELSE cw END AS crop_w, CASE WHEN cw > width THEN CAST(trunc(width * (1920e0 / 1080)) AS INTEGER) ELSE height END AS crop_h, CAST(trunc(height * 9 / 16) AS INTEGER) AS vw FROM
  (SELECT *, CAST(trunc(height / (1920e0 / 1080)) AS INTEGER) AS cw FROM f_probes))""")
def _(spark, d):
    k = F.col("o_orderkey")
    src = X.table(spark, d, "orders").select(
        k.alias("media_id"), F.when(k % 3 == 0, 1080).otherwise(1280).alias("width"),
        F.element_at(F.array(F.lit(1920), F.lit(1080), F.lit(720)), (k % 3 + 1).cast("int")).alias("height"))
    cw, ch = K.crop_dims(F.col("width"), F.col("height"))
    x, vw = K.vertical_x(F.col("width"), F.col("height"), 0.25)
    s = src.withColumns({"crop_w": cw, "crop_h": ch, "vertical_x": x, "vertical_w": vw})
    return s.select("media_id", "crop_w", "crop_h", K.clamp_window((F.col("width") * 0.7).cast("int"), F.col("crop_w"), F.col("width")).alias("x"), "vertical_x", "vertical_w")


CTES["f_tracks"] = """SELECT media_id, track_id, count(*) AS points, sum(w * h) / count(*) AS mean_area, count(*) + sum(w * h) / count(*) / 1e3 AS score, min(frame_idx) AS first_frame, arg_min(label, frame_idx) AS label FROM f_geo GROUP BY 1, 2"""
CTES["f_best"] = "SELECT media_id, track_id, score FROM (SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY score DESC, first_frame, track_id) AS rn FROM f_tracks) WHERE rn = 1"


@query("a09_track_summary", "SELECT media_id, track_id, points, round(mean_area, 6) AS mean_area, round(score, 6) AS score FROM f_tracks WHERE points > 10")
def _(spark, d):
    s = K.lasting_tracks(K.track_summary(points(spark, d)))
    return s.select("media_id", "track_id", "points", R6("mean_area").alias("mean_area"), R6("score").alias("score"))


@query("k05_best_track", "SELECT media_id, track_id, round(score, 6) AS score FROM f_best")
def _(spark, d):
    return K.best_track(K.track_summary(points(spark, d))).select("media_id", "track_id", R6("score").alias("score"))


CTES["f_main"] = "SELECT t.* FROM f_target t JOIN f_best b ON t.media_id = b.media_id AND t.track_id = b.track_id"
CTES["f_spine"] = "SELECT s_suppkey AS media_id, CAST(unnest(range(300)) AS INTEGER) AS frame_idx FROM supplier"


def main_points(spark, d):
    """Targets of the best track of each media item."""
    p = K.thirds_target(points(spark, d), 1080)
    return p.join(K.best_track(K.track_summary(p)).select("media_id", "track_id"), ["media_id", "track_id"])


def spine(spark, d):
    return K.frame_spine(X.table(spark, d, "supplier").select(F.col("s_suppkey").alias("media_id"), F.lit(300).alias("n_frames")))


@query("j14_hold_last_target", """SELECT s.media_id, s.frame_idx, coalesce(last_value(target_cx IGNORE NULLS) OVER w, fx, 960) AS held_cx, coalesce(last_value(target_cy IGNORE NULLS) OVER w, fy, 540) AS held_cy FROM f_spine s
  LEFT JOIN f_main m ON s.media_id = m.media_id AND s.frame_idx = m.frame_idx LEFT JOIN (SELECT media_id, arg_min(target_cx, frame_idx) AS fx, arg_min(target_cy, frame_idx) AS fy FROM f_main WHERE target_cx BETWEEN -1000 AND 2920 GROUP BY 1) f ON s.media_id = f.media_id
  WINDOW w AS (PARTITION BY s.media_id ORDER BY s.frame_idx)""")
def _(spark, d):
    return K.hold_last(spine(spark, d), main_points(spark, d)).select("media_id", "frame_idx", "held_cx", "held_cy")


CTES["f_steps"] = """SELECT media_id, track_id, frame_idx, CASE WHEN nose_x IS NOT NULL AND lag(nose_x) OVER w IS NOT NULL THEN sqrt(pow(nose_x - lag(nose_x) OVER w, 2) + pow(nose_y - lag(nose_y) OVER w, 2))
  ELSE sqrt(pow(cx - lag(cx) OVER w, 2) + pow(cy - lag(cy) OVER w, 2)) END AS step FROM f_geo WINDOW w AS (PARTITION BY media_id, track_id ORDER BY frame_idx)"""


@query("w19_track_motion", "SELECT media_id, track_id, coalesce(round(avg(step), 6), 0e0) AS motion, count(*) AS points FROM f_steps GROUP BY 1, 2")
def _(spark, d):
    return P.track_motion(points(spark, d), ["media_id", "track_id"]).select("media_id", "track_id", "motion", "points")


def speech(spark, d):
    s = X.table(spark, d, "supplier").select(F.col("s_suppkey").alias("media_id"), F.explode(F.array(*[F.lit(i) for i in range(5)])).alias("seg_idx"))
    start = F.col("seg_idx") * F.lit(2.0) + (F.col("media_id") % 3) / F.lit(10.0)
    return s.withColumns({"s_start": start, "s_end": start + 1.5})


CTES["f_speech"] = "SELECT s_suppkey AS media_id, seg_idx, seg_idx * 2e0 + (s_suppkey % 3) / 10e0 AS s_start, seg_idx * 2e0 + (s_suppkey % 3) / 10e0 + 1.5e0 AS s_end FROM supplier, (VALUES (0), (1), (2), (3), (4)) AS v(seg_idx)"
CTES["f_energy"] = """SELECT s.media_id, seg_idx, avg(rms) AS mean_rms FROM f_speech s JOIN (SELECT media_id, (sample_idx // 5) / 10e0 AS t, sqrt(avg(x * x)) AS rms FROM f_samples GROUP BY 1, 2) r
  ON r.media_id = s.media_id AND t BETWEEN s_start AND s_end GROUP BY 1, 2"""
CTES["f_act"] = """SELECT media_id, seg_idx, track_id, avg(step) AS motion FROM (SELECT s.media_id, seg_idx, track_id, CASE WHEN nose_x IS NOT NULL AND lag(nose_x) OVER w IS NOT NULL THEN sqrt(pow(nose_x - lag(nose_x) OVER w, 2) + pow(nose_y - lag(nose_y) OVER w, 2))
  ELSE sqrt(pow(cx - lag(cx) OVER w, 2) + pow(cy - lag(cy) OVER w, 2)) END AS step FROM f_speech s JOIN f_geo g ON g.media_id = s.media_id AND frame_idx BETWEEN CAST(trunc(s_start * 30) AS BIGINT) AND CAST(trunc(s_end * 30) AS BIGINT)
  WINDOW w AS (PARTITION BY s.media_id, seg_idx, track_id ORDER BY frame_idx)) GROUP BY 1, 2, 3 HAVING count(*) >= 2"""


@query("j06_active_speaker", """SELECT s.media_id, s.seg_idx, coalesce(track_id, 0) AS speaker_id, round(CASE WHEN score > 0 THEN least(score / 10, 1e0) ELSE 0.5e0 END, 4) AS confidence FROM f_speech s LEFT JOIN
  (SELECT *, row_number() OVER (PARTITION BY media_id, seg_idx ORDER BY score DESC, track_id) AS rn FROM (SELECT a.media_id, a.seg_idx, track_id, round(motion * mean_rms, 6) AS score FROM f_act a JOIN f_energy e ON a.media_id = e.media_id AND a.seg_idx = e.seg_idx)) b
  ON b.media_id = s.media_id AND b.seg_idx = s.seg_idx AND rn = 1""")
def _(spark, d):
    s = speech(spark, d)
    rms = R.frame_rms(X.samples(spark, d), 5).withColumn("t", F.col("frame_idx") / F.lit(10.0)).drop("frame_idx")
    energy = I.point_join(rms, s, ["media_id"], F.col("t"), (F.col("s_start"), F.col("s_end")), F.col("t").between(F.col("s_start"), F.col("s_end")), 5.0)
    energy = energy.groupBy("media_id", "seg_idx").agg(F.avg("rms").alias("mean_rms"))
    a = P.active_speakers(s, points(spark, d), energy)
    return a.select("media_id", "seg_idx", "speaker_id", F.round("confidence", 4).alias("confidence"))


# the given media items have few frames; short chunks make every query cross their borders
CHUNK = 48


def _spring(axis: str) -> str:
    d = f"p.c{axis} - s{axis}"
    return f"s{axis} + 0.25e0 * greatest(-(0.07e0 * 1920), least(0.07e0 * 1920, CASE WHEN abs({d}) < 0.02e0 * 1920 THEN 0e0 ELSE {d} END))"


BOX_EMA = f"""WITH RECURSIVE p AS MATERIALIZED (SELECT media_id, track_id, frame_idx, cx, cy, w, h, row_number() OVER (PARTITION BY media_id, track_id ORDER BY frame_idx) AS n FROM f_geo),
  s AS (SELECT media_id, track_id, frame_idx, n, CAST(cx AS DOUBLE) AS sx, CAST(cy AS DOUBLE) AS sy, CAST(w AS DOUBLE) AS sw, CAST(h AS DOUBLE) AS sh FROM p WHERE n = 1
  UNION ALL SELECT p.media_id, p.track_id, p.frame_idx, p.n, {_spring("x")}, {_spring("y")}, 0.25e0 * p.w + 0.75e0 * (sw + 0.25e0 * (p.w - sw)), 0.25e0 * p.h + 0.75e0 * (sh + 0.25e0 * (p.h - sh))
  FROM s JOIN p ON p.media_id = s.media_id AND p.track_id = s.track_id AND p.n = s.n + 1)
  SELECT media_id, CAST(track_id AS INTEGER) AS track_id, frame_idx, CAST(trunc(sx) AS INTEGER) AS cx, CAST(trunc(sy) AS INTEGER) AS cy, CAST(trunc(sw) AS INTEGER) AS w, CAST(trunc(sh) AS INTEGER) AS h FROM s"""


@query("w13_dead_zone_ema", BOX_EMA)
def _(spark, d):
    return K.smooth_boxes(points(spark, d), frames=CHUNK)


CTES["f_centres"] = "SELECT media_id, track_id, frame_idx, (x1 + x2) / 2 AS px, (y1 + y2) / 2 AS py, row_number() OVER (PARTITION BY media_id, track_id ORDER BY frame_idx) AS n FROM f_geo"


@query("w15_centre_ema", """WITH RECURSIVE p AS MATERIALIZED (SELECT * FROM f_centres), s AS (SELECT media_id, track_id, frame_idx, n, px AS sx, py AS sy FROM p WHERE n = 1
  UNION ALL SELECT p.media_id, p.track_id, p.frame_idx, p.n, 0.15e0 * px + (1 - 0.15e0) * sx, 0.15e0 * py + (1 - 0.15e0) * sy FROM s JOIN p ON p.media_id = s.media_id AND p.track_id = s.track_id AND p.n = s.n + 1)
  SELECT media_id, CAST(track_id AS INTEGER) AS track_id, frame_idx, CAST(trunc(round(sx, 9)) AS INTEGER) AS x, CAST(trunc(round(sy, 9)) AS INTEGER) AS y FROM s""")
def _(spark, d):
    return K.smooth_centres(points(spark, d), frames=CHUNK)


def _kalman_sql() -> str:
    """Covariance by step number (it needs no data), gains k_row_column from it, then the states."""
    pair = lambda r, c: f"{min(r, c)}{max(r, c)}"
    pairs = [(r, c) for r in range(4) for c in range(r, 4)]
    noise = ["pow(1e0 / 30, 3) / 6", "pow(1e0 / 30, 2) / 2", "1e0 / 30", "1e0"]
    moved = lambda i: [i, i + 1] if i % 2 == 0 else [i]
    ahead = ", ".join(f"{' + '.join(f'p{pair(i, j)}' for i in moved(r) for j in moved(c))} + 0.1e0 * ({noise[r]}) * ({noise[c]}) AS n{pair(r, c)}" for r, c in pairs)
    gain = ", ".join(f"(n{pair(r, 0)} * a{t} + n{pair(r, 2)} * b{t}) / det AS k{r}{t}" for r in range(4) for t in range(2))
    after = ", ".join(f"n{pair(r, c)} - k{r}0 * n{pair(0, c)} - k{r}1 * n{pair(2, c)} AS p{pair(r, c)}" for r, c in pairs)
    gains = ", ".join(f"k{r}{t}" for r in range(4) for t in range(2))
    step = lambda old: (f"SELECT n, {gains}, {after} FROM (SELECT *, {gain} FROM (SELECT *, n22 + 10 AS a0, -n02 AS b0, -n02 AS a1, n00 + 10 AS b1, (n00 + 10) * (n22 + 10) - n02 * n02 AS det "  # noqa: E731
                        f"FROM (SELECT n + 1 AS n, {ahead} FROM {old})))")
    start = ", ".join(f"{1000 if r == c else 0}e0 AS p{pair(r, c)}" for r, c in pairs)
    state = ", ".join(f"m{r} + k{r}0 * (px - m0) + k{r}1 * (py - m2) AS x{r}" for r in range(4))
    return f"""WITH RECURSIVE p AS MATERIALIZED (SELECT * FROM f_centres), gains AS ({step(f"(SELECT 0 AS n, {start})")} UNION ALL {step("gains WHERE n < (SELECT max(n) FROM p)")}),
  g AS MATERIALIZED (SELECT n, {gains} FROM gains), s AS (SELECT media_id, track_id, -1 AS frame_idx, CAST(0 AS BIGINT) AS n, 0e0 AS x0, 0e0 AS x1, 0e0 AS x2, 0e0 AS x3 FROM p WHERE n = 1
  UNION ALL SELECT media_id, track_id, frame_idx, n, {state} FROM (SELECT p.*, g.* EXCLUDE (n), x0 + x1 AS m0, x1 AS m1, x2 + x3 AS m2, x3 AS m3 FROM s JOIN p ON p.media_id = s.media_id AND p.track_id = s.track_id AND p.n = s.n + 1 JOIN g ON g.n = p.n))
  SELECT media_id, CAST(track_id AS INTEGER) AS track_id, CAST(frame_idx AS INTEGER) AS frame_idx, CAST(trunc(x0) AS INTEGER) AS x, CAST(trunc(x2) AS INTEGER) AS y FROM s WHERE n > 0"""


@query("w15_centre_kalman", _kalman_sql())
def _(spark, d):
    return K.smooth_centres(points(spark, d), kalman=True, frames=CHUNK)


CTES["f_band"] = """WITH RECURSIVE fr AS (SELECT s.media_id, s.frame_idx, target_cx, target_cy, coalesce(fx, 960) AS ix, coalesce(fy, 540) AS iy FROM f_spine s LEFT JOIN f_main m ON s.media_id = m.media_id AND s.frame_idx = m.frame_idx
  LEFT JOIN (SELECT media_id, arg_min(target_cx, frame_idx) AS fx, arg_min(target_cy, frame_idx) AS fy FROM f_main WHERE target_cx BETWEEN -1000 AND 2920 GROUP BY 1) f ON s.media_id = f.media_id),
  walk AS (SELECT media_id, -1 AS frame_idx, ix AS x, iy AS y FROM fr WHERE frame_idx = 0
  UNION ALL SELECT f.media_id, f.frame_idx, CASE WHEN abs(target_cx - x) >= 96 OR abs(target_cy - y) >= 54 THEN target_cx ELSE x END, CASE WHEN abs(target_cx - x) >= 96 OR abs(target_cy - y) >= 54 THEN target_cy ELSE y END
  FROM walk w JOIN fr f ON f.media_id = w.media_id AND f.frame_idx = w.frame_idx + 1) SELECT media_id, frame_idx, x, y FROM walk WHERE frame_idx >= 0"""
BAND = "SELECT media_id, frame_idx, x, y FROM f_band"


@query("w17_dead_band", BAND)
def _(spark, d):
    return K.dead_band(K.look_ahead_start(spine(spark, d), main_points(spark, d)), chunk=CHUNK)


def camera_frames(spark, d):
    p = durable(main_points(spark, d))
    held = K.dead_band(K.look_ahead_start(spine(spark, d), p)).withColumnsRenamed({"x": "target_cx", "y": "target_cy"})
    # the picture cuts where the detector was most certain; the crop narrows in steps
    cut = p.select("media_id", "frame_idx", (F.col("conf") > 0.9).alias("is_cut"))
    return held.join(cut, ["media_id", "frame_idx"], "left").withColumns({
        "is_cut": F.coalesce("is_cut", F.lit(False)), "crop_w": (607 - F.col("frame_idx") % 4 * 30).cast("int"), "crop_h": F.lit(1080)})


def _camera_sql() -> str:
    pull = lambda cutoff: f"((2 * pi() * ({cutoff}) / 30e0) / (2 * pi() * ({cutoff}) / 30e0 + 1))"
    names = ["cx", "cy", "zoom"]
    slope = ", ".join(f"CASE WHEN f.n = 2 THEN s_{c} ELSE s_{c} + {pull('1.0e0')} * ((f.{c} - v_{c}) * 30e0 - s_{c}) END AS t_{c}" for c in names)
    value = ", ".join(f"CASE WHEN n = 2 THEN v_{c} ELSE v_{c} + {pull(f'0.005e0 + 0.002e0 * abs(t_{c})')} * ({c} - v_{c}) END AS v_{c}" for c in names)
    first = ", ".join(f"{c} AS v_{c}, 0e0 AS s_{c}" for c in names)
    return f"""WITH RECURSIVE cuts AS (SELECT b.*, 607 - b.frame_idx % 4 * 30 AS crop_w, sum(CASE WHEN conf > 0.9e0 THEN 1 ELSE 0 END) OVER (PARTITION BY b.media_id ORDER BY b.frame_idx) AS scene
    FROM f_band b LEFT JOIN f_main m ON m.media_id = b.media_id AND m.frame_idx = b.frame_idx),
  fr AS MATERIALIZED (SELECT media_id, scene, frame_idx, crop_w, CAST(x AS DOUBLE) AS cx, CAST(y AS DOUBLE) AS cy, 1920e0 / crop_w AS zoom, row_number() OVER (PARTITION BY media_id, scene ORDER BY frame_idx) AS n FROM cuts),
  walk AS (SELECT *, {first} FROM fr WHERE n = 1
  UNION ALL SELECT media_id, scene, frame_idx, crop_w, cx, cy, zoom, n, {value.replace(", CASE", ", t_cx AS s_cx, CASE", 1).replace(", CASE WHEN n = 2 THEN v_zoom", ", t_cy AS s_cy, CASE WHEN n = 2 THEN v_zoom", 1)}, t_zoom AS s_zoom FROM (SELECT f.*, {", ".join(f"v_{c}" for c in names)}, {slope} FROM walk w JOIN fr f ON f.media_id = w.media_id AND f.scene = w.scene AND f.n = w.n + 1)),
  sized AS (SELECT *, CAST(trunc(1920 / greatest(1e0, CASE WHEN n = 2 THEN zoom ELSE v_zoom END)) AS INTEGER) AS out_w, CASE WHEN n = 2 THEN cx ELSE v_cx END AS ox, CASE WHEN n = 2 THEN cy ELSE v_cy END AS oy FROM walk),
  tall AS (SELECT *, CAST(trunc(1080 * (CAST(out_w AS DOUBLE) / crop_w)) AS INTEGER) AS tall FROM sized)
  SELECT media_id, frame_idx, greatest(0, least(CAST(trunc(ox - out_w / 2e0) AS INTEGER), 1920 - out_w)) AS crop_x, CASE WHEN tall > 1080 THEN 0 ELSE greatest(0, least(CAST(trunc(oy - tall / 2e0) AS INTEGER), 1080 - tall)) END AS crop_y,
  out_w, least(tall, 1080) AS out_h FROM tall"""


CAMERA = _camera_sql()


@query("w14_camera_path", CAMERA)
def _(spark, d):
    return K.camera_path(durable(camera_frames(spark, d))).select("media_id", "frame_idx", "crop_x", "crop_y", "out_w", "out_h")


LOCK_FPS = 5.0


def lock_lengths(spark, d):
    """Media items with boxes, and some without any."""
    n = X.table(spark, d, "supplier").select(F.col("s_suppkey").cast("long").alias("media_id"), F.lit(300).alias("n_frames"))
    return n.unionByName(X.table(spark, d, "nation").select((-1 - F.col("n_nationkey")).cast("long").alias("media_id"), F.lit(40).alias("n_frames")))


# states: 0 searching, 1 locked, 2 switching, 3 holding; 15 frames to switch, 10 to hold, 5 of grace
LOCK = """WITH RECURSIVE sc AS MATERIALIZED (SELECT media_id, frame_idx, track_id, score FROM f_score),
  top AS (SELECT media_id, frame_idx, track_id AS best, score AS top FROM (SELECT *, row_number() OVER (PARTITION BY media_id, frame_idx ORDER BY score DESC, track_id) AS rk FROM sc) WHERE rk = 1),
  spine AS (SELECT media_id, frame_idx FROM f_spine UNION ALL SELECT -1 - n_nationkey, CAST(unnest(range(40)) AS INTEGER) FROM nation),
  fr AS MATERIALIZED (SELECT s.media_id, s.frame_idx, best, top FROM spine s LEFT JOIN top t ON t.media_id = s.media_id AND t.frame_idx = s.frame_idx),
  walk AS (SELECT media_id, -1 AS frame_idx, 0 AS st, CAST(NULL AS BIGINT) AS locked, CAST(NULL AS BIGINT) AS rival, 0 AS rn, 0 AS held, 0 AS lost FROM fr WHERE frame_idx = 0
  UNION ALL SELECT media_id, frame_idx,
    CASE c WHEN 'rest' THEN 3 WHEN 'expire' THEN 0 WHEN 'back' THEN 1 WHEN 'lock' THEN 1 WHEN 'rise' THEN 2 WHEN 'switch' THEN 1 ELSE st END,
    CASE c WHEN 'expire' THEN NULL WHEN 'lock' THEN best WHEN 'switch' THEN rival ELSE locked END,
    CASE c WHEN 'rise' THEN best WHEN 'other' THEN best WHEN 'switch' THEN NULL ELSE rival END,
    CASE c WHEN 'rise' THEN 1 WHEN 'other' THEN 1 WHEN 'same' THEN rn + 1 WHEN 'switch' THEN 0 ELSE rn END,
    CASE c WHEN 'rest' THEN 1 WHEN 'expire' THEN held + 1 WHEN 'wait' THEN held + 1 WHEN 'back' THEN 0 ELSE held END,
    CASE WHEN c IN ('back', 'lock', 'switch') THEN 0 WHEN st = 1 AND best IS NOT NULL THEN CASE WHEN own IS NULL THEN lost + 1 ELSE 0 END ELSE lost END
  FROM (SELECT f.media_id, f.frame_idx, best, st, locked, rival, rn, held, lost, s.score AS own,
    CASE WHEN best IS NULL THEN CASE WHEN st IN (1, 2) THEN 'rest' WHEN st = 3 AND held + 1 >= 10 THEN 'expire' WHEN st = 3 THEN 'wait' ELSE 'none' END
      WHEN st = 0 THEN 'lock' WHEN st = 3 THEN CASE WHEN s.score IS NOT NULL THEN 'back' WHEN held + 1 < 10 THEN 'wait' ELSE 'lock' END
      WHEN st = 1 AND s.score IS NOT NULL THEN CASE WHEN best <> locked AND top > 2 * s.score THEN 'rise' ELSE 'none' END
      WHEN st = 1 THEN CASE WHEN lost + 1 >= 5 THEN 'rise' ELSE 'none' END
      WHEN best <> rival THEN 'other' WHEN rn + 1 >= 15 THEN 'switch' ELSE 'same' END AS c
    FROM walk w JOIN fr f ON f.media_id = w.media_id AND f.frame_idx = w.frame_idx + 1 LEFT JOIN sc s ON s.media_id = f.media_id AND s.frame_idx = f.frame_idx AND s.track_id = w.locked))
  SELECT media_id, frame_idx, CASE st WHEN 0 THEN 'SEARCHING' WHEN 1 THEN 'LOCKED' WHEN 2 THEN 'SWITCHING' ELSE 'HOLD_POSITION' END AS state, CAST(locked AS INTEGER) AS target FROM walk WHERE frame_idx >= 0"""


@query("w16_target_lock", LOCK)
def _(spark, d):
    return K.target_lock(X.detections(spark, d), lock_lengths(spark, d), fps=LOCK_FPS, frames=CHUNK)
