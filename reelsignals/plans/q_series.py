"""Queries on per-frame series, effects and pacing."""

from pyspark.sql import functions as F

from ..operators import effects as X2
from ..operators import ordered as O
from ..operators import series as R
from ..session import durable
from . import fixtures as X
from .registry import CTES, query

R6 = lambda c: F.round(c, 6)
HOP = 0.04


def _pct(arr, p):
    pos = f"({p} * (len({arr}) - 1))"
    lo, hi = f"{arr}[CAST(floor({pos}) AS BIGINT) + 1]", f"{arr}[CAST(ceil({pos}) AS BIGINT) + 1]"
    return f"({lo} + ({hi} - {lo}) * ({pos} - floor({pos})))"


CTES["f_thr"] = f"""SELECT media_id, mn AS rms_min, mx AS rms_max, onset_max, {_pct('oa', '0.9e0')} AS onset_p90, ({_pct('ra', '0.85e0')} - mn) / (mx - mn + 1e-8) AS peak_threshold, {_pct('ra', '0.5e0')} * 2 AS speech_threshold, n
  FROM (SELECT media_id, list_sort(list(rms)) AS ra, list_sort(list(onset)) AS oa, min(rms) AS mn, max(rms) AS mx, max(onset) AS onset_max, count(*) AS n FROM f_series GROUP BY 1)"""


@query("a12_thresholds", "SELECT media_id, rms_min, rms_max, onset_max, round(onset_p90, 6) AS onset_p90, round(peak_threshold, 6) AS peak_threshold, round(speech_threshold, 6) AS speech_threshold FROM f_thr")
def _(spark, d):
    return R.thresholds(X.series(spark, d)).select("media_id", "rms_min", "rms_max", "onset_max", R6("onset_p90").alias("onset_p90"),
                                                  R6("peak_threshold").alias("peak_threshold"), R6("speech_threshold").alias("speech_threshold"))


def _runs(flag, src="f_series", extra=""):
    return f"""SELECT media_id, min(frame_idx) AS f0, max(frame_idx) + 1 AS f1{extra} FROM (SELECT *, sum(c) OVER (PARTITION BY media_id ORDER BY frame_idx) AS isl FROM
  (SELECT *, CASE WHEN fl IS DISTINCT FROM lag(fl) OVER (PARTITION BY media_id ORDER BY frame_idx) THEN 1 ELSE 0 END AS c FROM (SELECT *, {flag} AS fl FROM {src}))) WHERE fl GROUP BY media_id, isl"""


CTES["f_voice_a"] = _runs("onset > 0.5e0")
CTES["f_len"] = "SELECT media_id, count(*) AS n FROM f_series GROUP BY 1"


@query("w01_voice_segments", """SELECT media_id, f0 * 0.03e0 AS start_time, CASE WHEN f1 = n THEN n * 0.03e0 + 0.01e0 ELSE f1 * 0.03e0 END AS end_time FROM f_voice_a JOIN f_len USING (media_id)""")
def _(spark, d):
    s = X.series(spark, d)
    ends = s.groupBy("media_id").agg(F.count(F.lit(1)).alias("n_frames")).withColumn("audio_end", F.col("n_frames") * F.lit(0.03) + 0.01)
    return R.voice_segments(s, F.col("onset") > 0.5, 0.03, ends=ends).select("media_id", "start_time", "end_time")


CTES["f_voice_b"] = _runs("rms > speech_threshold", "(SELECT * FROM f_series JOIN f_thr USING (media_id))")


@query("w01_energy_voice_segments", "SELECT media_id, f0 * 0.06e0 AS start_time, f1 * 0.06e0 AS end_time FROM f_voice_b WHERE f1 * 0.06e0 - f0 * 0.06e0 > 0.1e0")
def _(spark, d):
    return R.energy_voice_segments(X.series(spark, d), 0.06).select("media_id", "start_time", "end_time")


CTES["f_zones0"] = _runs("ti < 5 OR ae < 0.5e0", extra=", avg(ti) AS mean_ti")
CTES["f_zones"] = "SELECT media_id, f0 / 10e0 AS start_time, f1 / 10e0 AS end_time, 1.15e0 AS value, mean_ti, row_number() OVER (PARTITION BY media_id ORDER BY f0) AS action_idx FROM f_zones0 WHERE (f1 - f0) / 10e0 > 2"


@query("w02_low_activity_zones", "SELECT media_id, 'zoom' AS type, start_time, end_time, value, 'Low TI (' || printf('%.1f', mean_ti) || ')' AS reason FROM f_zones")
def _(spark, d):
    return R.low_activity_zones(X.series(spark, d), fps=10.0).select("media_id", "type", "start_time", "end_time", "value", "reason")


@query("w03_framewise_low_activity", "SELECT media_id, frame_idx, 'ZOOM_IN' AS action FROM f_series WHERE ti < 5 AND rms < 0.1e0")
def _(spark, d):
    return X.series(spark, d).where(R.low_activity(F.col("ti"), F.col("rms"), 5.0, 0.1, "and")).select("media_id", "frame_idx", F.lit("ZOOM_IN").alias("action"))


CTES["f_norm"] = "SELECT *, (rms - rms_min) / (rms_max - rms_min + 1e-8) AS e FROM f_series JOIN f_thr USING (media_id)"
CTES["f_state"] = """SELECT *, coalesce(last_value(CASE WHEN e > peak_threshold THEN true WHEN e < peak_threshold * 0.8e0 THEN false END IGNORE NULLS) OVER (PARTITION BY media_id ORDER BY frame_idx), false) AS st FROM f_norm"""
CTES["f_peaks0"] = _runs("st", "f_state", ", arg_max(e, frame_idx) AS intensity")
CTES["f_peaks"] = f"""SELECT media_id, f0, f0 * {HOP}e0 AS "timestamp", f1 * {HOP}e0 - f0 * {HOP}e0 AS duration, intensity, row_number() OVER (PARTITION BY media_id ORDER BY f0) AS rn FROM f_peaks0 JOIN f_len USING (media_id)
  WHERE f1 < n AND f1 * {HOP}e0 - f0 * {HOP}e0 > 0.1e0"""


def peaks(spark, d):
    s = durable(X.series(spark, d))
    return R.hysteresis_peaks(s, durable(R.thresholds(s)), HOP)


@query("w04_hysteresis_peaks", 'SELECT media_id, "timestamp", duration, round(intensity, 6) AS intensity FROM f_peaks')
def _(spark, d):
    return peaks(spark, d).select("media_id", "timestamp", "duration", R6("intensity").alias("intensity"))


CTES["f_ptrig"] = """SELECT media_id, "timestamp", 'zoom' AS effect_type, intensity, least(duration, 1e0) AS duration, f0 AS source_idx FROM f_peaks WHERE rn <= 20"""


@query("k04_first_peaks", 'SELECT media_id, "timestamp", duration FROM f_ptrig')
def _(spark, d):
    return R.peak_triggers(peaks(spark, d)).select("media_id", "timestamp", "duration")


CTES["f_otrig"] = f"""SELECT media_id, frame_idx * {HOP}e0 AS "timestamp", 'shake' AS effect_type, onset / onset_max AS intensity, 0.15e0 AS duration, frame_idx AS source_idx FROM f_series JOIN f_thr USING (media_id) WHERE onset > onset_p90"""


def onsets(spark, d):
    s = X.series(spark, d)
    return R.onset_triggers(s, R.thresholds(s), HOP)


@query("w05_strong_onsets", 'SELECT media_id, "timestamp", intensity, duration FROM f_otrig')
def _(spark, d):
    return onsets(spark, d).select("media_id", "timestamp", "intensity", "duration")


@query("w06_downbeats", """SELECT media_id, beat_idx, "time" AS "timestamp", 0.3e0 AS intensity FROM f_beats WHERE beat_idx % 4 = 0""")
def _(spark, d):
    return R.beat_triggers(X.beats(spark, d)).select("media_id", F.col("source_idx").alias("beat_idx"), "timestamp", "intensity")


def series_beats(spark, d):
    """Beats of the series media: frames with a strong attack."""
    b = O.number_rows(X.series(spark, d).where(F.col("onset") > 1.2), ["media_id"], ["frame_idx"], "beat_idx", chunk=O.dense_chunk("frame_idx"))
    return b.select("media_id", "beat_idx", (F.col("frame_idx") * F.lit(HOP)).alias("time"))


CTES["f_btrig"] = f"""SELECT media_id, "time" AS "timestamp", 'emphasize' AS effect_type, 0.3e0 AS intensity, 0.1e0 AS duration, beat_idx AS source_idx FROM (SELECT media_id, frame_idx * {HOP}e0 AS "time",
  row_number() OVER (PARTITION BY media_id ORDER BY frame_idx) - 1 AS beat_idx FROM f_series WHERE onset > 1.2e0) WHERE beat_idx % 4 = 0"""
CTES["f_alltrig"] = """SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY "timestamp", part, source_idx) AS r FROM (SELECT *, 0 AS part FROM f_ptrig UNION ALL SELECT *, 1 FROM f_otrig UNION ALL SELECT *, 2 FROM f_btrig)"""


def triggers(spark, d):
    s = durable(X.series(spark, d))
    lim = durable(R.thresholds(s))
    allt = X2.all_triggers(R.peak_triggers(R.hysteresis_peaks(s, lim, HOP)), R.onset_triggers(s, lim, HOP), R.beat_triggers(series_beats(spark, d)))
    return X2.dedupe_triggers(allt)


# rows 'keep' the trigger that stands when a later one is appended
CTES["f_fold"] = """SELECT 1"""
_W07 = """WITH RECURSIVE walk AS (SELECT media_id, r, "timestamp" AS kt, intensity AS ki, r AS kr FROM f_alltrig WHERE r = 1
  UNION ALL SELECT t.media_id, t.r, CASE WHEN t."timestamp" - w.kt > 0.1e0 OR t.intensity > w.ki THEN t."timestamp" ELSE w.kt END, CASE WHEN t."timestamp" - w.kt > 0.1e0 OR t.intensity > w.ki THEN t.intensity ELSE w.ki END,
    CASE WHEN t."timestamp" - w.kt > 0.1e0 OR t.intensity > w.ki THEN t.r ELSE w.kr END FROM walk w JOIN f_alltrig t ON t.media_id = w.media_id AND t.r = w.r + 1),
  steps AS (SELECT media_id, kr, kt, lead(kt) OVER (PARTITION BY media_id ORDER BY r) AS nt, lead(kr) OVER (PARTITION BY media_id ORDER BY r) AS nr FROM walk),
  kept AS (SELECT media_id, kr FROM steps WHERE nr IS NULL OR (nr <> kr AND nt - kt > 0.1e0))
  SELECT t.media_id, "timestamp", effect_type, round(intensity, 6) AS intensity, duration FROM f_alltrig t JOIN kept k ON t.media_id = k.media_id AND t.r = k.kr"""
del CTES["f_fold"]


@query("w07_trigger_dedupe", _W07)
def _(spark, d):
    return triggers(spark, d).select("media_id", "timestamp", "effect_type", R6("intensity").alias("intensity"), "duration")


@query("w07_trigger_dedupe_streamed", _W07)
def _(spark, d):
    return triggers(spark, d).select("media_id", "timestamp", "effect_type", R6("intensity").alias("intensity"), "duration")


@query("a11_effect_plan", """SELECT media_id, average_energy, coalesce(zoom, 0) AS zoom, coalesce(shake, 0) AS shake FROM (SELECT media_id, round(avg(rms), 6) AS average_energy FROM f_series GROUP BY 1)
  LEFT JOIN (SELECT media_id, count(*) FILTER (WHERE effect_type = 'zoom') AS zoom, count(*) FILTER (WHERE effect_type = 'shake') AS shake FROM (SELECT * FROM f_ptrig UNION ALL SELECT * FROM f_otrig) GROUP BY 1) USING (media_id)""")
def _(spark, d):
    s = durable(X.series(spark, d))
    lim = durable(R.thresholds(s))
    t = X2.all_triggers(R.peak_triggers(R.hysteresis_peaks(s, lim, HOP)), R.onset_triggers(s, lim, HOP))
    return X2.plan_summary(t, s).select("media_id", "average_energy", "zoom", "shake")


@query("a11_effect_totals", """SELECT media_id, effect_type, count(*) AS n FROM (SELECT * FROM f_ptrig UNION ALL SELECT * FROM f_otrig) GROUP BY ROLLUP (media_id, effect_type)""")
def _(spark, d):
    s = durable(X.series(spark, d))
    lim = durable(R.thresholds(s))
    t = X2.all_triggers(R.peak_triggers(R.hysteresis_peaks(s, lim, HOP)), R.onset_triggers(s, lim, HOP))
    return X2.plan_totals(t)


CTES["f_trigframes"] = """SELECT t.*, unnest(range(CAST(trunc("timestamp" * 30) AS BIGINT), CAST(trunc("timestamp" * 30) AS BIGINT) + greatest(1, CAST(trunc(duration * 30) AS BIGINT)))) AS frame_idx FROM f_otrig t"""


@query("j09_frame_triggers", """SELECT s.media_id, s.frame_idx, effect_type, intensity FROM f_series s JOIN f_trigframes t ON s.media_id = t.media_id AND s.frame_idx = t.frame_idx""")
def _(spark, d):
    return X2.frames_with_triggers(X.series(spark, d).select("media_id", "frame_idx"), onsets(spark, d)).select("media_id", "frame_idx", "effect_type", "intensity")


_KINDS = "list_extract(['zoom', 'zoom_punch', 'shake', 'flash', 'emphasize', 'vignette_pulse'], t.source_idx % 6 + 1)"
CTES["f_timed"] = f"""SELECT s.media_id, s.frame_idx, {_KINDS} AS effect_type, t.intensity, (s.frame_idx / 30e0 - t."timestamp") / t.duration AS p FROM f_series s JOIN f_otrig t ON s.media_id = t.media_id
  AND t."timestamp" <= s.frame_idx / 30e0 AND s.frame_idx / 30e0 <= t."timestamp" + t.duration"""


def _timed(spark, d):
    kind = F.element_at(F.array(*[F.lit(k) for k in X2.EFFECTS]), (F.col("source_idx") % 6 + 1).cast("int"))
    t = onsets(spark, d).withColumn("effect_type", kind)
    return X2.timed_trigger_frames(X.series(spark, d).select("media_id", "frame_idx"), t, 30.0)


@query("j09_timed_frame_triggers", "SELECT media_id, frame_idx, effect_type FROM f_timed")
def _(spark, d):
    return _timed(spark, d).select("media_id", "frame_idx", "effect_type")


@query("p21_effect_values", """SELECT media_id, frame_idx, effect_type, round(CASE effect_type WHEN 'zoom' THEN 1 + 0.25e0 * intensity * (0.5e0 - 0.5e0 * cos(p * pi()))
  WHEN 'zoom_punch' THEN 1 + 0.3e0 * intensity * greatest(0e0, exp(-3 * p) * sin(p * pi() * 2)) WHEN 'shake' THEN intensity * 0.05e0 * (1 - (0.5e0 - 0.5e0 * cos(p * pi()))) WHEN 'flash' THEN intensity * 0.35e0 * (1 - sqrt(p))
  WHEN 'emphasize' THEN 1 + 0.08e0 * intensity * sin(p * pi()) ELSE 0.3e0 + 0.4e0 * intensity * (1 - p) END, 6) AS value FROM f_timed""")
def _(spark, d):
    return _timed(spark, d).select("media_id", "frame_idx", "effect_type", R6(X2.effect_value(30.0)).alias("value"))


@query("j10_pacing_zoom", """SELECT s.media_id, s.frame_idx, coalesce(zoom, 1e0) AS zoom FROM f_series s LEFT JOIN (SELECT media_id, frame_idx, arg_max(value + action_idx / 100e0, action_idx) AS zoom FROM
  (SELECT *, unnest(range(CAST(trunc(start_time * 10) AS BIGINT), CAST(trunc((end_time + 3) * 10) AS BIGINT) + 1)) AS frame_idx FROM f_zones) GROUP BY 1, 2) z ON s.media_id = z.media_id AND s.frame_idx = z.frame_idx""")
def _(spark, d):
    s = X.series(spark, d)
    z = R.low_activity_zones(s, fps=10.0).withColumn("__f", (F.col("start_time") * 10).cast("bigint"))
    z = O.number_rows(z, ["media_id"], ["__f"], "action_idx", chunk=O.dense_chunk("__f"), start=1)
    # every action lasts three seconds longer, so that neighbours overlap and the last one wins
    z = z.withColumns({"value": F.col("value") + F.col("action_idx") / F.lit(100.0), "end_time": F.col("end_time") + 3})
    return X2.pacing_zoom(s.select("media_id", "frame_idx"), z, fps=10.0)


@query("p20_emphasis_zoom", """SELECT media_id, frame_idx, CASE WHEN ae < 0.5e0 THEN 1e0 ELSE 1 + (ae - 0.5e0) * (1.15e0 - 1) / (1 - 0.5e0) END AS zoom FROM f_series""")
def _(spark, d):
    return X.series(spark, d).select("media_id", "frame_idx", X2.emphasis_zoom(F.col("ae")).alias("zoom"))


@query("p22_impact_shake", """SELECT s.media_id, s.frame_idx, round(0.3e0 * (1 - (s.frame_idx - i0) / 5), 6) AS shake, round(sin(s.frame_idx * 7.3e0) * 2 - 1, 6) AS offset_x, round(cos(s.frame_idx * 11.7e0) * 2 - 1, 6) AS offset_y
  FROM f_series s JOIN (SELECT s2.media_id, s2.frame_idx, min(t.source_idx) AS i0 FROM f_series s2 JOIN f_otrig t ON t.media_id = s2.media_id AND s2.frame_idx >= t.source_idx AND s2.frame_idx < t.source_idx + 5 GROUP BY 1, 2) x
  ON s.media_id = x.media_id AND s.frame_idx = x.frame_idx""")
def _(spark, d):
    imp = onsets(spark, d).select("media_id", F.col("source_idx").alias("impact_frame"), F.col("source_idx").alias("impact_idx"))
    r = X2.impact_shake(X.series(spark, d).select("media_id", "frame_idx"), imp)
    return r.select("media_id", "frame_idx", R6("shake").alias("shake"), R6("offset_x").alias("offset_x"), R6("offset_y").alias("offset_y"))


CTES["f_aes"] = "SELECT media_id, ae, row_number() OVER (PARTITION BY media_id ORDER BY frame_idx) - 1 AS k, count(*) OVER (PARTITION BY media_id) AS l FROM f_series WHERE rms < 0.1e0"
CTES["f_x"] = """SELECT s.media_id, s.frame_idx, l, CASE WHEN s.frame_idx = n - 1 THEN CAST(l AS DOUBLE) ELSE s.frame_idx * (l / (n - 1)) END AS x FROM f_series s JOIN f_len USING (media_id) JOIN (SELECT DISTINCT media_id, l FROM f_aes) USING (media_id)"""


@query("j13_series_resample", """SELECT x.media_id, x.frame_idx, round((b.ae - a.ae) * (x - a.k) + a.ae, 6) AS ae_resampled FROM f_x x JOIN f_aes a ON a.media_id = x.media_id AND a.k = least(CAST(floor(x) AS BIGINT), x.l - 1)
  JOIN f_aes b ON b.media_id = x.media_id AND b.k = least(CAST(floor(x) AS BIGINT) + 1, x.l - 1)""")
def _(spark, d):
    s = X.series(spark, d)
    quiet = O.number_rows(s.where(F.col("rms") < 0.1), ["media_id"], ["frame_idx"], "sample_idx", chunk=O.dense_chunk("frame_idx")).select("media_id", "sample_idx", "ae")
    return R.resample(quiet, s.select("media_id", "frame_idx"), "ae").select("media_id", "frame_idx", R6("ae_resampled").alias("ae_resampled"))


@query("w18_moving_average", """SELECT media_id, frame_idx, round((coalesce(lag(onset) OVER w, onset) + onset + coalesce(lead(onset) OVER w, onset)) / 3, 6) AS smooth FROM f_series WINDOW w AS (PARTITION BY media_id ORDER BY frame_idx)""")
def _(spark, d):
    return R.moving_average3(X.series(spark, d), "onset", "smooth").select("media_id", "frame_idx", R6("smooth").alias("smooth"))


@query("x06_look_ahead_smoothing", """SELECT media_id, frame_idx, round(avg(rms) OVER (PARTITION BY media_id ORDER BY frame_idx ROWS BETWEEN 7 PRECEDING AND 7 FOLLOWING), 9) AS smooth FROM f_series""")
def _(spark, d):
    return R.look_ahead_mean(X.series(spark, d), "rms", "smooth", 7, chunk_rows=256).select("media_id", "frame_idx", F.round("smooth", 9).alias("smooth"))


CTES["f_hist"] = """SELECT media_id, frame_idx, list_transform(range(32), lambda b: len(list_filter(pixels, lambda x: least(31, floor(x * 32)) = b)) / (len(pixels) + 1e-8)) AS h FROM f_frames"""


@query("a15_scene_cuts", """SELECT media_id, frame_idx, round(diff, 6) AS hist_diff, diff > 0.35e0 AS is_cut FROM (SELECT media_id, frame_idx, coalesce(list_sum(list_transform(list_zip(h, lag(h) OVER (PARTITION BY media_id ORDER BY frame_idx)), lambda z: abs(z[1] - z[2]))), 0e0) AS diff FROM f_hist)""")
def _(spark, d):
    return R.scene_cuts(X.frame_vectors(spark, d)).select("media_id", "frame_idx", R6("hist_diff").alias("hist_diff"), "is_cut")


@query("a16_temporal_information", """SELECT media_id, frame_idx, round(coalesce(list_aggregate(list_transform(list_zip(pixels, lag(pixels) OVER (PARTITION BY media_id ORDER BY frame_idx)), lambda z: z[1] - z[2]), 'stddev_pop'), 0e0), 6) AS ti FROM f_frames""")
def _(spark, d):
    return R.temporal_information(X.frame_vectors(spark, d)).select("media_id", "frame_idx", R6("ti").alias("ti"))


@query("a17_frame_rms", "SELECT media_id, sample_idx // 16 AS frame_idx, round(sqrt(avg(x * x)), 6) AS rms FROM f_samples GROUP BY 1, 2")
def _(spark, d):
    return R.frame_rms(X.samples(spark, d), 16).select("media_id", "frame_idx", R6("rms").alias("rms"))
