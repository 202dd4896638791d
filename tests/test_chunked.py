"""Chunk-parallel folds, affine scans, levels of intervals and anchors against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from reelsignals.operators import captions as C
from reelsignals.operators import edl as E
from reelsignals.operators import folds
from reelsignals.operators import intervals as I
from reelsignals.operators import ordered as O
from reelsignals.operators import signals as T
from reelsignals.operators import speakers as P
from reelsignals.operators.chunked import chunk_fold

rng = random.Random(5)
BAND = "media_id bigint, frame_idx int, x int, y int"


def band_rows(media, n, far):
    x, rows = 900, []
    for f in range(n):
        x = max(0, min(1900, x + rng.choice([-1, 1]) * rng.randint(0, far)))
        rows.append((media, f * 3 + media, None if rng.random() < 0.2 else x, 500 + x // 9, 960, 540))
    return rows


def plain(rows, make):
    from collections import namedtuple

    row = namedtuple("row", "media_id frame_idx target_cx target_cy init_x init_y")
    out, now = [], {}
    for r in sorted(rows):
        fold = now.setdefault(r[0], make())
        out += [(r[0], *o) for o in fold.step(row(*r))]
    return out


@pytest.mark.parametrize("frames,warm,rounds", [(50, 20, 4), (40, 0, 0), (40, 0, 2), (5, 3, 3), (4000, 10, 1)])
def test_chunked_dead_band_equals_one_fold(spark, frames, warm, rounds):
    # the first item often jumps, the second hardly moves, so its state depends on far frames
    rows = band_rows(1, 300, 200) + band_rows(2, 200, 6) + band_rows(3, 1, 5)
    d = spark.createDataFrame(rows, "media_id bigint, frame_idx int, target_cx int, target_cy int, init_x int, init_y int").repartition(5)
    got = chunk_fold(d, ["media_id"], "frame_idx", lambda: folds.DeadBand(), BAND, frames, warm, rounds)
    assert sorted(map(tuple, got.collect())) == plain(rows, folds.DeadBand)


@pytest.mark.parametrize("frames,warm,rounds,run", [(50, 20, 4, 50), (40, 0, 0, 40), (40, 0, 2, 90), (5, 3, 3, 1), (10, 5, 1, 45)])
def test_runs_of_chunks_equal_one_fold(spark, frames, warm, rounds, run):
    rows = band_rows(1, 300, 200) + band_rows(2, 200, 6) + band_rows(3, 1, 5)
    d = spark.createDataFrame(rows, "media_id bigint, frame_idx int, target_cx int, target_cy int, init_x int, init_y int").repartition(5)
    got = chunk_fold(d, ["media_id"], "frame_idx", lambda: folds.DeadBand(), BAND, frames, warm, rounds, run)
    assert sorted(map(tuple, got.collect())) == plain(rows, folds.DeadBand)


def test_short_keys_are_folded_once(spark):
    steps = spark.sparkContext.accumulator(0)

    class Counted(folds.DeadBand):
        def step(self, row):
            steps.add(1)
            return super().step(row)

    rows = band_rows(1, 300, 200) + band_rows(2, 200, 6)
    d = spark.createDataFrame(rows, "media_id bigint, frame_idx int, target_cx int, target_cy int, init_x int, init_y int")
    assert chunk_fold(d, ["media_id"], "frame_idx", lambda: Counted(), BAND, 48).count() == len(rows) == steps.value


def test_one_long_item_runs_in_many_tasks(spark):
    n, old = 300_000, spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        x = (F.pmod(F.xxhash64("id"), F.lit(1900))).cast("int")
        d = spark.range(n).select(F.lit(1).cast("bigint").alias("media_id"), F.col("id").cast("int").alias("frame_idx"), x.alias("target_cx"), F.lit(500).alias("target_cy"), F.lit(960).alias("init_x"), F.lit(540).alias("init_y"))
        got = chunk_fold(d, ["media_id"], "frame_idx", lambda: folds.DeadBand(), BAND)
        tasks = got.groupBy(F.spark_partition_id()).count().collect()
        assert len(tasks) >= 8 and sum(r["count"] for r in tasks) == n
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    rows = [tuple(r) for r in d.orderBy("frame_idx").collect()]
    assert sorted(map(tuple, got.select("media_id", "frame_idx", "x", "y").collect())) == plain(rows, folds.DeadBand)


@pytest.mark.parametrize("fold", ["box", "kalman"])
def test_chunked_smoothers_equal_one_fold(spark, fold):
    rows = [(t, f, *(rng.randint(0, 900) for _ in range(4))) for t in (1, 2) for f in range(700)]
    d = spark.createDataFrame(rows, "media_id bigint, frame_idx int, cx int, cy int, w int, h int").selectExpr("*", "cx AS x1", "cy AS y1", "cx + w AS x2", "cy + h AS y2")
    gains = folds.CentreKalman.gain_list()
    make, schema = ((lambda: folds.DeadZoneEma(1920, 1080)), "media_id bigint, frame_idx int, cx int, cy int, w int, h int") if fold == "box" else ((lambda: folds.CentreKalman(gains)), BAND)
    whole = folds.sorted_fold(d, ["media_id"], ["frame_idx"], make, schema)
    for warm in (0, 150):
        assert sorted(chunk_fold(d, ["media_id"], "frame_idx", make, schema, 200, warm).collect()) == sorted(whole.collect())


@pytest.mark.parametrize("alpha,rows", [(0.15, None), (0.15, 7), (0.01, 20), (0.6, 3)])
def test_exponential_means(spark, tiny_chunks, alpha, rows):
    data = [(k, i * 2 + k, float(rng.randint(0, 2000)) / 2) for k in (1, 2) for i in range(150)]
    d = spark.createDataFrame(data, "k int, o int, v double").repartition(3)
    got = {(r.k, r.o): r.s for r in O.exponential_means(d, ["k"], "o", {"s": F.col("v")}, alpha, chunk_rows=rows).collect()}
    for k in (1, 2):
        s = None
        for _, o, v in sorted(x for x in data if x[0] == k):
            s = v if s is None else alpha * v + (1 - alpha) * s
            assert got[k, o] == pytest.approx(s, rel=1e-12)


def test_long_intervals_lie_in_few_bins_and_pairs_come_once(spark):
    spans = [(m, i, s, s + rng.choice([0.0, 0.5, 3.0, 40.0, 1e7])) for m in (1, 2) for i, s in enumerate(rng.uniform(-50, 200) for _ in range(60))]
    spans += [spans[3], spans[3], (1, 99, 5.0, 4.0), (1, 98, None, 4.0)]
    points = [(m, i, rng.uniform(-60, 260)) for m in (1, 2, 3) for i in range(50)]
    points += [points[0], points[0]]
    r = spark.createDataFrame(spans, "m int, j int, s2 double, e2 double")
    assert I.leveled(r, F.col("s2"), F.col("e2"), 1.0).count() <= 2 * len(spans)
    l = spark.createDataFrame(points, "m int, i int, t double")
    got = sorted((x.m, x.i, x.j) for x in I.point_join(l, r, ["m"], F.col("t"), (F.col("s2"), F.col("e2")), F.col("t").between(F.col("s2"), F.col("e2")), 1.0).collect())
    assert got == sorted((p[0], p[1], s[1]) for p in points for s in spans if p[0] == s[0] and s[2] is not None and s[2] <= p[2] <= s[3])
    long = [(m, i, a, a + rng.choice([0.1, 7.0, 900.0])) for m in (1, 2) for i, a in enumerate(rng.uniform(-50, 200) for _ in range(40))]
    q = spark.createDataFrame(long, "m int, i int, s double, e double")
    got = sorted((x.m, x.i, x.j) for x in I.overlap_join(q, r, ["m"], (F.col("s"), F.col("e")), (F.col("s2"), F.col("e2")), (F.col("s") <= F.col("e2")) & (F.col("e") >= F.col("s2")), 1.0).collect())
    assert got == sorted((p[0], p[1], s[1]) for p in long for s in spans if p[0] == s[0] and s[2] is not None and s[3] >= s[2] and p[2] <= s[3] and p[3] >= s[2])


def test_repeated_rows_come_out_repeated(spark):
    words = [(1, 0, "a", 0.0, 0.5), (1, 0, "a", 0.0, 0.5), (1, 1, "b", 90.0, 91.0), (2, 0, None, 1.0, 2.0)]
    w = spark.createDataFrame(words, "media_id int, word_idx int, word string, start double, end double")
    turns = spark.createDataFrame([(1, 0, "S1", 0.0, 1.0), (1, 1, "S2", 0.2, 9.0)], "media_id int, turn_idx int, speaker string, t_start double, t_end double")
    got = sorted((r.media_id, r.word_idx, r.speaker) for r in P.attribute_words(w, turns).collect())
    assert got == [(1, 0, "S1"), (1, 0, "S1"), (1, 1, "SPEAKER_00"), (2, 0, "SPEAKER_00")]
    got = sorted((r.media_id, r.word_idx, r.speaker or "") for r in P.speaker_at(w, turns, F.col("start") + 0.3).collect())
    assert got == [(1, 0, "S1"), (1, 0, "S1"), (1, 1, ""), (2, 0, "")]
    none = turns.where("speaker = 'nobody'")
    assert P.attribute_words(w, none).count() == 4
    frames = spark.createDataFrame([(1, 0.4), (1, 0.4), (1, 50.0)], "media_id int, t double")
    lines = spark.createDataFrame([(1, 0, 0.0, 1.0, "a", [("a", 0.0, 1.0)])], "media_id int, line_idx int, start double, end double, text string, words array<struct<word:string,start:double,end:double>>")
    assert [(r.t, r.line_idx) for r in C.active_line(frames, lines).collect()] == [(0.4, 0), (0.4, 0)]


def test_left_rows_move_once_whatever_the_levels(spark):
    spans = [(1, j, -100.0 * 2**j, 100.0 * 2**j) for j in range(12)]  # twelve levels, all of which hold every point
    points = spark.range(400).selectExpr("IF(id % 50 = 7, NULL, 1) AS m", "IF(id % 50 = 9, NULL, id / 40.0) AS t", "id AS i")
    r = spark.createDataFrame(spans, "m int, j int, s2 double, e2 double")
    join = lambda how: I.point_join(points, r, ["m"], F.col("t"), (F.col("s2"), F.col("e2")), F.col("t").between(F.col("s2"), F.col("e2")) & (F.col("j") < 2), 1.0, how)
    assert join("inner").count() == 2 * 384
    assert join("left").count() == 2 * 384 + 16
    assert I._with_cells(points, r, ["m"], (F.col("t"), F.col("t")), (F.col("s2"), F.col("e2")), 1.0)[1].count() == 10 * 12


def test_snap_to_the_nearest_mark(spark):
    marks = [(m, t) for m in (1, 2, None) for t in [rng.uniform(0, 90) for _ in range(12)] + [-40.0, 8.0, 8.0, 500.0]] + [(1, None), (4, 1e6)]
    points = [(m, i, rng.choice([rng.uniform(-60, 120), 8.0, 4.0, 1e5])) for m in (1, 2, 3, 4, None) for i in range(40)] + [(1, 99, None), (1, 0, 8.0), (1, 0, 8.0)]
    p, q = spark.createDataFrame(points, "media_id int, i int, t double"), spark.createDataFrame(marks, "media_id int, mark double")

    def nearest(m, t):
        near = [x for k, x in marks if k == m and x is not None] if t is not None else []
        return min(near, key=lambda x: (abs(x - t), x), default=t)

    order = lambda r: tuple(-1e9 if x is None else x for x in r)
    for chunk in (3600.0, 16.0):
        got = [tuple(r) for r in E.snap_to(p, q, "t", "mark", chunk_seconds=chunk).select("media_id", "i", "t", "t_snapped").collect()]
        assert sorted(got, key=order) == sorted(((m, i, t, nearest(m, t)) for m, i, t in points), key=order)


def test_segments_move_their_words_once(spark, tiny_chunks):
    from reelsignals.operators import transcripts as W

    words = [(m, i * 2, rng.choice(["a", "b.", "c", None]), i * 1.0, i + 0.5) for m in (1, None) for i in range(40)] + [(5, 0, "x", 0.0, 1.0)] * 2
    d = spark.createDataFrame(words, "media_id int, word_idx int, word string, start double, end double")
    lines = W.punctuation_groups(d, 5)
    got = [x["word_idx"] for r in lines.where("media_id = 1").orderBy("first_idx").collect() for x in r.words]
    assert got == [i * 2 for i in range(40)]
    assert lines.agg(F.sum("n_words")).first()[0] == len(words)
    assert [(r.n_words, r.text) for r in lines.where("media_id = 5").collect()] == [(2, "x x")]
    # one exchange of all words; the other one takes runs at the border of a chunk only
    plan = W._lines_of_chunks(O.keyed(O.chunked(d.withColumn("g", F.col("word_idx")), "word_idx"), ["media_id"]).repartition(O.CHUNK), ["media_id", "g"])
    assert plan._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning(media_id") == 1


def test_breakouts_by_anchor(spark):
    titles = [f"{a}{b} {c}" for a in ("Ab", "x", "éÉ") for b in ("cab", "", "bc bc") for c in ("TOPIC 1", "topic 12", "z")] + ["", None, "q", "Ab"]
    kws = ["ABC", "topic 1", "ic 12", "é", "Q", "bc b", "nowhere", "", None, "bcabcabcabc", "x z"]
    s = spark.createDataFrame([(i, t) for i, t in enumerate(titles + titles)], "arrival_idx int, title string")
    k = spark.createDataFrame([(x,) for x in kws], "keyword string")
    got = {r.arrival_idx: r.google_breakout for r in T.flag_breakouts(s, k).collect()}
    want = {i: any(x and t is not None and x.lower() in t.lower() for x in kws) for i, t in enumerate(titles + titles)}
    assert got == want and len(set(want.values())) == 2


def test_a_long_chain_of_overlaps(spark):
    n = 20_000
    rows = [(1, i, i * 10.0, i * 10.0 + 15.0, float(rng.randint(0, 100))) for i in range(n)] + [(1, n + i, 7.0, 7.0, 1.0) for i in range(3)]
    d = spark.createDataFrame(rows, "media_id int, moment_idx int, start_time double, end_time double, viral_score double")
    got = sorted(r.moment_idx for r in E.best_moments(d).collect())
    taken, near = [], {}
    for r in sorted(rows, key=lambda r: (-r[4], r[1])):
        cells = range(int(r[2] // 10) - 1, int(r[3] // 10) + 2)
        if not any(r[2] < k[3] and k[2] < r[3] for c in cells for k in near.get(c, ())):
            taken.append(r[1])
            near.setdefault(int(r[2] // 10), []).append(r)
    assert got == sorted(taken)
