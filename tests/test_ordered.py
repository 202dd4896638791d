"""Chunked scans against plain loops, with chunks far smaller than the keys."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from reelsignals.operators import intervals as I
from reelsignals.operators import ordered as O
from reelsignals.operators import series as R
from reelsignals.operators import transcripts as W

rng = random.Random(7)
ROWS = [(k, i, rng.choice(["a", "b"]), rng.choice([None, 1, 2, 3]), rng.randint(0, 9)) for k, n in ((1, 40), (2, 1), (3, 11)) for i in range(n)]


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame(ROWS, "k int, i int, s string, v int, x int").cache()


def by_key():
    return {k: [r for r in ROWS if r[0] == k] for k in (1, 2, 3)}


def test_running_sum(df, tiny_chunks):
    got = {(r.k, r.i): r.t for r in O.running_sum(df, ["k"], "i", F.col("x"), "t").collect()}
    excl = {(r.k, r.i): r.t for r in O.running_sum(df, ["k"], "i", F.col("x"), "t", inclusive=False).collect()}
    for k, rows in by_key().items():
        total = 0
        for r in rows:
            assert excl[(k, r[1])] == total
            total += r[4]
            assert got[(k, r[1])] == total


def test_shift_both_ways(df, tiny_chunks):
    lag = {(r.k, r.i): r.p for r in O.shifted(df, ["k"], "i", {"p": F.col("v")}).collect()}
    lead = {(r.k, r.i): r.p for r in O.shifted(df, ["k"], "i", {"p": F.col("v")}, forward=True).collect()}
    for k, rows in by_key().items():
        for j, r in enumerate(rows):
            assert lag[(k, r[1])] == (rows[j - 1][3] if j else None)
            assert lead[(k, r[1])] == (rows[j + 1][3] if j + 1 < len(rows) else None)


def test_last_known(df, tiny_chunks):
    d = O.last_known(df, ["k"], "i", F.col("v"), "p", fallback=F.lit(-1), first_value=F.when(F.col("v") > 1, F.col("v")))
    got = {(r.k, r.i): r.p for r in d.collect()}
    for k, rows in by_key().items():
        first = next((r[3] for r in rows if r[3] is not None and r[3] > 1), -1)
        last = None
        for r in rows:
            last = r[3] if r[3] is not None else last
            assert got[(k, r[1])] == (last if last is not None else first)


def test_islands(df, tiny_chunks):
    got = {(r.k, r.i): r.island for r in O.islands(df, ["k"], "i", F.col("s")).collect()}
    for k, rows in by_key().items():
        n = 0
        for j, r in enumerate(rows):
            n += int(j > 0 and rows[j - 1][2] != r[2])
            assert got[(k, r[1])] == n


def test_number_rows_sparse_order(df):
    d = df.withColumn("o", F.col("i") * 37 + F.col("x"))
    got = {(r.k, r.i): r.n for r in O.number_rows(d, ["k"], ["o"], "n", chunk=O.dense_chunk("o", 50)).collect()}
    assert all(got[(r[0], r[1])] == r[1] for r in ROWS)


def test_percentiles(df):
    got = {r.k: (r.a, r.b, r.c) for r in O.exact_percentiles(df, ["k"], "x", {"a": 0.5, "b": 0.85, "c": 0.9}, bins=5).collect()}
    for k, rows in by_key().items():
        assert got[k] == pytest.approx(np.percentile([r[4] for r in rows], [50, 85, 90]))


def test_moving_averages(df, tiny_chunks):
    near = {(r.k, r.i): r.m for r in R.moving_average3(df, "x", "m", "k", "i").collect()}
    wide = {(r.k, r.i): r.m for r in R.look_ahead_mean(df, "x", "m", 2, "k", "i").collect()}
    for k, rows in by_key().items():
        xs = [r[4] for r in rows]
        for j, r in enumerate(rows):
            pad = [xs[0], *xs, xs[-1]]
            assert near[(k, j)] == pytest.approx(sum(pad[j:j + 3]) / 3 if len(xs) >= 3 else xs[j])
            part = xs[max(0, j - 2):j + 3]
            assert wide[(k, j)] == pytest.approx(sum(part) / len(part))


def test_resample(spark):
    ae = [0.1, 0.9, 0.4]
    v = spark.createDataFrame([(1, i, x) for i, x in enumerate(ae)], "media_id int, sample_idx int, ae double")
    f = spark.range(7).select(F.lit(1).alias("media_id"), F.col("id").cast("int").alias("frame_idx"))
    got = [r.ae_resampled for r in R.resample(v, f, "ae").orderBy("frame_idx").collect()]
    assert got == pytest.approx(list(np.interp(np.linspace(0, 3, 7), np.arange(3), ae)))


def test_punctuation_groups(spark, tiny_chunks):
    words = [(m, i, rng.choice(["a", "b.", "c,", "d"]), i * 1.0, i + 0.5) for m in (1, 2) for i in range(50)]
    d = spark.createDataFrame(words, "media_id int, word_idx int, word string, start double, end double")
    got = sorted((r.media_id, r.first_idx, r.text) for r in W.punctuation_groups(d, 4).collect())
    want = []
    for m in (1, 2):
        cur = []
        for w in [w for w in words if w[0] == m]:
            cur.append(w)
            if len(cur) >= 4 or w[2][-1] in ".!?,":
                want.append((m, cur[0][1], " ".join(c[2] for c in cur)))
                cur = []
        if cur:
            want.append((m, cur[0][1], " ".join(c[2] for c in cur)))
    assert got == want


def test_overlap_join_gives_each_pair_once(spark):
    a = [(1, i, s, s + rng.random() * 30) for i, s in enumerate(rng.random() * 100 for _ in range(40))]
    b = [(1, i, s, s + rng.random() * 30) for i, s in enumerate(rng.random() * 100 for _ in range(40))]
    l = spark.createDataFrame(a, "m int, i int, s double, e double")
    r = spark.createDataFrame(b, "m int, j int, s2 double, e2 double")
    d = I.overlap_join(l, r, ["m"], (F.col("s"), F.col("e")), (F.col("s2"), F.col("e2")), (F.col("s") <= F.col("e2")) & (F.col("e") >= F.col("s2")), 7.0)
    got = sorted((x.i, x.j) for x in d.collect())
    assert got == sorted((x[1], y[1]) for x in a for y in b if x[2] <= y[3] and x[3] >= y[2])


def test_rows_with_null_keys_stay(spark):
    rows = [(None, 1, 2.0), (None, 2, 3.0), (1, 1, 5.0), (1, None, 7.0)]
    d = spark.createDataFrame(rows, "k int, o int, v double")
    got = O.running_sum(d, ["k"], "o", F.col("v"), "s", chunk=O.dense_chunk("o", 1))
    assert sorted((r.k or 0, r.o or 0, r.s) for r in got.collect()) == [(0, 1, 2.0), (0, 2, 5.0), (1, 0, 7.0), (1, 1, 12.0)]
