"""Words that lie by chunk and points that move once: the same rows as from words in any order, with fewer exchanges."""

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from reelsignals.operators import intervals as I
from reelsignals.operators import ordered as O
from reelsignals.operators import speakers as P
from reelsignals.operators import transcripts as W
from reelsignals.plans import catalog, registry  # noqa: F401
from reelsignals.plans import fixtures as X


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    long = " ".join(f"w{i}" + ".,"[i % 2] * (i % 5 == 4) for i in range(400))
    texts = [(1, long), (2, "one"), (3, " a\tb c \n d. e "), (4, ""), (5, None), (6, "  "), (None, "no id here."), (7, long[:900]), (7, long[:900]), (-8, "x. " * 60)]
    path = tmp_path_factory.mktemp("laid")
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{path}/documents.parquet")
    return str(path)


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def rows(df):
    return Counter(str(r) for r in df.collect())


def exchanges(df, by):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return len(re.findall(rf"\bExchange hashpartitioning\({by}#[^)]*\), ENSURE", plan))


@pytest.mark.parametrize("chunk", [3, 24, 8192])
def test_laid_words_are_the_same_words(spark, sf_dir, monkeypatch, chunk):
    monkeypatch.setattr(O, "CHUNK_ROWS", chunk)
    laid, words = X.laid_doc_words(spark, sf_dir), X.doc_words(spark, sf_dir)
    assert O.is_laid(laid, ["media_id"]) and not O.is_laid(words, ["media_id"])
    assert rows(laid.drop(O.CHUNK).select(*words.columns)) == rows(words) and laid.drop(O.CHUNK).dtypes == words.dtypes
    assert rows(W.punctuation_groups(laid, 5)) == rows(W.punctuation_groups(words, 5))
    clips = spark.createDataFrame(
        [(m, i, a, b) for m in (1, 2, 3, 7, None, -8, 99) for i, (a, b) in enumerate([(0.0, 2.0), (0.3, 1e6), (50.0, 40.0), (61.0, 61.0), (159.0, 180.0)])] + [(1, 0, 0.0, 2.0)],
        "media_id long, clip_idx int, clip_start double, clip_end double")
    got, want = W.retime(laid, clips, "start", "end", width=10.0), W.retime(words, clips, "start", "end", width=10.0)
    assert got.columns == want.columns and rows(got) == rows(want) and want.count() > 500


def test_laid_rows_with_empty_spans(spark):
    left = spark.createDataFrame([(1, 0, 5.0, 4.0), (1, 1, 5.0, 5.0), (1, 2, None, 5.0), (2, 3, 0.0, 9.0), (None, 4, 0.0, 9.0)], "m int, i int, s double, e double").withColumn("at", F.struct("m", F.col("i") % 2))
    right = spark.createDataFrame([(1, 0, 0.0, 9.0), (1, 0, 0.0, 9.0), (1, 1, 9.0, 0.0), (2, 2, 9.0, 9.0), (None, 3, 0.0, 9.0)], "m int, j int, s2 double, e2 double")
    spans = (F.col("s"), F.col("e")), (F.col("s2"), F.col("e2"))
    got = I.overlap_join_laid(left, right, ["m"], "at", *spans, F.lit(True), 1.0)
    assert sorted((r.i, r.j) for r in got.collect()) == [(1, 0), (1, 0), (3, 2)]


def test_segment_slice_does_not_move_words(spark, sf_dir, no_broadcast):
    """Chunk summaries are moved to the words, which were moved before as well."""
    lines = W.punctuation_groups(X.laid_doc_words(spark, sf_dir))
    assert exchanges(lines, "__chunk") < exchanges(W.punctuation_groups(X.doc_words(spark, sf_dir)), "__chunk")
    assert exchanges(registry.QUERIES["j07_segment_slice"](spark, sf_dir).select("slice"), "__chunk") <= 2 * exchanges(lines, "__chunk")


def test_srt_documents_move_words_once(spark, sf_dir, no_broadcast):
    d = registry.QUERIES["s15_srt_documents"](spark, sf_dir)
    assert exchanges(d, "clip_id") == 1
    got = {r.clip_id: r.document for r in d.collect()}
    words = {k: [(w.word, w.start, w.end) for w in X.doc_words(spark, sf_dir).where(F.col("media_id").eqNullSafe(k)).orderBy("word_idx").collect()] for k in (1, 3)}
    for m in X.moments(spark, sf_dir).where("media_id IN (1, 3)").collect():
        held = [w for w, a, b in words[m.media_id] if a <= m.end_time and b >= m.start_time]
        blocks = [x.split("\n") for x in got.get(m.media_id * 10 + m.moment_idx, "").split("\n\n")[:-1]]
        assert [x[0] for x in blocks] == [str(i + 1) for i in range(len(blocks))] and [w for x in blocks for w in x[2].split(" ")] == held


def test_active_speaker_moves_points_once(spark, no_broadcast):
    """The lag is taken once, not a second time to find the frames that segments hold."""
    point, pose = "struct<x:double,y:double>", "struct<nose:{0},left_eye:{0},right_eye:{0}>"
    at = lambda f, has: ((f * 3.0, f * 1.0) if has else None, (f * 2.0, 4.0), (f * 4.0, 5.0) if f % 4 else None)
    pts = [(1, t, f, at(f * t, f % 3), f * t, 7 * f) for t in (1, 2) for f in range(0, 90, 1 + t)] + [(1, 3, 40, at(1, 1), 1, 1), (None, 1, 2, at(1, 1), 1, 1)]
    p = spark.createDataFrame(pts, f"media_id int, track_id int, frame_idx int, pose {pose.format(point)}, cx int, cy int")
    segs = [(1, 0, 0.0, 1.0), (1, 1, 1.0, 2.5), (1, 1, 1.0, 2.5), (1, 2, 50.0, 60.0)]
    s = spark.createDataFrame(segs, "media_id int, seg_idx int, s_start double, s_end double")
    energy = spark.createDataFrame([(1, i, 0.01) for i in range(3)], "media_id int, seg_idx int, mean_rms double")
    d = P.active_speakers(s, p, energy)
    assert exchanges(d, "__chunk") == 2

    def motion(seg, t):
        track = sorted((r for r in pts if r[0] == 1 and r[1] == t), key=lambda r: r[2])
        head = lambda r: r[3][0] or (((r[3][1][0] + r[3][2][0]) // 2, (r[3][1][1] + r[3][2][1]) // 2) if r[3][1] and r[3][2] else None)
        far = lambda a, b: ((a[0] - b[0]) ** 2 + (a[1] - b[1]) ** 2) ** 0.5
        step = [0.0] + [far(head(a), head(b)) if head(a) and head(b) else far(a[4:], b[4:]) for a, b in zip(track, track[1:])]
        held = [(r, x) for r, x in zip(track, step) if int(seg[2] * 30) <= r[2] <= int(seg[3] * 30)]
        n = segs.count(seg)
        return (n * sum(x for _, x in held) - held[0][1]) / (n * len(held) - 1) if n * len(held) >= 2 else None

    for r in d.collect():
        found = {t: round(motion((r.media_id, r.seg_idx, r.s_start, r.s_end), t) * 0.01, 6) for t in (1, 2, 3) if motion((r.media_id, r.seg_idx, r.s_start, r.s_end), t) is not None}
        best = min(found, key=lambda t: (-found[t], t), default=0)
        assert r.speaker_id == best and (not found or r.score == pytest.approx(found[best], abs=2e-6))
