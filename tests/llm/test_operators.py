"""Operators against plain loops over small tables with awkward rows."""

import math
import re
import subprocess
import sys
import time
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from reelsignals.llm import bloom, collision_ann, gru, line_dedup, lm_score, mixing, ngram_join, packing, sentence_spans, shared, texthash, topk, toxicity, url_filter
from reelsignals.llm.components import components
from reelsignals.llm.queries import tokenizer_files

WORD = re.compile(r"[^\x20\x09-\x0D]+")
KIND = "doc_id long, text string, source string, __uid string, copies int, n_lines string, runs int, row int, node string"
EXTRA = ("u", 9, "x", 8, 7, "z")


def prose(n, seed, size=400):
    rng = np.random.default_rng(seed)
    return " ".join(f"w{i}" + "." * (j % 7 == 6) for j, i in enumerate(rng.integers(0, size, n)))


def awkward_texts():
    base = prose(120, 1)
    near = base.replace("w", "W", 3)
    lines = "\n".join(prose(8, 50 + i) for i in range(6))
    return [base, base, near, base + " tail", prose(120, 2), None, "", "  \n ", "one", "one two", "One TWO", lines, lines + "\n\nnew last line", "x\n" + lines, "é ü 中文 text\u00a0here now again ok",
            " ".join(["again"] * 300), prose(60, 3), prose(60, 3) + " more", "y" * 5000, prose(20_000, 4), "Head line here.\nfoot line here.", "Head line here.\nfoot line here.\nrest"]


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    texts = awkward_texts()
    rows = [(i if i not in (4, 9) else None, t, None if i % 5 == 0 else f"s{i % 4}", *EXTRA) for i, t in enumerate(texts)]
    rows += [rows[0], rows[11]]
    path = str(tmp_path_factory.mktemp("docs") / "documents.parquet")
    spark.createDataFrame(rows, KIND).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def none(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("none") / "documents.parquet")
    spark.createDataFrame([], KIND).write.parquet(path)
    return spark.read.parquet(path)


def words(t):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def shingles(t, width):
    w = words(t)
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1)))


def groups_of(texts, width, percent):
    s, root = [shingles(t, width) for t in texts], list(range(len(texts)))
    def find(a):
        while root[a] != a:
            a = root[a]
        return a
    for i in range(len(s)):
        for j in range(i):
            if s[i] and s[j] and 100 * len(s[i] & s[j]) >= percent * len(s[i] | s[j]):
                root[find(i)] = find(j)
    return [find(i) for i in range(len(s))], s


def test_word_hashes_tell_words_apart(spark):
    import pyarrow as pa

    texts = ["a b", None, "", "B a\tc", "c", "ab"]
    h, bounds = texthash.word_hashes(pa.array(texts))
    assert bounds.tolist() == [0, 2, 2, 2, 5, 6, 7]
    flat = [w for t in texts for w in words(t)]
    assert len(set(zip(flat, h.tolist()))) == len(set(flat)) == len(set(h.tolist()))


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 140)] + [(7, 7), (200, 201), (201, 200)]
    got = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {**{i: 0 for i in range(41)}, **{k: 100 for k in range(100, 140)}, 200: 200, 201: 200}


@pytest.mark.parametrize("width,percent", [(4, 85), (2, 80)])
def test_jaccard_components(spark, docs, width, percent):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    group, s = groups_of([t for _, t in rows], width, percent)
    least = {}
    for (d, _), g in zip(rows, group):
        if d is not None:
            least[g] = min(d, least.get(g, d))
    want = Counter((d, len(x), d if not x else least.get(g)) for (d, _), g, x in zip(rows, group, s))
    assert Counter(tuple(r)[:3] for r in ngram_join.jaccard_components(docs, width, percent).collect()) == want


@pytest.mark.parametrize("percent", [80, 85])
def test_linked_sets_share_a_signature(percent):
    scheme, rng = ngram_join.Scheme(percent), np.random.default_rng(percent)
    for n in [*range(1, 40), 60, 130, 500]:
        for _ in range(4):
            a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
            for _ in range(6):
                gone, new = rng.integers(0, n * 0.2 + 2), rng.integers(0, n * 0.2 + 2)
                b = np.unique(np.r_[rng.permutation(a)[: max(0, n - gone)], rng.integers(0, 2**63, new, dtype=np.uint64)])
                both = len(np.intersect1d(a, b))
                if len(b) and 100 * both >= percent * (len(a) + len(b) - both):
                    x, y = scheme.signatures(a), scheme.signatures(b)
                    tags = Counter((np.intersect1d(x, y) & ngram_join.TAG).tolist())
                    assert tags, (len(a), len(b), both)
                    for z in (a, b):
                        need = scheme.needs(z)
                        assert tags[0] or any(tags[t] >= k for t, k in zip(need[::2], need[1::2])), (len(a), len(b), both)


@pytest.mark.parametrize("percent", [80, 85])
def test_linked_sets_share_one_of_the_fewest_ranges(percent):
    scheme, rng = ngram_join.Scheme(percent), np.random.default_rng(percent + 1)
    for n in [*range(scheme.boundary + 1, 40), 60, 130, 500]:
        for _ in range(8):
            a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
            gone, new = rng.integers(0, n * 0.2 + 2), rng.integers(0, n * 0.2 + 2)
            b = np.unique(np.r_[rng.permutation(a)[: max(0, n - gone)], rng.integers(0, 2**63, new, dtype=np.uint64)])
            both = len(np.intersect1d(a, b))
            x, y = scheme.signatures(a, fewest=True), scheme.signatures(b, fewest=True)
            assert len(x) <= len(scheme.signatures(a)) and np.isin(x, scheme.signatures(a)).all()
            if len(b) and 100 * both >= percent * (len(a) + len(b) - both):
                assert len(np.intersect1d(x, y)), (len(a), len(b), both)


def test_entries_of_lists_are_short(spark, docs):
    """An entry is five bytes of the signature and six of the name, and both are read back."""
    scheme = ngram_join.Scheme(85)
    rows = ngram_join.lists(docs.coalesce(1), 4, scheme).toPandas()
    want = set()
    for r in docs.collect():
        s = next(texthash.shingle_sets(pa.array([r["text"]], pa.string()), 4))
        if len(s):
            name = np.array([ngram_join.set_hash(s)], np.int64).view(np.uint64)[0] >> np.uint64(16)
            want |= {(int(x >> np.uint64(58)), int((x << np.uint64(6)) >> np.uint64(30)), int(x & ngram_join.TAG), int(name)) for x in scheme.signatures(s)}
    assert sum(len(x) for c in ("sigs", "tops", "names", "ends") for x in rows[c]) == 11 * len(want)
    got = set()
    for bucket, part in rows.groupby("bucket"):
        sig, name, _ = ngram_join._sorted_list(part)
        got |= {(bucket, int(x >> np.uint64(6)), int(x & ngram_join.TAG), int(n)) for x, n in zip(sig, name)}
    assert got == want


def test_stored_leaves_no_shuffle_files(spark):
    def files():
        found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("|")
        return {f for f in found.split("|") if "/shuffle_" in f}

    before, was = files(), spark.conf.get(shared.CLEANUP, None)
    table = shared.stored(spark.range(3000).repartition(7).groupBy((F.col("id") % 50).alias("k")).count())
    for _ in range(50):
        if not (left := files() - before):
            break
        time.sleep(0.1)
    assert not left and spark.conf.get(shared.CLEANUP, None) == was
    assert table.count() == 50
    shared.forget(table)


def test_jaccard_blocks(spark, tmp_path, monkeypatch):
    """A group larger than a block is compared across blocks."""
    monkeypatch.setattr(ngram_join, "BLOCK", 4)
    base = prose(100, 9).split()
    texts = [" ".join(base[:k] + [f"x{k}"] + base[k + 1 :]) for k in range(30)] + [prose(100, 10 + k) for k in range(10)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "d"))
    group, s = groups_of(texts, 4, 85)
    least = {g: min(i for i, x in enumerate(group) if x == g) for g in group}
    got = {r[0]: r[2] for r in ngram_join.jaccard_components(spark.read.parquet(str(tmp_path / "d"))).collect()}
    assert got == {i: least[g] for i, g in enumerate(group)}


def test_near_duplicates_keep_one(spark, docs, none):
    got = ngram_join.near_duplicates(docs, 5, 80)
    assert got.columns == docs.columns
    rows = docs.collect()
    group, s = groups_of([r["text"] for r in rows], 5, 80)
    want = {}
    for r, g, x in zip(rows, group, s):
        if x:
            want.setdefault(g, []).append(r["doc_id"])
    best = Counter(min((d is None, d or 0) for d in v) for v in want.values()) + Counter((r["doc_id"] is None, r["doc_id"] or 0) for r, x in zip(rows, s) if not x)
    assert Counter((r["doc_id"] is None, r["doc_id"] or 0) for r in got.collect()) == best
    assert ngram_join.near_duplicates(none).count() == 0 and ngram_join.jaccard_components(none).count() == 0


def test_mix_meets_targets(spark, tmp_path):
    rows = [(i, prose(5 + i % 40, i), f"s{i % 3}" if i % 7 else None) for i in range(900)] + [(1000, "a b c", "tiny"), (1001, None, "tiny"), (1002, "", "blank"), (None, "d e", "tiny")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    got = mixing.copies(docs, [1, 2, 3]).collect()
    assert sorted(got) == sorted(mixing.copies(docs, [1, 2, 3]).collect())
    per = {}
    for r in got:
        assert r["size"] == len(words(rows[r["doc_id"]][1])) if r["doc_id"] is not None and r["doc_id"] < 900 else True
        assert 0 <= r["copies"] <= 3
        x = per.setdefault(r["source"], [0, 0, r["target"], 0])
        x[0] += r["size"]
        x[1] += r["copies"] * r["size"]
        x[3] = max(x[3], r["size"])
    total = sum(x[0] for x in per.values())
    assert sum(x[2] for x in per.values()) == pytest.approx(total)
    for size, taken, target, most in per.values():
        assert target <= 3 * size + 1e-6 and abs(taken - target) <= most / 2 + 1e-6
    mixed = mixing.mix(docs, [1, 2, 3])
    assert mixed.columns == docs.columns and mixed.count() == sum(r["copies"] for r in got)


def test_mix_with_importance(spark, tmp_path):
    rows = [(i, "w " * 10, "s", 3.0 if i < 100 else 1.0) for i in range(1000)]
    spark.createDataFrame(rows + [(5000 + i, "w " * 10, "t", 1.0) for i in range(1000)], "doc_id long, text string, source string, q double").write.parquet(str(tmp_path / "d"))
    got = mixing.copies(spark.read.parquet(str(tmp_path / "d")), [1, 3], importance="q").where("source = 's'").collect()
    mean = lambda f: np.mean([r["copies"] for r in got if f(r["doc_id"])])
    assert sum(r["copies"] for r in got) == pytest.approx(500, abs=1)
    assert mean(lambda i: i < 100) > 2 * mean(lambda i: i >= 100)


def test_mix_of_awkward_and_empty_tables(spark, docs, none):
    assert mixing.mix(docs, [1, 2, 3]).columns == docs.columns
    assert mixing.copies(docs, [1, 2, 3]).count() == docs.count()
    assert mixing.mix(none, [1, 2, 3]).count() == 0


def lines_by_hand(rows, min_lines, min_words):
    """rows: (order, text); the idx to delete per order."""
    seen, gone = set(), {}
    for key, t in rows:
        lines = [x for x in (t or "").split("\n") if WORD.search(x)]
        out = set()
        for i in range(len(lines)):
            run = tuple(lines[i : i + min_lines])
            if len(run) == min_lines:
                if run in seen:
                    out.update(range(i, i + min_lines))
                seen.add(run)
            if len(words(lines[i])) >= min_words:
                if lines[i] in seen:
                    out.add(i)
                seen.add(lines[i])
        gone[key] = out
    return gone


@pytest.mark.parametrize("min_lines,min_words", [(2, 50), (4, 30), (1, 1000)])
def test_line_dedup(spark, tmp_path, min_lines, min_words):
    rng = np.random.default_rng(min_lines)
    texts = ["\n".join(["", " ", "a", "b", "c", "long " * 40, "long " * 60][i] for i in rng.choice(7, rng.integers(0, 30), p=[0.05, 0.05, 0.3, 0.3, 0.24, 0.03, 0.03])) for _ in range(60)]
    texts += [None, "", "q\n" * 300 + "end", "q\n" * 300 + "end", "one line only", "one line only"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "d"))
    got = line_dedup.delete_repeats(spark.read.parquet(str(tmp_path / "d")), min_lines, min_words).collect()
    want = lines_by_hand(list(enumerate(texts)), min_lines, min_words)
    assert len(got) == len(texts)
    for r in got:
        out = {i for x in r["runs"] for i in range(x["first"], x["last"] + 1)}
        assert out == want[r["doc_id"]], r["doc_id"]
        assert r["n_removed"] == len(out)
        lines = [x for x in (texts[r["doc_id"]] or "").split("\n") if WORD.search(x)]
        kept = [x for x in (r["kept_text"] or "").split("\n") if WORD.search(x)]
        assert kept == [x for i, x in enumerate(lines) if i not in out]


def test_line_dedup_keeps_two_tables(spark, docs, tmp_path, monkeypatch):
    """The last state and the repeated long lines; the line table and the corpus order go."""
    monkeypatch.setattr(shared, "checkpoint_root", lambda spark: str(tmp_path))
    assert line_dedup.delete_repeats(docs).count() == docs.count()
    assert len(list(tmp_path.glob("llm-*"))) == 2


def test_line_dedup_of_awkward_and_empty_tables(spark, docs, none):
    got = line_dedup.without_repeats(docs)
    assert got.columns == docs.columns
    assert len([1 for r in got.collect() if r["text"] is None]) == 1
    assert line_dedup.without_repeats(none).count() == 0 and line_dedup.delete_repeats(none).count() == 0
    with pytest.raises(ValueError):
        line_dedup.delete_repeats(docs, min_lines=3)


RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def test_url_filter(spark):
    urls = ["https://www.Example.ORG/es/x?utm_source=a&b=1#t", "http://a.example.org/en/12", "http://xexample.org/en/12", "http://a.com/fr/", "http://a.com/de/1/", "a.com/de/1", None, "", "://", "http://a.com",
            "http://bad.net/q/?ref=1", "https://www.bad.net/q", "http://bad.net/q?page=2", "http://ok.net/" + "p" * 10_000, "http://u.net/a://b/c", "http://bad.net/q"]
    rows = [(i, u, "h", 1) for i, u in enumerate(urls)] + [(None, "http://bad.net/q", "h", 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, rule string, key int")
    listed = spark.createDataFrame([("bad.net/q",), ("bad.net/q",), (None,), ("",)], "canonical_url string")
    got = url_filter.judge(pages, listed, blocks=64).collect()
    assert len(got) == len(rows)
    for r in got:
        u = next(x[1] for x in rows if x[0] == r["page_id"])
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", u or "")
        host, path = (m[1].lower(), m[2]) if m else ("", "")
        fits = [x for x in RULES if (host == x[0] or host.endswith("." + x[0])) and path.startswith(x[1])]
        best = max(fits, key=lambda x: len(x[0] + x[1]), default=None)
        bad = host.removeprefix("www.") == "bad.net" and path.rstrip("/") == "/q" and "page" not in (u or "")
        assert (r["host"], r["path"]) == (host, path)
        assert r["rule"] == (best[0] + best[1] if best else None)
        assert r["verdict"] == (best[2] if best else "block" if bad else "allow"), u
    assert url_filter.judge(pages.limit(0), listed.limit(0)).count() == 0


def test_bloom_never_loses_a_key(spark):
    keys = np.random.default_rng(1).integers(-(2**62), 2**62, 5000)
    f = bloom.build(spark.createDataFrame([(int(k),) for k in keys] + [(None,)], "k long"), "k", blocks=256)
    assert f.may_hold(keys.view(np.uint64)).all()
    others = np.random.default_rng(2).integers(-(2**62), 2**62, 5000)
    assert f.may_hold(others.view(np.uint64)).mean() < 0.05


def vectors(spark, tmp_path, seed=3):
    rng = np.random.default_rng(seed)
    v = rng.normal(0, 0.2, (400, 16)).round(2)
    v[50:60] = v[0]
    v[1] = 0
    rows = [(i, [float(x) for x in r], i) for i, r in enumerate(v)]
    rows += [(1000, None, 1), (1050, [], 1), (1001, [float("nan")] * 16, 1), (1002, [float("inf")] * 16, 1), (1003, [None] + [1.0] * 15, 1), (1100, [0.1] * 3, 1), (1101, [0.2] * 3, 1), (None, [0.1] * 16, 1), (2, [0.5] * 16, 1), (50, rows[50][1], 5)]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>, score int").write.parquet(str(tmp_path / "v"))
    return spark.read.parquet(str(tmp_path / "v")), rows


def by_hand(rows, measure):
    good = [(i, np.array(v)) for i, v, _ in rows if i is not None and v and None not in v and np.isfinite(v).all()]
    asked = {}
    for i, v in good:
        if i % 50 == 0:
            asked.setdefault(i, v)
    out = {}
    for q, a in asked.items():
        s = [(-measure(a, v), i) for i, v in good if i != q and len(v) == len(a)]
        out[q] = sorted(x for x in s if not math.isnan(x[0]))[:5]
    return out


def test_exact_top_k(spark, tmp_path):
    table, rows = vectors(spark, tmp_path)
    want = by_hand(rows, lambda a, b: float(np.floor(256 * a) @ np.floor(256 * b)))
    got = {}
    for r in topk.exact_top_k(table).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((-float(r["score"]), r["vec_id"]))
    assert got == {q: v for q, v in want.items() if v}
    assert topk.exact_top_k(table.limit(0)).count() == 0


def test_threshold_search_stops_early_and_stays_exact(monkeypatch):
    monkeypatch.setattr(topk, "FIRST_DEPTH", 2)
    rng = np.random.default_rng(0)
    v = np.floor(rng.normal(0, 40, (500, 3)))
    ids = np.arange(500)
    q, i, s = topk.threshold_search(np.array([-1, -2]), v[:2], ids, v, 5)
    for n, row in ((-1, v[0]), (-2, v[1])):
        assert i[q == n].tolist() == np.lexsort((ids, -(v @ row)))[:5].tolist()


def test_collision_search(spark, tmp_path):
    table, rows = vectors(spark, tmp_path)
    def cosine(a, b):
        n = np.linalg.norm(a) * np.linalg.norm(b)
        return float(a @ b / n) if n else float("nan")
    want = {q: v for q, v in by_hand(rows, cosine).items() if v}
    got = {}
    for r in collision_ann.approximate_neighbours(table).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((-r["score"], r["vec_id"]))
    assert set(got) == set(want)
    hit = sum(len({i for _, i in got[q]} & {i for _, i in want[q]}) for q in want)
    assert hit >= 0.9 * sum(map(len, want.values()))
    assert all(len(got[q]) == len(want[q]) for q in want)
    exact = {(i, q): s for q in want for s, i in want[q]}
    assert all(abs(s - exact[(i, q)]) < 1e-12 for q in got for s, i in got[q] if (i, q) in exact)


def test_recall_on_the_given_vectors(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    pdf = table.toPandas()
    v = np.stack(pdf["embedding"]).astype(float)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    ids, hit, all_ = pdf["vec_id"].to_numpy(), 0, 0
    got = {}
    for r in collision_ann.approximate_neighbours(table).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    for k in np.flatnonzero(ids % 50 == 0):
        s = v @ v[k]
        s[k] = -2
        hit += len(got[ids[k]] & set(ids[np.argsort(-s)[:5]]))
        all_ += 5
    assert hit >= 0.9 * all_


def test_fast_ids_equal_the_tokenizers():
    files = tokenizer_files()
    both = packing.Ids(**files)
    slow = packing.Ids(files["file"])
    texts = [t or "" for t in awkward_texts()] + ["a<|endoftext|>b", " \u3000\n\n  x\t\ty  ", "z" * 3000, "\n" * 3000, "x " * 2000, "don't I'll 12345 ½ ² ① Ⅷ ࠀ 𐍈 👩‍👩‍👧 ﬁ İ ǅ", "\x00\x1f\x85\u2028"]
    assert all(np.array_equal(both(t), slow(t)) for t in texts)


def test_pack_is_a_partition_into_windows(spark, docs, none):
    files = tokenizer_files()
    ids_of = packing.Ids(files["file"])
    got = packing.pack(docs, **files).collect()
    load = Counter()
    for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == load[r["sequence_id"]]
        load[r["sequence_id"]] += r["length"]
    assert max(load.values()) <= 2048
    want = Counter()
    for r in docs.collect():
        ids = np.append(ids_of(r["text"] or ""), 1).astype("<u4")
        at = 0
        while at < len(ids):
            n = 2048 if len(ids) - at >= 2048 else min(512, len(ids) - at)
            want[(r["doc_id"], at, n, zlib.crc32(ids[at : at + n].tobytes()), len(ids))] += 1
            at += n
    assert Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in got) == want
    assert packing.pack(none, **files).count() == 0


def test_windows_are_near_equal():
    sizes = np.random.default_rng(0).integers(1, 513, 1500)
    load = np.bincount(packing.windows(sizes, 2048), sizes)
    assert load.max() <= 2048 and load.min() > 1900 and len(load) <= sizes.sum() / 2048 * 1.02 + 1
    assert packing.windows(np.array([2000, 2000, 60]), 2048).max() == 2


def test_gradients():
    rng = np.random.default_rng(0)
    freq = rng.random(64)
    p = {k: x.astype(np.float64) + 0.1 * rng.standard_normal(x.shape) for k, x in gru.new_params(freq / freq.sum()).items()}
    ids, before = rng.integers(0, 64, (5, 3)), rng.integers(0, 64, (5, 3))
    before[2, 1] = gru.END
    h = rng.standard_normal((3, gru.HIDDEN))
    g = gru.window_gradients(p, ids, before, h)[0]
    for k in gru.NAMES:
        at = tuple(rng.integers(0, n) for n in p[k].shape)
        if k == "embed":
            at = (before[1, 0], 3)
        old, loss = p[k][at], []
        for e in (1e-4, -1e-4):
            p[k][at] = old + e
            loss.append(gru.window_gradients(p, ids, before, h)[2])
        p[k][at] = old
        assert g[k][at] == pytest.approx((loss[0] - loss[1]) / 2e-4, rel=2e-2, abs=2e-5)


@pytest.mark.parametrize("scale", [0.0, 1.0, 300.0])
def test_output_without_overflow(scale):
    """Also where exp() of the plain numbers would overflow or vanish."""
    rng = np.random.default_rng(4)
    p = gru.new_params(np.full(96, 1 / 96))
    p = p | {k: (p[k] + scale * rng.standard_normal(p[k].shape)).astype(np.float32) for k in ("wc", "bc", "ww", "bw")}
    x, ids = rng.uniform(-1, 1, (50, gru.HIDDEN)).astype(np.float32), rng.integers(0, 96, 50)
    f = {k: v.astype(np.float64) for k, v in p.items()}
    parts = [(x @ f["wc"] + f["bc"], ids // gru.WIDTH), (np.stack([a @ f["ww"][c] + f["bw"][c] for a, c in zip(x, ids // gru.WIDTH)]), ids % gru.WIDTH)]
    want = sum(z[np.arange(50), i] - np.logaddexp.reduce(z, 1) for z, i in parts)
    assert gru.output(p, x, ids) == pytest.approx(want, rel=1e-4, abs=1e-3)
    grads = {k: np.zeros_like(v) for k, v in p.items()}
    assert np.isfinite(gru.output(p, x, ids, grads)[1]).all() and all(np.isfinite(g).all() for g in grads.values())


def test_a_task_keeps_its_memory_while_the_network_learns():
    """Arrays of a window are mapped once, not for each window."""
    code = """if True:
        import resource, sys
        import numpy as np
        from reelsignals.llm import gru, shared
        assert shared.keep_memory()
        trainer, ids = gru.Trainer(gru.new_params(np.full(1024, 1 / 1024))), np.random.default_rng(1).integers(0, 1024, 1 << 16)
        trainer.feed(ids)
        before = resource.getrusage(resource.RUSAGE_SELF).ru_minflt
        trainer.feed(ids)
        print(resource.getrusage(resource.RUSAGE_SELF).ru_minflt - before)"""
    out = subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).parents[2], capture_output=True, text=True, check=True, timeout=120)
    assert int(out.stdout) < 5000


def test_state_is_carried_over_windows(monkeypatch):
    rng = np.random.default_rng(1)
    p = {k: x + 0.2 * rng.standard_normal(x.shape).astype(np.float32) for k, x in gru.new_params(np.full(64, 1 / 64)).items()}
    sizes = [1, 300, 5, 64, 129]
    ids = np.concatenate([np.r_[rng.integers(1, 64, n - 1), gru.END] for n in sizes])
    bounds = np.r_[0, np.cumsum(sizes)]
    whole = gru.score(p, ids, bounds)
    monkeypatch.setattr(gru, "STEPS", 7)
    monkeypatch.setattr(gru, "LANES", 2)
    assert gru.score(p, ids, bounds) == pytest.approx(whole, rel=1e-4)
    one = []
    for a, b in zip(bounds, bounds[1:]):
        h, last, total = np.zeros((1, gru.HIDDEN), np.float32), gru.END, 0
        for w in ids[a:b]:
            h = gru.step(p["embed"][[last]] @ p["wx"] + p["b"], h * (last != gru.END), p["wh"])[0]
            total += gru.output(p, h, np.array([w]))[0]
            last = w
        one.append(total)
    assert whole == pytest.approx(one, rel=1e-4)


@pytest.mark.parametrize("common", [1 << 19, 40])
def test_base_scores(spark, docs, none, monkeypatch, common):
    monkeypatch.setattr(lm_score, "COMMON", common)
    rows = docs.collect()
    held = lambda d: d is None or zlib.crc32(str(d).encode()) % 7 == 2
    counts = Counter(w for r in rows if not held(r["doc_id"]) for w in [*words(r["text"]), "\n"])
    n, v = sum(counts.values()), len(counts)
    want = Counter()
    for r in rows:
        t = [*words(r["text"]), "\n"]
        want[(r["doc_id"], held(r["doc_id"]), len(t), sum(counts[w] > 0 for w in t), n, round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in t), 5))] += 1
    got = lm_score.score_documents(docs).collect()
    assert Counter((r[0], r[1], r[2], r[3], r[4], round(r[5], 5)) for r in got) == want
    assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in got)
    assert lm_score.score_documents(none).count() == 0


def test_each_text_is_read_three_times(spark, docs, monkeypatch):
    """To count, to learn and to score; the words that are not broadcast leave with the scores."""
    monkeypatch.setattr(lm_score, "COMMON", 3)
    passes = []
    kept = lm_score.stored
    monkeypatch.setattr(lm_score, "stored", lambda df: passes.append(df) or kept(df))
    out = lm_score.score_documents(docs)
    assert len(passes) == 2 and "text" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert passes[1].where("range is not null").count() > 0


def test_model_learns_from_every_training_document(spark, docs, monkeypatch):
    given = []
    monkeypatch.setattr(lm_score, "learn", lambda texts, known: given.extend(r["text"] for r in texts.collect()) or known.params)
    lm_score.score_documents(docs)
    held = lambda d: d is None or zlib.crc32(str(d).encode()) % 7 == 2
    assert Counter(given) == Counter(r["text"] for r in docs.collect() if not held(r["doc_id"]))


def test_model_beats_counts_on_held_out(spark):
    d = lm_score.score_documents(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).where("held_out").toPandas()
    assert d["score"].sum() > d["base_score"].sum()


def spans_by_hand(rows, width):
    seen, out = set(), {}
    for key, t in rows:
        sentences, own = [], []
        for line in re.split(r"\n", t or ""):
            for w in words(line):
                own.append(w)
                if w[-1] in ".!?":
                    sentences.append(own)
                    own = []
            if own:
                sentences.append(own)
                own = []
        cut = [tuple(s[i : i + 20]) for s in sentences for i in range(0, len(s), 20)]
        gone = set()
        for i in range(len(cut) - width + 1):
            k = tuple(cut[i : i + width])
            if k in seen:
                gone.update(range(i, i + width))
            seen.add(k)
        out[key] = (len(cut), sorted(gone))
    return out


def test_sentence_spans(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sentence_spans, "FLUSH", 50)
    part = " ".join(f"shared {i} words of a sentence {i}." for i in range(8))
    texts = [t for t in awkward_texts()] + [prose(40, 80 + i) + "\n" + part + "\n" + prose(30, 90 + i) for i in range(12)] + ["Same. Same. Same. Same. Same. Same."]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4).write.parquet(str(tmp_path / "d"))
    got = sentence_spans.remove_repeats(spark.read.parquet(str(tmp_path / "d"))).collect()
    want = spans_by_hand(list(enumerate(texts)), 3)
    for r in got:
        assert (r["n_sentences"], r["removed"]) == want[r["doc_id"]], r["doc_id"]
        assert (r["kept_text"] is None) == (texts[r["doc_id"]] is None)
        if not r["removed"]:
            assert r["kept_text"] == texts[r["doc_id"]]
    assert sum("shared 4 words" in (r["kept_text"] or "") for r in got) == 1


@pytest.mark.parametrize("passage", [" ".join(f"p{i}" for i in np.random.default_rng(7).integers(0, 400, 400)), "ha ho hu he hi " * 80, "a b c d e f g h i j " * 40, "go on now " * 60], ids=["varied", "of five", "of ten", "of three"])
def test_sentence_spans_without_stops(spark, tmp_path, passage):
    """Copies of a passage without stops behind heads of every length lose it, but for its edges."""
    texts = [" ".join([f"h{i}x{j}" for j in range(i)] + passage.split() + [f"t{i}x{j}" for j in range(i % 7)]) for i in range(20)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "d"))
    got = sentence_spans.remove_repeats(spark.read.parquet(str(tmp_path / "d"))).collect()
    own = set(passage.split())
    for r in got:
        left = words(r["kept_text"])
        assert [w for w in left if w not in own] == [w for w in words(texts[r["doc_id"]]) if w not in own]
        assert r["doc_id"] == 0 or sum(w in own for w in left) <= 80


def test_cuts_of_long_sentences_are_short_and_whole():
    rng = np.random.default_rng(11)
    for sizes in ([1, 20, 21, 500, 3], [20, 20], [400], []):
        ends = np.cumsum(np.array(sizes, np.int64))
        starts = ends - np.array(sizes, np.int64)
        for hashes in (rng.integers(0, 2**63, sum(sizes)).astype(np.uint64), np.ones(sum(sizes), np.uint64)):
            a, b = sentence_spans.cut_long(hashes, starts, ends)
            assert a.tolist() == [0, *b.tolist()[:-1]][: len(a)] and set(ends.tolist()) <= set(b.tolist())
            assert all(0 < n <= 20 for n in (b - a).tolist())


def test_sentence_spans_of_awkward_and_empty_tables(spark, docs, none):
    assert sentence_spans.remove_repeats(docs).count() == docs.count()
    assert sentence_spans.remove_repeats(none).count() == 0


def test_toxicity(spark, docs, none):
    base = "/root/testdata/sf0.1"
    all_docs, labels = spark.read.parquet(f"{base}/documents.parquet"), spark.read.parquet(f"{base}/labels.parquet")
    model = toxicity.train(all_docs, labels)
    d = toxicity.scored(all_docs, model).join(labels, "doc_id").where("held_out").toPandas()
    hit, ok = (d["predicted"][d["toxic"] == 1]).mean(), 1 - d["predicted"][d["toxic"] == 0].mean()
    assert hit > 0.9 and ok > 0.99
    got = toxicity.scored(docs, model).collect()
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 for r in got)
    assert toxicity.without_toxic(docs, model).columns == docs.columns
    assert toxicity.scored(none, toxicity.train(none, labels)).count() == 0
    assert toxicity.scored(docs, toxicity.train(docs, labels.limit(0))).where("predicted = 1").count() == 0


@pytest.mark.parametrize("between", ["", "_", "\u00a0"])
def test_toxic_end_of_a_text_without_blanks(spark, tmp_path, between):
    rng = np.random.default_rng(3)
    letters = [chr(0x4E00 + i) for i in range(300)]
    texts = [between.join([*rng.choice(letters, 600), *("滾開你這壞東西" if i % 2 else "謝謝你好朋友們")]) for i in range(120)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "d"))
    docs, labels = spark.read.parquet(str(tmp_path / "d")), spark.createDataFrame([(i, i % 2) for i in range(120)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    held = [r for r in toxicity.scored(docs, model).collect() if r["held_out"]]
    assert len(held) > 10 and all(r["predicted"] == r["doc_id"] % 2 for r in held)
    assert sorted(r["doc_id"] for r in toxicity.without_toxic(docs, model).collect()) == list(range(0, 120, 2))


def test_a_repeated_id_is_one_row_of_the_sample(spark):
    rows = [(i, f"text {i}") for i in range(40)] + [(1, "text 1")] * 300 + [(2, f"other {i}") for i in range(300)] + [(3, None)] * 5
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    got = toxicity.labelled_sample(spark.createDataFrame(rows, "doc_id long, text string"), labels, 5, 5, 0).collect()
    assert Counter(r["toxic"] for r in got) == {0: 5, 1: 5}
    got = toxicity.labelled_sample(spark.createDataFrame(rows, "doc_id long, text string"), labels, 100, 5, 0).collect()
    assert len(got) == sum(zlib.crc32(str(i).encode()) % 5 != 0 for i in range(40))


def test_the_driver_gives_the_sample_s_memory_back(spark, docs, monkeypatch):
    freed = []
    monkeypatch.setattr(toxicity, "release", lambda: freed.append(1))
    labels = spark.createDataFrame([(i, i % 2) for i in range(22)], "doc_id long, toxic int")
    toxicity.train(docs, labels)
    assert freed == [1]


def test_counterfactual_penalty_frees_group_names():
    """Toxic rows mention a group, clean ones do not: with the penalty the name alone does not condemn."""
    name, other, slur, plain = 0, 1, 2, 3
    rows = [(1, [name, slur], [other, slur])] * 30 + [(1, [name], [other])] * 5 + [(0, [plain], None)] * 40
    free, bound = toxicity.fit(rows, 4, 0.0, 1e-3), toxicity.fit(rows, 4, 50.0, 1e-3)
    score = lambda m, x: 1 / (1 + math.exp(-(m[0][x].sum() + m[1])))
    gap = lambda m: abs(score(m, [name, plain]) - score(m, [other, plain]))
    assert gap(bound) < 0.2 * gap(free)
    assert score(bound, [name, slur]) > 0.5
