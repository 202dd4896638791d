"""Reply trees, whitening and phrase collocations against plain loops over small tables with awkward rows."""

import hashlib
import math
import re
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from hypothesis import given
from hypothesis import strategies as st

from reelsignals.llm import chat_template, collocations, reply_trees, whitening

EXTRA_KIND = "__uid string, node_id int, rank string, n int, start string, c int, x string, at int"
EXTRA = ("u", 1, "r", 2, "s", 3, "x", 4)


def table(spark, tmp_path_factory, rows, kind, parts=3):
    path = str(tmp_path_factory.mktemp("t") / "t.parquet")
    spark.createDataFrame(rows, kind).repartition(parts).write.parquet(path)
    return spark.read.parquet(path)


@given(st.text(alphabet="<>[]/\\sINTOUXRYE ]é\n") | st.lists(st.sampled_from(["<s>", "</s>", "[INST]", "[/INST]", "[OUT]", "[TEXT]", "[/TURN]", "\\", "<", "[", "a"])).map("".join))
def test_escape_is_reversible_and_leaves_no_control_string(text):
    safe = chat_template.escape(text)
    assert chat_template.unescape(safe) == text
    assert not re.search(r"[<\[]" + chat_template.NAMES, safe)


@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "tool", "", "[TEXT]"]), st.sampled_from(["", "<", "[", "</s>", "[INST] a [/INST]", "[TURN]", "x\\"]))))
def test_turns_are_read_back(turns):
    text = chat_template.BEGIN + "".join(chat_template.render(r, t)[0] for r, t in turns)
    assert chat_template.parse(text) == turns


def plain_paths(rows, best):
    """rows: (tree, node, parent, score)."""
    parent = {n: p for _, n, p, _ in rows}
    score = {n: s or 0 for _, n, _, s in rows}
    inner = {p for p in parent.values() if p in parent}
    found = {}
    for tree, node, _, _ in rows:
        if node in inner:
            continue
        path, at = [], node
        while at is not None and at in parent and at not in path:
            path.append(at)
            at = parent[at]
        if at is None or at not in parent:
            found.setdefault(tree, []).append((-sum(score[x] for x in path), -len(path), node, path[::-1]))
    return {(tree, i + 1): p[3] for tree, ps in found.items() for i, p in enumerate(sorted(ps, key=lambda x: x[:3])[:best])}


def random_forest(seed, n=300):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        tree = None if i < 12 else int(rng.integers(0, 6)) if i % 3 else 0  # one tree holds a third
        mine = [r[1] for r in rows if r[0] == tree]
        parent = None if not mine or rng.random() < 0.05 else int(mine[-1] if rng.random() < 0.6 else rng.choice(mine))
        rows.append((tree, 1000 - i, parent, None if i % 17 == 0 else float(rng.integers(0, 4))))
    rows += [(7, 2001, 2002, 1.0), (7, 2002, 2003, 1.0), (7, 2003, 2001, 1.0), (7, 2004, 2001, 1.0)]  # a circle and a leaf on it
    rows += [(8, 3001, 9999, 1.0), (8, 3002, 3001, 2.0)]  # the parent is missing
    return rows


@pytest.mark.parametrize("seed,best", [(1, 1), (2, 3)])
def test_best_paths_equal_plain_walks(spark, tmp_path_factory, seed, best):
    rows = random_forest(seed)
    df = table(spark, tmp_path_factory, [(*r, "x", 1) for r in rows], "tree long, node long, parent long, score double, path string, pos int")
    got = {}
    for r in reply_trees.best_paths(df, best).collect():
        got.setdefault((r["tree"], r["rank"]), []).append((r["pos"], r["node"]))
    assert {k: [n for _, n in sorted(v)] for k, v in got.items()} == plain_paths(rows, best)


def test_formatted_paths_in_segments(spark, tmp_path_factory):
    rows = random_forest(3, 120)
    text = {r[1]: None if r[1] % 11 == 0 else "" if r[1] % 7 == 0 else f"[OUT] {r[1]} </s>" * (r[1] % 5) for r in rows}
    role = {r[1]: (None, "user", "assistant", "system", "to\nol")[r[1] % 5] for r in rows}
    kind = "tree long, node long, parent long, score double, role string, text string, segment int, loss string"
    df = table(spark, tmp_path_factory, [(*r, role[r[1]], text[r[1]], 1, "l") for r in rows], kind)
    want = plain_paths(rows, 2)
    for segment in (1, 60, 1 << 20):
        out = reply_trees.formatted(df, 2, segment).collect()
        joined = {}
        for r in out:
            own = joined.setdefault((r["tree"], r["rank"]), [[], []])
            assert r["segment"] == len(own[0])
            own[0].append(r["text"])
            own[1] += [chat_template.unescape(r["text"][s["start"] : s["end"]]) for s in r["loss"]]
        assert set(joined) == set(want)
        for key, nodes in want.items():
            assert chat_template.parse("".join(joined[key][0])) == [(role[n] or "", text[n] or "") for n in nodes]
            assert joined[key][1] == [text[n] or "" for n in nodes if role[n] == "assistant"]


def test_linear_threads_and_read_back(spark, tmp_path_factory, monkeypatch):
    monkeypatch.setattr(reply_trees, "CHUNK_TURNS", 4)
    rows = [(i % 4 if i % 9 else None, (i // 4) if i % 13 else None, ("user", "assistant", None)[i % 3], None if i % 5 == 0 else f"</s>é{i}" * (i % 4)) for i in range(80)]
    rows += rows[:3] + [(5, 0, "assistant", "long " * 50_000)]
    df = table(spark, tmp_path_factory, [(*r, *EXTRA) for r in rows], "conv_id long, turn long, role string, text string, " + EXTRA_KIND)
    got = {r["tree"]: r for r in reply_trees.read_back(reply_trees.formatted(reply_trees.threads(df))).collect()}
    want = {}
    for r in sorted(rows, key=lambda r: (r[1] is None, r[1] or 0, r[2] or "", hashlib.md5((r[3] or "").encode()).hexdigest())):
        want.setdefault(r[0], []).append((r[2] or "", r[3] or ""))
    assert set(got) == set(want)
    for conv, turns in want.items():
        told = "".join(t for r, t in turns if r == "assistant")
        formatted = chat_template.BEGIN + "".join(chat_template.render(*t)[0] for t in turns)
        assert got[conv]["n_turns"] == len(turns)
        assert got[conv]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert (got[conv]["loss_chars"], got[conv]["loss_sha256"]) == (len(told), hashlib.sha256(told.encode()).hexdigest())
        assert got[conv]["formatted_chars"] == len(formatted)


def test_no_messages(spark, tmp_path_factory):
    df = table(spark, tmp_path_factory, [], "conv_id long, turn long, role string, text string")
    assert reply_trees.read_back(reply_trees.formatted(reply_trees.threads(df))).count() == 0


def plain_whitening(vectors):
    x = [[math.floor(1024 * float(c)) + 100_000 for c in v] for v in vectors]
    n, sums = len(x), [sum(c) for c in zip(*x)]
    centred = np.array([[n * a - s for a, s in zip(r, sums)] for r in x], float) / n
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    return n, [sum((n * a - s) ** 2 for a, s in zip(r, sums)) for r in x], centred @ axes[:, ::-1], values[::-1]


@pytest.mark.parametrize("dim,rows,size", [(12, 700, 1.0), (3, 40, 1.0), (5, 60, 3e8)])
def test_whitening_equals_numpy(spark, tmp_path_factory, monkeypatch, dim, rows, size):
    monkeypatch.setattr(whitening, "ROWS", 64)
    monkeypatch.setattr(whitening, "BLOCKS", 2)
    rng = np.random.default_rng(dim)
    vectors = [(size * rng.normal(0, 1 + np.arange(dim))).tolist() for _ in range(rows)]
    data = [(None if i % 50 == 9 else i, v, *EXTRA) for i, v in enumerate(vectors)] + [(3, vectors[3], *EXTRA)]
    vectors = vectors + [vectors[3]]
    bad = [None, [], [None] + [1.0] * (dim - 1), [float("nan")] * dim, [float("inf")] + [0.0] * (dim - 1), [1.0] * (dim + 1)]
    df = table(spark, tmp_path_factory, data + [(9000 + i, v, *EXTRA) for i, v in enumerate(bad)], "vec_id long, embedding array<double>, " + EXTRA_KIND)
    out = whitening.whiten(df).collect()
    n, deviation, z, values = plain_whitening(vectors)
    k = min(8, dim)
    assert len(out) == n * k and {r["n"] for r in out} == {n}
    by_id = {d[0]: i for i, d in enumerate(data) if d[0] is not None}
    for r in out:
        if r["vec_id"] is not None:
            i, c = by_id[r["vec_id"]], r["component"] - 1
            assert r["deviation"] == (deviation[i] if deviation[i] < 2**63 else None)
            assert abs(r["whitened"]) == pytest.approx(abs(z[i, c]) / math.sqrt(values[c]), rel=1e-6, abs=1e-6)
            assert r["explained"] == pytest.approx(values[c] / values.sum(), rel=1e-9)
            assert r["identity_error"] < 1e-9
    for c in range(k):  # one sign for all rows
        pairs = [(r["whitened"], z[by_id[r["vec_id"]], c]) for r in out if r["component"] == c + 1 and r["vec_id"] is not None]
        assert len({np.sign(a * b) for a, b in pairs if abs(b) > 1e-9}) == 1


def test_whitening_without_variance_or_rows(spark, tmp_path_factory):
    same = whitening.whiten(table(spark, tmp_path_factory, [(i, [1.0, 2.0]) for i in range(5)], "vec_id long, embedding array<float>")).collect()
    assert len(same) == 10 and all(r["whitened"] is None and r["explained"] is None and r["deviation"] == 0 for r in same)
    few = whitening.whiten(table(spark, tmp_path_factory, [(0, [1.0, 0.0, 0.0]), (1, [0.0, 2.0, 1.0])], "vec_id long, embedding array<float>")).collect()
    assert [r["component"] for r in few if r["whitened"] is not None] == [1, 1] and few[0]["identity_error"] < 1e-9
    assert whitening.whiten(table(spark, tmp_path_factory, [(1, None)], "vec_id long, embedding array<float>")).count() == 0


def plain_phrases(rows, least, top, covered):
    n, f = Counter(), Counter()
    for lang, text in rows:
        lang = lang or "und"
        for piece in re.split("[.,;:!?\x0a-\x0d]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            words = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, 5):
                for i in range(len(words) - k + 1):
                    f[lang, tuple(words[i : i + k])] += 1
    out = {}
    cand = {p: a for p, a in f.items() if a >= least and len(p[1]) > 1}
    for (lang, p), a in cand.items():
        if any(q[0] == lang and len(q[1]) > len(p) and 100 * b >= covered * a and any(q[1][i : i + len(p)] == p for i in range(len(q[1]) - len(p) + 1)) for q, b in cand.items()):
            continue
        score, _, left, right = min((2_000_000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
        out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), left, right))
    return sorted((lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for lang, rows in out.items() for i, (s, a, p, left, right) in enumerate(sorted(rows)[:top]))


@pytest.mark.parametrize("shards,tokens,longest_list", [(1, 1 << 19, 2000), (3, 200, 2000), (4, 60, 5)])
def test_collocations_equal_plain_counts(spark, tmp_path_factory, monkeypatch, shards, tokens, longest_list):
    monkeypatch.setattr(collocations, "SLICE", 50)
    rng = np.random.default_rng(5)
    vocabulary = ["Ab", "b", "é x", "d", "E", "f\x01", "\x0bg", "h", "中文", "😀", "i-j", "k"]
    rows = []
    for i in range(160):
        words = [vocabulary[int(j)] for j in np.minimum(rng.geometric(0.25, 30) - 1, 11)]
        text = "".join(w + str(rng.choice([" ", "  ", "\t", ". ", ",", "\n", " ; "], p=[0.7, 0.1, 0.05, 0.05, 0.04, 0.03, 0.03])) for w in words)
        rows.append((None if i % 3 == 0 else ("en", "de")[i % 2], None if i % 40 == 7 else "" if i % 40 == 8 else text))
    rows += [rows[1]] * 9 + [("fr", "y" * 3000), ("fr", "one two three four five " * 2000), ("fr", " \n. ")]
    df = table(spark, tmp_path_factory, [(*r, *EXTRA) for r in rows], "lang string, text string, " + EXTRA_KIND)
    got = collocations.collocations(df, least=12, top=longest_list, covered=80, shards=shards, block_tokens=tokens)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == plain_phrases(rows, 12, longest_list, 80)


def test_windows_of_a_long_block_count_the_same():
    words = [["a", "b", "c"][i % 3] if i % 7 else None for i in range(500)]
    block = collocations._Block()
    block.add("en", " ".join("." if w is None else w for w in words))
    row = block.row(0)
    hashes, ids = np.frombuffer(row["hashes"], np.uint64), np.frombuffer(row["ids"], np.int32)
    bloom = collocations.BlockedBloom(64)
    two = collocations.lengthened(np.repeat(hashes, 3), np.tile(hashes, 3))
    for keys in (hashes, two, collocations.lengthened(np.repeat(two, 3), np.tile(hashes, 9))):
        bloom.add(keys)
    known = collocations.Known([(1, bloom)])

    def counted(window):
        total = Counter()
        for _, _, _, columns, counts in collocations.count_block(ids, hashes, known, 4, False, window):
            for i, c in enumerate(counts):
                total[tuple(int(col[i]) for col in columns)] += int(c)
        return total

    want = Counter()
    for k in range(1, 5):
        for i in range(len(ids) - k + 1):
            if (ids[i : i + k] >= 0).all():
                want[tuple(int(x) for x in ids[i : i + k])] += 1
    assert counted(1 << 20) == want and counted(7) == want


def test_no_documents(spark, tmp_path_factory):
    assert collocations.collocations(table(spark, tmp_path_factory, [], "lang string, text string")).count() == 0


def test_a_false_hit_does_not_start_a_cycle_before_the_subphrases_are_known():
    block = collocations._Block()
    block.add("en", "a b c d")
    row = block.row(0)
    hashes, ids = np.frombuffer(row["hashes"], np.uint64), np.frombuffer(row["ids"], np.int32)
    a, b, c, d = hashes[:, None]
    grow = collocations.lengthened
    early, late = collocations.BlockedBloom(64), collocations.BlockedBloom(64)
    early.add(np.concatenate([hashes, grow(grow(a, b), c), grow(grow(b, c), d)]))  # the last two by chance
    late.add(np.concatenate([grow(a, b), grow(b, c), grow(c, d)]))
    found = list(collocations.count_block(ids, hashes, collocations.Known([(1, early), (3, late)]), 4, False))
    assert [len(columns) for _, _, _, columns, _ in found] == [1, 2, 3, 4]
    assert found[1][1].tolist() == [1, 1, 1] and found[2][1].tolist() == [3, 3] and found[3][1].tolist() == [3]
    # steps 1 and 2 cannot meet the phrase of four, so its cycle must not begin there
    assert len(list(collocations.count_block(ids, hashes, collocations.Known([(1, early)]), 4, False))) == 2


def test_a_block_numbers_words_by_lang_over_slices(monkeypatch):
    monkeypatch.setattr(collocations, "SLICE", 3)
    block = collocations._Block()
    for lang, text in (("en", "A b  a."), ("de", "a \t"), ("en", "b,é"), ("de", " \n")):
        block.add(lang, text)
    row = collocations._Block.batch(block, 2).to_pylist()[0]
    assert (row["shard"], row["langs"], row["sizes"], row["words"]) == (2, ["en", "de"], [5, 1], ["a", "b", "é", "a"])
    assert np.frombuffer(row["ids"], np.int32).tolist() == [0, 1, 0, -1, -1, 1, -1, 2, -1, 3, -1, -1, -1]
    assert np.frombuffer(row["owner"], np.int32).tolist() == [0, 0, 0, 1]


@pytest.mark.parametrize("most", [1, 5, 1 << 19])
def test_counts_of_a_task_are_added_before_they_leave_it(monkeypatch, most):
    monkeypatch.setattr(collocations, "HELD_ROWS", most)
    part = pa.RecordBatch.from_pydict({"lang": ["en", "de"], "phrase": ["a b", "a b"], "len": pa.array([2, 2], pa.int32()), "c": [3, 4]})
    out = list(collocations.summed(iter([part, part.slice(0, 0), part])))
    total = Counter()
    for row in pa.Table.from_batches(out).to_pylist():
        total[row["lang"], row["phrase"], row["len"]] += row["c"]
    assert total == {("en", "a b", 2): 6, ("de", "a b", 2): 8} and sum(b.num_rows for b in out) == (4 if most == 1 else 2)
    assert not list(collocations.summed(iter([])))


def test_a_block_of_piece_ends_only():
    bloom = collocations.BlockedBloom(64)
    nothing = np.zeros(0, np.uint64)
    assert len(list(collocations.count_block(np.array([-1, -1], np.int32), nothing, collocations.Known([(1, bloom)]), 4, False))) == 1


def test_keys_are_read_back():
    rng = np.random.default_rng(3)
    prefix, word = (rng.integers(0, 2**64, 1000, np.uint64) for _ in range(2))
    assert (collocations.unmix(collocations.mix(prefix)) == prefix).all()
    assert (collocations.shortened(collocations.lengthened(prefix, word), word) == prefix).all()


def packed(entries, since=None):
    """entries: (key, count, tag, last)."""
    keys, counts, tags, last = zip(*entries)
    return [0, np.array(keys, np.uint64).tobytes(), np.array(counts, np.int64).tobytes(), np.array(tags, np.int16).tobytes(), np.array(last, np.uint64).tobytes(), since]


def test_a_key_of_two_phrases_has_no_length():
    merge = collocations.merge_ranges(1, 4, 3, 4)
    kind = ["p", "keys", "counts", "tags", "last", "since"]
    parts = [packed([(5, 2, 10, 7), (6, 2, 10, 7), (7, 3, 9, 0), (8, 1, 10, 7)]), packed([(5, 2, 10, 7), (6, 2, 10, 9), (7, 3, 10, 0), (8, 1, 10, 9)])]
    out = merge(pd.DataFrame(parts, columns=kind)).iloc[0]
    got = lambda: [np.frombuffer(out[c], t).tolist() for c, t in (("keys", np.uint64), ("counts", np.int64), ("tags", np.int16), ("last", np.uint64))]
    assert got()[:3] == [[5, 6, 7, 8], [4, 4, 6, 2], [10, 8, 8, 8]] and got()[3][0] == 7
    again = pd.DataFrame([[0, *(out[c] for c in kind[1:])], packed([(5, 1, 10, 7), (6, 1, 10, 7)])], columns=kind)
    out = merge(again).iloc[0]
    assert got()[:3] == [[5, 6, 7, 8], [5, 5, 6, 2], [10, 8, 8, 8]]


SHARED_KIND = "key long, prefix long, last long, len int, f long"


@pytest.mark.parametrize("odd", [None, "length", "count", "rare", "text"])
def test_phrases_are_named_from_keys_unless_a_key_is_shared(spark, odd):
    words = [(1, "en", "a", 40), (2, "en", "b", 35)] + [(2, "de", "c", 35)] * (odd == "text")
    found = [(1, 0, 0, 1, 41 if odd == "count" else 40), (2, 0, 0, 1, 70 if odd == "text" else 35), (12, 1, 2, 2, 33), (121, 12, 1, 0 if odd == "length" else 3, 31)] + [(9, 0, 0, 1, 30)] * (odd == "rare")
    tables = spark.createDataFrame(found, SHARED_KIND), spark.createDataFrame(words, "key long, lang string, phrase string, f long")
    out = collocations.named(*tables, 4)
    if odd:
        assert out is None
    else:
        assert sorted(map(tuple, out.collect())) == [("en", "a", 1, 40), ("en", "a b", 2, 33), ("en", "a b a", 3, 31), ("en", "b", 1, 35)]


@pytest.mark.parametrize("shared", [False, True])
def test_phrases_by_key_and_by_text_are_the_same(spark, tmp_path_factory, monkeypatch, shared):
    rows = [("en", "a b c d e"), ("de", "a b, c d"), (None, "a a a a a a")] * 4
    blocks = collocations.stored(collocations.word_blocks(table(spark, tmp_path_factory, rows, "lang string, text string"), 2, 10))
    scans, by_text = [], collocations.counted_by_text
    monkeypatch.setattr(collocations, "counted_by_text", lambda blocks, kept, least, longest: scans.append(longest) or by_text(blocks, kept, least, longest))
    if shared:
        monkeypatch.setattr(collocations, "named", lambda *_: None)
    got = {tuple(r) for r in collocations.frequent_phrases(blocks, 5, 2).collect()}
    f = Counter()
    for lang, text in rows:
        for piece in text.split(","):
            words = piece.split()
            f.update((lang or "und", " ".join(words[i : i + k]), k) for k in range(1, 5) for i in range(len(words) - k + 1))
    assert got == {(*p, c) for p, c in f.items() if c >= 5}
    assert scans == ([1, 4] if shared else [1])  # phrases are put together once, not in each task that has them
