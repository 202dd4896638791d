"""Bit-parallel word edits against the plain table, and on long transcripts."""

import random
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from reelsignals.operators import transcripts as W


def plain(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


words = st.lists(st.sampled_from("abcd"), max_size=30)


@settings(max_examples=300, deadline=None)
@given(words, words)
def test_equals_the_plain_table(a, b):
    assert W.word_edits(a, b) == plain(a, b) == W.word_edits(b, a)


@settings(max_examples=100, deadline=None)
@given(words, words)
def test_masks_that_are_not_kept(a, b):
    kept, W.MASKS_KEPT = W.MASKS_KEPT, 1
    try:
        assert W.word_edits(a, b) == plain(a, b)
    finally:
        W.MASKS_KEPT = kept


def test_longer_than_a_machine_word():
    rng = random.Random(3)
    a = [rng.choice("abcdefgh") for _ in range(400)]
    b = [w for w in a if rng.random() > 0.1] + ["z"]
    assert W.word_edits(a, b) == plain(a, b)


def test_long_transcripts_end_soon():
    """50,000 words, five in a hundred lost, each of its own kind, so that the count is known."""
    rng = random.Random(4)
    a = [f"w{i}" for i in range(50_000)]
    lost = set(rng.sample(range(1, 49_999), 2_500))
    begin = time.process_time()
    assert W.word_edits(a, [w for i, w in enumerate(a) if i not in lost]) == 2_500
    assert time.process_time() - begin < 10


def test_rate_with_nulls_and_empty_lists(spark):
    rows = [(0, ["a", "b"], ["a"]), (1, [], []), (2, [], ["x"]), (3, None, ["x"]), (4, ["a"], None), (5, ["a", None], ["a", None])]
    d = spark.createDataFrame(rows, "id int, ref array<string>, hyp array<string>").select("id", W.word_error_rate("ref", "hyp").alias("wer"))
    assert [r["wer"] for r in sorted(d.collect())] == [pytest.approx(0.5), 0.0, 1.0, None, None, 0.0]
