"""Operator 8: a counterfactually regularised toxicity classifier.

Features are pieces of words: the word itself, its beginnings and its inner five-letter
pieces, present or absent in a document. A bounded sample of labelled rows decides which
pieces tell toxic documents apart (weight of evidence against its standard error), and a
logistic model is fitted on them. For each sampled sentence that mentions a group, a copy with
another group's name in its place is made, and the model pays for every difference
between the two scores, so that a neutral mention of a group moves no score.

Sampling: at most ``sample`` rows of each label, those with the least hash of the id; of the
rows that repeat an id, the text with the least hash. The
sampled ids are the only broadcast (2 * ``sample`` at most); their documents reach the driver
as lists of chosen pieces. Scoring is one pass over all texts without a shuffle.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import fold_of, lean, release, small_batches

# Names of groups whose mention alone must not raise a score.
IDENTITY_TERMS = (
    "women men female male girl boy gay lesbian straight bisexual transgender queer black white asian african latino hispanic "
    "european american jewish muslim christian hindu buddhist sikh atheist catholic immigrant refugee foreign native disabled "
    "blind deaf elderly old young poor rich femme femmes homme hommes noir blanc juif musulman chrétien arabe étranger frau frauen "
    "mann männer schwarz weiß jüdisch muslimisch christlich ausländer mujer mujeres hombre hombres negro blanco judío musulmán "
    "cristiano extranjero"
).split()

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
EDGES = ".,;:!?\"'()[]{}<>*#&%$|-_"
SAMPLE = 8192
PIECES = 4096
CACHE = 100_000
TALLIES = 200_000
LONG = 64


def pieces(word: str) -> Iterator[str]:
    """The word with its end marks, its beginnings of 3 to 7 letters, its inner pieces of five.

    A text without blanks is one word and gives the pieces of all of it.
    """
    w = f"<{word}>"
    yield w
    yield from (w[:n] for n in range(4, min(9, len(w))))
    yield from (w[i : i + 5] for i in range(1, len(w) - 5))


def words_of(text: str | None) -> set[str]:
    return {w.strip(EDGES) for w in set(WORDS.findall((text or "").lower()))} - {""}


def features(words: set[str], chosen: dict, cache: dict) -> set[int]:
    """Numbers of the chosen pieces in ``words``; ``cache`` remembers words of up to ``LONG`` letters."""
    found: set[int] = set()
    for w in words:
        if len(w) > LONG:
            found.update(chosen[p] for p in pieces(w) if p in chosen)
            continue
        hit = cache.get(w)
        if hit is None:
            if len(cache) >= CACHE:
                cache.clear()
            hit = cache[w] = tuple({chosen[p] for p in pieces(w) if p in chosen})
        if hit:
            found.update(hit)
    return found


def labelled_sample(docs: DataFrame, labels: DataFrame, sample: int, folds: int, held: int) -> DataFrame:
    """(text, toxic) of the sampled training rows."""
    votes = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    votes = votes.where(fold_of(F.col("doc_id"), folds) != held).withColumn("o", F.xxhash64("doc_id", F.lit("sample")))
    chosen = [votes.where((F.col("toxic") > 0) == F.lit(y)).orderBy("o", "doc_id").limit(sample) for y in (True, False)]
    ids = chosen[0].unionByName(chosen[1]).select("doc_id", (F.col("toxic") > 0).cast("int").alias("toxic"))
    rows = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")
    return rows.groupBy("doc_id", "toxic").agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("text", "toxic")


def _piece_counts(rows: DataFrame) -> DataFrame:
    """(piece, toxic documents, other documents) over the sample, counted per task first in tallies of about ``TALLIES`` pieces."""

    def run(batches):
        tallies = Counter(), Counter()

        def tallied():
            names = list(tallies[0].keys() | tallies[1].keys())
            for i in range(0, len(names), 50_000):
                part = names[i : i + 50_000]
                yield pd.DataFrame({"piece": part, "toxic": [tallies[1][p] for p in part], "other": [tallies[0][p] for p in part]})
            for t in tallies:
                t.clear()

        for b in batches:
            for text, toxic in zip(b["text"], b["toxic"]):
                own: set[str] = set()
                for w in words_of(text):
                    own.update(pieces(w))
                tallies[toxic].update(own)
                if len(tallies[0]) + len(tallies[1]) > TALLIES:
                    yield from tallied()
        yield from tallied()

    return rows.mapInPandas(lean(run), "piece string, toxic long, other long").groupBy("piece").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))


def _chosen_pieces(rows: DataFrame, limit: int) -> tuple[list[str], int, int]:
    n = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    pos, neg = n.get(1, 0), n.get(0, 0)
    c = _piece_counts(rows).where("toxic + other >= 3")
    a, b = F.col("toxic") + 0.5, F.col("other") + 0.5
    evidence = F.log(a / (pos + 1)) - F.log(b / (neg + 1))
    z = evidence / F.sqrt(1 / a + 1 / b)
    best = c.withColumn("z", F.abs(z)).where("z > 3").orderBy(F.desc("z"), "piece").limit(limit)
    return sorted(r["piece"] for r in best.collect()), pos, neg


def _packed(numbers: set[int]) -> bytes:
    return np.array(sorted(numbers), np.int32).tobytes()


def _training_rows(rows: DataFrame, chosen: dict, terms: list[str]) -> list:
    """(toxic, pieces, pieces of the counterfactual copy or None) per sampled row, as arrays."""

    def run(batches):
        cache: dict = {}
        known = set(terms)
        for b in batches:
            out = []
            for text, toxic in zip(b["text"], b["toxic"]):
                words = words_of(text)
                named = sorted(words & known)
                swapped = None
                if named:
                    other = {t: terms[(terms.index(t) + 1 + len(words) % (len(terms) - 1)) % len(terms)] for t in named}
                    swapped = _packed(features((words - set(named)) | set(other.values()), chosen, cache))
                out.append((int(toxic), _packed(features(words, chosen, cache)), swapped))
            yield pd.DataFrame(out, columns=["toxic", "x", "swapped"])

    found = rows.mapInPandas(lean(run), "toxic int, x binary, swapped binary").collect()
    load = lambda b: None if b is None else np.frombuffer(b, np.int32)
    return [(r["toxic"], load(r["x"]), load(r["swapped"])) for r in found]


def fit(rows: list, width: int, penalty: float, decay: float, steps: int = 300) -> tuple[np.ndarray, float]:
    """Weights and bias: balanced logistic loss + ``penalty`` * squared score changes + ``decay`` * squared weights, by Adam."""
    y = np.array([r[0] for r in rows], np.float64)
    balance = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum()))

    def flat(lists):
        return np.repeat(np.arange(len(lists)), [len(x) for x in lists]), np.concatenate([np.asarray(x, np.int32) for x in lists]) if lists else np.zeros(0, np.int32)

    r, c = flat([x[1] for x in rows])
    pairs = [i for i, x in enumerate(rows) if x[2] is not None]
    pr, pc = flat([rows[i][2] for i in pairs])
    pairs = np.array(pairs, np.int64)
    w, bias = np.zeros(width), 0.0
    m, v = np.zeros(width + 1), np.zeros(width + 1)
    sigmoid = lambda t: 1 / (1 + np.exp(-np.clip(t, -40, 40)))
    for t in range(1, steps + 1):
        s = sigmoid(np.bincount(r, w[c], len(y)) + bias)
        err = balance * (s - y)
        if len(pairs):
            s2 = sigmoid(np.bincount(pr, w[pc], len(pairs)) + bias)
            gap = 2 * penalty * (s[pairs] - s2) / len(pairs)
            np.add.at(err, pairs, gap * s[pairs] * (1 - s[pairs]))
            err2 = -gap * s2 * (1 - s2)
        g = np.bincount(c, err[r], width) + decay * w
        gb = err.sum()
        if len(pairs):
            g += np.bincount(pc, err2[pr], width)
            gb += err2.sum()
        g = np.r_[g, gb]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, bias = w - step[:-1], bias - step[-1]
    return w, bias


class Model:
    def __init__(self, chosen: dict, weights: np.ndarray, bias: float):
        self.chosen, self.weights, self.bias = chosen, weights, bias

    def scores(self, texts, cache: dict) -> np.ndarray:
        logits = np.array([self.weights[list(features(words_of(t), self.chosen, cache))].sum() for t in texts], np.float64) + self.bias
        return 1 / (1 + np.exp(-np.clip(logits, -40, 40)))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, folds: int = 5, held: int = 0, limit: int = PIECES,
          penalty: float = 1.0, decay: float = 1e-5, terms: list[str] = IDENTITY_TERMS) -> Model:
    """Without labelled rows the model knows nothing and scores every text just under 0.5."""
    rows = labelled_sample(small_batches(docs), labels, sample, folds, held).persist()
    names, pos, neg = _chosen_pieces(rows, limit)
    chosen = dict(zip(names, count()))
    if not pos or not neg:
        rows.unpersist()
        return Model({}, np.zeros(0), -1e-9)
    data = _training_rows(rows, chosen, list(terms))
    rows.unpersist()
    model = Model(chosen, *fit(data, len(names), penalty, decay))
    del data  # the driver goes on with later stages
    release()
    return model


def scored(docs: DataFrame, model: Model, folds: int = 5, held: int = 0) -> DataFrame:
    """doc_id, held_out, score, predicted for every row.

    Null and empty texts get the score of the bias alone. A row without a doc_id can't be
    a labelled one and counts as held out. Other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        cache: dict = {}
        for b in batches:
            s = shared.value.scores(b.column("text").to_pylist(), cache)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = small_batches(docs).select("doc_id", F.coalesce(fold_of(F.col("doc_id"), folds) == held, F.lit(True)).alias("held_out"), "text")
    kind = rows.drop("text").schema.add("score", "double").add("predicted", "integer")
    return rows.mapInArrow(lean(run), kind)


def without_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` without the rows predicted toxic, all columns kept."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        cache: dict = {}
        for b in batches:
            yield b.filter(pa.array(shared.value.scores(b.column("text").to_pylist(), cache) < 0.5))

    return small_batches(docs).mapInArrow(lean(run), docs.schema)
