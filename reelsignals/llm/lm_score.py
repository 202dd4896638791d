"""Operator 7: document log-likelihood by a gated recurrent language model and by smoothed counts.

Counts cover every training document. They are gathered per task, meet by hash range and
stay packed: a row of the count table is a range of word hashes with their counts. The
``COMMON`` most frequent words at most (a fixed bound) are broadcast; the rest of a
document's words look their counts up in the ranges, one packed row per batch and range;
they are packed in the scan that scores, so a text is read once for both.

The recurrent model (``gru``) predicts a vocabulary of ``VOCABULARY`` ids: the end, the unknown,
and the most frequent words. A word outside has the probability of the unknown times its
smoothed share (c + 1) / (N' + V' + 1) among the words outside. The model learns in every
task from all of the task's training documents, and the tasks' parameters are averaged by
words seen (in groups of tasks first).
"""

from __future__ import annotations

import math
import pickle

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from . import gru
from .shared import fold_of, keep_memory, lean, stored, with_uid
from .texthash import word_hashes

COMMON = 1 << 19
VOCABULARY = 1024
FLUSH = 1 << 20
UNKNOWN = 1
COUNT_KIND = "range long, words binary, counts binary"


def _by_range(words: np.ndarray, bits: int):
    """(range, start, end) of sorted hashes."""
    r = (words >> np.uint64(64 - bits)).astype(np.int64)
    start = np.flatnonzero(np.r_[True, r[1:] != r[:-1]]) if len(r) else np.zeros(0, np.int64)
    return r[start], start, np.r_[start[1:], len(r)].astype(np.int64)


def count_table(texts: DataFrame, bits: int) -> DataFrame:
    """(range, words, counts, bins): counts of all words; bins: words by quarter powers of two of their count."""

    def emit(batches):
        held, size = [], 0

        def flush():
            words, counts = _merged(np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held]))
            r, start, end = _by_range(words, bits)
            return pa.RecordBatch.from_arrays(
                [pa.array(r, pa.int64()), pa.array([words[a:b].tobytes() for a, b in zip(start, end)], pa.binary()),
                 pa.array([counts[a:b].tobytes() for a, b in zip(start, end)], pa.binary())], ["range", "words", "counts"])

        for b in batches:
            part = np.unique(word_hashes(b.column("text"))[0], return_counts=True)
            if len(part[0]):
                held.append(part)
                size += len(part[0])
            if size >= FLUSH:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        words, counts = _merged(np.frombuffer(b"".join(pdf["words"]), np.uint64), np.frombuffer(b"".join(pdf["counts"]), np.int64))
        bins = np.bincount((4 * np.log2(counts)).astype(np.int64), minlength=256)
        return pd.DataFrame({"range": pdf["range"].iloc[:1], "words": [words.tobytes()], "counts": [counts.tobytes()],
                             "bins": [bins], "total": [int(counts.sum())], "types": [len(words)]})

    return texts.mapInArrow(emit, COUNT_KIND).groupBy("range").applyInPandas(merge, COUNT_KIND + ", bins array<long>, total long, types long")


def _merged(words: np.ndarray, counts: np.ndarray):
    order = np.argsort(words, kind="stable")
    words, counts = words[order], counts[order]
    start = np.flatnonzero(np.r_[True, words[1:] != words[:-1]])
    return words[start], np.add.reduceat(counts, start) if len(start) else counts[:0]


def common_words(table: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (sorted) and counts of at most ``most`` words: whole bins of counts from the top."""
    bins = {r["pos"]: r["n"] for r in table.select(F.posexplode("bins")).groupBy("pos").agg(F.sum("col").alias("n")).collect()}
    least, kept = 256, 0
    while least > 0 and kept + bins.get(least - 1, 0) <= most:
        least -= 1
        kept += bins.get(least, 0)

    def pick(batches):
        for b in batches:
            for w, c in zip(b["words"], b["counts"]):
                words, counts = np.frombuffer(w, np.uint64), np.frombuffer(c, np.int64)
                some = (4 * np.log2(counts)).astype(np.int64) >= least
                if some.any():
                    yield pd.DataFrame({"words": [words[some].tobytes()], "counts": [counts[some].tobytes()]})

    rows = table.select("words", "counts").mapInPandas(pick, "words binary, counts binary").collect()
    words = np.frombuffer(b"".join(bytes(r[0]) for r in rows), np.uint64)
    counts = np.frombuffer(b"".join(bytes(r[1]) for r in rows), np.int64)
    order = np.argsort(words)
    return words[order], counts[order]


class Knowledge:
    """What every task needs: totals, common words with counts and ids, model parameters."""

    def __init__(self, documents: int, total: int, types: int, words: np.ndarray, counts: np.ndarray):
        self.documents, self.words, self.counts = documents, words, counts
        self.n = total + documents
        self.types = types + (documents > 0)
        best = np.lexsort((words, -counts))[: VOCABULARY - 2]
        self.ids = np.full(len(words), UNKNOWN)
        self.ids[best] = np.arange(2, 2 + len(best))
        by_hash = best[np.argsort(words[best])]
        self.vocabulary, self.vocabulary_ids = words[by_hash], self.ids[by_hash]
        inside = int(counts[best].sum())
        self.outside = total - inside + types - len(best) + 1
        freq = np.zeros(VOCABULARY)
        freq[gru.END], freq[UNKNOWN] = documents, total - inside + 1
        freq[2 : 2 + len(best)] = counts[best]
        self.params = gru.new_params((freq + 1e-3) / (freq + 1e-3).sum())

    def look_up(self, hashes: np.ndarray):
        """Position among the common words, and whether it is one."""
        return _found(self.words, hashes)

    def model_ids(self, hashes: np.ndarray) -> np.ndarray:
        """By the vocabulary alone: it is small, so a search in it stays in a core's cache."""
        at, known = _found(self.vocabulary, hashes)
        return np.where(known, self.vocabulary_ids[at], UNKNOWN) if len(self.vocabulary) else np.full(len(hashes), UNKNOWN)

    def closed_ids(self, hashes: np.ndarray, bounds: np.ndarray):
        """Model ids of all documents, each closed by the end, with bounds; and those of the words."""
        ids, n = self.model_ids(hashes), len(bounds) - 1
        closed = np.full(len(ids) + n, gru.END)
        closed[np.arange(len(ids)) + np.repeat(np.arange(n), np.diff(bounds))] = ids
        return closed, bounds + np.arange(n + 1), ids


def _found(words: np.ndarray, hashes: np.ndarray):
    if not len(words):
        return np.zeros(len(hashes), np.int64), np.zeros(len(hashes), bool)
    at = np.minimum(np.searchsorted(words, hashes), len(words) - 1)
    return at, words[at] == hashes


def learn(texts: DataFrame, known: Knowledge) -> dict:
    """Average the parameters that each task reaches on its own documents."""
    shared = texts.sparkSession.sparkContext.broadcast(known)
    groups = max(1, math.isqrt(texts.rdd.getNumPartitions()))

    def train(batches):
        from pyspark import TaskContext

        keep_memory()
        trainer = gru.Trainer(shared.value.params)
        held, size = [], 0
        for b in batches:
            closed = shared.value.closed_ids(*word_hashes(b.column("text")))[0]
            held.append(closed)
            size += len(closed)
            if size >= 1 << 16:
                trainer.feed(np.concatenate(held))
                held, size = [], 0
        if held:
            trainer.feed(np.concatenate(held))
        if trainer.tokens:
            data = pickle.dumps({k: x * np.float32(trainer.tokens) for k, x in trainer.p.items()})
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId() % groups]), pa.array([float(trainer.tokens)]), pa.array([data], pa.binary())], ["part", "weight", "params"])

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = None
        for x in map(pickle.loads, pdf["params"]):
            total = x if total is None else {k: total[k] + x[k] for k in x}
        return pd.DataFrame({"part": pdf["part"].iloc[:1], "weight": [pdf["weight"].sum()], "params": [pickle.dumps(total)]})

    kind = "part long, weight double, params binary"
    rows = texts.mapInArrow(lean(train), kind).groupBy("part").applyInPandas(add, kind).collect()
    if not rows:
        return known.params
    weight = sum(r["weight"] for r in rows)
    parts = [pickle.loads(r["params"]) for r in rows]
    return {k: (sum(p[k] for p in parts) / np.float32(weight)).astype(np.float32) for k in known.params}


class Rare:
    """Words of a task that are not broadcast, packed by range with their rows."""

    def __init__(self, bits: int):
        from pyspark import TaskContext

        self.bits, self.batch, self.held, self.size = bits, TaskContext.get().partitionId() << 24, [], 0

    def add(self, words: np.ndarray, uid: np.ndarray) -> None:
        self.held.append((words, uid))
        self.size += len(words)

    def columns(self) -> dict:
        words, uid = (np.concatenate(x) for x in zip(*self.held))
        order = np.argsort(words, kind="stable")
        words, uid = words[order], uid[order]
        r, start, end = _by_range(words, self.bits)
        out = {"range": pa.array(r, pa.int64()), "batch": pa.array([self.batch] * len(r), pa.int64()), "words": pa.array([words[a:b].tobytes() for a, b in zip(start, end)], pa.binary()),
               "rows": pa.array([(uid[a:b] & 0xFFFFFFFF).astype(np.uint32).tobytes() for a, b in zip(start, end)], pa.binary())}
        self.held, self.size, self.batch = [], 0, self.batch + 1
        return out


ASKED = "range long, batch long, words binary, rows binary"


def rare_sums(asked: DataFrame, table: DataFrame) -> DataFrame:
    """(__uid, rare_log, rare_known): sum of log10(c + 1) and number of counted words among those ``asked`` for (``ASKED``)."""

    def answer(asked: pd.DataFrame, counted: pd.DataFrame) -> pd.DataFrame:
        words = np.frombuffer(b"".join(counted["words"]), np.uint64)
        counts = np.frombuffer(b"".join(counted["counts"]), np.int64)
        out = []
        if len(words):
            for _, x in asked.iterrows():
                mine, row = np.frombuffer(x["words"], np.uint64), np.frombuffer(x["rows"], np.uint32)
                at = np.minimum(np.searchsorted(words, mine), len(words) - 1)
                hit = words[at] == mine
                who, back = np.unique(row[hit], return_inverse=True)
                out.append((x["batch"], who.tobytes(), np.bincount(back, np.log10(counts[at[hit]] + 1.0), len(who)).tobytes(), np.bincount(back, minlength=len(who)).tobytes()))
        return pd.DataFrame(out, columns=["batch", "rows", "logs", "known"])

    def total(pdf: pd.DataFrame) -> pd.DataFrame:
        row = np.frombuffer(b"".join(pdf["rows"]), np.uint32)
        who, back = np.unique(row, return_inverse=True)
        logs = np.bincount(back, np.frombuffer(b"".join(pdf["logs"]), np.float64), len(who))
        known = np.bincount(back, np.frombuffer(b"".join(pdf["known"]), np.int64), len(who))
        return pd.DataFrame({"__uid": who.astype(np.int64) + ((int(pdf["batch"].iloc[0]) >> 24) << 33), "rare_log": logs, "rare_known": known.astype(np.int64)})

    answers = asked.groupBy("range").cogroup(table.select("range", "words", "counts").groupBy("range")).applyInPandas(answer, "batch long, rows binary, logs binary, known binary")
    sums = answers.groupBy("batch").applyInPandas(total, "__uid long, rare_log double, rare_known long")
    return sums.groupBy("__uid").agg(F.sum("rare_log").alias("rare_log"), F.sum("rare_known").alias("rare_known"))


def score_documents(docs: DataFrame, folds: int = 7, held: int = 2) -> DataFrame:
    """``docs`` (a table scan): doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    A null or empty text is its end alone. A row without a doc_id is in no training fold and
    counts as held out. Repeated rows count as often as they occur. Without training
    documents every count is 0 and the model is uniform over its ids. Other columns are ignored.
    """
    rows = with_uid(docs.select("doc_id", "text"))
    rows = rows.withColumn("held_out", F.coalesce(fold_of(F.col("doc_id"), folds) == held, F.lit(True)))
    trained = rows.where("not held_out")
    bits = max(6, (8 * docs.select("text").rdd.getNumPartitions() - 1).bit_length())
    table = stored(count_table(trained.select("text"), bits))
    documents = trained.count()
    total, types = table.agg(F.coalesce(F.sum("total"), F.lit(0)), F.coalesce(F.sum("types"), F.lit(0))).first()
    known = Knowledge(documents, total, types, *common_words(table, COMMON))
    known.params = learn(trained.select("text"), known)
    shared = docs.sparkSession.sparkContext.broadcast(known)
    names = ["__uid", "doc_id", "held_out", "n_tokens", "n_known", "n_unknown", "common_log", "unknown_log", "model_log"]
    kind = T.StructType([T.StructField(f.name, f.dataType) for f in rows.select("__uid", "doc_id", "held_out").schema])
    for c in names[3:6]:
        kind = kind.add(c, "long")
    for c in names[6:]:
        kind = kind.add(c, "double")
    for field in T.StructType.fromDDL(ASKED):
        kind = kind.add(field)
    arrow = to_arrow_schema(kind)

    def judge(batches):
        keep_memory()
        k, rare = shared.value, Rare(bits)
        end_log, ln10 = math.log10(k.documents + 1), math.log(10)

        def batch(columns):
            n = len(next(iter(columns.values())))
            return pa.RecordBatch.from_arrays([columns[f.name].cast(f.type) if f.name in columns else pa.nulls(n, f.type) for f in arrow], names=arrow.names)

        for b in batches:
            for low in range(0, b.num_rows, 4096):
                part = b.slice(low, 4096)
                hashes, bounds = word_hashes(part.column("text"))
                at, common = k.look_up(hashes)
                closed, closed_bounds, ids = k.closed_ids(hashes, bounds)
                n = part.num_rows
                owner = np.repeat(np.arange(n), np.diff(bounds))
                logs = np.where(common, np.log10(k.counts[at] + 1.0) if len(k.counts) else 0.0, 0.0)
                tally = lambda mask: np.bincount(owner[mask], minlength=n)  # noqa: E731, B023
                weigh = lambda mask: np.bincount(owner[mask], logs[mask], n).astype(np.float64)  # noqa: E731, B023
                unknown = ids == UNKNOWN
                yield batch({"__uid": part.column("__uid"), "doc_id": part.column("doc_id"), "held_out": part.column("held_out"), "n_tokens": pa.array(np.diff(bounds) + 1),
                             "n_known": pa.array(tally(common) + (k.documents > 0)), "n_unknown": pa.array(tally(unknown)), "common_log": pa.array(weigh(common) + end_log),
                             "unknown_log": pa.array(weigh(common & unknown)), "model_log": pa.array(gru.score(k.params, closed, closed_bounds) / ln10)})
                if not common.all():
                    rare.add(hashes[~common], part.column("__uid").to_numpy(zero_copy_only=False)[owner[~common]])
                if rare.size >= FLUSH:
                    yield batch(rare.columns())
        if rare.size:
            yield batch(rare.columns())

    judged = stored(rows.select("__uid", "doc_id", "held_out", "text").mapInArrow(lean(judge), kind))
    scored, asked = judged.where("range is null").select(*names), judged.where("range is not null").select("range", "batch", "words", "rows")
    out = scored.join(rare_sums(asked, table), "__uid", "left")
    rare = F.coalesce("rare_log", F.lit(0.0))
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"), F.lit(known.n).cast("long").alias("train_tokens"),
        (F.col("common_log") + rare - F.col("n_tokens") * math.log10(known.n + known.types + 1)).alias("base_score"),
        (F.col("model_log") + F.col("unknown_log") + rare - F.col("n_unknown") * math.log10(known.outside)).alias("score"))
