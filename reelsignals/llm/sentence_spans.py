"""Operator 10: repeated runs of sentences.

Every run of ``SPAN`` consecutive sentences is hashed (words lower-cased, white space
ignored). Equal hashes meet in one group; all but the first run (by doc_id, null last, then
reading order) are repeats, and every sentence a repeat covers is removed.

A sentence ends with a word that closes in . ! or ? or at a line break. One of more than
``LONGEST`` words is cut at places that its words alone decide, so that a passage without stops
is cut alike whatever comes before it: after each word whose hash is the least within
``NEAR`` words on both sides and, where that leaves more than ``LONGEST`` words, after the
word of least hash among the last ``NEAR`` that may end the piece. A passage shows its cuts
from its sixth word on; a repeat needs three whole pieces (about 11 words each) inside it.

Repeats within a task's batch are settled there, so a run shared by a third of all
documents sends one row per batch to its group. Runs travel packed, one row per batch and group.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import with_uid
from .texthash import BASE, Words, mix, run_hashes

SPAN = 3
LONGEST = 20
NEAR = 5
FLUSH = 1 << 19
ROW_BITS = 33
CLOSES = np.zeros(256, bool)
CLOSES[[ord(c) for c in ".!?"]] = True


def cut_long(hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the sentences [starts, ends), which follow each other, with the long ones cut by their words."""
    if not len(ends) or (ends - starts).max() <= LONGEST:
        return starts, ends
    long = np.repeat(ends - starts > LONGEST, ends - starts)
    place = np.arange(len(hashes))
    least = long & (place - np.repeat(starts, ends - starts) >= NEAR) & (np.repeat(ends, ends - starts) - place > NEAR)
    for k in range(1, NEAR + 1):
        least[k:] &= hashes[k:] < hashes[:-k]
        least[:-k] &= hashes[:-k] <= hashes[k:]
    least[ends - 1] = True
    bounds = [np.flatnonzero(least) + 1]
    start, end = np.r_[0, bounds[0][:-1]], bounds[0]
    while (more := end - start > LONGEST).any():
        start, end = start[more], end[more]
        late = hashes[start[:, None] + np.arange(LONGEST - 1, LONGEST - 1 - NEAR, -1)]
        start = start + LONGEST - late.argmin(axis=1)
        bounds.append(start)
    end = np.sort(np.concatenate(bounds))
    return np.r_[0, end[:-1]], end


class Sentences:
    """Sentences of a batch: hash, text number, first word's byte; ``bounds`` of each text."""

    def __init__(self, texts: pa.Array):
        w = self.words = Words(texts)
        n = len(w.hashes)
        stop = CLOSES[w.data[w.end - 1]] if n else np.zeros(0, bool)
        if n:
            lines = np.flatnonzero(w.data == 10)
            stop[:-1] |= np.searchsorted(lines, w.first[1:]) > np.searchsorted(lines, w.end[:-1])
        stop[w.bounds[1:][w.bounds[1:] > w.bounds[:-1]] - 1] = True
        ends = np.flatnonzero(stop) + 1
        starts = np.r_[0, ends[:-1]][: len(ends)]
        start, end = cut_long(w.hashes, starts, ends)
        self.hashes = run_hashes(w.hashes, start, end)
        self.bounds = np.searchsorted(start, w.bounds)
        self.byte = w.first[start]


def spans(s: Sentences, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first sentence of every run of ``width`` sentences of one text."""
    n = max(0, len(s.hashes) - width + 1)
    runs = np.zeros(n, np.uint64)
    for i in range(width):
        runs += s.hashes[i : i + n] * (mix(np.array([i + 1], np.uint64) * BASE)[0] | np.uint64(1))
    text = np.repeat(np.arange(len(s.bounds) - 1), np.diff(s.bounds))
    whole = np.flatnonzero(text[:n] == text[width - 1 : width - 1 + n]) if n else np.zeros(0, np.int64)
    return mix(runs[whole]), whole


def _later(key, doc, row, at):
    """Order by (key, doc, row, at), and which entries are not the first of their key in it."""
    order = np.lexsort((at, row, doc, key))
    k = key[order]
    return order, np.r_[False, k[1:] == k[:-1]] if len(k) else np.zeros(0, bool)


def repeated(docs: DataFrame, width: int) -> DataFrame:
    """(__uid, at): the first sentences of all repeats of a document, from ``docs`` (__uid, doc_id, text)."""
    buckets = 1 << max(6, (4 * docs.select("text").rdd.getNumPartitions() - 1).bit_length())
    shift = np.uint64(64 - (buckets.bit_length() - 1))
    none = np.iinfo(np.int64).max

    def emit(batches):
        held, count = [], 0

        def flush():
            key, doc, row, at = (np.concatenate(x) for x in zip(*held))
            order, later = _later(key, doc, row, at)
            settled = order[later]
            first = order[~later]
            bucket = (key[first] >> shift).astype(np.int64)
            start = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(first) else np.zeros(0, np.int64)
            end = np.r_[start[1:], len(first)].astype(np.int64)
            pack = lambda x: [x[first[a:b]].tobytes() for a, b in zip(start, end)]
            numbers, keys, docs_, rows, ats = list(bucket[start]), pack(key), pack(doc), pack(row), pack(at)
            for i in range(0, len(settled), 8192):
                part = settled[i : i + 8192]
                numbers.append(int(key[part[0]] ^ np.uint64(row[part[0]])) % buckets)
                keys.append(b"")
                docs_.append(b"")
                rows.append(row[part].tobytes())
                ats.append(at[part].tobytes())
            return pa.RecordBatch.from_arrays([pa.array(numbers, pa.int64())] + [pa.array(x, pa.binary()) for x in (keys, docs_, rows, ats)], ["bucket", "keys", "docs", "rows", "at"])

        for b in batches:
            s = Sentences(b.column("text"))
            key, where = spans(s, width)
            text = np.searchsorted(s.bounds, where, "right") - 1
            doc = b.column("doc_id").cast(pa.int64()).fill_null(none).to_numpy(zero_copy_only=False)
            row = b.column("__uid").to_numpy(zero_copy_only=False)
            held.append((key, doc[text], row[text], (where - s.bounds[text]).astype(np.int32)))
            count += len(key)
            if count >= FLUSH:
                yield flush()
                held, count = [], 0
        if count:
            yield flush()

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        settled = pdf["keys"].map(len) == 0
        mine = pdf[~settled]
        load = lambda frame, c, t: np.frombuffer(b"".join(frame[c]), t)
        key, doc, row, at = load(mine, "keys", np.uint64), load(mine, "docs", np.int64), load(mine, "rows", np.int64), load(mine, "at", np.int32)
        order, later = _later(key, doc, row, at)
        row = np.r_[row[order[later]], load(pdf[settled], "rows", np.int64)]
        at = np.r_[at[order[later]], load(pdf[settled], "at", np.int32)]
        order = np.lexsort((at, row))
        row, at = row[order], at[order]
        start = np.flatnonzero(np.r_[True, row[1:] != row[:-1]]) if len(row) else np.zeros(0, np.int64)
        return pd.DataFrame({"__uid": row[start], "at": pd.Series(np.split(at, start[1:]) if len(start) else [], dtype=object)})

    runs = docs.select("__uid", "doc_id", "text").mapInArrow(emit, "bucket long, keys binary, docs binary, rows binary, at binary")
    found = runs.groupBy("bucket").applyInPandas(meet, "__uid long, at array<int>")
    return found.groupBy("__uid").agg(F.flatten(F.collect_list("at")).alias("at"))


def remove_repeats(docs: DataFrame, width: int = SPAN) -> DataFrame:
    """``docs`` (a table scan): doc_id, n_sentences, n_removed, removed (numbers from 0), kept_text.

    A null text has no sentences and stays null; one shorter than ``width`` sentences is
    kept whole. Repeated rows are copies: all but the first lose their runs. Rows without
    a doc_id come last in the order. Other columns are ignored. An empty table stays empty.
    """
    rows = with_uid(docs.select("doc_id", "text"))
    rows = rows.join(repeated(rows, width), "__uid", "left")

    def cut(batches):
        for b in batches:
            s = Sentences(b.column("text"))
            sizes, removed, texts = np.diff(s.bounds), [], []
            null = b.column("text").is_null().to_pylist()
            data = s.words.data
            for i, at in enumerate(b.column("at").to_pylist()):
                low, n = s.words.offsets[i], int(sizes[i])
                high = s.words.offsets[i + 1]
                gone = np.zeros(n, bool)
                if at:
                    first = np.array(at)
                    for j in range(width):
                        gone[first + j] = True
                removed.append(np.flatnonzero(gone))
                edges = np.r_[s.byte[s.bounds[i] : s.bounds[i + 1]], high]
                keep = [data[low : edges[0]]] + [data[edges[j] : edges[j + 1]] for j in np.flatnonzero(~gone)]
                texts.append(None if null[i] else b"".join(x.tobytes() for x in keep).decode("utf-8") if at else data[low:high].tobytes().decode("utf-8"))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(sizes, pa.int64()), pa.array([len(r) for r in removed], pa.int64()), pa.array([r.tolist() for r in removed], pa.list_(pa.int32())), pa.array(texts, pa.string())],
                ["doc_id", "n_sentences", "n_removed", "removed", "kept_text"])

    kind = docs.select("doc_id").schema.add("n_sentences", "long").add("n_removed", "long").add("removed", T.ArrayType(T.IntegerType())).add("kept_text", "string")
    return rows.select("doc_id", "text", "at").mapInArrow(cut, kind)
