"""Operator 5: packing token sequences by Karmarkar-Karp multiway differencing.

Documents are tokenized and each one's ids followed by an end id. Whole windows are cut off
first, the rest into pieces of at most ``PIECE`` ids. Pieces are gathered, in reading
order, until they fill about ``GROUP`` windows; the group is then split into k = its tokens /
window, rounded up, near-equal parts: every piece starts as a partial partition with one
filled part, and the two partial partitions with the largest spread are merged again and
again, the largest parts of one with the smallest of the other. If the fullest part
exceeds a window, k rises by one and the group is split anew.

All of it is one pass in the tasks that read the table: no shuffle, one group in memory,
and a lost task repeats only itself. A task's last group may be short; each group pads
less than a window or two in all.
"""

from __future__ import annotations

import base64
import heapq
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .shared import lean, small_batches

WINDOW = 2048
PIECE = 512
GROUP = 256
LONG_RUN = 2000


class Ids:
    """Ids of the tokenizers file, computed by the faster reader of the same ranks wherever the two are alike.

    ``tokenizers`` itself takes the texts that hold a special token's string, and those with
    a run of letters or of white space so long that the other's merge loop would be slow.
    """

    def __init__(self, file: str, ranks: str | None = None, pattern: str | None = None):
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(file)
        self.special = [t.content for t in self.slow.get_added_tokens_decoder().values()]
        self.fast = None
        if ranks:
            import tiktoken

            with open(ranks, "rb") as f:
                table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
            self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})

    def __call__(self, text: str) -> np.ndarray:
        plain = self.fast is not None and not any(s in text for s in self.special)
        if plain and len(text) > LONG_RUN:
            plain = max(map(len, text.split()), default=0) <= LONG_RUN and " " * LONG_RUN not in text and text.count("\n" * 16) == 0 and "\t" * 64 not in text
        if plain:
            return np.asarray(self.fast.encode_to_numpy(text), np.uint32)
        return np.array(self.slow.encode(text, add_special_tokens=False).ids, np.uint32)


def difference(sizes: np.ndarray, k: int) -> np.ndarray:
    """The part (0 to k - 1) of each piece by multiway differencing."""
    n = len(sizes)
    sums: list = [None] * n
    made: list = [None] * n
    heap = []
    for i, s in enumerate(sizes):
        heap.append((-int(s), i))
    heapq.heapify(heap)
    zero = np.zeros(k, np.int64)

    def parts(i):
        if sums[i] is None:
            v = zero.copy()
            v[-1] = sizes[i]
            return v
        return sums[i]

    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        v = parts(a) + parts(b)[::-1]
        order = np.argsort(v, kind="stable")
        v = v[order]
        v -= v[0]
        sums.append(v)
        made.append((a, b, order))
        sums[a] = sums[b] = None
        heapq.heappush(heap, (-int(v[-1]), len(sums) - 1))
    out = np.zeros(n, np.int64)
    todo = [(heap[0][1], np.arange(k))] if n else []
    while todo:
        i, place = todo.pop()
        if i < n:
            out[i] = place[-1]
            continue
        a, b, order = made[i]
        own = np.empty(k, np.int64)
        own[order] = place
        todo.append((a, own))
        todo.append((b, own[::-1]))
    return out


def windows(sizes: np.ndarray, window: int) -> np.ndarray:
    """Parts of at most ``window`` each; their number rises until none exceeds it."""
    k = max(1, -(-int(sizes.sum()) // window))
    while True:
        part = difference(sizes, k)
        if np.bincount(part, sizes, k).max(initial=0) <= window:
            return part
        k += 1


def pack(docs: DataFrame, file: str, ranks: str | None = None, pattern: str | None = None, end: int = 1, window: int = WINDOW) -> DataFrame:
    """Pieces: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A null or empty text is the end id alone. Rows without a doc_id and repeated rows are
    packed like any other. sequence_id counts up in each task of the scan. Other columns
    are ignored. An empty table gives no piece.
    """
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    kind = docs.select("doc_id").schema
    for c in names[1:]:
        kind = kind.add(c, "long")

    def run(batches):
        ids_of = Ids(file, ranks, pattern)
        base = TaskContext.get().partitionId() << 40
        state = {"next": 0}
        id_type = None

        def batch(rows):
            columns = list(zip(*rows))
            return pa.RecordBatch.from_arrays([pa.array(columns[0], id_type)] + [pa.array(c, pa.int64()) for c in columns[1:]], names)

        def settle(pieces):
            sizes = np.array([p[2] for p in pieces], np.int64)
            part = windows(sizes, window)
            rows, at = [], {}
            for p, k in zip(pieces, part):
                k = int(k)
                rows.append((*p, base + state["next"] + k, at.get(k, 0)))
                at[k] = at.get(k, 0) + p[2]
            state["next"] += int(part.max()) + 1
            return batch(rows)

        open_, held, full = [], 0, []
        for b in batches:
            id_type = b.column("doc_id").type
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                ids = np.append(ids_of(text or ""), np.uint32(end)).astype("<u4")
                n, at = len(ids), 0
                while at < n:
                    length = window if n - at >= window else min(PIECE, n - at)
                    piece = (doc_id, at, length, zlib.crc32(ids[at : at + length].tobytes()), n)
                    if length == window:
                        full.append((*piece, base + state["next"], 0))
                        state["next"] += 1
                    else:
                        open_.append(piece)
                        held += length
                    at += length
                if len(full) >= 4096:
                    yield batch(full)
                    full = []
                if held >= GROUP * window:
                    yield settle(open_)
                    open_, held = [], 0
        if full:
            yield batch(full)
        if open_:
            yield settle(open_)

    return small_batches(docs).select("doc_id", "text").mapInArrow(lean(run), kind)
