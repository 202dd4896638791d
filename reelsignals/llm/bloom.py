"""Blocked Bloom filter: all bits of a key lie in one 64-byte block.

The filter has a fixed size, so that broadcasting it has a proven bound however many keys
it holds; more keys only let more rows pass. It is built where the keys are: each task
sets bits in the segments its keys fall in, and segments are merged by key.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .texthash import mix

BLOCK_BITS = 512
PROBES = 6
SEGMENTS = 64


class BlockedBloom:
    def __init__(self, blocks: int, words: np.ndarray | None = None):
        if blocks % SEGMENTS:
            raise ValueError(f"blocks must be a multiple of {SEGMENTS}")
        self.blocks = blocks
        self.words = np.zeros(blocks * 8, np.uint64) if words is None else words

    def _bits(self, keys: np.ndarray):
        h = mix(keys.astype(np.uint64))
        block = ((h >> np.uint64(32)) * np.uint64(self.blocks)) >> np.uint64(32)
        g = mix(h + np.uint64(0x9E3779B97F4A7C15))
        for i in range(PROBES):
            bit = (g >> np.uint64(9 * i)) & np.uint64(BLOCK_BITS - 1)
            yield (block * np.uint64(8) + (bit >> np.uint64(6))).astype(np.int64), np.uint64(1) << (bit & np.uint64(63))

    def add(self, keys: np.ndarray) -> None:
        for word, bit in self._bits(keys):
            np.bitwise_or.at(self.words, word, bit)

    def may_hold(self, keys: np.ndarray) -> np.ndarray:
        found = np.ones(len(keys), bool)
        for word, bit in self._bits(keys):
            found &= (self.words[word] & bit) != 0
        return found


def build(keys: DataFrame, column: str, blocks: int = 1 << 14) -> BlockedBloom:
    """The filter of a bigint column; nulls are left out. 2^14 blocks are 1 MB.

    The driver receives the ``SEGMENTS`` merged segments, never a key.
    """
    width = blocks * 8 // SEGMENTS

    def partial(batches):
        own, seen = BlockedBloom(blocks), False
        for b in batches:
            values = b[column]
            if len(values):
                own.add(values.to_numpy(np.int64).view(np.uint64))
                seen = True
        if seen:
            parts = own.words.reshape(SEGMENTS, width)
            some = np.flatnonzero(parts.any(axis=1))
            yield pd.DataFrame({"segment": some, "bits": [parts[i].tobytes() for i in some]})

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        bits = np.zeros(width, np.uint64)
        for b in pdf["bits"]:
            bits |= np.frombuffer(b, np.uint64)
        return pd.DataFrame({"segment": pdf["segment"].iloc[:1], "bits": [bits.tobytes()]})

    kind = "segment long, bits binary"
    merged = keys.select(column).where(F.col(column).isNotNull()).mapInPandas(partial, kind).groupBy("segment").applyInPandas(merge, kind)
    out = BlockedBloom(blocks)
    for row in merged.collect():
        out.words[row["segment"] * width : (row["segment"] + 1) * width] = np.frombuffer(row["bits"], np.uint64)
    return out
