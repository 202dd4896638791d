"""Word and shingle hashes of whole Arrow batches of texts, in numpy without a loop over words.

The bytes of a batch are laid end to end. A word's hash is a polynomial over random byte
values modulo 2^64, read from one cumulative sum, so the cost is a few array passes per
byte whatever the word lengths. Two different words or shingles share a 64-bit hash with
a chance of about 2^-64.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BYTE_VALUE = np.random.default_rng(20240501).integers(1, 2**63, 256, dtype=np.uint64)
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 2**64))
CHUNK_BYTES = 1 << 17  # its arrays of numbers stay in a core's cache
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def unmix(h: np.ndarray) -> np.ndarray:
    """The inverse of ``mix``."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(pow(0xC4CEB9FE1A85EC53, -1, 2**64))
    h = (h ^ (h >> np.uint64(33))) * np.uint64(pow(0xFF51AFD7ED558CCD, -1, 2**64))
    return h ^ (h >> np.uint64(33))


def power_tables(n: int):
    if len(_powers[0]) < n:
        for i, step in enumerate((BASE, INVERSE)):
            table = np.full(max(n, CHUNK_BYTES), step, np.uint64)
            table[0] = 1
            _powers[i] = np.multiply.accumulate(table)
    return _powers


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets of each text (a null is empty) and all bytes."""
    texts = texts.cast(pa.large_string()).fill_null("")
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    return offsets, np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)


class Words:
    """Words of a batch: hashes, bounds of each text in them, first and end byte of each (in ``data``)."""

    def __init__(self, texts: pa.Array, lower: bool = True):
        self.offsets, self.data = text_bytes(texts)
        offsets, n = self.offsets, len(texts)
        bounds = np.zeros(n + 1, np.int64)
        hashes, firsts, lasts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        low = 0
        while low < n:
            high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + CHUNK_BYTES, "right")) - 1)
            d = self.data[offsets[low] : offsets[high]]
            if lower:
                d = LOWER[d]
            cuts = offsets[low : high + 1] - offsets[low]
            solid = ~SPACE[d]
            edge = np.zeros(len(d) + 1, bool)
            edge[cuts] = True
            before, after = np.ones(len(d), bool), np.ones(len(d), bool)
            before[1:] = ~solid[:-1]
            after[:-1] = ~solid[1:]
            starts = np.flatnonzero(solid & (before | edge[:-1]))
            ends = np.flatnonzero(solid & (after | edge[1:])) + 1
            power, inverse = power_tables(len(d) + 1)
            total = np.zeros(len(d) + 1, np.uint64)
            np.cumsum(BYTE_VALUE[d] * power[: len(d)], out=total[1:])
            hashes.append(mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64) * BASE))
            firsts.append(starts + offsets[low])
            lasts.append(ends + offsets[low])
            bounds[low + 1 : high + 1] = np.diff(np.searchsorted(starts, cuts))
            low = high
        self.hashes, self.bounds = np.concatenate(hashes), np.cumsum(bounds)
        self.first, self.end = np.concatenate(firsts), np.concatenate(lasts)


def word_hashes(texts: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words ``[^\\x20\\x09-\\x0D]+`` of all texts, and each text's bounds in them."""
    words = Words(texts, lower)
    return words.hashes, words.bounds


def run_hashes(hashes: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of each stretch [start, end) of a sequence of hashes."""
    power, inverse = power_tables(len(hashes) + 1)
    total = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * power[: len(hashes)], out=total[1:])
    return mix((total[end] - total[start]) * inverse[start] + (end - start).astype(np.uint64) * BASE)


def shingle_sets(texts: pa.Array, width: int):
    """The sorted distinct shingle hashes of each text: runs of ``width`` lower-cased words,
    the whole sequence where there are fewer words, nothing without words."""
    words, bounds = word_hashes(texts)
    weights = mix(np.arange(1, width + 1, dtype=np.uint64) * BASE) | np.uint64(1)
    runs = np.zeros(max(0, len(words) - width + 1), np.uint64)
    for i, weight in enumerate(weights):
        runs += words[i : i + len(runs)] * weight
    runs = mix(runs)
    for a, b in zip(bounds[:-1], bounds[1:]):
        if b - a >= width:
            yield np.unique(runs[a : b - width + 1])
        elif b > a:
            yield mix((words[a:b] * weights[: b - a]).sum(keepdims=True) + np.array([b - a], np.uint64) * BASE)
        else:
            yield words[a:a]
