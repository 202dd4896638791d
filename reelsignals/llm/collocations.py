"""Operator 13: phrase collocations by dynamic itemset counting.

Texts are read once into blocks of word numbers with a dictionary each, dealt over ``SHARDS`` shards.
The shards are scanned in a cycle. A step counts, in one shard, the words and longer phrases
that are active then, all lengths together, and adds them to the running counts. A phrase that
reaches ``least`` is known from the next step on; a longer phrase becomes active with the
step that knows both its subphrases (all but the last word, all but the first), is counted for one full
cycle and then rests, so its count is exact. Steps end when no phrase is active.

What a step has learned goes to the tasks as one blocked Bloom filter per step, of a size with a
fixed bound. The step that knows a phrase is the first filter that seems to hold it, or the step that knows both its
subphrases if that is later; filters never change, so a false hit only lets a phrase be counted from an earlier
step on, for the same full cycle, and no count is lost. Running counts are kept by a 64-bit key of the phrase, packed by ranges of the key: a
block counts by array sorts, and Spark shuffles and merges packed ranges. A key is a bijection of the key of all words
but the last and the last word's hash, and comes with that hash, so keys are read back into their words and each
text is put together once, by joins. This also proves the counts: a key that came with two last words or lengths, or a word whose
count by key is not its count by text, would mean that two phrases share a key. Then the survivors are counted
by their text in a scan of all blocks, and these counts are the result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bloom import BLOCK_BITS, PROBES, SEGMENTS, BlockedBloom, build
from .shared import forget, lean, small_batches, stored
from .texthash import mix, unmix, word_hashes

SHARDS = 4
LONGEST = 4
BLOCK_TOKENS = 1 << 18
BLOCKS_PER_FILE = 8  # of about 2 MB
SLICE = 1 << 20
BLOCK_BYTES = 1 << 24
HELD_ROWS, HELD_BYTES = 1 << 19, 1 << 25
NEVER = 1 << 14
LEAST_RANGES = 64
RANGE_TOKENS = 1 << 20
MOST_BLOCKS = 1 << 17  # of 64 bytes: no filter exceeds 8 MB
ODD = np.uint64(0xD6E8FEB86659FD93)
ODD_INVERSE = np.uint64(pow(int(ODD), -1, 2**64))

# Upper case to lower case, piece ends to line breaks, tabs to blanks.
_TABLE = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t.,;:!?\x0b\x0c\x0d", b"abcdefghijklmnopqrstuvwxyz " + b"\n" * 9)


def slices(data: bytes) -> Iterator[bytes]:
    """``data`` in parts of about ``SLICE`` bytes, cut at blanks, so that no word is cut."""
    at = 0
    while at < len(data):
        end = data.find(b" ", at + SLICE)
        end = len(data) if end < 0 else end
        yield data[at:end]
        at = end


def _encoded(texts: list[bytes]) -> tuple[np.ndarray, pa.Array]:
    """The words and piece ends of ``texts``, in order, as places in an array of different ones.

    Each slice is split and encoded by itself, so that words lie side by side for one slice only.
    """
    data = b"\n".join(texts).replace(b"\n", b" \n ")
    parts = [pc.split_pattern(pa.array([x], pa.binary()), b" ").values.dictionary_encode() for x in slices(data)]
    if len(parts) > 1:
        parts = pa.chunked_array(parts).unify_dictionaries().chunks
    return np.concatenate([x.indices.to_numpy() for x in parts]), parts[0].dictionary


class _Block:
    """Texts of one block by lang; ``tokens`` counts their blanks and piece ends, about as many as words and piece ends."""

    def __init__(self):
        self.texts: dict[str, list[bytes]] = {}
        self.tokens = self.bytes = 0

    def add(self, lang: str, text: str) -> None:
        data = text.encode().translate(_TABLE)
        self.texts.setdefault(lang, []).append(data)
        self.tokens += data.count(b" ") + data.count(b"\n") + 2
        self.bytes += len(data)

    def batch(self, shard: int) -> pa.RecordBatch:
        langs, ids, words, owner, sizes = list(self.texts), [], [pa.array([], pa.string())], [np.zeros(0, np.int32)], []
        base = 0
        for i, texts in enumerate(self.texts.values()):
            at, values = _encoded(texts)
            real = pc.and_(pc.not_equal(values, b"\n"), pc.not_equal(values, b""))
            is_word = real.to_numpy(zero_copy_only=False)
            number = np.where(is_word, base + np.cumsum(is_word) - 1, np.where(pc.equal(values, b"").to_numpy(zero_copy_only=False), -2, -1)).astype(np.int32)
            own = number[at]
            own = own[own > -2]
            ids += [own, np.array([-1], np.int32)]
            sizes.append(int((own >= 0).sum()))
            words.append(values.filter(real).cast(pa.string()))
            owner.append(np.full(len(words[-1]), i, np.int32))
            base += len(words[-1])
        words, owner = pa.concat_arrays(words), np.concatenate(owner)
        hashes = mix(single_hashes(words) + lang_hash(langs)[owner]) if len(owner) else np.zeros(0, np.uint64)
        listed = lambda x: pa.ListArray.from_arrays([0, len(x)], x)
        return pa.RecordBatch.from_arrays(
            [pa.array([shard], pa.int32()), listed(pa.array(langs, pa.string())), listed(pa.array(sizes, pa.int64())), listed(words),
             *(pa.array([x.tobytes()], pa.binary()) for x in (owner, hashes, np.concatenate(ids)))], schema=BLOCKS)

    def row(self, shard: int) -> dict:
        return self.batch(shard).to_pylist()[0]


BLOCKS = pa.schema([("shard", pa.int32()), ("langs", pa.list_(pa.string())), ("sizes", pa.list_(pa.int64())), ("words", pa.list_(pa.string())), ("owner", pa.binary()), ("hashes", pa.binary()), ("ids", pa.binary())])


def word_blocks(docs: DataFrame, shards: int, tokens: int) -> DataFrame:
    """Blocks of about ``tokens`` words and piece ends: the words in order as numbers, the dictionary, and per lang the words counted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, block = TaskContext.get().partitionId(), _Block()

        def full():
            return block.batch(number % shards)

        for b in batches:
            langs = b["lang"].to_pylist()
            for i, text in enumerate(b["text"]):
                block.add(langs[i], text.as_py())
                if block.tokens >= tokens or block.bytes >= BLOCK_BYTES:
                    yield full()
                    number, block = number + 1, _Block()
        if block.tokens:
            yield full()

    rows = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text").where(F.length("text") > 0)
    return rows.mapInArrow(lean(run), "shard int, langs array<string>, sizes array<bigint>, words array<string>, owner binary, hashes binary, ids binary")


@cache
def _text_hash(text: str) -> int:
    h = 0xCBF29CE484222325
    for c in text.encode():
        h = ((h ^ c) * 0x100000001B3) % 2**64
    return h


def lang_hash(langs) -> np.ndarray:
    return np.array([_text_hash(x) for x in langs], np.uint64)


def single_hashes(words: pa.Array) -> np.ndarray:
    """One hash per word (words hold no blanks and are not empty)."""
    return word_hashes(words, lower=False)[0]


def lengthened(prefix: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mix(prefix * ODD + word)


def shortened(keys: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The prefixes that ``lengthened`` by ``word`` give ``keys``."""
    return (unmix(keys) - word) * ODD_INVERSE


class Known:
    """The filters of all steps so far: which step first knew a phrase."""

    def __init__(self, filters: list[tuple[int, BlockedBloom]]):
        self.filters = filters

    def since(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), NEVER, np.int16)
        h = mix(keys)
        g = mix(h + np.uint64(0x9E3779B97F4A7C15))
        open_ = np.arange(len(keys))
        for step, bloom in self.filters:
            some = open_
            base = (((h[some] >> np.uint64(32)) * np.uint64(bloom.blocks)) >> np.uint64(32)) * np.uint64(8)
            for i in range(PROBES):
                bit = (g[some] >> np.uint64(9 * i)) & np.uint64(BLOCK_BITS - 1)
                word = bloom.words[(base + (bit >> np.uint64(6))).astype(np.int64)]
                hit = (word >> (bit & np.uint64(63))) & np.uint64(1) > 0
                some, base = some[hit], base[hit]
            out[some] = step
            open_ = open_[out[open_] == NEVER]
            if not len(open_):
                break
        return out


def count_block(ids, hashes, known: Known, longest: int, all_known: bool, window: int = 2 * BLOCK_TOKENS) -> Iterator[tuple]:
    """(keys, begin, held, word numbers per position, counts) of the words, and of the longer phrases whose
    subphrases are known: begin is the step that knows both, held the one that knows the phrase itself (of
    the longest phrases only if ``all_known``).

    A long block is counted in windows of phrase starts; a window sees the words behind it that its last phrases need.
    """
    held = known.since(hashes)
    yield hashes, np.zeros(len(hashes), np.int16), held, [np.arange(len(hashes))], np.bincount(ids[ids >= 0], minlength=len(hashes))
    if known.filters and len(hashes):
        for low in range(0, len(ids), window):
            yield from _grown(ids[low : low + window + longest - 1].astype(np.int64), window, hashes, held, known, longest, all_known)


def _grown(ids, window, hashes, word_since, known, longest, all_known) -> Iterator[tuple]:
    """Phrases of two words and more. ``at`` holds the starts of the phrases of the last length, ``since``
    when each is known, ``code`` its number among them; ``keys`` and ``columns`` hold key and words by number."""
    at, since, code = np.arange(len(ids)), np.where(ids >= 0, word_since[ids], NEVER), ids
    keys, columns = hashes, [np.arange(len(hashes))]
    for length in range(2, longest + 1):
        grows = np.flatnonzero((at[1:] == at[:-1] + 1) & (since[1:] < NEVER) & (since[:-1] < NEVER))
        if not len(grows):
            return
        at, begins, pair = at[grows], np.maximum(since[grows], since[grows + 1]), code[grows] << 32 | ids[at[grows] + length - 1]
        pair, code = np.unique(pair, return_inverse=True)
        begin = np.zeros(len(pair), np.int16)
        begin[code] = begins
        counts = np.bincount(code[at < window], minlength=len(pair))
        prefix, word = pair >> 32, pair & 0xFFFFFFFF
        columns = [c[prefix] for c in columns] + [word]
        keys = lengthened(keys[prefix], hashes[word])
        held = known.since(keys) if all_known or length < longest else None
        yield keys, begin, held, columns, counts
        if length < longest:
            # a false hit may be older than the subphrases, but the phrase is met only once these are known
            since = np.maximum(held, begin)[code]


RANGE = "p long, keys binary, counts binary, tags binary, last binary, since binary"


def active_counts(blocks: DataFrame, step: int, filters: list, shards: int, longest: int, ranges: int) -> DataFrame:
    """The counts of the active phrases of each block, packed by key range. A tag is 8 * start + length; last is a longer phrase's last word."""
    shared = blocks.sparkSession.sparkContext.broadcast(Known(filters))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ids, hashes in zip(b["ids"], b["hashes"]):
                keys, tags, counts, last = [], [], [], []
                hashes = np.frombuffer(hashes.as_buffer(), np.uint64)
                for key, begin, _, columns, count in count_block(np.frombuffer(ids.as_buffer(), np.int32), hashes, shared.value, longest, False):
                    active = np.flatnonzero((begin <= step) & (step < begin + shards) & (count > 0))
                    keys.append(key[active])
                    tags.append((8 * begin[active] + len(columns)).astype(np.int16))
                    counts.append(count[active].astype(np.int32))
                    last.append(hashes[columns[-1][active]] if len(columns) > 1 else np.zeros(len(active), np.uint64))
                keys, tags, counts, last = (np.concatenate(x) for x in (keys, tags, counts, last))
                p = ((keys >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)
                order = np.argsort(p, kind="stable")
                keys, tags, counts, last = keys[order], tags[order], counts[order], last[order]
                some, first = np.unique(p[order], return_index=True)
                ends = np.append(first[1:], len(keys))
                pack = lambda a: pa.array([a[x:y].tobytes() for x, y in zip(first, ends)], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int64)), pack(keys), pack(counts.astype(np.int64)), pack(tags), pack(last), pa.nulls(len(some), pa.binary())], ["p", "keys", "counts", "tags", "last", "since"])

    return blocks.select("ids", "hashes").mapInArrow(lean(run), RANGE)


def merge_ranges(step: int, shards: int, least: int, longest: int):
    """The merge of one key range after ``step`` steps: counts are summed, phrases that reach ``least`` are
    known from this step on, those that rest below it go. A key of two phrases gets a tag of length 0."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        keys = np.frombuffer(b"".join(pdf["keys"]), np.uint64)
        counts = np.frombuffer(b"".join(pdf["counts"]), np.int64)
        tags = np.frombuffer(b"".join(pdf["tags"]), np.int16)
        last = np.frombuffer(b"".join(pdf["last"]), np.uint64)
        since = np.concatenate([np.full(len(k) // 8, NEVER, np.int16) if s is None else np.frombuffer(s, np.int16) for k, s in zip(pdf["keys"], pdf["since"])])
        order = np.argsort(keys, kind="stable")
        keys, tags, last = keys[order], tags[order], last[order]
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
        if not len(first):
            return pd.DataFrame(columns=["p", "keys", "counts", "tags", "last", "since", "fresh"])
        shared = np.flatnonzero((keys[1:] == keys[:-1]) & ((last[1:] != last[:-1]) | ((tags[1:] ^ tags[:-1]) & 7 > 0)))
        keys, last, counts = keys[first], last[first], np.add.reduceat(counts[order], first)
        tags, since = np.maximum.reduceat(tags, first), np.minimum.reduceat(since[order], first)
        tags[np.searchsorted(first, shared, "right") - 1] &= ~7
        since[(since == NEVER) & (counts >= least)] = step
        kept = (since < NEVER) | ((tags >> 3) + shards > step)
        fresh = keys[(since == step) & ((tags & 7) < longest)]
        out = [a[kept].tobytes() for a in (keys, counts, tags, last, since)]
        return pd.DataFrame([[pdf["p"].iloc[0], *out, fresh.tobytes()]], columns=["p", "keys", "counts", "tags", "last", "since", "fresh"])

    return run


def filter_of(ranges: DataFrame, column: str) -> BlockedBloom | None:
    """A filter over packed keys; None without keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for keys in b[column]:
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(keys.as_buffer(), np.int64))], ["key"])

    n = ranges.agg(F.sum(F.octet_length(column))).first()[0] or 0
    return filter_of_keys(ranges.select(column).mapInArrow(lean(run), "key long"), n // 8)


def filter_of_keys(keys: DataFrame, n: int) -> BlockedBloom | None:
    """A filter over ``n`` keys of about 16 bits a key, up to ``MOST_BLOCKS`` blocks; None without keys."""
    blocks = min(MOST_BLOCKS, max(SEGMENTS, -(-n * 16 // BLOCK_BITS // SEGMENTS) * SEGMENTS))
    return build(keys, "key", blocks) if n else None


def survivors(blocks: DataFrame, least: int, shards: int, longest: int, ranges: int) -> DataFrame:
    """The packed ranges of the keys of all phrases of up to ``longest`` words with ``least`` occurrences, by dynamic counting."""
    filters: list[tuple[int, BlockedBloom]] = []
    running, step, last = None, 0, 0
    while step < last + shards:
        parts = active_counts(blocks.where(F.col("shard") == step % shards), step, filters, shards, longest, ranges)
        if running is not None:
            parts = parts.unionByName(running.drop("fresh"))
        step += 1
        new = stored(parts.groupBy("p").applyInPandas(merge_ranges(step, shards, least, longest), RANGE + ", fresh binary"))
        if running is not None:
            forget(running)
        running = new
        known = filter_of(running, "fresh")
        if known is not None:
            filters.append((step, known))
            last = step
    return running


def survivor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, prefix, last, len, f) of packed ranges: the key of all words but the last, and the last word's."""
    for b in batches:
        for packed in zip(b["keys"], b["counts"], b["tags"], b["last"]):
            keys, counts, tags, last = (np.frombuffer(x.as_buffer(), t) for x, t in zip(packed, (np.uint64, np.int64, np.int16, np.uint64)))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (keys.view(np.int64), shortened(keys, last).view(np.int64), last.view(np.int64), (tags & 7).astype(np.int32), counts)], ["key", "prefix", "last", "len", "f"])


def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, phrase, len, c) with the counts of a task's blocks added up, as long as ``HELD_ROWS`` rows and ``HELD_BYTES`` hold them."""
    held, rows, size = [], 0, 0
    for b in batches:
        held.append(b)
        rows, size = rows + b.num_rows, size + b.nbytes
        if rows >= HELD_ROWS or size >= HELD_BYTES:
            held = _added(held)
            rows, size = sum(x.num_rows for x in held), sum(x.nbytes for x in held)
            if 2 * rows >= HELD_ROWS or 2 * size >= HELD_BYTES:
                yield from held
                held, rows, size = [], 0, 0
    if rows:
        yield from _added(held)


def _added(batches: list[pa.RecordBatch]) -> list[pa.RecordBatch]:
    out = pa.Table.from_batches(batches).group_by(["lang", "phrase", "len"], use_threads=False).aggregate([("c", "sum")])
    return out.select(["lang", "phrase", "len", "c_sum"]).rename_columns(["lang", "phrase", "len", "c"]).to_batches(max_chunksize=1 << 16)


def counted_by_text(blocks: DataFrame, kept: BlockedBloom | None, least: int, longest: int) -> DataFrame:
    """(lang, phrase, len, f) of the phrases of up to ``longest`` words that ``kept`` holds, with f >= ``least``: one scan, by text."""
    shared = blocks.sparkSession.sparkContext.broadcast(Known([] if kept is None else [(1, kept)]))

    def counts_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                words, langs = b["words"][i].values, b["langs"][i].values
                owner = np.frombuffer(b["owner"][i].as_buffer(), np.int32)
                ids, hashes = np.frombuffer(b["ids"][i].as_buffer(), np.int32), np.frombuffer(b["hashes"][i].as_buffer(), np.uint64)
                for _, _, held, columns, counts in count_block(ids, hashes, shared.value, longest, True):
                    some = np.flatnonzero((held < NEVER) & (counts > 0))
                    each = [words.take(pa.array(c[some])) for c in columns]
                    phrase = pc.binary_join_element_wise(*each, " ") if len(each) > 1 else each[0]
                    yield pa.RecordBatch.from_arrays([langs.take(pa.array(owner[columns[0][some]])), phrase, pa.array(np.full(len(some), len(each), np.int32)), pa.array(counts[some].astype(np.int64))], ["lang", "phrase", "len", "c"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return summed(counts_of(batches))

    counted = blocks.select("langs", "words", "owner", "ids", "hashes").mapInArrow(lean(run), "lang string, phrase string, len int, c long")
    return stored(counted.groupBy("lang", "phrase", "len").agg(F.sum("c").alias("f")).where(F.col("f") >= least))


def with_word_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, lang, phrase, f) of words."""
    for b in batches:
        if b.num_rows:
            keys = mix(single_hashes(b["phrase"]) + lang_hash(b["lang"].to_pylist()))
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), b["lang"], b["phrase"], b["f"]], ["key", "lang", "phrase", "f"])


def named(found: DataFrame, words: DataFrame, longest: int) -> DataFrame | None:
    """(lang, phrase, len, f) of the survivors ``found``; None if a key may stand for two phrases.

    ``words`` holds the frequent words with their counts by text. A key that came with one length and one last word
    has one prefix, so it stands for one phrase if its prefix does; a word's key does if all its count is that word's.
    """
    by_key = found.where("len = 1").select("key", F.col("f").alias("by_key"))
    proof = words.join(by_key, "key", "full").where(~F.col("f").eqNullSafe(F.col("by_key")))
    if not found.where("len = 0").isEmpty() or not proof.isEmpty():
        return None
    levels = [words.select("key", "lang", "phrase", F.lit(1).alias("len"), "f")]
    ends = words.select(F.col("key").alias("last"), F.col("phrase").alias("end"))
    for n in range(2, longest + 1):
        heads = levels[-1].select(F.col("key").alias("prefix"), "lang", F.col("phrase").alias("head"))
        rows = found.where(F.col("len") == n).join(ends, "last").join(heads, "prefix")
        levels.append(stored(rows.select("key", "lang", F.concat_ws(" ", "head", "end").alias("phrase"), "len", "f")))
    out = levels[0]
    for x in levels[1:]:
        out = out.unionByName(x)
    return out.select("lang", "phrase", "len", "f")


def frequent_phrases(blocks: DataFrame, least: int, shards: int = SHARDS, longest: int = LONGEST) -> DataFrame:
    """(lang, phrase, len, f) of all phrases of up to ``longest`` words with f >= ``least``."""
    tokens = blocks.agg(F.sum(F.octet_length("ids"))).first()[0] or 0
    running = survivors(blocks, least, shards, longest, max(LEAST_RANGES, tokens // 4 // RANGE_TOKENS))
    found = stored(running.select("keys", "counts", "tags", "last").mapInArrow(lean(survivor_rows), "key long, prefix long, last long, len int, f long"))
    words = counted_by_text(blocks, filter_of_keys(found.where("len < 2"), found.where("len < 2").count()), least, 1)
    words = stored(words.mapInArrow(lean(with_word_keys), "key long, lang string, phrase string, f long"))
    out = named(found, words, longest)
    if out is None:
        out = counted_by_text(blocks, filter_of_keys(found, found.count()), least, longest)
    forget(running)
    return out


def collocations(docs: DataFrame, least: int = 30, top: int = 2000, covered: int = 80, shards: int = SHARDS, longest: int = LONGEST, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each lang's best ``top`` phrases of 2 to ``longest`` words.

    Words are lower-cased in A-Z, pieces end at ``[.,;:!?]`` and line breaks. A phrase counts with
    ``least`` occurrences; its score is the least over its cuts of floor(2000000 * a / (l + r)). A phrase
    goes if a longer frequent one holds it and has ``covered`` percent of its occurrences or more.
    A null lang is ``und``, a null text empty. Repeated rows count each. An empty table gives no row; other columns are ignored.
    """
    blocks = stored(word_blocks(small_batches(docs), shards, block_tokens), BLOCKS_PER_FILE)
    totals = blocks.select(F.explode(F.arrays_zip("langs", "sizes")).alias("x")).groupBy(F.col("x.langs").alias("lang")).agg(F.sum("x.sizes").alias("n"))
    counts = frequent_phrases(blocks, least, shards, longest)
    words = F.split("phrase", " ")
    longer = counts.where("len > 1").select("lang", "phrase", "len", F.col("f").alias("a"), words.alias("w"))
    cut = longer.select("lang", "phrase", "a", "w", F.explode(F.sequence(F.lit(1), F.col("len") - 1)).alias("k"))
    cut = cut.select("lang", "phrase", "a", "k", F.expr("array_join(slice(w, 1, k), ' ')").alias("left"), F.expr("array_join(slice(w, k + 1, size(w) - k), ' ')").alias("right"))
    for side, name in (("left", "l"), ("right", "r")):
        cut = cut.join(counts.select("lang", F.col("phrase").alias(side), F.col("f").alias(name)), ["lang", side])
    score = F.expr("(CAST(2000000 AS DECIMAL(7,0)) * CAST(a AS DECIMAL(20,0))) div (CAST(l AS DECIMAL(20,0)) + CAST(r AS DECIMAL(20,0)))").cast("long")
    scored = cut.withColumn("score", score).groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.min(F.struct("score", "k", "l", "r")).alias("s"))
    inner = longer.where("len > 2").select("lang", "a", "w", F.explode(F.sequence(F.lit(2), F.col("len") - 1)).alias("m"))
    inner = inner.select("lang", "a", "w", "m", F.explode(F.expr("sequence(1, size(w) - m + 1)")).alias("i"))
    inner = inner.select("lang", F.expr("array_join(slice(w, i, m), ' ')").alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("most"))
    kept = scored.join(inner, ["lang", "phrase"], "left").where(F.col("most").isNull() | (F.expr("CAST(100 AS DECIMAL(3,0)) * CAST(most AS DECIMAL(20,0))") < F.expr(f"CAST({int(covered)} AS DECIMAL(3,0)) * CAST(a AS DECIMAL(20,0))")))
    kept = kept.select("lang", "phrase", "a", "s.l", "s.r", "s.score")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = kept.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
    return best.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
