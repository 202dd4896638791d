"""Operator 11: reply trees to formatted conversations.

A message names its parent. Self-joins with doubled reach give every message the ancestor
2^i steps up, and the sum of scores on the way, in about log2(depth) rounds of narrow rows; a
message whose jumps end has found its root. Leaves are then ranked in their tree by the score
of their whole path. For the chosen leaves the jumps are played back from the widest to the
narrowest, each round doubling the members found, until every path holds all its messages.
Only then do the texts come in: one join on the message, one exchange by path. A task streams the
messages of its paths in order and writes marked turns in segments of bounded length, so a
conversation never lies in memory as a whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from ..operators.ordered import shifted
from .chat_template import BEGIN, parse, render, unescape
from .shared import forget, stored

SEGMENT = 1 << 20
CHUNK_TURNS = 8192
SPANS = ArrayType(StructType().add("start", "long").add("end", "long"))


def jumps(messages: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Jump tables (node, up), the i-th with the ancestors 2^i steps up of the messages that have one,
    and (node, root, hops, total) of every message: its root, the length and the score of the path to it.

    A parent that is no message makes its child a root. Messages whose parents run in a
    circle have no root and are left out.
    """
    links = messages.select("node", F.col("parent").alias("up"), F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("total"))
    known = messages.select(F.col("node").alias("up")).where("up is not null").distinct()
    child = links.where("up is not null")
    start = child.join(known, "up", "left_semi").select("node", "up", F.lit(None).cast("long").alias("root"), F.lit(1).cast("long").alias("hops"), "total")
    ends = links.where("up is null").unionByName(child.join(known, "up", "left_anti")).select("node", F.col("node").alias("root"), F.lit(1).cast("long").alias("hops"), "total")
    open_, ended, n, levels = stored(start), stored(ends), messages.count(), []
    while 2 ** len(levels) <= n and open_.take(1):
        levels.append(open_)
        at = open_.unionByName(ended, allowMissingColumns=True).select(F.col("node").alias("up"), F.struct(F.col("up").alias("up"), "root", "hops", "total").alias("b"))
        further = stored(open_.join(at, "up").select(
            "node", F.col("b.up").alias("up"), F.col("b.root").alias("root"), (F.col("hops") + F.col("b.hops")).alias("hops"), (F.col("total") + F.col("b.total")).alias("total")))
        open_ = further.where("up is not null")
        ended = ended.unionByName(further.where("up is null").drop("up"))
    return levels, ended


def best_paths(messages: DataFrame, best: int = 1) -> DataFrame:
    """(path, tree, rank, score, pos, node): the ``best`` root-to-leaf paths of every tree, message by message.

    path is the leaf's node, pos counts from the root. Paths are ranked by the sum of their scores
    (null counts 0), ties to the longer path, then to the smaller leaf.
    """
    levels, ends = jumps(messages)
    parents = messages.select(F.col("parent").alias("node")).where("node is not null").distinct()
    leaves = messages.select("node", F.struct("tree").alias("tree")).join(parents, "node", "left_anti").join(ends, "node")
    order = Window.partitionBy("tree").orderBy(F.desc("total"), F.desc("hops"), "node")
    chosen = leaves.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best)
    members = stored(chosen.select(F.col("node").alias("path"), "tree", "rank", F.col("total").alias("score"), (F.col("hops") - 1).alias("pos"), "node"))
    for i in reversed(range(len(levels))):
        further = members.join(levels[i].select("node", "up"), "node").select("path", "tree", "rank", "score", (F.col("pos") - 2**i).alias("pos"), F.col("up").alias("node"))
        new = stored(members.unionByName(further))
        forget(members)
        members = new
    return members.select("path", "tree.tree", "rank", "score", "pos", "node")


def formatted(messages: DataFrame, best: int = 1, segment: int = SEGMENT) -> DataFrame:
    """tree, path, rank, score, segment, text, loss: each chosen path as one conversation.

    A conversation is its segments joined in order; a segment ends with the turn that takes it to
    ``segment`` code points or more. ``loss`` holds the bounds (start, end) in the segment's text of
    the assistant's words. ``messages`` (a table scan or a projection of one): tree, node, parent, role,
    text, score; node is unique. Null roles and texts are empty, repeated rows are messages of their own,
    an empty table gives no row, other columns are ignored. Rows come path by path, segments in order.
    """
    texts = messages.select("node", "role", "text")
    rows = best_paths(messages, best).join(texts, "node").repartition("path").sortWithinPartitions("path", "pos")
    rows = rows.select("tree", "path", "rank", "score", "role", "text")
    kind = rows.drop("role", "text").schema.add("segment", "long").add("text", "string").add("loss", SPANS)
    names = kind.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, number, length, parts, loss = None, 0, 0, [], []
        out, held = [], 0

        def close():
            out.append({**head, "segment": number, "text": "".join(parts), "loss": loss})

        def packed(schema):
            return pa.RecordBatch.from_pylist(out, schema=schema)

        schema = None
        for b in batches:
            schema = schema or pa.schema([b.schema.field(n) for n in ("tree", "path", "rank", "score")] + [
                pa.field("segment", pa.int64()), pa.field("text", b.schema.field("text").type),
                pa.field("loss", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])
            for row in b.to_pylist():
                role, text = row.pop("role"), row.pop("text")
                if head is None or row["path"] != head["path"]:
                    if head is not None and parts:
                        close()
                    head, number, length, parts, loss = row, 0, len(BEGIN), [BEGIN], []
                turn, start, end = render(role, text)
                if role == "assistant":
                    loss.append({"start": length + start, "end": length + end})
                parts.append(turn)
                length += len(turn)
                held += len(turn)
                if length >= segment:
                    close()
                    number, length, parts, loss = number + 1, 0, [], []
                if held >= 16 * SEGMENT or len(out) >= 4096:
                    yield packed(schema)
                    out, held = [], length
        if head is not None and parts:
            close()
        if out:
            yield packed(schema)

    return rows.mapInArrow(run, kind).select(*names)


def read_back(conversations: DataFrame) -> DataFrame:
    """tree, path, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars of ``formatted`` rows as
    they come (path by path, segments in order), parsed from text and loss."""
    kind = conversations.select("tree", "path").schema
    for name in ("n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"):
        kind = kind.add(name, "string" if name.endswith("256") else "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None

        def ended(s):
            return {"tree": s[0], "path": s[1], "n_turns": s[2], "turns_sha256": s[3].hexdigest(), "loss_chars": s[4], "loss_sha256": s[5].hexdigest(), "formatted_chars": s[6]}

        schema = None
        for b in batches:
            schema = schema or pa.schema([b.schema.field("tree"), b.schema.field("path"), ("n_turns", pa.int64()), ("turns_sha256", pa.string()),
                                          ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
            out = []
            for row in b.to_pylist():
                if state is None or state[1] != row["path"]:
                    if state is not None:
                        out.append(ended(state))
                    state = [row["tree"], row["path"], 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text in parse(row["text"]):
                    state[2] += 1
                    state[3].update(f"{role}\n{text}\n".encode())
                for span in row["loss"]:
                    learned = unescape(row["text"][span["start"] : span["end"]])
                    state[4] += len(learned)
                    state[5].update(learned.encode())
                state[6] += len(row["text"])
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=schema)
        if state is not None:
            yield pa.RecordBatch.from_pylist([ended(state)], schema=schema)

    return conversations.select("tree", "path", "text", "loss").mapInArrow(run, kind)


def threads(conversations: DataFrame) -> DataFrame:
    """Linear conversations (conv_id, turn, role, text) as messages, each the child of the turn before.

    Turns come in order of turn (null last), then role, then the md5 of the text; rows without a
    conv_id form one conversation. The score of a message is the length of an assistant's text.
    """
    rows = conversations.select("conv_id", "turn", "role", "text").withColumn("node", F.monotonically_increasing_id())
    place = F.struct(F.col("turn").isNull().alias("late"), F.col("turn").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.md5(F.coalesce("text", F.lit(""))).alias("text"), "node")
    chunk = F.coalesce(F.floor(F.col("turn") / CHUNK_TURNS), F.lit(2**62)).cast("long")
    narrow = rows.select("conv_id", "node", place.alias("place"), chunk.alias("part"))
    linked = shifted(narrow, ["conv_id"], "place", {"parent": F.col("node")}, chunk=F.col("part")).select("node", "parent")
    score = F.when(F.col("role") == "assistant", F.length("text")).otherwise(0)
    return rows.join(stored(linked), "node").select(F.col("conv_id").alias("tree"), "node", "parent", "role", "text", score.alias("score"))
