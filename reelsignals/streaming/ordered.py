"""Streams that need a key's rows in order: a buffer per key, released by the watermark.

Rows may come in any order across files and micro-batches. A row waits in its key's state until the clock
(the newest event time of the stream less ``late``) has passed it; then the rows that are due go through the fold in
order. A row that comes after its place was folded is not folded and not lost: it comes out with ``late`` set
and empty values. State ends ``ttl`` of event time after the last row of a key. What is held is the
fold's state and the rows of the last ``late`` of event time, of all keys that one hash bucket holds.
"""

from __future__ import annotations

import json
from collections import namedtuple
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

FAR = 2**62
#: Groups of keys that share one state; a call of Spark's operator costs milliseconds, so short keys do not get one each.
BUCKETS = 1 << 13


def _plain(value):
    return value.tolist() if isinstance(value, (np.ndarray, np.generic)) else value


def _whole(values: pd.Series, integral: bool) -> list:
    """A column as plain values; whole numbers stay whole beside nulls, which pandas holds as NaN."""
    if values.dtype.kind == "O":
        return [_plain(v) for v in values]
    return [v if v != v else int(v) for v in values.tolist()] if integral and values.dtype.kind == "f" else values.tolist()


def ordered_fold_stream(rows: DataFrame, keys: Sequence[str], at: str, order: str, make: Callable[[], object], schema: str,
                        late: str = "10 seconds", ttl: str = "7 days", column: str = "late", buckets: int = BUCKETS) -> DataFrame:
    """Fold the rows of each key in the order of ``order``, which rises with the event time ``at`` (a timestamp).

    ``make()`` returns a fold with ``step(row)``, ``dump`` and ``load``; ``schema`` names the keys (whole numbers or texts), then
    ``order``, then the other outputs. ``column`` is true for a row that came too late. A key is forgotten ``ttl`` after its
    last row; a row that comes later still starts it anew. ``buckets`` is fixed for the life of a checkpoint.
    """
    names = [c.strip().split(" ")[0] for c in schema.split(",")] + [column]
    keys = list(keys)
    keep, wait = (int(pd.Timedelta(x).total_seconds() * 1000) for x in (ttl, late))
    cols = [c for c in rows.columns if c != at]
    integral = [f.dataType.typeName() in ("byte", "short", "integer", "long") for f in rows.select(*cols).schema]
    record = namedtuple("record", cols)
    place, width = cols.index(order), len(names) - len(keys) - 2

    def step(bucket, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        # by key: place of its last folded row, its newest time, its fold, how many of its rows wait
        held, waiting, first = (json.loads(state.get[0]), state.get[1], state.get[2]) if state.exists else ({}, "", FAR)
        behind, out, new = state.getCurrentWatermarkMs(), [], {}
        now = behind + wait if behind > 0 else -FAR

        def head(name):
            key = json.loads(name)
            return tuple(key.get(k) for k in keys)

        for pdf in batches:
            values = zip(*(_whole(pdf[c], whole) for c, whole in zip(cols, integral)))
            for name, t, row in zip(pdf["__key"].tolist(), pdf["__at"].tolist(), values):
                own = held.get(name)
                if own is None:
                    own = held[name] = [-FAR, -FAR, None, 0]
                if row[place] <= own[0]:
                    out.append((*head(name), row[place], *[None] * width, True))
                else:
                    new.setdefault(name, []).append((t, row))
                    own[3] += 1
                    first = min(first, t)
                own[1] = max(own[1], t)
        if first <= now:  # rows that wait are read again only when one of them is due
            every: dict[str, list] = {}
            for part in [*map(json.loads, waiting.splitlines()), new]:
                for name, some in part.items():
                    every.setdefault(name, []).extend(some)
            waiting, new, first = "", {}, FAR
            for name, some in every.items():
                own, due, rest = held[name], [r for t, r in some if t <= now], [w for w in some if w[0] > now]
                if due:
                    fold, front = make() if own[2] is None else make().load(own[2]), head(name)
                    for row in sorted(due, key=lambda r: r[place]):
                        out += [(*front, *o, False) for o in fold.step(record(*row))]
                        own[0] = max(own[0], int(row[place]))
                    own[2], own[3] = fold.dump(), len(rest)
                if rest:
                    new[name], first = rest, min(first, min(w[0] for w in rest))
        if new:
            waiting += json.dumps(new, separators=(",", ":")) + "\n"
        gone = [name for name, own in held.items() if not own[3] and own[1] + keep <= now]
        for name in gone:
            del held[name]
        if held:
            state.update((json.dumps(held, separators=(",", ":")), waiting, first))
            state.setTimeoutTimestamp(max(behind, min([first, *(own[1] + keep for own in held.values() if not own[3])]) - wait) + 1)
        elif state.exists:
            state.remove()
        if out:
            yield pd.DataFrame(out, columns=names)

    # Spark drops rows behind its watermark before the operator sees them, so that one stays another ``late`` behind the clock used here
    marked = rows.withWatermark(at, f"{2 * wait} milliseconds").select(
        *cols, at, F.floor(F.unix_micros(F.col(at)) / 1000).alias("__at"), F.to_json(F.struct(*keys)).alias("__key"),
        F.pmod(F.xxhash64(*keys), F.lit(buckets).cast("bigint")).alias("__bucket"))
    return marked.groupBy("__bucket").applyInPandasWithState(
        step, f"{schema}, {column} boolean", "held string, waiting string, first long", "append", GroupStateTimeout.EventTimeTimeout)
