"""Sequential folds over the chunks of a key in parallel, by speculation.

A key's rows are cut into chunks of ``frames`` order values. Every chunk is folded at once, from a guess of
its first state: the state that the last ``warm`` values of the chunk before lead to. State machines and
smoothers forget, so most guesses are the true state. A chunk's state before and behind its rows rests as
text, and a guess is right exactly when it equals the text behind the chunk before; only chunks with a
wrong guess are folded again, from the state now known. A round settles at least the first wrong chunk
of every key and, where states forget, nearly all. Keys that remember for longer than ``rounds`` rounds are folded
from their first wrong chunk to the end in one stream, so the number of jobs has a bound. The
result is that of the plain fold in every case.

Chunks shorter than ``RUN_FRAMES`` order values are joined to runs of about that many: a task folds a run's chunks one
after another, so only the first chunk of a run needs a guess, and rows of keys that fit a run are folded once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import durable

CHUNK_FRAMES = 8192
RUN_FRAMES = 8192
WARM_FRAMES = 512
ROUNDS = 4
STATE = "__chunk bigint, __in string, __out string"


def _folded(rows: DataFrame, by: Sequence[str], order: str, make: Callable[[], object], schema: str, head: Sequence[str]) -> DataFrame:
    """Fold the rows of each ``by`` group in order. A group starts from ``__state`` or anew, runs through its ``__warm`` rows
    without output, and tells its states before and behind the other rows with the last one it puts out."""
    names = [c.strip().split(" ")[0] for c in schema.split(",")] + ["__chunk", "__in", "__out"]
    by, head = list(by), list(head)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, fold, before, last = None, None, None, None
        for pdf in batches:
            out = []
            groups, warm, states, chunks = list(zip(*(pdf[c] for c in by))), pdf["__warm"].to_numpy(), pdf["__state"].to_numpy(), pdf["__chunk"].to_numpy()
            heads = list(zip(*(pdf[c] for c in head)))
            plain = pdf.drop(columns=["__warm", "__state", "__chunk"])
            for i, row in enumerate(plain.itertuples(index=False)):
                if groups[i] != current:
                    if last is not None:
                        out.append(last + (before, fold.dump()))
                    current, fold, before, last = groups[i], make(), None, None
                    if states[i] is not None:
                        fold.load(states[i])
                if warm[i]:
                    fold.step(row)
                    continue
                if last is not None:
                    out.append(last + (None, None))
                else:
                    before = fold.dump()
                (one,) = fold.step(row)
                last = (*heads[i], *one, int(chunks[i]))
            if out:
                yield pd.DataFrame(out, columns=names)
        if last is not None:
            yield pd.DataFrame([last + (before, fold.dump())], columns=names)

    # a stated number: few bytes are much work here, and adaptive execution joins partitions by their bytes
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(tasks, *by).sortWithinPartitions(*by, order)
    return rows.mapInPandas(run, f"{schema}, {STATE}")


def chunk_fold(df: DataFrame, keys: Sequence[str], order: str, make: Callable[[], object], schema: str,
               frames: int | None = None, warm: int | None = None, rounds: int = ROUNDS, run: int | None = None) -> DataFrame:
    """Fold every key's rows in the order of an integer column, many runs of chunks of a key at a time (``run``: the
    order values of a run, whole chunks; one chunk at least).

    ``make()`` returns a fold whose ``step(row)`` gives one output tuple per row, with ``dump``
    and ``load`` of its whole state as text. ``schema`` names the keys first.
    """
    frames, warm = frames or CHUNK_FRAMES, WARM_FRAMES if warm is None else warm
    frames *= max(1, (RUN_FRAMES if run is None else run) // frames)
    keys, parts = list(keys), [*keys, "__chunk"]
    chunk = F.floor(F.col(order) / frames).cast("bigint")
    place = lambda c, w: F.struct(c.alias("chunk"), F.lit(w).alias("warm"))
    late = F.pmod(F.col(order), F.lit(frames)) >= frames - warm
    places = F.when(late, F.array(place(chunk, False), place(chunk + 1, True))).otherwise(F.array(place(chunk, False)))
    rows = df.withColumn("__p", F.explode(places)).select(*df.columns, F.col("__p.chunk").alias("__chunk"), F.col("__p.warm").alias("__warm"))
    done = durable(_folded(rows.withColumn("__state", F.lit(None).cast("string")), parts, order, make, schema, keys))
    along = Window.partitionBy(*keys).orderBy("__chunk")
    for n in range(rounds + 1):
        ends = done.where(F.col("__out").isNotNull()).select(*parts, "__in", "__out")
        wrong = ends.withColumn("__state", F.lag("__out").over(along)).where(F.col("__state") != F.col("__in")).select(*parts, "__state")
        if wrong.isEmpty():
            break
        own = df.withColumn("__chunk", chunk).withColumn("__warm", F.lit(False))
        if n < rounds:
            again = _folded(own.join(wrong, parts), parts, order, make, schema, keys)
            kept = done.join(wrong.select(*parts), parts, "left_anti")
        else:
            first = wrong.groupBy(*keys).agg(F.min_by("__state", "__chunk").alias("__state"), F.min("__chunk").alias("__from"))
            again = _folded(own.join(first, keys).where(F.col("__chunk") >= F.col("__from")).drop("__from"), keys, order, make, schema, keys)
            kept = done.join(first.select(*keys, "__from"), keys, "left").where(F.col("__from").isNull() | (F.col("__chunk") < F.col("__from"))).drop("__from")
        done = durable(kept.select(*done.columns).unionByName(again))
    return done.drop("__chunk", "__in", "__out")
