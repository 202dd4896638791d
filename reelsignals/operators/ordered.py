"""Ordered operators that survive hot keys.

A plain ``Window.partitionBy(key)`` puts all rows of a key into one task. Here
each key is cut into *chunks* of its order column: the heavy window runs per
(key, chunk), one summary row per chunk is scanned per key, and the result is
joined back. A key that holds a third of all rows becomes many tasks, and the
only per-key work left is one row per chunk.

Key and chunk number rest in one struct column. Structs with null fields are equal, so
rows with a null key or order value are kept by a plain equi-join, and the join and the
window that follows it share one exchange of the rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK_ROWS = 8192
CHUNK = "__chunk"


def dense_chunk(order, rows: int | None = None) -> Column:
    """Chunk number for an order column that counts rows (frame, word index)."""
    col = F.col(order) if isinstance(order, str) else order
    return F.floor(col / F.lit(rows or CHUNK_ROWS)).cast("bigint")


def chunked(df: DataFrame, order: str, chunk: Column | None = None) -> DataFrame:
    return df.withColumn(CHUNK, dense_chunk(order) if chunk is None else chunk)


def is_laid(df: DataFrame, keys: Sequence[str]) -> bool:
    """Do the rows bring the chunk column of ``keyed`` along? They lie by it, then, and need not be moved."""
    return CHUNK in df.columns and getattr(df.schema[CHUNK].dataType, "names", None) == [*keys, "__no"]


def keyed(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Put the keys into the chunk column."""
    return df if is_laid(df, keys) else df.withColumn(CHUNK, F.struct(*keys, F.col(CHUNK).alias("__no")))


def chunk_window(order: Sequence[str]):
    """The rows of one chunk of one key (see ``keyed``)."""
    return Window.partitionBy(CHUNK).orderBy(*order)


def with_carry(
    df: DataFrame,
    keys: Sequence[str],
    summary: Mapping[str, Column],
    carried: Mapping[str, Callable[[object], Column]],
) -> DataFrame:
    """Join every row with columns computed over the chunk summaries of its key.

    ``summary`` aggregates a chunk (map-side combined); each ``carried`` function
    gets the window over the chunks of a key and returns the column to bring back.
    """
    df = keyed(df, keys)
    parts = df.groupBy(*keys, CHUNK).agg(*[c.alias(n) for n, c in summary.items()])
    w = Window.partitionBy(*keys).orderBy(CHUNK)
    return df.join(parts.select(CHUNK, *[fn(w).alias(n) for n, fn in carried.items()]), CHUNK)


def before(w):
    """All earlier chunks."""
    return w.rowsBetween(Window.unboundedPreceding, -1)


def number_rows(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], out: str, chunk: Column, start: int = 0
) -> DataFrame:
    """Row number per key, for an order that is not dense yet; ``chunk`` must rise with it."""
    d = df.withColumn(CHUNK, chunk)
    d = with_carry(
        d, keys, {"__n": F.count(F.lit(1))},
        {"__off": lambda w: F.coalesce(F.sum("__n").over(before(w)), F.lit(0))},
    )
    local = F.row_number().over(chunk_window(order))
    return d.withColumn(out, F.col("__off") + local - 1 + start).drop(CHUNK, "__off")


def running_sum(
    df: DataFrame, keys: Sequence[str], order: str, value: Column, out: str,
    chunk: Column | None = None, inclusive: bool = True, tie: Sequence[str] = (),
) -> DataFrame:
    """Sum of ``value`` over the rows up to (or before) each row of its key."""
    d = chunked(df, order, chunk).withColumn("__v", value)
    d = with_carry(
        d, keys, {"__t": F.sum("__v")},
        {"__off": lambda w: F.coalesce(F.sum("__t").over(before(w)), F.lit(0))},
    )
    w = chunk_window([order, *tie]).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total = F.col("__off") + F.sum("__v").over(w)
    if not inclusive:
        total = total - F.col("__v")
    return d.withColumn(out, total).drop(CHUNK, "__off", "__v", "__t")


def exponential_means(
    df: DataFrame, keys: Sequence[str], order: str, values: Mapping[str, Column], alpha: float, chunk: Column | None = None,
    chunk_rows: int | None = None,
) -> DataFrame:
    """s = alpha * x + (1 - alpha) * s along each key, started at the first x, without a loop.

    A step is the affine map s -> r * s + b. A run of steps is one too: its offset is a sum of weighted x, which
    a window gives inside a chunk, and chunks are composed by their offsets alone where r to the power of the
    chunk's length is nothing in double precision; a chunk is as long as the weights allow, or ``chunk_rows``
    with up to eight chunks composed. Values differ
    from those of the loop by rounding only.
    """
    r = 1.0 - alpha
    falls = -math.log10(r)
    rows = max(chunk_rows or int(280 / falls), math.ceil(5 / falls), 2)
    d = number_rows(df, keys, [order], "__n", chunk=dense_chunk(order) if chunk is None else chunk)
    d = d.withColumn(CHUNK, F.floor(F.col("__n") / rows).cast("bigint")).withColumn("__i", F.col("__n") % rows)
    up, down = F.pow(F.lit(1.0 / r), F.col("__i")), F.pow(F.lit(r), F.col("__i"))
    offset = lambda x: F.when(F.col("__n") == 0, x).otherwise(alpha * x) * up
    summary = {f"__t_{n}": F.sum(offset(x)) * F.pow(F.lit(r), F.max("__i")) for n, x in values.items()}
    steps = math.ceil(40 / (falls * rows))
    # the state behind a chunk: its own offset and those of the chunks before that still count
    behind = lambda n, w: sum((F.lag(f"__t_{n}", i + 1).over(w) if i == 0 else F.coalesce(F.lag(f"__t_{n}", i + 1).over(w) * r ** (rows * i), F.lit(0.0)) for i in range(steps)), F.lit(0.0))
    d = with_carry(d, keys, summary, {f"__in_{n}": lambda w, n=n: F.coalesce(behind(n, w), F.lit(0.0)) for n in values})
    w = chunk_window(["__i"]).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    for n, x in values.items():
        d = d.withColumn(n, F.col(f"__in_{n}") * down * r + F.sum(offset(x)).over(w) * down)
    return d.drop(CHUNK, "__n", "__i", *[f"__in_{n}" for n in values])


def shifted(
    df: DataFrame, keys: Sequence[str], order: str, values: Mapping[str, Column],
    chunk: Column | None = None, forward: bool = False,
) -> DataFrame:
    """``lag`` (or ``lead``) by one row of several values, across chunk borders.

    The values are put together behind the exchange, so rows bring their columns only once.
    """
    several = F.struct(*[c.alias(n) for n, c in values.items()])
    edge = F.min_by(several, order) if forward else F.max_by(several, order)
    move = F.lead if forward else F.lag
    d = with_carry(chunked(df, order, chunk), keys, {"__e": edge}, {"__in": lambda w: move("__e").over(w)})
    local = move(several).over(chunk_window([order]))
    d = d.withColumn("__p", F.coalesce(local, F.col("__in")))
    return d.select(
        "*", *[F.col("__p")[n].alias(n) for n in values]
    ).drop(CHUNK, "__in", "__p")


def last_known(
    df: DataFrame, keys: Sequence[str], order: str, value: Column, out: str,
    chunk: Column | None = None, fallback: Column | None = None,
    first_value: Column | None = None,
) -> DataFrame:
    """Latest non-null ``value`` up to each row; before any, the first non-null
    ``first_value`` of the key (if given), then ``fallback``."""
    look_ahead = first_value is not None
    d = chunked(df, order, chunk).withColumn("__v", value)
    d = d.withColumn("__w", first_value if look_ahead else F.lit(None))
    summary = {
        "__l": F.max_by("__v", F.when(F.col("__v").isNotNull(), F.col(order))),
    }
    carried = {"__in": lambda w: F.last("__l", ignorenulls=True).over(before(w))}
    if look_ahead:
        summary["__f"] = F.min_by("__w", F.when(F.col("__w").isNotNull(), F.col(order)))
        carried["__first"] = lambda w: F.first("__f", ignorenulls=True).over(
            w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        )
    d = with_carry(d, keys, summary, carried)
    w = chunk_window([order]).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    tries = [F.last("__v", ignorenulls=True).over(w), F.col("__in")]
    if look_ahead:
        tries.append(F.col("__first"))
    if fallback is not None:
        tries.append(fallback)
    return d.withColumn(out, F.coalesce(*tries)).drop(CHUNK, "__v", "__w", "__in", "__first")


def islands(
    df: DataFrame, keys: Sequence[str], order: str, flag: Column, out: str = "island",
    chunk: Column | None = None,
) -> DataFrame:
    """Number the runs of equal ``flag`` values per key (gaps and islands)."""
    d = keyed(chunked(df, order, chunk), keys).withColumn("__f", F.struct(flag.alias("v")))
    w = chunk_window([order])
    prev = F.lag("__f").over(w)
    d = d.withColumn(
        "__c", F.when(prev.isNull() | prev.eqNullSafe(F.col("__f")), 0).otherwise(1).cast("bigint")
    )
    border = lambda w_: F.when(
        F.lag("__b").over(w_).isNull() | F.lag("__b").over(w_).eqNullSafe(F.col("__a")), 0
    ).otherwise(1)
    parts = d.groupBy(*keys, CHUNK).agg(
        F.min_by("__f", order).alias("__a"), F.max_by("__f", order).alias("__b"),
        F.sum("__c").alias("__n"),
    )
    wk = Window.partitionBy(*keys).orderBy(CHUNK)
    side = parts.select(*keys, CHUNK, "__n", border(wk).cast("bigint").alias("__d")).select(
        CHUNK,
        (F.sum(F.col("__n") + F.col("__d")).over(wk.rowsBetween(Window.unboundedPreceding, 0))
         - F.col("__n")).alias("__off"),
    )
    d = d.join(side, CHUNK)
    run = F.sum("__c").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return d.withColumn(out, F.col("__off") + run).drop(CHUNK, "__f", "__c", "__off")


def exact_percentiles(
    df: DataFrame, keys: Sequence[str], value: str, points: Mapping[str, float], bins: int = 4096
) -> DataFrame:
    """Linear-interpolated percentiles per key without collecting a key's values.

    Equal values are counted first, a histogram finds the bins that hold the
    wanted ranks, and only those bins are ranked.
    """
    d = df.select(*keys, F.col(value).alias("__v")).where(F.col("__v").isNotNull())
    counts = d.groupBy(*keys, "__v").agg(F.count(F.lit(1)).alias("__c"))
    # derived from the counts, whose shuffle all readers share
    bounds = counts.groupBy(*keys).agg(
        F.min("__v").alias("__lo"), F.max("__v").alias("__hi"), F.sum("__c").alias("__n")
    )
    bin_no = F.coalesce(
        F.floor(F.try_divide(F.col("__v") - F.col("__lo"), F.col("__hi") - F.col("__lo")) * (bins - 1)),
        F.lit(0),
    )
    binned = join_stats(counts, bounds, keys, "__v").withColumn("__bin", bin_no.cast("bigint"))
    hist = binned.groupBy(*keys, "__bin").agg(F.sum("__c").alias("__bc"), F.max("__n").alias("__n"))
    w = Window.partitionBy(*keys).orderBy("__bin")
    hist = hist.withColumn("__before", F.coalesce(F.sum("__bc").over(before(w)), F.lit(0)))
    rank = {n: F.lit(p) * (F.col("__n") - 1) for n, p in points.items()}
    wanted = None
    for pos in rank.values():
        hit = (F.col("__before") <= F.ceil(pos)) & (F.col("__before") + F.col("__bc") > F.floor(pos))
        wanted = hit if wanted is None else (wanted | hit)
    near = binned.drop("__n", "__lo", "__hi").join(
        hist.where(wanted).select(*keys, "__bin", "__before", "__n"), [*keys, "__bin"]
    )
    wb = Window.partitionBy(*keys, "__bin").orderBy("__v")
    upto = F.col("__before") + F.sum("__c").over(wb.rowsBetween(Window.unboundedPreceding, 0))
    near = near.withColumn("__to", upto)
    aggs = []
    for n, pos in rank.items():
        at = lambda r: F.max(
            F.when((F.col("__to") > r) & (F.col("__to") - F.col("__c") <= r), F.col("__v"))
        )
        lo, hi = at(F.floor(pos)), at(F.ceil(pos))
        frac = F.max(pos - F.floor(pos))
        aggs.append((lo + (hi - lo) * frac).alias(n))
    return near.groupBy(*keys).agg(*aggs)


def join_stats(df: DataFrame, stats: DataFrame, keys: Sequence[str], spread: str, salts: int = 32) -> DataFrame:
    """Inner join with one small row per key that does not gather a hot key: the rows of a key
    go to ``salts`` places by a hash of ``spread``, and its statistics to all of them."""
    side = stats.withColumn("__salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint"))))
    salted = df.withColumn("__salt", F.pmod(F.xxhash64(spread), F.lit(salts).cast("bigint")))
    return salted.join(side, [*keys, "__salt"]).drop("__salt")


def first_by(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """First row per key under a total order, as a map-side combined aggregate."""
    rest = [c for c in df.columns if c not in keys]
    sort_cols = [c.alias(f"__o{i}") for i, c in enumerate(order)]
    pick = F.min_by(F.struct(*rest), F.struct(*sort_cols)).alias("__r")
    return df.groupBy(*keys).agg(pick).select(*keys, *[F.col("__r")[c].alias(c) for c in rest])


def top_n(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, out: str = "rank") -> DataFrame:
    """First ``n`` rows per key; Spark limits each group before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(out, F.row_number().over(w)).where(F.col(out) <= n)
