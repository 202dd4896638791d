"""Operator 2: mix sources to target weights by Pareto order sampling, in DataFrame operations only.

Targets: sources in code point order (null last) share all words by their weights; a target
stops at ``most`` times its source's size and the excess goes to the others by weight.

Copies: with r = target / size of the source, a document of importance a is expected
e = r * a / (mean importance by words) times, ``most`` at the most. floor(e) copies are
certain. For the rest p = e - floor(e) is its inclusion probability and its Pareto rank is
[u / (1 - u)] / [p / (1 - p)] with u a uniform number from the id; in rank order documents
get one more copy until the source's target in words is met as nearly as whole documents
allow. The sample's size (in words) is thus fixed, and reruns agree as u depends on the id only.

Without a column of importance all documents of a source have the same p, which differs
between sources.

Finding where a source's target is met needs running sums in rank order. A source may
hold a third of all rows, so ranks are counted in ``CELLS`` cells per source, then the one
cell where the sum crosses the target in ``CELLS`` finer cells; only the documents of one
finer cell (a millionth of a source) are sorted in a window. Source statistics reach the
documents by a join on (source, salt).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import WORD, as_rows, stored, with_uid

SALTS = 32
CELLS = 1024
KEY = ["no_source", "src"]


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def uniform(doc_id: Column, seed: str) -> Column:
    """A number in (0, 1) from md5 of the id and the seed; 52 bits."""
    digest = F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(seed)).cast("binary"))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(2**52)


def targets(sized: DataFrame, weights: list[int], most: float) -> DataFrame:
    """Per source: size, target. One row per source passes through a window."""
    per = sized.groupBy(*KEY).agg(F.sum("size").alias("source_size"), F.sum(F.col("size") * F.col("importance")).alias("heft"))
    everything, by_name = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing), Window.orderBy(*KEY)
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    per = per.withColumn("weight", weight).withColumn("cap", F.col("source_size") * most)
    order = Window.orderBy(F.col("cap") / F.col("weight"), *KEY)
    per = per.withColumn("level", (F.sum("source_size").over(everything)
                                   - F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
                         / F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)))
    free = F.max(F.when(F.col("cap") >= F.col("weight") * F.col("level"), F.col("level"))).over(everything)
    return per.withColumn("target", F.least("cap", F.col("weight") * free)).select(*KEY, "source_size", "target", "heft")


def _split(rows: DataFrame, keys: list[str], finer: Column) -> tuple[DataFrame, DataFrame]:
    """Rows surely taken, and those of the cell where the target is crossed (with less left to take)."""
    rows = rows.withColumn("cell", finer)
    sums = rows.groupBy(*keys, "cell").agg(F.sum("size").alias("in_cell"), F.first("left").alias("all_left"))
    before = F.coalesce(F.sum("in_cell").over(Window.partitionBy(*keys).orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.withColumn("now_left", F.col("all_left") - before).where("now_left >= 0").drop("all_left")
    rows = rows.join(sums, [*keys, "cell"]).withColumn("left", F.col("now_left"))
    return (rows.where("in_cell <= now_left").drop("cell", "in_cell", "now_left"),
            rows.where("in_cell > now_left").drop("cell", "in_cell", "now_left"))


def copies(docs: DataFrame, weights: list[int], most: float = 3.0, seed: str = "|mix", importance: str | None = None) -> DataFrame:
    """``docs`` (a table scan) as one narrow row each: __uid, doc_id, source, size, source_size, target, copies."""
    score = F.lit(1.0) if importance is None else F.greatest(F.coalesce(F.col(importance).cast("double"), F.lit(0.0)), F.lit(0.0))
    sized = with_uid(docs).select("__uid", "doc_id", "source", word_count(F.col("text")).alias("size"), uniform(F.col("doc_id"), seed).alias("u"),
                                  score.alias("importance"), F.col("source").isNull().alias("no_source"), F.coalesce("source", F.lit("")).alias("src"))
    sized = stored(sized.withColumn("salt", F.pmod(F.xxhash64("__uid"), F.lit(SALTS))))
    per = targets(sized, weights, most).withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    rows = sized.join(per, [*KEY, "salt"])
    rate = F.when(F.col("heft") > 0, F.col("target") * F.col("importance") / F.col("heft")).otherwise(0.0)
    rows = rows.withColumn("e", F.least(rate, F.lit(most))).withColumn("whole", F.floor("e")).withColumn("p", F.col("e") - F.col("whole"))
    rows = stored(rows.drop("salt", "importance", "heft"))
    certain = rows.groupBy(*KEY).agg((F.first("target") - F.sum(F.col("whole") * F.col("size"))).alias("left"))
    certain = certain.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    q = (F.col("u") / (1 - F.col("u"))) / (F.col("p") / (1 - F.col("p")))
    drawn = rows.where("p > 0").select("__uid", "doc_id", *KEY, "size", "u", q.alias("q"), F.pmod(F.xxhash64("__uid"), F.lit(SALTS)).alias("salt"))
    drawn = drawn.join(certain, [*KEY, "salt"]).drop("salt").withColumn("place", F.col("q") / (1 + F.col("q")))
    sure, open_ = _split(drawn, KEY, F.floor(F.col("place") * CELLS))
    sure_too, open_ = _split(open_, KEY, F.floor(F.col("place") * CELLS * CELLS))
    before = F.coalesce(F.sum("size").over(Window.partitionBy(*KEY).orderBy("q", "u", "doc_id", "__uid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    last = open_.withColumn("before", before).where("2 * before + size <= 2 * left")
    more = sure.select("__uid").unionByName(sure_too.select("__uid")).unionByName(last.select("__uid")).withColumn("more", F.lit(1))
    return rows.join(more, "__uid", "left").select(
        "__uid", "doc_id", "source", "size", "source_size", "target", (F.col("whole") + F.coalesce("more", F.lit(0))).cast("long").alias("copies"))


def mix(docs: DataFrame, weights: list[int], **options) -> DataFrame:
    """The mix itself: every row of ``docs`` as often as it is taken, all columns kept.

    A null text has no words and size 0; a source without words takes nothing. Rows
    without a doc_id draw by their place in the table among equal numbers. Repeated rows
    are separate documents. An empty table gives an empty mix.
    """
    taken = copies(docs, weights, **options).where("copies > 0").select("__uid", "copies")
    out = as_rows(docs).join(taken, "__uid").select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return out.select("row.*")
