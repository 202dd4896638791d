"""Operator 9: repeated runs of lines by a suffix array, in DataFrame operations only.

Every line with a word becomes a line id (two 64-bit hashes). A line that occurs once ends
any repeat, so the suffix array is built over the stretches of lines that occur at least
twice. Prefix doubling: ``r`` is the rank of a suffix by its first h lines (the number of
suffixes before its class, from 1); a round sorts each class by the rank h lines further on
and thus ranks by 2h lines. Suffixes alone in their class are settled; the rounds end when
all are, after the logarithm of the longest repeat.

A class of the first 2h lines is a stretch of the suffix array with common prefixes of at
least 2h lines, or of all ``rest`` lines to the stretch's end (an LCP interval). A member that
is not the first of its interval in the corpus repeats these lines: it keeps the deepest such interval in ``depth``. The union of
these spans over a document are its maximal repeated runs; copies after the first are deleted.

No class is sorted in one task: members are counted per next rank before they are shuffled,
and a class's next ranks are summed in up to ``CELLS`` cells of the suffix array. Order in
the corpus: doc_id (null last), then reading order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .mixing import word_count
from .shared import as_rows, forget, stored

CELLS = 4096
BEFORE = (Window.unboundedPreceding, -1)


def _numbered_lines(text: Column) -> Column:
    """The lines that hold a word, with their number in the text."""
    lines = F.transform(F.split(text, "\n"), lambda line, i: F.struct(line.alias("line"), i.alias("no")))
    return F.filter(lines, lambda x: x["line"].rlike(r"[^\x20\x09-\x0D]"))


def _sum_before(value: str, window) -> Column:
    return F.coalesce(F.sum(value).over(window.rowsBetween(*BEFORE)), F.lit(0))


def line_table(docs: DataFrame, min_words: int) -> DataFrame:
    """One row per line with a word: __uid, idx, h1, h2, long (``min_words`` words or more)."""
    rows = docs.select("__uid", F.posexplode(_numbered_lines(F.col("text"))).alias("idx", "x")).select("__uid", "idx", F.col("x.line").alias("line"))
    long = F.when(F.length("line") < 2 * min_words - 1, F.lit(False)).otherwise(word_count(F.col("line")) >= min_words)
    return rows.select("__uid", "idx", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"), long.alias("long"))


def corpus_positions(docs: DataFrame, lines: DataFrame) -> DataFrame:
    """(__uid, base): the number of lines before each document in corpus order."""
    sizes = lines.groupBy("__uid").agg(F.count("*").alias("lines"))
    ids = docs.select("__uid", F.col("doc_id").isNull().alias("no_id"), "doc_id").join(sizes, "__uid")
    ids = stored(ids.repartitionByRange("no_id", "doc_id", "__uid").withColumn("range", F.spark_partition_id()))
    totals = ids.groupBy("range").agg(F.sum("lines").alias("total"))
    totals = totals.select("range", _sum_before("total", Window.orderBy("range")).alias("start"))
    own = Window.partitionBy("range").orderBy("no_id", "doc_id", "__uid")
    return ids.join(totals, "range").select("__uid", (F.col("start") + _sum_before("lines", own)).alias("base"))


def first_ranks(lines: DataFrame) -> DataFrame:
    """(h1, h2, r, s) of lines that occur twice or more; the order of lines is that of their hashes."""
    twice = lines.groupBy("h1", "h2").agg(F.count("*").alias("s")).where("s > 1").withColumn("cell", F.shiftright("h1", 52))
    totals = twice.groupBy("cell").agg(F.sum("s").alias("total")).select("cell", _sum_before("total", Window.orderBy("cell")).alias("start"))
    return twice.join(totals, "cell").select("h1", "h2", "s", (1 + F.col("start") + _sum_before("s", Window.partitionBy("cell").orderBy("h1", "h2"))).alias("r"))


def suffix_array(docs: DataFrame, min_words: int = 50) -> DataFrame:
    """Suffixes of repeated lines of ``docs`` (with __uid): __uid, idx, pos, r (rank; equal
    suffixes share it), long, depth (0, or the lines surely copied from earlier in the corpus)."""
    lines = stored(line_table(docs, min_words))
    places = corpus_positions(docs, lines)
    state = lines.join(first_ranks(lines), ["h1", "h2"]).join(places, "__uid")
    state = state.select("__uid", "idx", "long", "r", "s", (F.col("base") + F.col("idx")).alias("pos"))
    state = state.withColumn("seg", F.col("idx") - F.row_number().over(Window.partitionBy("__uid").orderBy("idx")))
    piece = Window.partitionBy("__uid", "seg")
    state = state.withColumn("rest", F.count("*").over(piece) + F.min("idx").over(piece) - F.col("idx"))
    state = stored(state.withColumn("depth", F.lit(0).cast("long")))
    forget(lines)
    forget(places)
    heads = state.where("long").groupBy("r").agg(F.min("pos").alias("first"))
    once = state.where("long").join(heads, "r").where("pos > first").select("pos", F.lit(1).cast("long").alias("one"))
    once = stored(once)
    total, left = state.agg(F.count("*"), F.count(F.when(F.col("s") > 1, 1))).first()
    h = 1
    while left:
        further = state.withColumn("r2", F.coalesce(F.lead("r", h).over(Window.partitionBy("__uid", "seg").orderBy("idx")), F.lit(0)))
        settled, open_ = further.where("s = 1").drop("r2"), further.where("s > 1")
        pairs = open_.groupBy("r", "r2").agg(F.count("*").alias("c"), F.min("pos").alias("first"), F.first("s").alias("size"))
        pairs = pairs.withColumn("cell", F.floor((F.col("r") + F.col("size") * (F.col("r2") / (total + 1))) * (CELLS / total)))
        sums = pairs.groupBy("r", "cell").agg(F.sum("c").alias("total"))
        sums = sums.select("r", "cell", _sum_before("total", Window.partitionBy("r").orderBy("cell")).alias("start"))
        own = _sum_before("c", Window.partitionBy("r", "cell").orderBy("r2"))
        ranks = pairs.join(sums, ["r", "cell"]).select("r", "r2", "c", "first", (F.col("r") + F.col("start") + own).alias("new_r"))
        open_ = open_.join(ranks, ["r", "r2"]).select(
            "__uid", "idx", "long", F.col("new_r").alias("r"), F.when(F.col("r2") > 0, F.col("c")).otherwise(F.lit(1)).cast("long").alias("s"), "pos", "seg", "rest",
            F.when((F.col("r2") > 0) & (F.col("pos") > F.col("first")), F.least(F.lit(2 * h).cast("long"), "rest")).otherwise(F.col("depth")).alias("depth"))
        new = stored(open_.unionByName(settled))
        forget(state)
        state, h = new, 2 * h
        left = state.where("s > 1").count()
    return state.join(once, "pos", "left").select("__uid", "idx", "pos", "r", "long", F.greatest("depth", F.coalesce("one", F.lit(0))).alias("depth"))


def repeated_runs(docs: DataFrame, min_lines: int, min_words: int) -> DataFrame:
    """(__uid, runs): per document the maximal runs of lines (first, last idx) to delete, in order."""
    deep = F.when(F.col("depth") >= min_lines, F.col("depth")).when(F.col("long") & (F.col("depth") >= 1), 1)
    spans = suffix_array(docs, min_words if min_lines > 1 else 1).withColumn("deep", deep).where("deep is not null")
    spans = spans.select("__uid", "idx", (F.col("idx") + F.col("deep") - 1).alias("last"))
    own = Window.partitionBy("__uid").orderBy("idx")
    reach = F.max("last").over(own.rowsBetween(*BEFORE))
    spans = spans.withColumn("new", F.when(F.col("idx") <= reach + 1, 0).otherwise(1)).withColumn("run", F.sum("new").over(own))
    runs = spans.groupBy("__uid", "run").agg(F.min("idx").cast("int").alias("first"), F.max("last").cast("int").alias("last"))
    return runs.groupBy("__uid").agg(F.sort_array(F.collect_list(F.struct("first", "last"))).alias("runs"))


def _marked(docs: DataFrame, min_lines: int, min_words: int) -> DataFrame:
    """(row, n_lines, n_removed, runs, kept_text) for every row of ``docs``."""
    if min_lines < 1 or min_lines & (min_lines - 1):
        raise ValueError("min_lines must be a power of two")
    rows = as_rows(docs)
    runs = repeated_runs(rows.select("__uid", "row.doc_id", "row.text"), min_lines, min_words)
    none = F.array().cast("array<struct<first:int,last:int>>")
    out = rows.join(runs, "__uid", "left").withColumn("runs", F.coalesce("runs", none)).withColumn("all", F.split("row.text", "\n")).withColumn("worded", _numbered_lines(F.col("row.text")))
    number = lambda i: F.element_at("worded", i + 1)["no"]
    out = out.withColumn("cuts", F.transform("runs", lambda x: F.struct(number(x["first"]).alias("a"), number(x["last"]).alias("b"))))
    begin = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.get("cuts", i - 1)["b"] + 1)
    kept = F.transform("cuts", lambda c, i: F.slice("all", begin(i) + 1, c["a"] - begin(i)))
    tail = F.slice("all", begin(F.size("cuts")) + 1, F.greatest(F.size("all") - begin(F.size("cuts")), F.lit(0)))
    text = F.when(F.size("runs") == 0, F.col("row.text")).otherwise(F.array_join(F.flatten(F.concat(kept, F.array(tail))), "\n"))
    removed = F.aggregate("runs", F.lit(0), lambda n, x: n + x["last"] - x["first"] + 1)
    return out.select("row", F.coalesce(F.size("worded"), F.lit(0)).alias("n_lines"), removed.alias("n_removed"), "runs", text.alias("kept_text"))


def delete_repeats(docs: DataFrame, min_lines: int = 2, min_words: int = 50) -> DataFrame:
    """doc_id, n_lines, n_removed, runs and kept_text for every row of ``docs`` (a table scan).

    A run counts with ``min_lines`` lines (a power of two), or as one line of ``min_words``
    words. Lines without a word are no part of runs and go only between two deleted lines.
    Lines are compared as they are. runs hold first and last number among the lines with a word.
    A null text gives 0 lines and a null kept_text; a text left without lines gives ''.
    Repeated rows are copies: all but the first lose their runs. An empty table stays empty.
    Other columns are ignored.
    """
    return _marked(docs, min_lines, min_words).select("row.doc_id", "n_lines", "n_removed", "runs", "kept_text")


def without_repeats(docs: DataFrame, min_lines: int = 2, min_words: int = 50) -> DataFrame:
    """``docs`` with the repeated runs deleted from text, and n_chars (where there is one)
    brought in line; documents that lose all their lines go. All columns are kept."""
    out = _marked(docs, min_lines, min_words).where("n_removed = 0 or n_removed < n_lines")
    kinds = {f.name: f.dataType for f in docs.schema}
    new = {"text": F.col("kept_text"), "n_chars": F.when(F.col("n_removed") > 0, F.length("kept_text").cast(kinds.get("n_chars", "long"))).otherwise(F.col("row.n_chars"))} if "n_chars" in kinds else {"text": F.col("kept_text")}
    return out.select(*[new.get(c, F.col("row")[c]).alias(c) for c in docs.columns])
