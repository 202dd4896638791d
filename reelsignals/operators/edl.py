"""Edit decisions: clamping, timelines, snapping, non-overlapping picks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import folds
from . import ordered as O


def clamp_moments(moments: DataFrame, max_len: float = 90.0) -> DataFrame:
    """Rule-based decision: too long moments end early; pacing and scores are defaults."""
    end = F.least(F.col("end_time"), F.col("start_time") + F.lit(max_len))
    # fixed values: default pacing and scores
    return moments.withColumns({
        "source_end": end, "output_duration": end - F.col("start_time"), "pacing": F.lit("normal"),
        "hook_score": F.lit(0.5), "coherence_score": F.lit(0.5)})


def timeline(decisions: DataFrame, key: str = "media_id", num_shorts: int = 4) -> DataFrame:
    """First ``num_shorts`` decisions placed one after another.

    After the limit a key has at most ``num_shorts`` rows, so the window is small.
    """
    d = O.top_n(decisions, [key], [F.col("moment_idx")], num_shorts, "position")
    w = Window.partitionBy(key).orderBy("moment_idx")
    total = Window.partitionBy(key)
    return d.withColumns({
        "output_start": F.coalesce(F.sum("output_duration").over(O.before(w)), F.lit(0.0)),
        "total_output_duration": F.sum("output_duration").over(total), "segments_count": F.count(F.lit(1)).over(total)})


def snap_to(points: DataFrame, marks: DataFrame, at: str, mark: str, key: str = "media_id", chunk_seconds: float = 3600.0,
            cell_seconds: float = 8.0) -> DataFrame:
    """Nearest mark for each point (the earlier one on ties).

    A point meets the different marks of its own cell; of other cells only the first and last mark count, found by two
    hold-last scans over one row per cell.
    """
    place = lambda t: F.struct(F.col(key).alias("k"), F.floor(F.col(t) / cell_seconds).cast("bigint").alias("c"))
    m = marks.select(F.col(mark).alias("__m"), place(mark).alias("__cell")).where(F.col("__m").isNotNull())
    p = points.where(F.col(at).isNotNull()).select(F.col(at).alias("__t"), place(at).alias("__cell")).distinct()
    low, high = F.when(F.col("__m") <= F.col("__t"), F.col("__m")), F.when(F.col("__m") >= F.col("__t"), F.col("__m"))
    own = p.join(m, "__cell", "left").groupBy("__cell", "__t").agg(F.max(low).alias("__lo"), F.min(high).alias("__hi"))
    ends = m.groupBy("__cell").agg(F.min("__m").alias("__least"), F.max("__m").alias("__most"))
    # a cell's marks stand behind its points in either direction, so points see those of other cells
    side = lambda d, k: d.withColumns({"__k": F.col("__cell.k"), "__o": F.struct(F.col("__cell.c").alias("c"), F.lit(k).alias("k"))})
    both = side(own, 0).unionByName(side(ends, 1), allowMissingColumns=True)
    chunk = F.floor(F.col("__cell.c") * (cell_seconds / chunk_seconds)).cast("bigint")
    both = O.last_known(both, ["__k"], "__o", F.col("__most"), "__before", chunk=chunk)
    back = both.withColumn("__r", F.struct((-F.col("__o.c")).alias("c"), F.col("__o.k").alias("k")))
    both = O.last_known(back, ["__k"], "__r", F.col("__least"), "__after", chunk=-chunk).where(F.col("__o.k") == 0)
    lo, hi = F.coalesce("__lo", "__before"), F.coalesce("__hi", "__after")
    near = F.when(hi.isNull() | (F.col("__t") - lo <= hi - F.col("__t")), lo).otherwise(hi)
    found = both.select(F.struct("__k", "__t").alias("__p"), near.alias("__near"))
    d = points.withColumn("__p", F.struct(F.col(key).alias("__k"), F.col(at).alias("__t"))).join(found, "__p", "left")
    return d.withColumn(f"{at}_snapped", F.coalesce("__near", at)).drop("__p", "__near")


def overlap_clusters(spans: DataFrame, key: str, start: str, end: str, tie: str, chunk_seconds: float = 600.0) -> DataFrame:
    """Number the groups of transitively overlapping spans of each key."""
    order = F.struct(F.col(start).alias("s"), F.col(tie).alias("t"))
    d = spans.withColumns({"__o": order, O.CHUNK: F.floor(F.col(start) / chunk_seconds).cast("bigint")})
    d = O.with_carry(d, [key], {"__me": F.max(end)}, {"__in": lambda w: F.max("__me").over(O.before(w))})
    reach = F.greatest(F.max(end).over(O.before(O.chunk_window(["__o"]))), F.col("__in"))
    d = d.withColumn("__new", F.when(reach.isNull() | (F.col(start) >= reach), 1).otherwise(0)).drop(O.CHUNK, "__in")
    return O.running_sum(d, [key], "__o", F.col("__new"), "cluster",
                         chunk=F.floor(F.col(start) / chunk_seconds).cast("bigint")).drop("__o", "__new")


def best_moments(moments: DataFrame, key: str = "media_id") -> DataFrame:
    """Greedy pick by score of moments that do not overlap.

    Picks in different overlap clusters cannot affect each other, so every cluster is a fold of its own. Its
    moments stream by in order of score; the state is the sorted list of picks, which are disjoint,
    so that a moment is tested by one binary search and no cluster is gathered.
    """
    d = overlap_clusters(moments, key, "start_time", "end_time", "moment_idx")
    kinds = {f.name: f.dataType.simpleString() for f in d.schema}
    names = [key, "cluster", "moment_idx", "start_time", "end_time", "viral_score"]
    d = d.select(*names, (-F.col("viral_score")).alias("falling"))
    picks = folds.sorted_fold(d, [key, "cluster"], ["falling", "moment_idx"], folds.DisjointPicks, ", ".join(f"{n} {kinds[n]}" for n in names))
    return picks.drop("cluster")


def frames_needed(spans: DataFrame, frames: DataFrame, fps: float = 30.0, pad: int = 150, key: str = "media_id") -> DataFrame:
    """Only the frames up to the last one any span needs."""
    last = spans.groupBy(key).agg(((F.max("end_time") * fps).cast("bigint") + pad).alias("__last"))
    return O.join_stats(frames, last, [key], "frame_idx").where(F.col("frame_idx") <= F.col("__last")).drop("__last")


def sample_times(media: DataFrame, n: int, duration: str = "duration") -> DataFrame:
    """``n`` even times up to 0.1 s before the end, with the flags of the two sub-samples."""
    d = media.withColumn("sample_idx", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))) if n > 0 else media.withColumn("sample_idx", F.lit(0)).limit(0)
    step = (F.col(duration) - 0.1) / F.lit(max(1, n - 1))
    i = F.col("sample_idx")
    return d.withColumns({"at": i * step, "scene_sample": (i >= 4) & (i % 4 == 0), "viral_sample": i % max(1, n // 8) == 0})


def scene_changes(responses: DataFrame) -> DataFrame:
    """Every fourth sample whose model response does not say SAME."""
    i = F.col("sample_idx")
    return responses.where((i >= 4) & (i % 4 == 0) & (F.col("response") != "") & ~F.contains(F.upper("response"), F.lit("SAME")))
