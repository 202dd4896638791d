"""Run roll-ups, progress, logs, inventories and resume state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from . import ordered as O
from .sourcing import VIDEO_EXTENSIONS

# fixed values: weight of each stage in the overall progress
WEIGHTS = {
    "Transcription": 10, "Audio Transcription": 10, "Video Analysis": 20, "Subject Tracking": 15, "Tracking": 15, "Short Generation": 30,
    "Editing": 30, "Metadata Generation": 5, "Export": 5, "Thumbnail Extraction": 5, "Quality Assurance": 5}


def run_rollup(results: DataFrame, key: str = "run_id") -> DataFrame:
    """One small row per run; the lists stay long (:func:`run_items`)."""
    return results.groupBy(key).agg(
        F.bool_or("success").alias("success"), F.sum(F.size("shorts")).alias("n_shorts"), F.round(F.sum("duration"), 4).alias("duration"),
        F.sum(F.size("errors")).alias("n_errors"), F.count(F.lit(1)).alias("n_videos"))


def run_items(results: DataFrame, column: str, key: str = "run_id") -> DataFrame:
    """The flattened list of a run as rows in their order (video_idx, pos)."""
    return results.select(key, "video_idx", F.posexplode(column).alias("pos", "item"))


def weight_of(stage: str):
    table = F.create_map(*[F.lit(x) for kv in WEIGHTS.items() for x in kv])
    return F.coalesce(F.try_element_at(table, F.col(stage)), F.lit(0))


def applied_progress(events: DataFrame, key: str = "run_id") -> DataFrame:
    """Events with the stage they touch: a step belongs to the last started stage."""
    d = O.last_known(events, [key], "seq", F.when(F.col("type") == "stage_start", F.col("stage")), "current_stage", fallback=F.lit("Unknown"))
    pct = (F.when(F.col("type") == "stage_start", 0.0).when(F.col("type") == "stage_complete", 100.0)
           .when(F.col("type") == "step", F.when(F.col("total") > 0, F.col("current") / F.col("total") * 100).otherwise(0.0)))
    return d.withColumns({"on_stage": F.when(F.col("type") == "step", F.col("current_stage")).otherwise(F.col("stage")), "pct": pct})


def overall_progress(events: DataFrame, key: str = "run_id") -> DataFrame:
    """Weights of completed stages plus the share of the running one, at most 100."""
    d = applied_progress(events, key)
    seen = F.col("pct").isNotNull()
    stages = d.groupBy(key, "on_stage").agg(
        F.bool_or(F.col("type") == "stage_complete").alias("done"), F.max_by("pct", F.when(seen, F.col("seq"))).alias("pct"),
        F.max(F.when(F.col("type") == "stage_start", F.col("seq"))).alias("started"), F.count_if(F.col("type") == "error").alias("n_errors"))
    current = F.max_by("on_stage", "started")
    runs = stages.groupBy(key).agg(
        current.alias("current_stage"), F.max_by(F.struct("on_stage", "done", "pct"), "started").alias("cur"),
        F.sum(F.when(F.col("done"), weight_of("on_stage")).otherwise(0)).alias("done_weight"),
        F.count_if("done").alias("n_completed"), F.sum("n_errors").alias("n_errors"))
    share = F.when(F.col("cur").isNotNull() & ~F.col("cur.done"), weight_of("current_stage") * F.col("cur.pct") / 100.0).otherwise(0.0)
    return runs.select(key, "current_stage", "n_completed", "n_errors",
                       F.least(F.lit(100.0), F.col("done_weight") + F.coalesce(share, F.lit(0.0))).alias("overall_pct"))


def log_lines(events: DataFrame) -> DataFrame:
    """Text line of each progress event."""
    step = F.concat(F.lit("["), F.col("current").cast("string"), F.lit("/"), F.col("total").cast("string"), F.lit("] ("),
                    S.fixed(F.col("current") / F.col("total") * 100, 0), F.lit("%) "), F.coalesce("step", F.lit("")))
    kind = F.col("type")
    text = (F.when(kind == "stage_start", F.concat(F.lit("[STAGE] "), "stage"))
            .when((kind == "step") & (F.col("total") > 0), F.concat(F.lit("  "), step))
            .when(kind == "step", F.concat(F.lit("  → "), F.coalesce("step", F.lit(""))))
            .when(kind == "stage_complete", F.concat(F.lit("  ✅ "), "stage", F.lit(" complete")))
            .when(kind == "error", F.concat(F.lit("  ❌ Error in "), "stage", F.lit(": "), F.coalesce("error", F.lit("")))))
    return events.withColumn("line", text)


def last_entries(rows: DataFrame, n: int, key: str = "run_id", order: str = "seq") -> DataFrame:
    """The newest ``n`` rows of each run."""
    return O.top_n(rows, [key], [F.col(order).desc()], n, "age")


def video_inventory(files: DataFrame) -> DataFrame:
    """Video files with name, folder and size."""
    ext = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    d = files.where(ext.isin(VIDEO_EXTENSIONS))
    return d.withColumns({"directory": F.regexp_replace("path", "/[^/]*$", ""), "name": F.regexp_extract("path", "([^/]+)$", 1), "size_mb": S.size_mb("length")})


def directory_counts(inventory: DataFrame) -> DataFrame:
    return inventory.groupBy("directory").agg(F.count(F.lit(1)).alias("video_count"))


def short_inventory(shorts: DataFrame, files: DataFrame, meta: DataFrame, ai: DataFrame) -> DataFrame:
    """Shorts with their video (the reframed one, else any) and both sidecars.

    ``files``: output, short, file; ``meta``/``ai``: output, short, and one text column each.
    """
    k = ["output", "short"]
    mp4 = files.where(F.lower("file").endswith(".mp4"))
    best = mp4.groupBy(*k).agg(F.min(F.when(F.col("file") == "reframed.mp4", F.col("file"))).alias("r"), F.min("file").alias("a"))
    d = shorts.join(best.select(*k, F.coalesce("r", "a").alias("video")), k, "left").join(meta, k, "left").join(ai, k, "left")
    path = F.when(F.col("video").isNotNull(), F.concat_ws("/", "output", "short", "video"))
    return d.withColumns({"has_video": F.col("video").isNotNull(), "video_path": path}).drop("video")


def resume_state(files: DataFrame, metas: DataFrame, key: str = "run_id") -> DataFrame:
    """Furthest phase per run from its files; a complete run starts again at 0.

    ``files``: run_id, path below the run; ``metas``: run_id, phases_completed.
    """
    g = files.groupBy(key).agg(
        F.bool_or(F.col("path") == "content_brief.json").alias("brief"), F.bool_or(F.col("path") == "pipeline_run.json").alias("meta"),
        F.min(F.when(F.concat(F.lit("/"), "path").endswith("/video.mp4"), F.col("path"))).alias("video"))
    done = metas.groupBy(key).agg(F.bool_or(F.array_contains("phases_completed", "output_qa")).alias("complete"))
    d = g.join(done, key, "left").withColumn("complete", F.col("meta") & F.coalesce("complete", F.lit(False)))
    phase = F.when(F.col("complete"), 0).when(F.col("video").isNotNull(), 2).when(F.col("brief"), 1).otherwise(0)
    return d.select(key, phase.alias("phase"), F.when(~F.col("complete"), F.col("video")).alias("video_path"))


def quarantine(items: DataFrame, failures: DataFrame, key: str, more_than: int = 2) -> DataFrame:
    """Items without those that failed more than ``more_than`` times."""
    bad = failures.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > more_than)
    return items.join(bad.select(key), key, "left_anti")
