"""Progress roll-up and stall watch of running jobs."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.runs import WEIGHTS

SNAPSHOT = "run_id bigint, current_stage string, n_completed bigint, n_errors bigint, overall_pct double, log array<string>, errors array<string>"
KEPT = 100


class RunState:
    """Progress of one run, fed with its events in order, with its newest log lines and errors."""

    def __init__(self, kept: int = KEPT):
        self.current, self.pct, self.done, self.errors = None, {}, [], 0
        self.kept, self.log, self.failures = kept, [], []

    def apply(self, kind: str, stage: str, current: float, total: float, line: str | None = None) -> None:
        if kind == "stage_start":
            self.current, self.pct[stage] = stage, 0.0
        elif kind == "step":
            self.pct[self.current or "Unknown"] = current / total * 100 if total > 0 else 0.0
        elif kind == "stage_complete":
            self.pct[stage] = 100.0
            if stage not in self.done:
                self.done.append(stage)
        elif kind == "error":
            self.errors += 1
        if line is not None:
            self.log = [*self.log, line][-self.kept :]
            if kind == "error":
                self.failures = [*self.failures, line][-self.kept :]

    def overall(self) -> float:
        total = float(sum(WEIGHTS.get(s, 0) for s in self.done))
        if self.current is not None and self.current not in self.done:
            total += WEIGHTS.get(self.current, 0) * self.pct.get(self.current, 0.0) / 100.0
        return min(100.0, total)


def rollup_stream(events: DataFrame, kept: int = KEPT) -> DataFrame:
    """Latest snapshot per run (update mode), with its last ``kept`` log lines and errors.

    ``events``: run_id, seq, type, stage, current, total, line. Events of a run arrive as bounded pieces.
    """

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        run = RunState(kept)
        if state.exists:
            run.__dict__.update(json.loads(state.get[0]))
        waiting = sorted((r for pdf in batches for r in pdf[["seq", "type", "stage", "current", "total", "line"]].itertuples(index=False)), key=lambda r: r.seq)
        for r in waiting:
            run.apply(r.type, r.stage, r.current, r.total, r.line)
        state.update((json.dumps(run.__dict__),))
        yield pd.DataFrame([(key[0], run.current, len(run.done), run.errors, run.overall(), run.log, run.failures)],
                           columns=["run_id", "current_stage", "n_completed", "n_errors", "overall_pct", "log", "errors"])

    return events.groupBy("run_id").applyInPandasWithState(step, SNAPSHOT, "text string", "update", GroupStateTimeout.NoTimeout)


def watchdog_stream(events: DataFrame, timeout_ms: int = 5_000) -> DataFrame:
    """An error row for every run that was running and stays silent for too long."""

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame([(key[0], "error", "no live worker")], columns=["run_id", "state", "message"])
            return
        last = max(((int(pdf["seq"].iloc[i]), pdf["type"].iloc[i], pdf["stage"].iloc[i]) for pdf in batches for i in [int(pdf["seq"].values.argmax())]), default=None)
        if last is not None and last[1:] == ("stage_complete", "Quality Assurance"):
            if state.exists:
                state.remove()
            return
        state.update((last[0] if last else 0,))
        state.setTimeoutDuration(timeout_ms)

    return events.groupBy("run_id").applyInPandasWithState(
        step, "run_id bigint, state string, message string", "last bigint", "update", GroupStateTimeout.ProcessingTimeTimeout)


def silence_stream(events: DataFrame, silence: str, late: str = "0 seconds", closing: str = "stage_complete/Quality Assurance") -> DataFrame:
    """A row for every unfinished run that has been silent for longer than ``silence`` of event time.

    The timer of a run is moved on with each of its events, and fires when the newest event of any run is that much later.
    ``events``: run_id, seq, ts (timestamp), type, stage.
    """
    wait = int(pd.Timedelta(silence).total_seconds() * 1000)

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            seq, _, _ = state.get
            state.remove()
            yield pd.DataFrame([(key[0], seq)], columns=["run_id", "last_seq"])
            return
        seq, newest, what = state.get if state.exists else (-1, 0, "")
        for pdf in batches:
            i = int(pdf["seq"].to_numpy().argmax())
            newest = max(newest, int(pdf["__at"].max()))
            if int(pdf["seq"].iloc[i]) > seq:
                seq, what = int(pdf["seq"].iloc[i]), f"{pdf['type'].iloc[i]}/{pdf['stage'].iloc[i]}"
        if what == closing:
            if state.exists:
                state.remove()
            return
        state.update((seq, newest, what))
        state.setTimeoutTimestamp(max(newest + wait, state.getCurrentWatermarkMs() + 1))

    rows = events.withWatermark("ts", late).select("run_id", "seq", "type", "stage", "ts", F.floor(F.unix_micros("ts") / 1000).alias("__at"))
    return rows.groupBy("run_id").applyInPandasWithState(
        step, "run_id bigint, last_seq bigint", "seq bigint, newest bigint, what string", "append", GroupStateTimeout.EventTimeTimeout)


def stalled_runs(events: DataFrame, silence: Column) -> DataFrame:
    """Batch twin of the watch: unfinished runs without an event for ``silence`` before the newest one."""
    runs = events.groupBy("run_id").agg(
        F.max("seq").alias("last_seq"), F.max("ts").alias("last_ts"), F.max_by(F.concat_ws("/", "type", "stage"), "seq").alias("at"))
    newest = runs.agg(F.max("last_ts").alias("now"))
    late = F.col("last_ts") < F.col("now") - silence
    return runs.join(F.broadcast(newest), late & (F.col("at") != "stage_complete/Quality Assurance")).select("run_id", "last_seq")
