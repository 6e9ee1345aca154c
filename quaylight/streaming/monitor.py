"""Streams: first row of a key, silence, and a watchdog over heartbeats."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.store import upsert

STATE = "dead_since double, silent_since double, last_restart double, restarts int"
ACTIONS = "key bigint, at double, action string, restarts int"


def decide(state: tuple, at: float, alive: bool, progress: bool, paused: bool, locked: bool, queued: int, dead_after: float = 600, silent_after: float = 900, cooldown: float = 900) -> tuple[tuple, str]:
    """One step of the watchdog: (dead_since, silent_since, last_restart, restarts) and a heartbeat to the next state and an action.

    Silence is counted from the first heartbeat without progress; a lock or pause suppresses all, and so does the time after a restart.
    """
    dead, silent, last, n = state
    silent = None if progress else at if silent is None else silent
    if locked:
        return (dead, silent, last, n), "locked"
    if paused:
        return (dead, silent, last, n), "paused"
    if last is not None and at - last < cooldown:
        return (dead, silent, last, n), "cooldown"
    if not alive:
        silent, dead = None, at if dead is None else dead
        if at - dead < dead_after:
            return (dead, silent, last, n), "confirming"
        if queued == 0:
            return (None, silent, last, n), "idle"
    else:
        dead = None
        if silent is None or at - silent < silent_after:
            return (dead, silent, last, n), "armed"
    return (None, None, at, n + 1), "restart"


def _fold(rows: pd.DataFrame, state: tuple, **limits) -> tuple[list[tuple], tuple]:
    out = []
    for r in rows.sort_values(["at", "beat_id"]).itertuples():
        state, action = decide(state, r.at, bool(r.alive), bool(r.progress), bool(r.paused), bool(r.locked), int(r.queued), **limits)
        out.append((r.key, r.at, action, state[3]))
    return out, state


def watchdog(beats: DataFrame, **limits) -> DataFrame:
    """(key, at, action, restarts) for each heartbeat (key, beat_id, at, alive, progress, paused, locked, queued) of a batch.

    A fold in order of time, which no window expresses; the group of a key is one monitored process, whose beats are few.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(_fold(rows, (None, None, None, 0), **limits)[0], columns=["key", "at", "action", "restarts"])

    return beats.groupBy("key").applyInPandas(run, ACTIONS)


def watchdog_stream(beats: DataFrame, **limits) -> DataFrame:
    """watchdog() over a stream: the state of each process is kept between micro-batches; beats must come in order."""

    def run(key, batches: Iterator[pd.DataFrame], state):
        old = state.get if state.exists else (None, None, None, 0)
        now, out = tuple(None if x is None or x != x else x for x in old), []
        for b in batches:
            rows, now = _fold(b, now, **limits)
            out += rows
        state.update(now)
        yield pd.DataFrame(out, columns=["key", "at", "action", "restarts"])

    return beats.groupBy("key").applyInPandasWithState(run, ACTIONS, STATE, "append", "NoTimeout")


def silences(events: DataFrame, key: str, ts: str, seconds: int) -> DataFrame:
    """(key, silent_from, silent_to, seconds): gaps between the rows of a key of at least so many seconds."""
    w = Window.partitionBy(key).orderBy(ts)
    x = events.select(key, ts).withColumn("before", F.lag(ts).over(w))
    gap = F.expr(f"timestampdiff(SECOND, before, {ts})")
    return x.withColumn("seconds", gap).where(F.col("seconds") >= seconds).select(key, F.col("before").alias("silent_from"), F.col(ts).alias("silent_to"), "seconds")


def activity_windows(events: DataFrame, key: str, ts: str, gap: str, late: str = "0 seconds") -> DataFrame:
    """(key, started, ended, n): sessions with pauses under `gap`; in a stream, closed as the watermark passes."""
    x = events.withColumn("_t", F.col(ts).cast("timestamp"))
    if x.isStreaming:
        x = x.withWatermark("_t", late)
    out = x.groupBy(key, F.session_window("_t", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return out.select(key, F.col("w.start").cast("timestamp_ntz").alias("started"), F.col("w.end").cast("timestamp_ntz").alias("ended"), "n")


def first_of_stream(rows: DataFrame, key: str, ts: str | None = None, late: str | None = None) -> DataFrame:
    """The first row of each key as it comes; with a time and a delay, state of older keys is dropped."""
    if ts and late:
        return rows.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])
    return rows.dropDuplicates([key])


def stage_of_log(lines: DataFrame, markers: dict[str, str]) -> DataFrame:
    """(log_id, stage, line_no): the stage of the last line that holds a marker; lines are (log_id, line_no, line)."""
    stage = F.coalesce(*[F.when(F.col("line").contains(m), F.lit(s)) for m, s in markers.items()])
    return lines.withColumn("stage", stage).where("stage is not null").groupBy("log_id").agg(F.max_by("stage", "line_no").alias("stage"), F.max("line_no").alias("line_no"))


def progress_of_log(lines: DataFrame) -> DataFrame:
    """(log_id, line_no, done, total, percent) of lines such as [3/10] or 3/10 (30%)."""
    m = F.regexp_extract("line", r"([0-9]+)\s*/\s*([0-9]+)", 1)
    t = F.regexp_extract("line", r"([0-9]+)\s*/\s*([0-9]+)", 2)
    x = lines.withColumn("done", m.try_cast("bigint")).withColumn("total", t.try_cast("bigint")).where("done is not null and total > 0")
    return x.select("log_id", "line_no", "done", "total", F.round(100 * F.col("done") / F.col("total"), 1).alias("percent"))


def upsert_each_batch(path_of, key: str, keep: list[str], order: list):
    """For foreachBatch: puts each micro-batch into the table of path_of(batch_id - 1) and writes it as path_of(batch_id).

    A batch that is run again writes the same folder again, so the result is the same.
    """

    def put(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = spark.read.parquet(path_of(batch_id - 1)) if batch_id > 0 else batch.limit(0)
        upsert(before, batch, key, keep, order).write.mode("overwrite").parquet(path_of(batch_id))

    return put


def log_state(lines: DataFrame) -> DataFrame:
    """(log, line_no, line) -> (log, last_running, place, last_progress, percent): the last place that a log says is running, and the last progress that it tells, with their lines.

    All are aggregates over lines, so a log of any length and any number of logs are one pass.
    """
    running, progress = F.regexp_extract("line", r"RUNNING:\s*(.*?)\s*$", 1), F.regexp_extract("line", r"^Progress:.*\(([0-9]+)%\)", 1)
    at_run, at_progress = F.when(running != "", F.col("line_no")), F.when(progress != "", F.col("line_no"))
    return lines.groupBy("log").agg(F.max(at_run).alias("last_running"), F.max_by(running, at_run).alias("place"), F.max(at_progress).alias("last_progress"), F.max_by(progress, at_progress).try_cast("int").alias("percent"))


def poll_reports(lines: DataFrame, line_bytes: int, least_bytes: int = 50, stuck_after: int = 3) -> DataFrame:
    """(process, poll, completes), the log lines of each poll -> (process, poll, lines, completed, progress, event).

    A poll has progress if its log grew by `least_bytes` or a company was completed; without it the event is 'stuck' once `stuck_after` polls have gone
    by since the last progress, 'quiet' before. Lines are added up for each poll first, so a window holds polls and not lines.
    """
    polls = lines.groupBy("process", "poll").agg(F.count(F.lit(1)).alias("n"), F.count_if("completes").alias("done"))
    w = Window.partitionBy("process").orderBy("poll")
    moved = (F.col("n") * line_bytes >= least_bytes) | (F.col("done") > 0)
    out = polls.select("process", "poll", F.sum("n").over(w).alias("lines"), F.sum("done").over(w).alias("completed"), moved.alias("progress"), F.max(F.when(moved, F.col("poll"))).over(w).alias("last"))
    gone = F.col("poll") - F.coalesce("last", "poll")
    return out.select("process", "poll", "lines", "completed", "progress", F.when(F.col("progress"), "ok").when(gone >= stuck_after, "stuck").otherwise("quiet").alias("event"))
