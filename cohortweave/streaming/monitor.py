"""Streaming training-log and event operators."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from ..sources.stored import StoredTable
from ..sources.tables import parse_epochs


METRICS = ("train_loss", "val_loss", "train_f1", "val_f1", "learning_rate", "task")
DONE = "metrics.json"  # a run that has this file is finished


def log_stream(spark: SparkSession, folder: str) -> DataFrame:
    """(run, file, value, seen_at, logged_at): lines of all files in the runs' folders under folder, as a stream; when each was read, and
    when its file was written.

    A file is read once, when it appears; a log that grows in place is for merge_epochs over a fresh read.
    """
    path = F.split(F.col("_metadata.file_path"), "/")
    lines = spark.readStream.option("recursiveFileLookup", "true").text(folder)
    return lines.select(F.element_at(path, -2).alias("run"), F.element_at(path, -1).alias("file"), "value", F.current_timestamp().alias("seen_at"), F.col("_metadata.file_modification_time").alias("logged_at"))


def epochs_of(lines: DataFrame) -> DataFrame:
    """(run, seen_at, logged_at, epoch, metrics) of lines; lines that are no epoch fall out."""
    return parse_epochs(lines, ["run", "seen_at", "logged_at"])


def merged_epochs(old: DataFrame | None, lines: DataFrame) -> DataFrame:
    """A row per run and epoch: first_at, the time it was first seen, last_at and the metrics of the line logged last (of ties the greatest).

    Taking the same lines in again changes nothing, in any order and number of steps.
    """
    fields = F.struct(*METRICS)
    new = epochs_of(lines).select("run", "epoch", F.col("seen_at").alias("first_at"), F.col("logged_at").alias("last_at"), *METRICS)
    both = new if old is None else old.select(new.columns).unionByName(new)
    last = both.groupBy("run", "epoch").agg(F.min("first_at").alias("first_at"), F.max(F.struct("last_at", fields.alias("m"))).alias("x"))
    return last.select("run", "epoch", "first_at", "x.last_at", "x.m.*")


def _stream_id(spark: SparkSession, checkpoint: str) -> str:
    return json.loads(spark.read.text(f"{checkpoint}/metadata").first().value)["id"]


def keep_log(lines: DataFrame, table: StoredTable, checkpoint: str, trigger: dict | None = None):
    """Keep `table` (a row per run and epoch) current with a stream of lines; returns the query, which may be stopped and started again.

    A batch's number is written with its rows in one swap, under the checkpoint's own id: a batch that is played again after a crash
    finds its number and leaves the table as it is, and where it has none, the keyed merge gives the same rows.
    """
    def merge(batch: DataFrame, number: int) -> None:
        spark, state = batch.sparkSession, table.state()
        notes = state.get("notes", {})
        stream = _stream_id(spark, checkpoint)
        if notes.get(stream, -1) >= number:
            return
        table.write(merged_epochs(table.read() if state else None, batch), **{**notes, stream: number})

    return lines.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def read_log(spark: SparkSession, folder: str, table: StoredTable) -> None:
    """The same from all of the files as they stand, for logs that grow in place: one pass of a poll."""
    path = F.split(F.col("_metadata.file_path"), "/")
    lines = spark.read.option("recursiveFileLookup", "true").text(folder)
    seen = lines.select(F.element_at(path, -2).alias("run"), "value", F.current_timestamp().alias("seen_at"), F.col("_metadata.file_modification_time").alias("logged_at"))
    table.write(merged_epochs(table.read() if table.exists() else None, seen), **table.state().get("notes", {}))


STATES = "run string, status string, latest int, n_epochs int, seconds_per_epoch double, at timestamp"


def _pace(stamps: list[tuple[int, float]], last: int = 5) -> float | None:
    """Seconds an epoch: the mean of the last positive gaps between first sightings, each over the epochs that it spans."""
    gaps = [(t - s) / (e - d) for (d, s), (e, t) in zip(stamps, stamps[1:]) if t > s]
    return sum(gaps[-last:]) / len(gaps[-last:]) if gaps else None


def _run_step(stall_ms: int):
    def step(key, parts, state):
        run, at = key[0], pd.Timestamp(state.getCurrentProcessingTimeMs(), unit="ms", tz="UTC")
        latest, n_epochs, finished, epochs, times = state.get if state.exists else (None, 0, False, [], [])
        stamps = dict(zip(epochs, times))
        if state.hasTimedOut:
            status = "stalled" if n_epochs else "waiting"
        else:
            for frame in parts:
                finished = finished or bool((frame["file"] == DONE).any())
                for value, seen in zip(frame["value"], frame["seen_at"]):
                    epoch = _epoch(value)
                    if epoch is None:
                        continue
                    if latest is None or epoch > latest:
                        n_epochs += 1
                        latest = epoch
                        stamps[epoch] = seen.timestamp()
                    elif epoch in stamps:
                        stamps[epoch] = min(stamps[epoch], seen.timestamp())
            status = "finished" if finished else "running" if n_epochs else "waiting"
        kept = sorted(stamps.items())[-_KEPT:]
        state.update((latest, n_epochs, finished, [e for e, _ in kept], [t for _, t in kept]))
        if status in ("running", "waiting") and not state.hasTimedOut:
            state.setTimeoutDuration(stall_ms)
        yield pd.DataFrame({"run": [run], "status": [status], "latest": pd.array([latest], "Int32"), "n_epochs": pd.array([n_epochs], "Int32"), "seconds_per_epoch": [_pace(kept)], "at": [at]})

    return step


_KEPT = 12  # first sightings that a run's state holds: what the pace needs


def _epoch(value: str) -> int | None:
    try:
        row = json.loads(value)
        return int(row["epoch"]) if isinstance(row, dict) else None
    except (ValueError, KeyError, TypeError, OverflowError):
        return None


def run_states(lines: DataFrame, stall: float) -> DataFrame:
    """A stream of each run's status as it changes (STATES) from a stream of lines (run, file, value, seen_at).

    waiting: files but no epoch; running: a new line within `stall` seconds; stalled: none since, when the state's timer fires; finished:
    the file DONE is there, for good. A run's state is its count, its latest epoch and its last first sightings, whatever its log's length.
    An epoch under the latest adds no epoch.
    """
    return lines.groupBy("run").applyInPandasWithState(
        _run_step(int(stall * 1000)), STATES, "latest int, n_epochs int, finished boolean, epochs array<int>, times array<double>",
        "update", GroupStateTimeout.ProcessingTimeTimeout)


def time_left(stamps: DataFrame, max_epochs: int, last: int = 5) -> DataFrame:
    """seconds_per_epoch, the mean of the last positive gaps between first sightings, each over its epochs, and eta_s of those to come.

    stamps: epoch, first_at; a row per epoch, so one window over all is small.
    """
    w = Window.orderBy("epoch")
    gap = (F.unix_micros("first_at") - F.unix_micros(F.lag("first_at").over(w))) / 1e6 / (F.col("epoch") - F.lag("epoch").over(w))
    g = stamps.select("epoch", gap.alias("gap")).filter("gap > 0").orderBy(F.desc("epoch")).limit(last)
    left = F.greatest(F.lit(max_epochs) - F.col("latest"), F.lit(0))
    j = g.agg(F.avg("gap").alias("seconds_per_epoch")).crossJoin(stamps.agg(F.max("epoch").alias("latest")))  # a row each
    return j.select("latest", "seconds_per_epoch", (left * F.col("seconds_per_epoch")).alias("eta_s"))


def run_status(finished: Column, alive: Column, n_epochs: Column) -> Column:
    """finished, running, stalled (epochs but no process) or waiting."""
    return F.when(finished, "finished").when(alive, "running").when(n_epochs > 0, "stalled").otherwise("waiting")


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Tumbling counts and sums by event type, for streams and tables alike."""
    e = events.withWatermark("ts", late) if events.isStreaming else events
    return e.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")).select(
        F.col("w.start").alias("w_start"), "event_type", "n", "total"
    )
