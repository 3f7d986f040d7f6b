"""Watch events: debounced batches, last state per key, incremental merge into snapshots."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from stratagraph.operators.ordered import islands
from stratagraph.staging import checkpointed, dropped
from stratagraph.streaming.snapshots import Snapshots

DEBOUNCE = "300 milliseconds"
#: Versions of an index that a watcher keeps for readers.
KEPT = 3


def debounce_batch(events: DataFrame, key: str, ts: str, gap_seconds: float) -> DataFrame:
    """(key, start, end, n): runs of events of a key with less than the gap between neighbours."""
    timed = events.withColumn("_us", F.unix_micros(F.col(ts).cast("timestamp")))
    runs = islands(timed, key, ["_us"], "_us", "_us", lambda at, last: at - last >= int(gap_seconds * 1e6))
    return runs.groupBy(key, "_island").agg(F.min(ts).alias("start"), F.max(ts).alias("end"), F.count("*").alias("n")).drop("_island")


def debounce_stream(events: DataFrame, key: str, ts: str, path: str, gap: str = DEBOUNCE, late: str = "10 seconds") -> DataFrame:
    """The streaming form: a session window closes after the gap; each gives its set of paths."""
    return (
        events.withWatermark(ts, late)
        .groupBy(F.session_window(ts, gap).alias("w"), key)
        .agg(F.array_sort(F.collect_set(path)).alias("paths"), F.count("*").alias("n"))
        .select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "paths", "n")
    )


def _joined(runs: list[tuple], gap: int) -> list[tuple]:
    """Runs (start, end, paths, n) in order, those with less than the gap between them made one."""
    out: list[tuple] = []
    for start, end, paths, n in sorted(runs, key=lambda r: r[:2]):
        if out and start - out[-1][1] < gap:
            was = out[-1]
            out[-1] = (was[0], max(was[1], end), was[2] | paths, was[3] + n)
        else:
            out.append((start, end, paths, n))
    return out


def _bursts(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState, silence_ms: int) -> Iterator[pd.DataFrame]:
    """One key's new events, or its timer: finished runs go out, the last one is held until the timer fires."""
    gap = silence_ms * 1000
    held = []
    if state.exists:
        start, end, paths, n = state.get
        held = [(start, end, set(paths), n)]
    if state.hasTimedOut:
        state.remove()
        done = held
    else:
        for batch in batches:
            batch = batch.sort_values("at", kind="stable")
            cuts = np.flatnonzero(np.diff(batch["at"].to_numpy()) >= gap) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(batch)], strict=True):
                part = batch.iloc[lo:hi]
                if len(part):
                    held.append((int(part["at"].iloc[0]), int(part["at"].iloc[-1]), set(part["path"].dropna()), len(part)))
            held = _joined(held, gap)
        *done, (start, end, paths, n) = held
        state.update((start, end, sorted(paths), n))
        state.setTimeoutDuration(silence_ms)
    if done:
        yield pd.DataFrame({"key": [key[0]] * len(done), "start": [r[0] for r in done], "end": [r[1] for r in done], "paths": [sorted(r[2]) for r in done], "n": [r[3] for r in done]})


def debounce_silence(events: DataFrame, key: str, ts: str, path: str, silence_ms: int = 300) -> DataFrame:
    """The streaming form that waits for silence: (key, start, end, paths, n) of a run comes out once its key has had
    no event for ``silence_ms`` of the clock, though no event follows at all; a run that a later one ends comes out at once.

    State is one open run a key, with its distinct paths. Runs are parted by the events' own times, so that a
    backlog gives the same runs. Events without a time are left out; a null path counts in ``n`` only. Timers are
    looked at once a trigger. A stream of ticks without rows beside the events sees to it that they also are
    after a restart, before any event.
    """
    kind = events.schema[key].dataType.simpleString()
    rows = events.where(F.col(ts).isNotNull()).select(F.col(key).alias("key"), F.unix_micros(F.col(ts).cast("timestamp")).alias("at"), F.col(path).cast("string").alias("path"))
    ticks = events.sparkSession.readStream.format("rate").option("rowsPerSecond", 1).option("numPartitions", 1).load().where("value < 0")
    both = rows.unionByName(ticks.select(F.lit(None).cast(kind).alias("key"), F.col("value").alias("at"), F.lit(None).cast("string").alias("path")))
    run = "start long, end long, paths array<string>, n long"
    out = both.groupBy("key").applyInPandasWithState(partial(_bursts, silence_ms=silence_ms), f"key {kind}, {run}", run, "append", GroupStateTimeout.ProcessingTimeTimeout)
    return out.select(F.col("key").alias(key), F.timestamp_micros("start").alias("start"), F.timestamp_micros("end").alias("end"), "paths", "n")


def last_state(events: DataFrame, key: str, ts: str, *values: str) -> DataFrame:
    """The last row per key, as a max aggregate."""
    return events.groupBy(key).agg(F.max_by(F.struct(*values), F.struct(ts, *values)).alias("r")).select(key, "r.*")


def merge(index: DataFrame, batch: DataFrame, key: str = "file", hash_: str = "source_hash") -> tuple[DataFrame, DataFrame]:
    """(new index, moved rows): batch rows replace the index's; rows without a hash are deletions; equal hashes change nothing."""
    old = index.select(key, F.col(hash_).alias("_old"))
    moved = batch.join(old, key, "left").where(~F.col(hash_).eqNullSafe(F.col("_old"))).drop("_old")
    kept = index.join(moved.select(key), key, "left_anti")
    return kept.unionByName(moved.where(F.col(hash_).isNotNull())), moved


def maintain(stream: DataFrame, snapshots: Snapshots, checkpoint: str, extract):
    """Start the watcher: each micro-batch of (file, source_hash, text) merges into the current index version.

    ``extract(rows)`` runs on the batch's rows only, and only the buckets that hold them are read; those of moved rows
    are written again. A batch that moves nothing publishes nothing. A batch that is repeated after a failure moves nothing more.
    """

    def step(batch: DataFrame, _: int) -> None:
        rows = checkpointed(extract(batch))  # read three times, extracted once
        old = snapshots.read(batch.sparkSession, "index", snapshots.touched("index", rows))
        moved = checkpointed(merge(old, rows)[1])
        if not moved.isEmpty():
            snapshots.update("index", moved, lambda held: merge(held, moved)[0])
            snapshots.expire(KEPT)
        dropped(moved)
        dropped(rows)

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).start()
