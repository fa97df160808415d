"""File events: snapshot differences, debouncing, and keeping an index up to date from a stream.

A file source only shows new files; changes and removals come from comparing each trigger's listing with the one
before (``sources/folder_changes.py``).  Debouncing keeps the time of a path's last accepted event as state.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lodegrain.operators.index import index_files, manifest_diff
from lodegrain.sources.files import admitted_files, project_files, watchable
from lodegrain.sources.folder_changes import changed_contents, folder_changes, mounted
from lodegrain.sources.workspace import bounded, discard, stage

DELAY_SECONDS, PASSIVE_DELAY_SECONDS, FILES_PER_TRIGGER, FLUSH = 1.0, 10.0, 10, "5 seconds"
KEPT_SECONDS = 3600
#: Events that one task folds, about.
STRETCH = 500_000


def file_events(before: DataFrame, now: DataFrame) -> DataFrame:
    """(file_path, event): created, modified or deleted between two (file_path, size, mtime, hash) snapshots."""
    diff = manifest_diff(now, before).where("status <> 'unchanged'")
    return diff.select("file_path", F.when(F.col("status") == "new", "created").when(F.col("status") == "changed", "modified").otherwise("deleted").alias("event"))


def accepted(times: list[float], last: float | None, delay: float) -> list[bool]:
    """Which of a path's events, in order of time, come at least ``delay`` after the last accepted one."""
    out = []
    for t in times:
        ok = last is None or t - last >= delay
        out.append(ok)
        last = t if ok else last
    return out


def passages(times: np.ndarray, delay: int) -> tuple[np.ndarray, np.ndarray]:
    """What a stretch of one key's events (rising times) makes of the time from which events count: (until, leaves), where
    a time of at most ``until[i]``, and more than ``until[i - 1]``, becomes ``leaves[i]``; a later one stays as it is.

    An accepted event leads to the first one that is ``delay`` later, and that one on; doubling these steps gives where each
    ends.  Events before it can set the time to no more than ``delay`` after the first, and paths soon join, so the
    table is short."""
    n = len(times)
    step = np.maximum(np.searchsorted(times, times + delay), np.arange(1, n + 1))  # one event on at least, if there is no delay
    ends = np.where(step < n, step, np.arange(n))
    while True:
        on = ends[ends]
        if (on == ends).all():
            break
        ends = on
    leaves = times[ends] + delay
    reach = min(n, int(np.searchsorted(times, times[0] + delay)) + 1) if n else 0
    last = np.append(leaves[1:reach] != leaves[: reach - 1], True) if reach else np.zeros(0, bool)
    return times[:reach][last], leaves[:reach][last]


def debounce(events: DataFrame, key: str, ts: str, order: str, delay: float = DELAY_SECONDS, stretch: int = STRETCH) -> DataFrame:
    """The accepted events of a finite table: those at least ``delay`` seconds after the last accepted one of their key.
    Events without a time are none; of events at one time the first by ``order`` comes first, then any.

    Acceptance depends on what was accepted before, yet a key is not bound to one task: events are dealt in stretches by
    key and time, of about ``stretch`` rows.  For keys that go over several, each stretch gives the table of its
    :func:`passages`; following these tables from stretch to stretch gives when each one's events begin to count, and then
    all stretches are read at once, holding one time."""
    columns, spark = events.columns, events.sparkSession
    names = [f"c{i}" for i in range(len(columns))]
    named = dict(zip(columns, names, strict=True))
    wait = round(delay * 1_000_000)
    timed = events.toDF(*names).withColumn("_t", F.unix_micros(F.col(named[ts]).cast("timestamp"))).where("_t is not null")
    by = [named[key], "_t", named[order], "_h"]
    kinds = {f: events.schema[c].dataType.simpleString() for f, c in zip(names, columns, strict=True)}
    kind = kinds[named[key]]
    at = columns.index(key)
    parts = max(spark.sparkContext.defaultParallelism, -(-events.count() // stretch))
    # a hash deals events that are alike in key, time and order
    dealt = timed.withColumn("_h", F.xxhash64(*names)).repartitionByRange(parts, *by).sortWithinPartitions(*by).withColumn("_part", F.spark_partition_id())
    held = stage(dealt, "stretches")
    spans = held.groupBy(F.col(named[key]).alias("_k")).agg(F.min("_part").alias("low"), F.max("_part").alias("high")).where("low < high")
    split = stage(held.join(bounded(spans, parts), F.col(named[key]).eqNullSafe(F.col("_k")), "left_semi").select(F.col(named[key]).alias("k"), "_part", "_t"), "split-keys")

    def table(group: pa.Table) -> pa.Table:
        until, leaves = passages(np.sort(group["_t"].to_numpy()), wait)
        return pa.table({"k": group["k"].slice(0, 1), "_part": group["_part"].slice(0, 1), "until": pa.array([until.tolist()], pa.list_(pa.int64())), "leaves": pa.array([leaves.tolist()], pa.list_(pa.int64()))})

    def follow(group: pa.Table) -> pa.Table:
        group, now, begins = group.sort_by("_part"), -(2**63), []
        for until, leaves in zip(group["until"].to_pylist(), group["leaves"].to_pylist(), strict=True):
            begins.append(now)
            i = bisect_left(until, now)
            now = leaves[i] if i < len(until) else now
        return pa.table({"k": group["k"], "_part": group["_part"], "begins": pa.array(begins, pa.int64())})

    entries = split.groupBy("k", "_part").applyInArrow(table, f"k {kind}, _part int, until array<bigint>, leaves array<bigint>").groupBy("k").applyInArrow(follow, f"k {kind}, _part int, begins long")
    begins = stage(entries, "stretch-begins")
    known = held.join(bounded(begins.toDF("_k", "_p", "_begins"), parts * 2), F.col(named[key]).eqNullSafe(F.col("_k")) & (F.col("_part") == F.col("_p")), "left").drop("_k", "_p")
    sorted_rows = known.repartition(parts, "_part").sortWithinPartitions("_part", *by).select(*names, "_t", "_part", "_begins")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, since = object(), 0
        for b in batches:
            ok = []
            for k, t, part, begin in zip(b.column(at).to_pylist(), *(b.column(len(names) + i).to_pylist() for i in range(3)), strict=True):
                if (k, part) != before:
                    before, since = (k, part), -(2**63) if begin is None else begin
                ok.append(t >= since)
                since = t + wait if ok[-1] else since
            yield b.filter(pa.array(ok, pa.bool_())).select(names)

    return sorted_rows.mapInArrow(fold, ", ".join(f"{n} {kinds[n]}" for n in names)).toDF(*columns)


def debounce_stream(events: DataFrame, key: str, ts: str, delay: float = DELAY_SECONDS) -> DataFrame:
    """(key, ts) of the accepted events of a stream; the state is one time per key and goes, by the events' own
    time, two hours after its last event.  Events over an hour late are dropped."""
    kind = events.schema[key].dataType.simpleString()

    def step(name: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(batches)).sort_values(ts)
        times = [t.timestamp() for t in rows[ts]]
        ok = accepted(times, state.get[0] if state.exists else None, delay)
        if any(ok):
            state.update((max(t for t, x in zip(times, ok, strict=True) if x),))
        state.setTimeoutTimestamp(int(1000 * max(times)) + 2 * KEPT_SECONDS * 1000)
        yield pd.DataFrame({key: [name[0]] * sum(ok), ts: list(rows[ts][ok])})

    timed = events.select(key, F.col(ts).cast("timestamp").alias(ts)).withWatermark(ts, f"{KEPT_SECONDS} seconds")
    return timed.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, {ts} timestamp", "last double", "append", GroupStateTimeout.EventTimeTimeout)


def watch(spark: SparkSession, root: str, index_path: str, checkpoint: str, embed: Callable[[DataFrame], DataFrame] | None = None, once: bool = False):
    """A running query that brings the index up to date with the folder at every trigger.

    Of a mounted folder, only files that were created, modified or deleted since the trigger before are read; no file
    is, if none was.  Files whose names are not watched stay in the index as they are, but go when deleted.  In any other store, new
    files start a batch, and the whole listing is then compared with the manifest."""
    if mounted(root) and mounted(checkpoint):
        arriving = folder_changes(spark, root, f"{checkpoint}/listings")
    else:
        shape = "path string, modificationTime timestamp, length long, content binary"
        arriving = spark.readStream.schema(shape).format("binaryFile").option("recursiveFileLookup", True).option("maxFilesPerTrigger", FILES_PER_TRIGGER).load(root).select("path", "length")

    def apply(batch: DataFrame, _: int) -> None:
        if "event" not in batch.columns:
            files = project_files(spark, root)
            index_files(spark, files.where(watchable(F.col("file_path"), F.col("size"))), index_path, embed)
            return
        events = stage(batch.where((F.col("event") == "deleted") | watchable(F.col("file_path"), F.lit(0))), "folder-events")
        if not events.isEmpty():
            files = admitted_files(changed_contents(events.where("event <> 'deleted'"), root))
            index_files(spark, stage(files, "changed-files"), index_path, embed, only=events.select("file_path"))
        discard(events)

    writer = arriving.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=FLUSH)).start()


def windowed_counts(events: DataFrame, ts: str, by: str, window: str = "1 hour", late: str | None = None) -> DataFrame:
    """Rows and sums of ``value`` per tumbling window; give ``late`` for a stream, as its watermark."""
    timed = events.withColumn(ts, F.col(ts).cast("timestamp"))
    timed = timed.withWatermark(ts, late) if late else timed
    return timed.groupBy(F.window(ts, window).alias("w"), by).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("begin"), by, "n", "total")
