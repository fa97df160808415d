"""Counts of a run, taken while its tables are written, and a log of them.

Spark's observed metrics are counted by the tasks that write a table, so counts cost no second pass.  A log is a folder of
small files, one an event, never changed; it is read as a table.
"""

from __future__ import annotations

import json
import uuid
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener

EVENT = "at timestamp, kind string, counts map<string,string>"


def counted(df: DataFrame, **counts: Column) -> tuple[Observation, DataFrame]:
    """``df`` whose next action also takes ``counts``; they are in the observation's ``get`` after it."""
    seen = Observation(f"counts-{uuid.uuid4().hex}")
    return seen, df.observe(seen, *(c.alias(n) for n, c in counts.items()))


class RunLog:
    """Events (at, kind, counts) under ``path``, in any file system that Spark reads.  Several writers may append."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def append(self, kind: str, counts: dict) -> None:
        """Write one event; it is there whole or not at all, as a reader sees no name that begins with a dot."""
        at = datetime.now(UTC)
        line = json.dumps({"at": at.isoformat(timespec="milliseconds").replace("+00:00", "Z"), "kind": kind, "counts": {k: None if v is None else str(v) for k, v in counts.items()}})
        path, jvm = f"{at:%Y%m%dT%H%M%S%f}-{uuid.uuid4().hex}.json", self.spark._jvm
        draft, final = (jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}") for name in (f".{path}", path))
        files = final.getFileSystem(self.spark._jsc.hadoopConfiguration())
        files.mkdirs(final.getParent())
        stream = files.create(draft, False)
        try:
            stream.write(bytearray(line.encode()))
        finally:
            stream.close()
        files.rename(draft, final)

    def read(self, kind: str | None = None) -> DataFrame:
        """The events, of one kind if it is named; none where there is no log."""
        root = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if not root.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(root):
            return self.spark.createDataFrame([], EVENT)
        events = self.spark.read.schema(EVENT).json(self.path)
        return events.where(F.col("kind") == kind) if kind else events


class ProgressLog(StreamingQueryListener):
    """A listener that logs each batch of the session's streams, by its name or id: ``spark.streams.addListener(ProgressLog(log))``."""

    def __init__(self, log: RunLog):
        self.log = log

    def onQueryStarted(self, event) -> None:  # noqa: N802  names of the interface
        self.log.append("stream-start", {"query": event.name or str(event.id)})

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        seen = {f"{name}.{k}": v for name, row in p.observedMetrics.items() for k, v in row.asDict().items()}
        self.log.append("stream-batch", {"query": p.name or str(p.id), "batch": p.batchId, "rows": p.numInputRows, "rows_per_second": p.processedRowsPerSecond, "batch_ms": p.batchDuration, **seen})

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        self.log.append("stream-end", {"query": str(event.id), "error": event.exception})
