"""Written intermediate tables in the shared folder, and side tables of a checked size."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of under 100 bytes that may be broadcast; larger sides are joined by shuffle.
BROADCAST_ROWS = 200_000
SALTS = 32
_own: dict[str, str] = {}
_swept: set[str] = set()


def work_path(spark: SparkSession, name: str) -> str:
    """A new path in the application's folder under ``spark.checkpoint.dir``, or under a folder of our own where that is
    unset and all runs in one process.  The application's folder goes when the driver ends."""
    root, app = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext.applicationId
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = _own.setdefault(app, "file://" + tempfile.mkdtemp(prefix="lodegrain-"))
    root = f"{root.rstrip('/')}/lodegrain-{app}"
    if root not in _swept:
        _swept.add(root)
        path = spark._jvm.org.apache.hadoop.fs.Path(root)
        files = path.getFileSystem(spark._jsc.hadoopConfiguration())
        files.mkdirs(path)
        files.deleteOnExit(path)
    return f"{root}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` and read it back, so its lineage ends in files that all executors share."""
    path = work_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def discard(*staged: DataFrame | None) -> None:
    """Remove tables of :func:`stage` that nothing will read any more."""
    for df in staged:
        if df is not None:
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._staged_at)
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def bounded(df: DataFrame, rows: int, most: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast a side of ``rows`` rows if they are few enough; else leave it to a shuffled join."""
    return F.broadcast(df) if rows <= most else df


def spread(df: DataFrame, bytes_each: int = 1 << 20) -> DataFrame:
    """Deal a small table, which its few files would leave to one task or a few, over all cores; a table of as many
    files, or with work for all cores by its size, is left as it is.  Both are known to the planner, so nothing is
    read for it."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    tasks = min(cores, -(-size // bytes_each))
    return df.repartition(tasks) if 1 < tasks and size < cores << 24 and 0 < len(df.inputFiles()) < cores else df


def attach_first(df: DataFrame, by: Sequence[str], first: str, out: str) -> DataFrame:
    """Add ``out``, the smallest ``first`` of the rows with equal ``by``.  A group of any size is dealt over
    several tasks, in the aggregation and in the join.  ``df`` is read twice."""
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(first), F.lit(SALTS)).cast("int"))
    part = salted.groupBy(*by, "_salt").agg(F.min(first).alias("_least"))
    least = part.groupBy(*by).agg(F.min("_least").alias(out), F.collect_set("_salt").alias("_at"))
    return salted.join(least.withColumn("_salt", F.explode("_at")).drop("_at"), [*by, "_salt"], "left").drop("_salt")
