"""The index of a folder: change detection against its manifest, and one version per change."""

from __future__ import annotations

from collections.abc import Callable
from time import perf_counter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodegrain.operators.chunkers import chunk_files
from lodegrain.operators.run_log import RunLog, counted
from lodegrain.operators.segments import SegmentedIndex
from lodegrain.sources.workspace import discard, stage

#: Folder of an index that holds the log of its runs.
RUNS = "_runs"


def file_hash(content) -> F.Column:
    return F.sha2(content, 256)


def manifest_diff(current: DataFrame, manifest: DataFrame) -> DataFrame:
    """(file_path, status): new, changed, unchanged or removed, from (file_path, size, mtime, hash) on both
    sides.  Size and time are compared first; a hash decides only where both are equal."""
    old = manifest.select("file_path", F.col("size").alias("old_size"), F.col("mtime").alias("old_mtime"), F.col("hash").alias("old_hash"))
    both = current.select("file_path", "size", "mtime", "hash").join(old, "file_path", "full_outer")
    status = F.when(F.col("old_size").isNull(), "new").when(F.col("size").isNull(), "removed").when((F.col("size") != F.col("old_size")) | (F.col("mtime") != F.col("old_mtime")) | (F.col("hash") != F.col("old_hash")), "changed").otherwise("unchanged")
    return both.select("file_path", status.alias("status"))


def changed_files(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """The rows of ``files`` that have to be chunked."""
    todo = manifest_diff(files, manifest).where(F.col("status").isin("new", "changed")).select("file_path")
    return files.join(todo, "file_path", "left_semi")


def open_index(spark: SparkSession, path: str) -> SegmentedIndex:
    return SegmentedIndex(spark, path)


def index_files(spark: SparkSession, files: DataFrame, path: str, embed: Callable[[DataFrame], DataFrame] | None = None, only: DataFrame | None = None) -> DataFrame:
    """Bring the index under ``path`` up to date with (file_path, content, size, mtime, hash) rows, as one new version
    of chunks, manifest and keywords together; returns the status of every file.  Only new and changed files are
    chunked and tokenized.  Files without chunks are in the manifest too.  With ``only`` (file_path) other files are
    left as they are; without, a file that ``files`` lacks is removed.

    Counts of the run, taken while its tables are written, go to its log (:func:`indexing_runs`)."""
    began, index = perf_counter(), open_index(spark, path)
    now = index.snapshot()
    manifest = now.owners() if now else spark.createDataFrame([], "file_path string, size long, mtime timestamp, hash string")
    if only is not None:
        manifest = manifest.join(only.select("file_path").distinct(), "file_path", "left_semi")
    seen, compared = counted(manifest_diff(files, manifest), files=F.count("*"), **{s: F.count_if(F.col("status") == s) for s in ("new", "changed", "removed", "unchanged")})
    status = stage(compared, "file-status")
    if seen.get["unchanged"] == seen.get["files"]:
        return status
    todo = files.join(status.where(F.col("status").isin("new", "changed")).select("file_path"), "file_path", "left_semi")
    chunks = chunk_files(todo)
    made, chunks = counted((embed(chunks) if embed else chunks).withColumn("indexed_at", F.current_timestamp()), chunks=F.count("*"), indexed=F.count_if(F.col("chunk_index") == 0))
    chunks = stage(chunks, "chunks")
    per_file = chunks.groupBy("file_path").agg(F.count("*").cast("int").alias("chunks"), F.first("language").alias("language"))
    held = todo.select("file_path", "size", "mtime", "hash").join(per_file, "file_path", "left").withColumn("chunks", F.coalesce("chunks", F.lit(0))).withColumn("indexed_at", F.current_timestamp())
    index.update(chunks, held, status.where("status = 'removed'").select("file_path"))
    discard(chunks)
    todo_files, seconds = seen.get["new"] + seen.get["changed"], perf_counter() - began
    done = made.get["indexed"]
    RunLog(spark, f"{path}/{RUNS}").append("indexing", {**seen.get, **made.get, "failed": todo_files - done, "seconds": round(seconds, 3), "files_per_second": round(done / max(seconds, 1e-9), 3)})
    return status


def indexing_runs(spark: SparkSession, path: str) -> DataFrame:
    """One row a run that changed the index, with what it counted while it wrote: files by status, how many were indexed and how
    many failed (no chunk), chunks, seconds and files a second."""
    kinds = [*((c, "long") for c in ("files", "new", "changed", "removed", "unchanged", "indexed", "failed", "chunks")), ("seconds", "double"), ("files_per_second", "double")]
    return RunLog(spark, f"{path}/{RUNS}").read("indexing").select("at", *(F.element_at("counts", c).cast(k).alias(c) for c, k in kinds))


def index_size(spark: SparkSession, path: str) -> int:
    """Bytes of all files of an index."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    return files.getContentSummary(root).getLength() if files.exists(root) else 0


def indexing_stats(status: DataFrame, chunks: DataFrame, seconds: float) -> DataFrame:
    """(files, indexed, failed, chunks, files_per_second) of a run: its files' (file_path, status), the index's chunks,
    and how long it took; a file that was to be indexed and has no chunk has failed."""
    todo = status.where(F.col("status").isin("new", "changed"))
    held = chunks.groupBy("file_path").agg(F.count("*").alias("n"))
    done = todo.join(held, "file_path", "left").agg(F.count("n").alias("indexed"), F.count_if(F.col("n").isNull()).alias("failed"), F.coalesce(F.sum("n"), F.lit(0)).alias("chunks"))
    return status.agg(F.count("*").alias("files")).crossJoin(done).withColumn("files_per_second", F.round(F.col("indexed") / F.lit(max(seconds, 1e-9)), 3))
