"""Shared plumbing: the shared work folder, written intermediate tables, skew-proof minima, components."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_own_dir: dict[str, str] = {}
_swept: set[str] = set()

#: Bytes of a table that may be broadcast.  Larger sides are joined by shuffle.
BROADCAST_BYTES = 32 * 1024 * 1024
SALTS = 64
BATCH_BYTES = 2 * 1024 * 1024


def work_root(spark: SparkSession) -> str:
    """The application's folder in the shared one, ``spark.checkpoint.dir``, which is removed when the driver ends.
    Where that is unset, one of our own will do if all runs in one process; on a cluster it is an error."""
    named, app = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext.applicationId
    if not named:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = _own_dir.setdefault(app, "file://" + tempfile.mkdtemp(prefix="lodegrain-"))
    root = f"{named.rstrip('/')}/lodegrain/{app}"
    if root not in _swept:
        _swept.add(root)
        path = spark._jvm.org.apache.hadoop.fs.Path(root)
        files = path.getFileSystem(spark._jsc.hadoopConfiguration())
        files.mkdirs(path)
        files.deleteOnExit(path)
    return root


def work_path(spark: SparkSession, name: str) -> str:
    return f"{work_root(spark)}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: the lineage ends there and a lost
    executor costs a re-read, not a recomputation."""
    path = work_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def discard(spark: SparkSession, *paths: str | None) -> None:
    """Remove staged tables, by path, that nothing will read any more."""
    for p in paths:
        if p:
            path = spark._jvm.org.apache.hadoop.fs.Path(p)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def bound_batches(spark: SparkSession) -> None:
    """Arrow batches of at most 2 MB, so the memory of a Python worker and of the buffers that feed it does not grow
    with the length of rows.  This sets the session's configuration; a size that it names itself is left."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.sparkContext.getConf().get(key) is None:
        spark.conf.set(key, BATCH_BYTES)


def settle(spark: SparkSession) -> None:
    """Between the stages of a long run: let the executors' JVMs collect their garbage, so that the heap which the
    stage before needed goes back to the machine before the next one's Python workers ask for memory."""
    n = spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).selectExpr("java_method('java.lang.System', 'gc') AS done").write.format("noop").mode("overwrite").save()


def bounded_bytes(df: DataFrame, size: int) -> DataFrame:
    """Broadcast a side of ``size`` bytes if they are few enough; beyond that leave it to a shuffled join."""
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


def bounded(df: DataFrame, rows: int, width: int = 32) -> DataFrame:
    """The same for ``rows`` rows of ``width`` bytes."""
    return bounded_bytes(df, rows * width)


def row_ids(df: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame | None]:
    """``df`` with a column ``doc``, the key as a long where all rows with it have the same text (or none), else a hash
    of key and text, and the (doc, key) of the latter, None if there are none.  A null key has a null ``doc``."""
    ids = df.where(F.col(key).isNotNull()).groupBy(F.col(key).cast("long").alias("_id"))
    if ids.count().where("count > 1").isEmpty():
        return df.withColumn("doc", F.col(key).cast("long")), None
    print_of = F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit("")))
    twice = stage(ids.agg(F.min(print_of).alias("x"), F.max(print_of).alias("y")).where("x <> y").select("_id", F.lit(True).alias("_several")), "repeated-ids")
    named = df.join(bounded(twice, twice.count()), F.col(key).cast("long") == F.col("_id"), "left")
    out = named.withColumn("doc", F.when(F.col("_several"), F.xxhash64(F.col(key).cast("long"), F.coalesce(F.col(text).cast("string"), F.lit("")))).otherwise(F.col(key).cast("long")))
    names = out.where("_several").select("doc", F.col(key).cast("long").alias(key)).distinct()
    return out.drop("_id", "_several"), stage(names, "row-ids")


def salt_of(*columns: str | Column, salts: int = SALTS) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(salts)).cast("int")


def attach_min(df: DataFrame, keys: Sequence[str], value: str, out: str, salts: int = SALTS) -> DataFrame:
    """Add ``out``, the smallest ``value`` among the rows with equal ``keys``.  A key with a third of all
    rows is dealt over ``salts`` tasks in the aggregation and in the join.  Null keys get null.  ``df``
    is read twice, so it should be a scan."""
    salted = df.withColumn("_salt", salt_of(value, salts=salts))
    per = salted.groupBy(*keys, "_salt").agg(F.min(value).alias("_m"))
    least = per.groupBy(*keys).agg(F.min("_m").alias(out), F.collect_set("_salt").alias("_salts"))
    return salted.join(least.withColumn("_salt", F.explode("_salts")).drop("_salts"), [*keys, "_salt"], "left").drop("_salt")


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Connected components of (a, b) links: one row (node, root) per linked node but the roots
    themselves, root being the smallest node reachable.

    Alternating large-star and small-star rounds; every round is a salted minimum and a written table,
    so a hub with any number of links is spread over tasks and nothing is collected.  Null ends are
    ignored.
    """
    spark = edges.sparkSession
    now = stage(edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    if now.isEmpty():
        return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    before = None
    for _ in range(most_rounds):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        star = attach_min(both, ["a"], "b", "m").select("a", "b", F.least("a", "m").alias("m")).where("b > a")
        large = stage(star.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct(), "star")
        discard(spark, now._staged_at)
        star = attach_min(large, ["a"], "b", "m")
        small = star.select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").where("a <> b").distinct()
        now = stage(small, "links")
        discard(spark, large._staged_at)
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.countDistinct("a")).first()
        if tuple(seen) == before and seen[0] == seen[2]:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = tuple(seen)
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def without(docs: DataFrame, key: str, gone: DataFrame, rows: int) -> DataFrame:
    """``docs`` without the rows whose ``key`` is in the one column of ``gone`` (``rows`` rows), nulls being
    equal.  Sides are told apart by alias, so any column names may be in ``docs``."""
    listed = bounded(gone.toDF("id"), rows).alias("gone")
    return docs.alias("docs").join(listed, F.col(f"docs.{key}").eqNullSafe(F.col("gone.id")), "left_anti")
