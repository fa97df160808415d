"""Centroid clustering (Lloyd's rounds, exact in integers) with Elkan's bounds.

Vectors travel in blocks, each a row of packed columns: ids, the integer matrix, the cluster of each vector, an upper
bound of its distance to that cluster's centroid and a lower bound of its distance to every centroid.  A round is one
pass over the blocks:

* bounds are moved by how far the centroids moved; where the upper bound is strictly below half the distance from the
  vector's centroid to the next one, nothing is computed;
* else a distance is computed only to centroids whose lower bound, and half whose distance from the best centroid so far,
  are not above the upper bound.

Distances are integers; bounds are doubles, rounded up or down by a step after each operation, so a bound never says more than
is true.  Only what is strictly farther is skipped, so a tie is always computed and goes to the smaller number.  A
block carries the sums of its clusters, so new centroids come from a scan of that one small column.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, discard, stage
from .kernels import narrow, widen

K, ROUNDS, DIMENSION, SCALE, SEED = 8, 10, 64, 1024, 3
#: Components up to here have squared distances that a long holds, for up to 128 of them.
_SMALL = 1 << 27
_STATE = "ids binary, valid binary, vectors binary, cluster binary, upper binary, lower binary, sums binary, computed long"
_LONG = 2**63 - 1


def _above(x: np.ndarray) -> np.ndarray:
    return np.nextafter(x, np.inf)


def _below(x: np.ndarray) -> np.ndarray:
    return np.maximum(np.nextafter(x, -np.inf), 0.0)


def root_above(squared) -> np.ndarray:
    """Doubles that are at least the square roots of exact integers; two steps for the two roundings."""
    return _above(_above(_above(np.sqrt(np.asarray(squared, np.float64)))))


def root_below(squared) -> np.ndarray:
    return _below(_below(_below(np.sqrt(np.asarray(squared, np.float64)))))


def squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of the rows of ``x`` (longs) to one centroid; integers of any size where longs could
    overflow."""
    if not x.size:
        return np.zeros(len(x), np.int64)
    if max(int(x.max()), -int(x.min()), int(c.max()), -int(c.min())) <= _SMALL and x.shape[1] <= 128:
        gap = x - c
        return np.einsum("ij,ij->i", gap, gap)
    gap = x.astype(object) - c.astype(object)
    return (gap * gap).sum(1)


class Centroids:
    """Exact centroids, bounds of half the distances between them, and of how far each has moved."""

    def __init__(self, at: np.ndarray, before: np.ndarray | None = None):
        k = len(at)
        self.at = at
        self.half = np.full((k, k), np.inf)
        for j in range(k):
            self.half[j] = _below(0.5 * root_below(squares(at, at[j])))
            self.half[j, j] = np.inf
        self.nearest = self.half.min(1)
        self.moved = np.array([float(root_above(squares(at[j : j + 1], before[j]))[0]) if (at[j] != before[j]).any() else 0.0 for j in range(k)]) if before is not None else np.zeros(k)


def assign(x: np.ndarray, c: Centroids, cluster: np.ndarray | None, upper: np.ndarray | None, lower: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(cluster, upper, lower, number of distances computed) of the rows of ``x``, from the state of the round before."""
    n, k = len(x), len(c.at)
    if cluster is None:
        cluster, upper, lower = np.zeros(n, np.int64), np.full(n, np.inf), np.zeros((n, k))
    else:
        cluster = cluster.astype(np.int64)
        upper = np.where(c.moved[cluster] > 0, _above(upper + c.moved[cluster]), upper)
        lower = np.where(c.moved > 0, _below(lower - c.moved), lower)
    rows = np.flatnonzero(~(c.nearest[cluster] > upper))
    computed = 0
    if len(rows):
        best, mine = cluster[rows].copy(), x[rows]
        exact = np.zeros(len(rows), np.int64)
        for j in np.unique(best):
            at = np.flatnonzero(best == j)
            found = squares(mine[at], c.at[j])
            exact = exact.astype(object) if found.dtype == object else exact
            exact[at] = found
            computed += len(at)
        up = root_above(exact)
        lower[rows, best] = root_below(exact)
        start = best.copy()
        for j in range(k):
            near = np.flatnonzero((start != j) & ~(lower[rows, j] > up) & ~(c.half[best, j] > up))
            if not len(near):
                continue
            found = squares(mine[near], c.at[j])
            computed += len(near)
            lower[rows[near], j] = root_below(found)
            if found.dtype == object:
                exact = exact.astype(object)
            win = (found < exact[near]) | ((found == exact[near]) & (j < best[near]))
            at = near[win]
            exact[at], best[at] = found[win], j
            up[at] = root_above(found[win])
        cluster[rows], upper[rows] = best, up
    return cluster, upper, lower, computed


def _sums(x: np.ndarray, cluster: np.ndarray, k: int) -> bytes:
    """Count and exact sums of each cluster of a block, as text where longs could overflow."""
    total = np.zeros((k, x.shape[1] + 1), object)
    for j in np.unique(cluster):
        own = x[cluster == j]
        wide = own.size and max(int(own.max()), -int(own.min())) > (1 << 62) // len(own)
        total[j, 0], total[j, 1:] = len(own), own.astype(object).sum(0) if wide else own.sum(0)
    return " ".join(map(str, total.ravel())).encode()


def _longs(flat: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) of doubles, held to the range of a long."""
    v = np.floor(flat.astype(np.float64) * scale)
    out = np.clip(v, -(2.0**63), 2.0**63 - 1024).astype(np.int64)
    out[v >= 2.0**63] = _LONG
    return out


def integer_blocks(df: DataFrame, key: str, vector: str, dimension: int = DIMENSION, scale: int = SCALE) -> DataFrame:
    """Blocks (ids, valid, vectors) of the kept vectors, a block for each batch of rows."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = _longs(b.column(1).flatten().to_numpy(zero_copy_only=False), scale)
                ids = b.column(0)
                known = ids.is_valid().to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([pa.array([c], pa.binary()) for c in (narrow(ids.fill_null(0).to_numpy(zero_copy_only=False)), np.packbits(known).tobytes(), narrow(x))], names=["ids", "valid", "vectors"])

    return kept_vectors(df, key, vector, dimension).mapInArrow(run, "ids binary, valid binary, vectors binary")


def kept_vectors(df: DataFrame, key: str, vector: str, dimension: int = DIMENSION) -> DataFrame:
    """(id, v) of the rows whose vector has exactly ``dimension`` components, none null or non-finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return df.where(F.col(vector).isNotNull() & (F.size(vector) == dimension) & finite).select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))


def first_centroids(df: DataFrame, key: str, vector: str, k: int, dimension: int, scale: int, seed: int) -> np.ndarray:
    """The ``k`` kept vectors with the smallest hash of ``seed:id``; equal hashes by the vector.  Without an id, last."""
    ranked = kept_vectors(df, key, vector, dimension).withColumn("h", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")).cast("binary"), 256))
    first = ranked.orderBy(F.asc_nulls_last("h"), "v").limit(k).select("v").collect()  # k rows
    return np.array([_longs(np.array(r[0]), scale) for r in first], np.int64).reshape(-1, dimension)


def _step(blocks: DataFrame, c: Centroids, dimension: int) -> DataFrame:
    """The blocks after a round's assignment."""
    again, k = "cluster" in blocks.columns, len(c.at)
    sent = blocks.sparkSession.sparkContext.broadcast(c)  # k centroids

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = sent.value
        for b in batches:
            for r in b.to_pylist():
                x = widen(r["vectors"]).reshape(-1, dimension)
                state = (np.frombuffer(r["cluster"], np.int32), np.frombuffer(r["upper"]), np.frombuffer(r["lower"]).reshape(-1, k)) if again else (None, None, None)
                cluster, upper, lower, computed = assign(x, c, *state)
                held = [r["ids"], r["valid"], r["vectors"], cluster.astype(np.int32).tobytes(), upper.tobytes(), lower.tobytes(), _sums(x, cluster, k)]
                yield pa.RecordBatch.from_arrays([*(pa.array([h], pa.binary()) for h in held), pa.array([computed], pa.int64())], names=[f.split()[0] for f in _STATE.split(", ")])

    return blocks.mapInArrow(run, _STATE)


def _totals(texts: DataFrame, column: str) -> list[int]:
    """Exact sums, place by place, of a column of integers as text; each task hands on one row."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            for x in b.column(0).to_pylist():
                part = np.array([int(v) for v in x.split()], object)
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([str(v) for v in total]), pa.array(np.arange(len(total), dtype=np.int32))], names=["value", "place"])

    per_task = texts.select(column).mapInArrow(run, "value string, place int")
    summed = per_task.groupBy("place").agg(F.sum(F.col("value").cast("decimal(38,0)")).cast("string").alias("value")).collect()  # clusters times components
    out = [0] * len(summed)
    for r in summed:
        out[r["place"]] = int(r["value"])
    return out


def cluster_vectors(df: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = K, rounds: int = ROUNDS, dimension: int = DIMENSION, scale: int = SCALE, seed: int = SEED) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every vector with exactly ``dimension``
    components, none null or non-finite.

    A component x becomes floor(scale * x), held to the range of a long.  Centroids start as the ``k`` vectors with the smallest
    SHA-256 of ``seed:id`` (all, if fewer; equal ids by their vectors; a null id comes last).  In each round every vector goes to
    the nearest centroid, ties to the smaller number, and a centroid that has vectors moves to the floor of their mean.
    After the rounds vectors are assigned once more.  Repeated rows count each; a null id comes back null; other
    columns are not read.  Distances and inertias beyond a long are held to its end.  An empty table gives none.
    """
    spark = df.sparkSession
    bound_batches(spark)
    result = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    at = first_centroids(df, key, vector, k, dimension, scale, seed)
    k = len(at)
    if not k:
        return spark.createDataFrame([], result)
    state, c = stage(integer_blocks(df, key, vector, dimension, scale), "vectors"), Centroids(at)
    for _ in range(rounds):
        after = stage(_step(state, c, dimension), "assigned")
        discard(spark, state._staged_at)
        state = after
        sums = np.array(_totals(state, "sums"), object).reshape(k, dimension + 1)
        moved = np.array([[s // row[0] for s in row[1:]] if row[0] else list(old) for row, old in zip(sums, c.at, strict=True)], object).astype(np.int64).reshape(k, dimension)
        c = Centroids(moved, c.at)
    last = stage(_final(_step(state, c, dimension), c, dimension), "distances")
    discard(spark, state._staged_at)
    inertia = _totals(last, "inertia")
    prints = [hashlib.sha256(",".join(map(str, row)).encode()).hexdigest() for row in c.at.tolist()]
    own, all_of = [min(x, _LONG) for x in inertia], min(sum(inertia), _LONG)

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                ids, cluster, gap = widen(r["ids"]), np.frombuffer(r["cluster"], np.int32), widen(r["distance"])
                known = np.unpackbits(np.frombuffer(r["valid"], np.uint8), count=len(ids)).astype(bool)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, mask=~known), pa.array(cluster), pa.array(gap), pa.array(np.array(own, np.int64)[cluster]), pa.array(np.full(len(ids), all_of, np.int64)), pa.array(prints).take(pa.array(cluster))],
                    names=["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"],
                )

    return last.select("ids", "valid", "cluster", "distance").mapInArrow(rows, result)


def _final(blocks: DataFrame, c: Centroids, dimension: int) -> DataFrame:
    """(ids, valid, cluster, distance, inertia): exact distances, and their sums by cluster as text."""
    sent = blocks.sparkSession.sparkContext.broadcast(c.at)  # k centroids

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = sent.value
        for b in batches:
            for r in b.to_pylist():
                x, cluster = widen(r["vectors"]).reshape(-1, dimension), np.frombuffer(r["cluster"], np.int32)
                gap, total = np.zeros(len(x), np.int64), [0] * len(at)
                for j in np.unique(cluster):
                    own = cluster == j
                    found = squares(x[own], at[j])
                    total[j] = min(sum(found.tolist()), 1 << 64)  # beyond a long it is held to its end
                    gap[own] = np.array([min(int(v), _LONG) for v in found], np.int64) if found.dtype == object else found
                yield pa.RecordBatch.from_arrays([pa.array([h], pa.binary()) for h in (r["ids"], r["valid"], r["cluster"], narrow(gap))] + [pa.array([" ".join(map(str, total)).encode()], pa.binary())], names=["ids", "valid", "cluster", "distance", "inertia"])

    return blocks.select("ids", "valid", "vectors", "cluster").mapInArrow(run, "ids binary, valid binary, cluster binary, distance binary, inertia binary")
