"""Exact maximum-inner-product top-k by norm-bucketed retrieval.

Candidates are ordered by length (a range partitioning, ties cut by id, so equal vectors spread over
tasks) and each task cuts its run into buckets of similar length.  A query walks a task's buckets from the
longest down with its running k-th score as threshold.  The local cosine threshold of a bucket, threshold /
(query length * longest length in the bucket), picks how it is pruned: not above 1 the bucket is read, else
it and all later ones are skipped; a low threshold uses lengths alone (the prefix that is long enough), a
high one uses the feasible interval of the query's strongest coordinates.  What is left is verified with exact
integer products.  Queries are taken in blocks of bounded size, each against all candidates.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import stage

BUCKET = 1024
QUERY_BLOCK = 8192
COORD_FROM = 0.6
FOCUS = 3
_EXACT = float(2**53)
_SLACK = 1e-6


def integer_vectors(df: DataFrame, key: str, vector: str, scale: int = 256) -> DataFrame:
    """(vec_id, v array<bigint>) with floor(scale * x) of each component, x as double; rows whose vector is
    null or holds a null or non-finite component, or whose id is null, are left out."""
    ok = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return df.where(F.col(key).isNotNull() & F.col(vector).isNotNull() & ok).select(F.col(key).cast("long").alias("vec_id"), F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("v"))


def _matrices(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(dimension, ids, int64 rows) for each dimension that occurs."""
    ids, sizes, flat = [], [], []
    for b in batches:
        col = b.column(1)
        ids.append(b.column(0).to_numpy(zero_copy_only=False))
        sizes.append(np.diff(col.offsets.to_numpy()))
        flat.append(col.flatten().to_numpy(zero_copy_only=False))
    if not ids:
        return
    ids, sizes, flat = np.concatenate(ids), np.concatenate(sizes), np.concatenate(flat)
    at = np.concatenate([[0], np.cumsum(sizes)])
    for dim in np.unique(sizes):
        pick = np.flatnonzero(sizes == dim)
        yield int(dim), ids[pick].astype(np.int64), flat[(at[pick][:, None] + np.arange(dim)).ravel()].reshape(len(pick), dim) if dim else np.zeros((len(pick), 0), np.int64)


def products(rows: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Exact integer inner products; doubles while every partial sum is an exact one, else big integers,
    held to the range of a long."""
    if not rows.size:
        return np.zeros(len(rows), np.int64)
    bound = float(np.abs(rows.astype(np.float64)).max()) * float(np.abs(q.astype(np.float64)).sum())
    if bound < _EXACT:
        return (rows.astype(np.float64) @ q.astype(np.float64)).astype(np.int64)
    exact = [sum(int(a) * int(b) for a, b in zip(r, q, strict=True)) for r in rows]
    return np.array([max(-(2**63), min(2**63 - 1, x)) for x in exact], dtype=np.int64)


class Buckets:
    """Candidates of one dimension in a task, by falling length."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, size: int = BUCKET):
        real = rows.astype(np.float64)
        norm = np.sqrt((real * real).sum(1))
        order = np.lexsort((ids, -norm))
        self.ids, self.rows, self.norm = ids[order], rows[order], norm[order]
        self.unit = real[order] / np.maximum(self.norm, 1e-300)[:, None]
        self.cuts = list(range(0, len(ids), size))
        self.size = size
        self.verified = 0
        self.at: dict[int, list[int]] = {}
        for i, v in enumerate(self.ids.tolist()):
            self.at.setdefault(v, []).append(i)

    def search(self, qid: int, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(scores, ids) of the k best, by falling score, then id; the query's own row is no candidate."""
        own = next((int(i) for i in self.at.get(qid, ()) if (self.rows[i] == q).all()), -1)
        qn = float(np.sqrt((q.astype(np.float64) ** 2).sum()))
        qu = q / qn if qn else q.astype(np.float64)
        focus = np.argsort(-np.abs(qu), kind="stable")[:FOCUS]
        score, ids = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for a in self.cuts:
            b = min(a + self.size, len(self.ids))
            rows, uid = slice(a, b), None
            if len(score) == k:
                least = float(score[-1])
                if least > 0 and qn * self.norm[a] * (1 + _SLACK) < least:
                    break  # no vector from here on is long enough
                if least > 0:
                    local = least / (qn * self.norm[a]) * (1 - _SLACK)
                    fit = self.norm[rows] * qn * (1 + _SLACK) >= least
                    if local >= COORD_FROM:
                        wide = np.sqrt(np.maximum(0.0, 1 - local * local) * np.maximum(0.0, 1 - qu[focus] ** 2)) + _SLACK
                        # the interval holds for every cosine from ``local`` up to 1
                        low = np.minimum(qu[focus] * local - wide, np.where(qu[focus] < -local, -1.0, qu[focus] * local - wide))
                        high = np.maximum(qu[focus] * local + wide, np.where(qu[focus] > local, 1.0, qu[focus] * local + wide))
                        near = self.unit[rows][:, focus]
                        fit &= ((near >= low) & (near <= high)).all(1)
                    uid = np.flatnonzero(fit) + a
            pick = np.arange(a, b) if uid is None else uid
            pick = pick[pick != own]
            if not len(pick):
                continue
            self.verified += len(pick)
            score = np.concatenate([score, products(self.rows[pick], q)])
            ids = np.concatenate([ids, self.ids[pick]])
            best = np.lexsort((ids, -score))[:k]
            score, ids = score[best], ids[best]
        return score, ids


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, query_block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score) of the ``k`` best candidates of each query by integer inner product,
    ties to the smaller vec_id; both inputs as made by :func:`integer_vectors`.

    A query never meets its own row.  Rows that share a vec_id but not the vector are queries and candidates of their
    own; a query row that is repeated counts once as a query, and its twins are candidates.  Vectors of another
    dimension than the query's are no candidates.  Repeated candidate rows count each.  Fewer candidates than ``k`` give
    fewer rows; empty inputs give none.  A score beyond the range of a long is held to its end.
    """
    spark = vectors.sparkSession
    schema = "query_id long, query_no long, vec_id long, score long"
    queries = stage(queries.dropDuplicates(["vec_id", "v"]).withColumn("no", F.monotonically_increasing_id()), "queries")
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    held = stage(vectors.withColumn("_n", norm).repartitionByRange(F.col("_n").desc(), F.col("vec_id")).drop("_n"), "vectors")
    blocks = max(1, -(-queries.count() // query_block))
    found = None
    for i in range(blocks):
        block = queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == i) if blocks > 1 else queries
        held_block = block.select("no", "v", "vec_id").toArrow()
        name = dict(zip(held_block["no"].to_pylist(), held_block["vec_id"].to_pylist(), strict=True))
        asked = [(d, no.tobytes(), np.array([name[int(x)] for x in no], np.int64).tobytes(), rows.tobytes()) for d, no, rows in _matrices(held_block.to_batches())]
        sent = spark.sparkContext.broadcast(asked)  # at most about query_block vectors

        def search(batches: Iterable[pa.RecordBatch], sent=sent) -> Iterable[pa.RecordBatch]:
            mine = {d: Buckets(ids, rows) for d, ids, rows in _matrices(batches)}
            for dim, no, ids, rows in sent.value:
                if dim not in mine:
                    continue
                out = []
                wanted = np.frombuffer(rows, np.int64).reshape(-1, dim) if dim else np.zeros((len(ids) // 8, 0), np.int64)
                for number, qid, q in zip(np.frombuffer(no, np.int64), np.frombuffer(ids, np.int64), wanted, strict=True):
                    score, got = mine[dim].search(int(qid), q, k)
                    out.append((np.full(len(got), qid), np.full(len(got), number), got, score))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in zip(*out, strict=True)], names=["query_id", "query_no", "vec_id", "score"])

        part = held.mapInArrow(search, schema)
        found = part if found is None else found.unionByName(part)
    order = W.partitionBy("query_id", "query_no").orderBy(F.col("score").desc(), F.col("vec_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
