"""Joins that are no equality, as joins on keys: cosine above a threshold, containment of a text, overlap of intervals."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodegrain.sources.workspace import stage

#: Cells of a vector join at most, vectors of a cell on average at least, bytes of a block's vectors at most, vectors of a block
#: at least, and how far an angle may be off by rounding.
PIVOTS, CELL, BLOCK_BYTES, SMALL_BLOCK, SLACK = 128, 256, 16 << 20, 2048, 1e-6
#: Vectors of a sample by which cells are judged, the share of cells that a vector may ask there, and sizes of a product and of
#: what is computed in full at once.
SAMPLE, MOST_ASKED, TILE, FULL = 2048, 0.5, (2048, 4096), 1 << 16
#: Lengths of the pieces of a text that are joined; a text goes by the longest that fits in it.
PIECES = (8, 4, 2, 1)


# --- cosine ---------------------------------------------------------------------------------------------


def _units(column: pa.Array) -> np.ndarray:
    """Rows scaled to length 1; a row of zeros stays."""
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    n = np.sqrt((x * x).sum(1))
    return x / np.where(n > 0, n, 1.0)[:, None]


def _angles(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(x @ pivots.T, -1.0, 1.0))


def _worth_cells(x: np.ndarray, pivots: np.ndarray, reach: float) -> bool:
    """Whether cells spare vectors like ``x`` enough of the others."""
    far = _angles(x, pivots)
    own, wide = far.argmin(1), np.full(len(pivots), -np.inf)
    np.maximum.at(wide, own, far[np.arange(len(own)), own])
    share = np.bincount(own, minlength=len(pivots)) / len(own)
    return float(((far <= reach + wide + SLACK) * share).sum(1).mean()) <= MOST_ASKED


def similar_vectors(vectors: DataFrame, key: str, vector: str, least: float, n_pivots: int | None = None, block: int | None = None) -> DataFrame:
    """(a, b, similarity) of all pairs a < b of (key, vector) rows with a cosine of at least ``least``, exact.

    Angles are a metric, so pivots prune: each vector lies in the cell of its nearest pivot, a cell is as wide as its
    farthest vector, and a vector is sent to another cell only if its angle to that cell's pivot is no more than the
    threshold's angle and the cell's width.  Cells are cut into blocks, and each two blocks that may hold a pair meet once, by
    key, as products of a fixed size, whose near ones are then computed in full.  At a low threshold, or where vectors
    have no clusters, as a sample shows, there is one cell: all blocks meet then, and are large, as what is shuffled is the
    vectors times the number of blocks.
    Keys are distinct; rows whose vector is null, or holds a null, have no pair; all vectors have one length; a
    vector of zeros has a cosine of 0 with all.
    """
    kind = vectors.schema[key].dataType.simpleString()
    of_floats = vectors.schema[vector].dataType.simpleString() == "array<float>"
    held_as = "array<float>" if of_floats else "array<double>"
    good = vectors.where(F.col(vector).isNotNull() & ~F.exists(vector, lambda x: x.isNull())).select(F.col(key).alias("k"), F.col(vector).cast(held_as).alias("v"))
    rows = stage(good, "vectors")
    n = rows.count()
    sample = rows.orderBy(F.xxhash64("k"), "k").limit(max(SAMPLE, n_pivots or 0)).toArrow()  # so many rows
    if not sample.num_rows:
        return vectors.sparkSession.createDataFrame([], f"a {kind}, b {kind}, similarity double")
    seen = _units(sample["v"].combine_chunks())
    reach = float(np.arccos(np.clip(least, -1.0, 1.0))) + SLACK
    pivots = seen[: n_pivots or max(1, min(PIVOTS, n // CELL))]
    if n_pivots is None and not _worth_cells(seen, pivots, reach):
        pivots = pivots[:1]
    sent = vectors.sparkSession.sparkContext.broadcast(pivots)

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                far = _angles(_units(b.column(1)), sent.value)
                own = far.argmin(1)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(own.astype(np.int32)), pa.array(far[np.arange(len(own)), own])], names=["k", "v", "cell", "far"])

    placed = stage(rows.mapInArrow(place, f"k {kind}, v {held_as}, cell int, far double"), "cells")
    size = {r["cell"]: (r["n"], r["wide"]) for r in placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("wide")).collect()}  # as many rows as pivots
    if block is None:  # four meetings for each core, and no more than the largest block allows
        most = max(SMALL_BLOCK, BLOCK_BYTES // (seen.shape[1] * (4 if of_floats else 8) or 1))
        cores = vectors.sparkSession.sparkContext.defaultParallelism
        block = int(min(most, max(SMALL_BLOCK, -(-n // np.ceil(np.sqrt(8 * cores))))))
    blocks = np.array([-(-size[c][0] // block) if c in size else 0 for c in range(len(pivots))])
    wide = np.array([size[c][1] if c in size else -np.inf for c in range(len(pivots))])
    first, cell_of = np.cumsum(blocks) - blocks, np.repeat(np.arange(len(pivots)), blocks)

    def asked(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows of (k, v, cell, block), the blocks they ask, and the blocks they are of: from its own on, those of each cell in reach."""
        own = b.column(3).to_numpy()
        near = _angles(_units(b.column(1)), sent.value) <= reach + wide + SLACK
        at, to = np.nonzero(near[:, cell_of] & (np.arange(len(cell_of)) >= own[:, None]))
        return at, to.astype(np.int32), own[at]

    def meetings(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            _, to, own = asked(b)
            both = np.unique(to.astype(np.int64) * len(cell_of) + own)
            yield pa.RecordBatch.from_arrays([pa.array((both // len(cell_of)).astype(np.int32)), pa.array((both % len(cell_of)).astype(np.int32))], names=["block", "by"])

    def ask(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (c.slice(o, 1024) for c in batches for o in range(0, c.num_rows, 1024)):
            at, to, own = asked(b)
            pick = pa.array(at)
            yield pa.RecordBatch.from_arrays([pa.array(to), pa.array(own), pa.array(np.ones(len(at), bool)), b.column(0).take(pick), b.column(1).take(pick)], names=["block", "by", "asks", "k", "v"])

    cells = pa.table({"cell": pa.array(np.arange(len(blocks)), pa.int32()), "first": pa.array(first, pa.int32()), "blocks": pa.array(blocks, pa.int32())})
    table = vectors.sparkSession.createDataFrame(cells).where("blocks > 0")
    units = placed.join(F.broadcast(table), "cell").select("k", "v", "cell", (F.col("first") + F.pmod(F.xxhash64("k", F.lit(3)), F.col("blocks"))).cast("int").alias("block"))
    # those who ask a block come by the block they are from, so that a task holds two blocks and no more
    met = units.mapInArrow(meetings, "block int, by int").distinct()
    held = units.join(F.broadcast(met), "block").select("block", "by", F.lit(False).alias("asks"), "k", "v")
    both = units.mapInArrow(ask, f"block int, by int, asks boolean, k {kind}, v {held_as}").unionByName(held)
    rough = 1.2e-7 * (seen.shape[1] + 16)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Products in single precision, with what that may be off, then in full."""
        group = pa.Table.from_batches(batches).combine_chunks()
        asks = group["asks"].combine_chunks()
        same = group["block"][0] == group["by"][0]
        left, right = (group.filter(side).select(["k", "v"]).combine_chunks() for side in (asks, pc.invert(asks)))
        del group
        if not left.num_rows or not right.num_rows:
            return
        (p, x), (q, y) = ((t["k"].combine_chunks(), _units(t["v"].combine_chunks())) for t in (left, right))
        u, w = x.astype(np.float32), y.astype(np.float32).T
        for i0 in range(0, len(x), TILE[0]):
            for j0 in range(0, len(y), TILE[1]):
                at = np.flatnonzero((u[i0 : i0 + TILE[0]] @ w[:, j0 : j0 + TILE[1]]).ravel() >= least - rough)
                for o in range(0, len(at), FULL):
                    i, j = np.divmod(at[o : o + FULL], min(TILE[1], len(y) - j0))
                    s = np.einsum("ij,ij->i", x[i0 + i], y[j0 + j])
                    keep = np.flatnonzero(s >= least)
                    a, b = p.take(pa.array(i0 + i[keep])), q.take(pa.array(j0 + j[keep]))
                    out = pa.RecordBatch.from_arrays([a, b, pa.array(s[keep])], names=["a", "b", "similarity"])
                    yield out.filter(pc.less(a, b)) if same else out  # a block meets itself from both sides, others from one

    found = both.groupBy("block", "by").applyInArrow(meet, f"a {kind}, b {kind}, similarity double")
    return found.where(F.col("a") != F.col("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "similarity")


# --- containment ----------------------------------------------------------------------------------------


def _grams(text: Column, size: int) -> Column:
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - size + 1), lambda i: F.substring(text, i, F.lit(size))))


def containing(texts: DataFrame, text: str, parts: DataFrame, part: str) -> DataFrame:
    """Distinct (text, part) with the ``part`` anywhere in the ``text``; an empty part is in every text, a null in none.

    Each part goes by the piece of it that is in the fewest texts, and only texts with that piece are looked through.  A
    piece that is in many texts, or a part in many, spreads like any key of a join."""
    held = stage(texts.select(F.col(text).alias("_t")).where("_t is not null").distinct(), "texts")
    asked = stage(parts.select(F.col(part).alias("_p")).where("_p is not null").distinct(), "parts")
    size = F.coalesce(*(F.when(F.length("_p") >= s, s) for s in PIECES))
    sizes = [r[0] for r in asked.where("_p <> ''").select(size.alias("s")).distinct().collect()]  # at most len(PIECES)
    out = asked.where("_p = ''").join(held, F.lit(True)) if not asked.where("_p = ''").isEmpty() else None
    for s in sizes:
        mine = asked.where(size == s).select("_p", F.explode(_grams(F.col("_p"), s)).alias("g"))
        near = stage(held.where(F.length("_t") >= s).select("_t", F.explode(_grams(F.col("_t"), s)).alias("g")).join(mine.select("g").distinct(), "g", "left_semi"), "pieces")
        often = near.groupBy("g").agg(F.count("*").alias("n"))
        rarest = mine.join(often, "g", "left").groupBy("_p").agg(F.min_by("g", F.struct(F.coalesce("n", F.lit(0)), "g")).alias("g"))
        part_of = rarest.join(near, "g").where(F.contains("_t", "_p")).select("_p", "_t")
        out = part_of if out is None else out.unionByName(part_of)
    if out is None:
        out = asked.withColumn("_t", F.col("_p")).limit(0)
    return out.select(F.col("_t").alias(text), F.col("_p").alias(part))


# --- intervals ------------------------------------------------------------------------------------------


def not_overlapping(spans: DataFrame, others: DataFrame, by: str, begin: str, end: str) -> DataFrame:
    """The ``spans`` that no interval of ``others`` with the same ``by`` overlaps; ends are inclusive, and an interval whose
    end is before its begin holds nothing.  Other columns stay; a null in ``by`` or an end overlaps nothing.

    A sweep over endpoints: of the others that begin no later than a span's end, the one that ends last decides, and that is a
    running maximum in the order of the endpoints, so nothing is paired."""
    names = [f"c{i}" for i in range(len(spans.columns))]
    of = dict(zip(spans.columns, names, strict=True))
    rows = spans.toDF(*names).select(*names, F.col(of[by]).alias("_by"), F.col(of[end]).alias("_at"), F.col(of[begin]).alias("_from"), F.lit(None).cast(others.schema[end].dataType).alias("_to"), F.lit(1).alias("_kind"))
    cover = others.where(F.col(end) >= F.col(begin)).select(*(F.lit(None).cast(f.dataType).alias(n) for n, f in zip(names, spans.schema, strict=True)), F.col(by).alias("_by"), F.col(begin).alias("_at"), F.lit(None).cast(spans.schema[begin].dataType).alias("_from"), F.col(end).alias("_to"), F.lit(0).alias("_kind"))
    sweep = W.partitionBy("_by").orderBy("_at", "_kind").rowsBetween(W.unboundedPreceding, W.currentRow)
    seen = rows.unionByName(cover).withColumn("_last", F.max("_to").over(sweep)).where("_kind = 1")
    hit = F.coalesce((F.col("_last") >= F.col("_from")) & (F.col("_at") >= F.col("_from")) & F.col("_by").isNotNull(), F.lit(False))
    return seen.where(~hit).select(*names).toDF(*spans.columns)
