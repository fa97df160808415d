"""Near-duplicate documents by SuperMinHash signatures, banding, verification and grouping.

1. Every shingle of a document's set draws a random permutation of the signature's places and a random number per
   rank.  A place keeps the least (rank, number) that any shingle puts there.  The ranks of one shingle are all
   different, which spreads small sets evenly over the places and lowers the variance below that of independent hash
   functions.  A document is done as soon as no place is empty, as later ranks cannot win any more: about
   max(n, places * log(places)) draws instead of n * places.
2. Equal sets form a class by a 128-bit fingerprint; its smallest doc_id goes on for all.
3. The signature is cut into bands (:func:`banding`).  Each document is verified, on the whole sets, against the first
   one of the bucket in which it shares most bands; components of the links are groups.
4. A bucket that still holds several groups may hide links between them that do not go through its first document.
   The documents of such buckets, and only they, are compared once more.  Those go that share too few shingles with
   all others of them together; groups of the rest that share a prefix shingle and whose bounds allow a link are
   searched member by member in blocks, again on whole sets.
5. Components of all links are the result.

Buckets and groups of any size are spread: minima are salted, a group has one row per shingle whatever its
number of members, and members are dealt in blocks.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodegrain.sources.workspace import spread

from . import ngram_join as J
from .common import attach_min, bound_batches, bounded, components, discard, stage
from .kernels import mix, pieces

SIZE, PERCENT = 4, 80
#: Share of pairs at the threshold that may share no band, and places of a signature at most.
MISS, MOST_VALUES = 1e-7, 255
#: Shingles whose permutations are held at a time.
ELEMENTS = 1 << 16
_U = np.uint64
_EMPTY = _U(2**64 - 1)
_GOLD = _U(0x9E3779B97F4A7C15)


def banding(percent: int = PERCENT, miss: float = MISS, most: int = MOST_VALUES) -> tuple[int, int]:
    """(bands, rows) with as many rows as ``most`` places allow, such that of pairs with a similarity of
    ``percent`` / 100 at most a share of ``miss`` has no band in common."""
    best = None
    for rows in range(1, most + 1):
        alike = (percent / 100) ** rows
        bands = 1 if alike >= 1 else int(np.ceil(np.log(miss) / np.log1p(-alike)))
        if bands * rows > most:
            break
        best = (bands, rows)
    if best is None:
        raise ValueError(f"a similarity of {percent} % needs more than {most} places")
    return best


def signatures(tokens: np.ndarray, off: np.ndarray, size: int, counted: list | None = None) -> np.ndarray:
    """(documents, size) SuperMinHash values of the token sets ``tokens[off[i]:off[i + 1]]``; those of an empty set are
    all 2**64 - 1.  ``counted`` gets the number of draws of each step."""
    out = np.full((len(off) - 1, size), _EMPTY, np.uint64)
    row = np.repeat(np.arange(len(off) - 1), np.diff(off))
    a = 0
    while a < len(off) - 1:
        z = max(a + 1, int(np.searchsorted(off, off[a] + ELEMENTS, side="right")) - 1)
        if off[z] > off[a]:
            _fill(out[a:z], tokens[off[a] : off[z]], row[off[a] : off[z]] - a, counted)
        a = z
    return out


def _fill(out: np.ndarray, token: np.ndarray, row: np.ndarray, counted: list | None) -> None:
    size, flat = out.shape[1], out.reshape(-1)
    seed, held = mix(token + _GOLD), None
    for rank in range(size):
        draw = mix(seed + _U(rank * int(_GOLD) % 2**64))
        other = rank + (((draw & _U(0xFFFFFFFF)) * _U(size - rank)) >> _U(32)).astype(np.int64)
        if held is None:
            place = other
        else:  # the next step of a Fisher-Yates shuffle of each token's places
            each = np.arange(len(row))
            place = held[each, other].astype(np.int64)
            held[each, other] = held[:, rank]
        at = row * size + place
        fresh = (flat[at] >> _U(32)) >= _U(rank)
        np.minimum.at(flat, at[fresh], (_U(rank) << _U(32)) | (draw[fresh] >> _U(32)))
        if counted is not None:
            counted.append(len(row))
        keep = (out == _EMPTY).any(1)[row]
        if not keep.any():
            return
        seed, row, other = seed[keep], row[keep], other[keep]
        if held is None:
            held = np.tile(np.arange(size, dtype=np.uint8), (len(row), 1))
            held[np.arange(len(row)), other] = 0
        else:
            held = held[keep]


def band_keys(values: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """(documents, bands) keys of signatures of bands * rows values."""
    parts = values.reshape(len(values), bands, rows)
    keys = np.tile(np.arange(1, bands + 1, dtype=np.uint64) * _GOLD, (len(values), 1))
    for r in range(rows):
        keys = mix(keys ^ parts[:, :, r])
    return keys


def signed(rows: DataFrame, tokens: J.Tokens, bands: int, width: int) -> DataFrame:
    """(doc_id, n, fp1, fp2, bands array<long>) of (doc_id, text) rows; a document without tokens has no bands."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j in pieces(b.column(1)):
                t, off = tokens(b.column(1).slice(i, j - i))
                n = np.diff(off)
                prints = [J._sums(mix(t + _U(1)), off), J._sums(mix(t ^ _U(0x5851F42D4C957F2D)), off)]
                keys = band_keys(signatures(t, off, bands * width), bands, width)[n > 0]
                ends = np.append(0, np.cumsum(np.where(n > 0, bands, 0))).astype(np.int32)
                held = pa.ListArray.from_arrays(pa.array(ends), pa.array(keys.ravel().view(np.int64)))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(n, pa.int64()), *(pa.array(x.view(np.int64)) for x in prints), held], names=["doc_id", "n", "fp1", "fp2", "bands"])

    return rows.mapInArrow(run, "doc_id long, n long, fp1 long, fp2 long, bands array<bigint>")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row: the number of distinct ``size``-word shingles, the smallest
    doc_id reachable by links of at least ``percent`` / 100 Jaccard similarity, and whether that is the row's own.

    With fewer words the whole sequence is the only shingle.  Null or empty texts, and texts of white space, have none,
    link with nothing and are kept.  Rows that repeat a doc_id are one document with all of their links; rows with a null
    doc_id link with nothing, have a null component and are kept.  An empty table gives none.  Links are never taken
    from signatures alone: every one is confirmed on both whole sets.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    tokens, (bands, width) = J.shingle_sets(size), banding(percent)
    rows = spread(docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")))
    prints = stage(signed(rows, tokens, bands, width), "signatures")
    known = prints.where("n > 0 and doc_id is not null")
    classes = stage(attach_min(known.select("doc_id", "n", "fp1", "fp2"), ["fp1", "fp2", "n"], "doc_id", "rep").select("doc_id", "rep"), "classes")
    edges = classes.where("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    # a document whose rows all have a smaller twin is represented by it
    copies = stage(classes.groupBy("doc_id").agg(F.max(F.col("doc_id") == F.col("rep")).alias("own")).where("not own").select(F.col("doc_id").alias("_copy")), "copies")
    single = known.join(bounded(copies, copies.count()), F.col("doc_id") == F.col("_copy"), "left_anti")
    keyed = single.select("doc_id", F.explode("bands").alias("key"))
    shared = keyed.groupBy("key").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most").select("key")
    buckets = stage(keyed.join(shared, "key", "left_semi").distinct(), "buckets")
    hubs = attach_min(buckets, ["key"], "doc_id", "hub").where("hub < doc_id")
    best = hubs.groupBy("doc_id", "hub").count().groupBy("doc_id").agg(F.max_by("hub", F.struct("count", -F.col("hub"))).alias("b"))
    able = stage(buckets.select(F.col("doc_id").alias("_id")).distinct(), "able")
    wanted = rows.join(bounded(able, able.count()), F.col("doc_id") == F.col("_id")).select("doc_id", F.lit(0).cast("long").alias("c"), "text")
    sets = stage(J._packed_sets(wanted, tokens).withColumn("c", F.col("n")), "sets")
    linked = stage(J._verify(best.select(F.col("doc_id").alias("a"), "b"), sets, percent), "hub-links")
    grouped = components(edges.unionByName(linked))

    roots = buckets.join(grouped, F.col("doc_id") == F.col("node"), "left").select("key", "doc_id", F.coalesce("root", "doc_id").alias("root"))
    mixed = roots.groupBy("key").agg(F.min("root").alias("least"), F.max("root").alias("most")).where("least < most").select("key")
    label = stage(roots.join(mixed, "key", "left_semi").select(F.col("doc_id").alias("node"), "root").distinct(), "labels")
    discard(spark, buckets._staged_at)
    if n := label.count():
        # how many shingles of an open document occur in another one bounds its overlap with all of them
        still = bounded(label.select("node").distinct(), n)
        total = sets.join(still, F.col("doc_id") == F.col("node"), "left_semi").agg(F.sum("n")).first()[0] or 0
        counted = stage(J.shared_counts(rows.join(still, F.col("doc_id") == F.col("node"), "left_semi"), tokens, total).where(F.col("n") > 0).where(F.col("c") * 100 >= F.col("n") * percent), "shared")
        most = counted.groupBy("doc_id").agg(F.max("c").alias("c"))
        open_sets = stage(sets.drop("c").join(bounded(most, n), "doc_id").select("doc_id", "n", "c", "tokens"), "open-sets")
        pairs = stage(J._group_pairs(stage(J._token_groups(open_sets, label, percent), "matrix"), label, percent), "group-pairs")
        if not pairs.isEmpty():
            more = stage(J._search_groups(pairs, open_sets, label, percent), "group-links")
            grouped = components(grouped.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more))
    found = prints.join(grouped, F.col("doc_id") == F.col("node"), "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("root", "doc_id").alias("component_id"))
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
