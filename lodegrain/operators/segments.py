"""A keyword index in immutable segments, with tombstones, tiered merging and block-max retrieval.

A segment holds what one change brought: its rows with their tokens, their postings, how document frequencies change
(those of rows that the change replaces are taken off), the rows of older segments that it kills, and the owners
(files) it brings or removes.  A change costs what it brings and kills; nothing older is tokenized or written again.
Segments of like size that lie side by side are merged when there are several.

Postings of a term lie in layers by what they add to a score, and in a layer in blocks of up to BLOCK, in the order of
their rows.  A block says what is the most a posting in it can add, and from which row to which it goes.  Searching looks
at these bounds first:

1. the best blocks of every term of a query, with k rows, give partial scores; the k-th best of them is a floor for the k-th best
   score, as no term takes from a score;
2. a query's terms that together cannot reach the floor are minor: a row needs one of the others.  A block of those is
   read only if its bound, with the most that the query's other terms can add, reaches the floor.  All postings of a row
   that reaches it lie in such blocks; rows that can still reach it with the minor terms are candidates;
3. a block of a minor term, which is often a frequent one, is read only if a candidate lies in its range.

A batch of queries that asks for more postings than the live rows have tokens, as many queries of frequent words do, would
read most blocks, once for each query.  Such a batch is scored from the rows' kept tokens instead, for all queries at once and in one pass.

Statistics are those of all live rows, so results are those of an index built afresh.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodegrain.functions import text as T
from lodegrain.operators.retrieval import EPSILON, K1, B, scored_batches
from lodegrain.operators.snapshots import Conflict, SnapshotLog
from lodegrain.sources.workspace import BROADCAST_ROWS, bounded, discard, spread, stage

#: Postings of a block, and of a part of a term, which one task puts in order.
BLOCK, PART, LAYERS = 64, 1 << 20, 10
#: Candidates of a query and segment beyond which the blocks of minor terms are not looked through for them.
MOST_SOUGHT = 4096
#: As many neighbours of one tier are merged; a tier is so many times the rows of the one below it.
FAN, FIRST_TIER = 4, 1000
#: Rows whose tokens are counted at once.
TALLIED_ROWS = 1024
#: Killed rows, of two longs each, that are broadcast at most.
DEAD_ROWS = 1_000_000
#: Terms that are named to the scan; more are joined.
NAMED_TERMS = 2000
_OWN = ("_doc", "_dl", "_tokens", "_segment")
_BLOCK = ("term", "part", "layer", "block")


def _union(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def _tally(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, _doc, _dl, tf) of (_doc, _dl, _tokens) rows; a row has all of its tokens, so nothing is shuffled for it."""
    for b in (c.slice(o, TALLIED_ROWS) for c in batches for o in range(0, c.num_rows, TALLIED_ROWS)):
        tokens = b.column(2)
        row = np.repeat(np.arange(b.num_rows), pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False))
        words = tokens.flatten().dictionary_encode()
        most = max(1, len(words.dictionary))
        found, tf = np.unique(row * most + words.indices.to_numpy(), return_counts=True)
        pick = pa.array(found // most)
        yield pa.RecordBatch.from_arrays([words.dictionary.take(pa.array(found % most)), b.column(0).take(pick), b.column(1).take(pick), pa.array(tf.astype(np.int32))], names=["term", "_doc", "_dl", "tf"])


def _pack(batches: Iterable[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Blocks of at most ``most`` postings of (term, part, layer, _doc, _dl, tf) rows in order; the last block of a batch waits for the next."""
    left, before = None, 0

    def cut(t: pa.RecordBatch, last: bool) -> tuple[pa.RecordBatch | None, pa.RecordBatch | None, int]:
        n = t.num_rows
        term, part, layer = t.column(0).dictionary_encode().indices.to_numpy(), t.column(1).to_numpy(), t.column(2).to_numpy()
        fresh = np.append(True, (np.diff(term) != 0) | (np.diff(part) != 0) | (np.diff(layer) != 0))
        run = np.flatnonzero(fresh)
        place = np.arange(n) - np.repeat(run, np.diff(np.append(run, n)))
        block = place // most
        block[: run[1] if len(run) > 1 else n] += before
        begin = np.flatnonzero(place % most == 0)
        rest = (None, 0) if last else (t.slice(begin[-1]), int(block[begin[-1]]))
        end = n if last else begin[-1]
        begin = begin if last else begin[:-1]
        if not len(begin):
            return None, *rest
        size = np.diff(np.append(begin, end))
        doc, dl, tf = (t.column(k).to_numpy()[:end] for k in (3, 4, 5))
        at = pa.array(begin)
        each = lambda x: pa.ListArray.from_arrays(pa.array(np.append(begin, end).astype(np.int32)), pa.array(x))
        return pa.RecordBatch.from_arrays([
            *(t.column(k).take(at) for k in range(3)), pa.array(block[begin].astype(np.int32)), pa.array(size.astype(np.int32)), pa.array(np.maximum.reduceat(tf, begin)), pa.array(np.minimum.reduceat(dl, begin)),
            pa.array(doc[begin]), pa.array(doc[begin + size - 1]), each(doc), each(tf), each(dl),
        ], names=[*_BLOCK, "n", "max_tf", "min_dl", "low", "high", "docs", "tfs", "dls"]), *rest

    for b in batches:
        if b.num_rows:
            out, left, before = cut(b if left is None else pa.Table.from_batches([left, b]).combine_chunks().to_batches()[0], False)
            if out is not None:
                yield out
    if left is not None:
        yield cut(left, True)[0]


def postings_of(rows: DataFrame) -> DataFrame:
    """(term, _doc, _dl, tf) of (_doc, _dl, _tokens) rows, written."""
    return stage(rows.select("_doc", "_dl", "_tokens").mapInArrow(_tally, "term string, _doc long, _dl int, tf int"), "postings")


def blocks_of(each: DataFrame, mean_length: float) -> DataFrame:
    """(term, part, layer, block, n, max_tf, min_dl, low, high, docs, tfs, dls) of the postings ``each``, in order within a
    partition.  A term of more than PART rows is dealt in parts by row, so no task orders more than about so many postings.
    Layers go by the mean length of now; bounds are right whatever it becomes."""
    often = stage(each.groupBy("term").count().where(F.col("count") > PART).select("term", F.ceil(F.col("count") / PART).alias("parts")), "frequent-terms")
    part = F.coalesce(F.pmod(F.xxhash64("_doc"), F.col("parts")), F.lit(0)).cast("int")
    share = F.col("tf") / (F.col("tf") + K1 * (1 - B + B * F.col("_dl") / F.lit(max(mean_length, 1.0))))
    dealt = each.join(bounded(often, often.count()), "term", "left").withColumn("part", part).withColumn("layer", (LAYERS - F.ceil(share * LAYERS)).cast("int"))
    order = dealt.select("term", "part", "layer", "_doc", "_dl", "tf").repartition("term", "part").sortWithinPartitions("term", "part", "layer", "_doc")
    most = BLOCK
    return order.mapInArrow(lambda batches: _pack(batches, most), "term string, part int, layer int, block int, n int, max_tf int, min_dl int, low long, high long, docs array<long>, tfs array<int>, dls array<int>")


class Snapshot:
    """One version of an index, which stays as it is."""

    def __init__(self, index: SegmentedIndex, content: dict):
        self.index, self.content, self.version = index, content, content["version"]
        self.spark, self.key = index.spark, index.key
        self.count, self.mean_length = content["rows"], content["length"] / content["rows"] if content["rows"] else 0.0

    def table(self, name: str) -> DataFrame:
        """A table of all segments, with the number of each one's segment."""
        parts = [self.spark.read.parquet(f"{self.index.path}/segments/{s['dir']}/{name}").withColumn("_segment", F.lit(s["id"])) for s in self.content["segments"] if name in s["has"]]
        return _union(parts) if parts else self.spark.createDataFrame([], self.index.shape(name))

    def dead(self) -> DataFrame:
        """(_segment, _doc) of the rows that later segments have killed."""
        return self.table("dead").select(F.col("segment").alias("_segment"), F.col("doc").alias("_doc"))

    def _alive(self, df: DataFrame) -> DataFrame:
        n = sum(s["kills"] for s in self.content["segments"])
        return df.join(bounded(self.dead(), n, DEAD_ROWS), ["_segment", "_doc"], "left_anti") if n else df

    def live(self) -> DataFrame:
        """All live rows, with the index's own columns."""
        return self._alive(self.table("rows"))

    def rows(self) -> DataFrame:
        """All live rows as they were given."""
        return self.live().drop(*_OWN)

    def owners(self) -> DataFrame:
        """(owner, ...) of all files there are."""
        held = self.table("owners")
        names = [c for c in held.columns if c != "_segment"]
        newest = held.groupBy(F.col(self.index.owner).alias("_o")).agg(F.max_by(F.struct(*names), "_segment").alias("s"))
        return newest.select("s.*").where("not _removed").drop("_removed")

    def _weights(self, asked: DataFrame) -> DataFrame:
        """(query_id, term, w, df) of (query_id, term, qtf): what a posting's length-adjusted frequency counts, and how many
        rows hold the term."""
        df = self._of(self.table("terms"), asked).groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")
        n = F.lit(float(self.count))
        raw = F.log(n - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
        idf = F.when(raw < 0, F.lit(EPSILON * self.content["mean_idf"])).otherwise(raw)
        return asked.join(df, "term").select("query_id", "term", (F.col("qtf") * idf).alias("w"), "df")

    def _of(self, df: DataFrame, asked: DataFrame) -> DataFrame:
        """Rows of the terms of ``asked`` (query_id, term, ...), a written table: few are named to the scan, which then
        skips what holds none of them."""
        if not hasattr(asked, "_names"):
            asked._names = [r[0] for r in asked.select("term").distinct().limit(NAMED_TERMS + 1).collect()]
        return df.where(F.col("term").isin(asked._names)) if len(asked._names) <= NAMED_TERMS else df.join(asked.select("term").distinct(), "term", "left_semi")

    def _part(self, tf: str, dl: str) -> Column:
        return F.col(tf) * (K1 + 1) / (F.col(tf) + K1 * (1 - B + B * F.col(dl) / F.lit(self.mean_length)))

    def _read(self, wanted: DataFrame, asked: DataFrame) -> DataFrame:
        """(query_id, _segment, _doc, gain) of the live postings in the ``wanted`` blocks, of terms of ``asked``.  The blocks are
        a written table, or some of one, so the planner knows whether they are small enough to be broadcast."""
        held = self._of(self.table("postings"), asked).select("_segment", *_BLOCK, "docs", "tfs", "dls")
        found = held.join(wanted.select("query_id", "_segment", *_BLOCK, "w"), ["_segment", *_BLOCK])
        each = found.select("query_id", "_segment", "w", F.explode(F.arrays_zip("docs", "tfs", "dls")).alias("p")).select("query_id", "_segment", "w", F.col("p.docs").alias("_doc"), F.col("p.tfs").alias("tf"), F.col("p.dls").alias("dl"))
        return self._alive(each).select("query_id", "_segment", "_doc", (F.col("w") * self._part("tf", "dl")).alias("gain"))

    @staticmethod
    def _asked(queries: DataFrame, query: str) -> DataFrame:
        return stage(queries.select("query_id", F.explode(T.code_tokens(query)).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf")), "asked")

    def search(self, queries: DataFrame, k: int, query: str = "query", prune: bool = True) -> tuple[DataFrame, DataFrame]:
        """(query_id, _segment, _doc, score) of rows that have the ``k`` best of each query among them, and (query_id, term,
        _segment, part, layer, block, n, read) of all blocks of the queries' terms, saying which were read."""
        asked = self._asked(queries, query)
        weighted = self._weights(asked).drop("df")
        bounds = self._of(self.table("postings"), asked).select("_segment", *_BLOCK, "n", "max_tf", "min_dl", "low", "high")
        most = F.greatest(F.col("w") * self._part("max_tf", "min_dl"), F.lit(0.0))
        every = stage(bounds.join(weighted, "term").withColumn("most", most).drop("max_tf", "min_dl"), "block-bounds")
        tops = every.groupBy("query_id", "term").agg(F.max("most").alias("top"), F.min("w").alias("least"))
        if prune:
            best = W.partitionBy("query_id", "term").orderBy(F.desc("most"), "_segment", "part", "layer", "block")
            before = F.coalesce(F.sum("n").over(best.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
            partial = self._read(every.withColumn("before", before).where((F.col("before") < k) & (F.col("w") > 0)), asked).groupBy("query_id", "_segment", "_doc").agg(F.sum("gain").alias("score"))
            place = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score")))
            floor = partial.withColumn("place", place).where(F.col("place") == k).select("query_id", (F.col("score") * (1 - 1e-9) - 1e-9).alias("floor"))
            tops = tops.join(floor, "query_id", "left")
        else:
            tops = tops.withColumn("floor", F.lit(None).cast("double"))
        # a query with a term that takes from scores has no floor
        of = W.partitionBy("query_id")
        tops = tops.withColumn("floor", F.when(F.min("least").over(of) >= 0, F.col("floor"))).withColumn("total", F.sum("top").over(of))
        tops = tops.withColumn("minor", F.coalesce(F.sum("top").over(of.orderBy("top", "term")) < F.col("floor"), F.lit(False)))
        tops = stage(tops.withColumn("rest", F.sum(F.when(F.col("minor"), F.col("top")).otherwise(0.0)).over(of)).drop("least"), "tops")
        seen = every.join(tops, ["query_id", "term"])
        major = stage(seen.where(~F.col("minor")).withColumn("read", F.col("floor").isNull() | (F.col("most") + F.col("total") - F.col("top") >= F.col("floor"))), "major-blocks")
        sides = tops.select("query_id", "floor", "rest").distinct()
        found = self._read(major.where("read"), asked).groupBy("query_id", "_segment", "_doc").agg(F.sum("gain").alias("score"))
        candidates = stage(found.join(sides, "query_id").where("floor is null or score + rest >= floor").select("query_id", "_segment", "_doc", "score"), "candidates")
        sought = self._sought(candidates)
        minor = seen.where("minor").join(sought, ["query_id", "_segment"], "left")
        inside = F.exists("rows", lambda r: r.between(F.col("low"), F.col("high")))
        minor = stage(minor.withColumn("read", F.col("sought").isNotNull() & ((F.col("sought") > MOST_SOUGHT) | inside)).drop("rows", "sought"), "minor-blocks")
        more = self._read(minor.where("read"), asked).join(candidates.select("query_id", "_segment", "_doc"), ["query_id", "_segment", "_doc"], "left_semi")
        scored = candidates.withColumnRenamed("score", "gain").unionByName(more).groupBy("query_id", "_segment", "_doc").agg(F.sum("gain").alias("score"))
        return scored, major.unionByName(minor).select("query_id", "term", "_segment", "part", "layer", "block", "n", "read")

    @staticmethod
    def _sought(candidates: DataFrame) -> DataFrame:
        """(query_id, _segment, sought, rows): how many candidates there are, and which, if they are few."""
        counts = candidates.groupBy("query_id", "_segment").agg(F.count("*").alias("sought"))
        few = counts.where(F.col("sought") <= MOST_SOUGHT)
        rows = candidates.join(few.select("query_id", "_segment"), ["query_id", "_segment"], "left_semi").groupBy("query_id", "_segment").agg(F.collect_list("_doc").alias("rows"))
        return counts.join(rows, ["query_id", "_segment"], "left")

    def bm25(self, queries: DataFrame, k: int, query: str = "query", within: DataFrame | None = None) -> DataFrame:
        """(query_id, key..., score, rank) of the ``k`` best rows of each query with a positive score, ties to the smaller
        key; of those whose key is in ``within`` only, if that is given (statistics stay those of all rows)."""
        keys = self.table("rows").select("_segment", "_doc", *self.key)
        mine = None if within is None else stage(keys.join(within.select(*self.key), list(self.key), "left_semi").select("_segment", "_doc"), "within")
        only = lambda df: df if mine is None else df.join(bounded(mine, mine.count()), ["_segment", "_doc"], "left_semi")
        weighted = stage(self._weights(self._asked(queries, query)), "weights")
        n, postings = weighted.agg(F.count("*"), F.coalesce(F.sum("df"), F.lit(0))).first()
        if n <= BROADCAST_ROWS and postings > self.content["length"]:
            rows = only(self.live()).select("_segment", "_doc", F.col("_tokens").alias("tokens"), F.col("_dl").alias("dl"))
            scored = scored_batches(rows, ["_segment", "_doc"], weighted.drop("df"), k, self.mean_length)
        else:
            scored = only(self.search(queries, k, query, within is None)[0])
        scored = scored.withColumn("score", F.round("score", 9)).where("score > 0")
        first = stage(scored.withColumn("r", F.rank().over(W.partitionBy("query_id").orderBy(F.desc("score")))).where(F.col("r") <= k).drop("r"), "best-rows")
        named = keys.join(first, ["_segment", "_doc"])
        order = W.partitionBy("query_id").orderBy(F.desc("score"), *self.key)
        return named.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", *self.key, "score", "rank")


class SegmentedIndex:
    """The index under ``path``.  Rows are known by ``key``; those of one ``owner`` are replaced together."""

    def __init__(self, spark: SparkSession, path: str, owner: str = "file_path", key: Sequence[str] = ("file_path", "chunk_index"), text: Column | None = None):
        self.spark, self.path, self.owner, self.key = spark, path.rstrip("/"), owner, tuple(key)
        self.text = text if text is not None else T.searchable_text("content", "name", "chunk_type")
        self.log = SnapshotLog(spark, path)

    @staticmethod
    def shape(name: str) -> str:
        """Columns of a table that no segment has."""
        return {"dead": "segment long, doc long, _segment long", "terms": "term string, df long, _segment long", "postings": "term string, part int, layer int, block int, n int, max_tf int, min_dl int, low long, high long, docs array<bigint>, tfs array<int>, dls array<int>, _segment long"}[name]

    def snapshot(self, version: int | None = None) -> Snapshot | None:
        """A version, the latest unless one is named."""
        content = self.log.read(version)
        return Snapshot(self, content) if content else None

    def update(self, rows: DataFrame, owners: DataFrame, removed: DataFrame | None = None, merge: bool = True) -> Snapshot:
        """Bring the ``rows`` of ``owners`` (owner, ...) in, in place of what these had, and take those of ``removed``
        (owner) out, as one new version.  Only ``rows`` are tokenized.  The writer that loses a race gets a Conflict
        and nothing of its change is seen."""
        before = self.snapshot()
        folder = uuid.uuid4().hex
        at = f"{self.path}/segments/{folder}"
        number = before.content["next"] if before else 1
        none = F.lit(False).alias("_removed")
        brought = owners.select("*", none)
        if removed is not None:
            brought = brought.unionByName(removed.select(self.owner, F.lit(True).alias("_removed")), allowMissingColumns=True)
        brought.write.parquet(f"{at}/owners")
        tokens = spread(rows).withColumn("_tokens", F.coalesce(T.code_tokens(self.text), F.array().cast("array<string>")))
        tokens.withColumn("_dl", F.size("_tokens")).withColumn("_doc", F.monotonically_increasing_id()).write.parquet(f"{at}/rows")
        written = self.spark.read.parquet(f"{at}/rows")
        has = ["owners", "rows"]
        kills, lost = 0, None
        if before:
            touched = self.spark.read.parquet(f"{at}/owners").select(self.owner).distinct()
            lost = stage(before.live().join(bounded(touched, touched.count()), self.owner, "left_semi").select("_segment", "_doc", "_dl", "_tokens"), "killed")
            lost.select(F.col("_segment").alias("segment"), F.col("_doc").alias("doc")).write.parquet(f"{at}/dead")
            kills = lost.count()
            has.append("dead")
        postings = postings_of(written)
        more = postings.select("term", F.lit(1).alias("df"))
        if kills:
            more = more.unionByName(lost.select(F.explode(F.array_distinct("_tokens")).alias("term"), F.lit(-1).alias("df")))
        self._put_terms(more, at)
        came, went = (self._sizes(x) if x is not None else (0, 0) for x in (written, lost))
        self._put_postings(postings, came, at)
        has += ["terms", "postings"]
        discard(lost, postings)
        entry = {"dir": folder, "id": number, "has": has, "rows": came[0], "kills": kills}
        old = before.content if before else {"segments": [], "rows": 0, "length": 0, "version": 0}
        content = {"segments": [*old["segments"], entry], "rows": old["rows"] + came[0] - went[0], "length": old["length"] + came[1] - went[1], "next": number + 1}
        return self._commit(content, old["version"], merge)

    def _put_terms(self, counts: DataFrame, at: str) -> None:
        counts.groupBy("term").agg(F.sum("df").cast("long").alias("df")).where("df <> 0").repartitionByRange("term").sortWithinPartitions("term").write.parquet(f"{at}/terms")

    def _put_postings(self, postings: DataFrame, size: tuple[int, int], at: str) -> None:
        blocks_of(postings, size[1] / max(1, size[0])).write.parquet(f"{at}/postings")

    @staticmethod
    def _sizes(rows: DataFrame) -> tuple[int, int]:
        n, length = rows.agg(F.count("*"), F.coalesce(F.sum("_dl"), F.lit(0))).first()
        return n, length

    def _commit(self, content: dict, after: int, merge: bool) -> Snapshot:
        new = Snapshot(self, content | {"version": after + 1, "mean_idf": 0.0})
        # the mean idf of all terms, which frequent terms count by: a pass over the vocabulary, not over rows
        df = new.table("terms").groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")
        n = F.lit(float(content["rows"]))
        content["mean_idf"] = df.agg(F.avg(F.log(n - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))).first()[0] or 0.0
        number = self.log.commit(content, after)
        new = Snapshot(self, content | {"version": number})
        run = self._mergeable(content["segments"]) if merge else None
        try:
            return self._merge(new, *run) if run else new
        except Conflict:  # another writer's change came first; a later change merges
            return new

    @staticmethod
    def _mergeable(segments: list[dict]) -> tuple[int, int] | None:
        """(begin, end) of neighbours to merge: the last FAN or more of a tier no larger than that of any before them."""
        tier = lambda s: next(t for t in range(64) if s["rows"] <= FIRST_TIER * FAN**t)
        end, begin = len(segments), len(segments)
        top = -1
        while begin and (top < 0 or tier(segments[begin - 1]) <= top):
            begin -= 1
            top = max(top, tier(segments[begin]))
        return (begin, end) if end - begin >= FAN else None

    def _merge(self, now: Snapshot, begin: int, end: int) -> Snapshot:
        """One segment in place of some neighbours, of what is alive in them; nothing is tokenized."""
        part = now.content["segments"][begin:end]
        ids = [s["id"] for s in part]
        folder = uuid.uuid4().hex
        at = f"{self.path}/segments/{folder}"
        within = lambda df: df.where(F.col("_segment").isin(ids))
        within(now.live()).drop("_segment").withColumn("_doc", F.monotonically_increasing_id()).write.parquet(f"{at}/rows")
        written = self.spark.read.parquet(f"{at}/rows")
        # kills of older segments stay; those among the merged rows are done with
        kept = within(now.table("dead")).where(~F.col("segment").isin(ids)).select("segment", "doc")
        kept.write.parquet(f"{at}/dead")
        owners = within(now.table("owners"))
        names = [c for c in owners.columns if c != "_segment"]
        newest = owners.groupBy(F.col(self.owner).alias("_o")).agg(F.max_by(F.struct(*names), "_segment").alias("s")).select("s.*")
        (newest if begin else newest.where("not _removed")).write.parquet(f"{at}/owners")
        # what is alive now is all of the merged rows, as they are the last ones
        self._put_terms(within(now.table("terms")).select("term", "df"), at)
        size = self._sizes(written)
        postings = postings_of(written)
        self._put_postings(postings, size, at)
        discard(postings)
        entry = {"dir": folder, "id": ids[-1], "has": ["owners", "rows", "dead", "terms", "postings"], "rows": size[0], "kills": self.spark.read.parquet(f"{at}/dead").count()}
        content = {k: v for k, v in now.content.items() if k != "version"} | {"segments": [*now.content["segments"][:begin], entry, *now.content["segments"][end:]]}
        return Snapshot(self, content | {"version": self.log.commit(content, now.version)})
