"""N-gram Jaccard self-join by a token-group matrix.

Documents are sets of distinct word shingles (52-bit hashes); two link when their Jaccard similarity is at
least a threshold.  What decides a link is always the exact overlap of the two whole sets.

1. Equal sets form a class by a 128-bit fingerprint; its smallest doc_id goes on for all.
2. How many tokens of a document occur in any other one bounds its overlap with all of them.  Tokens travel
   once, packed in bins by bucket; what repeats within a piece of documents travels once a piece.  Only
   documents that can reach the threshold with such tokens stay.
3. Those are grouped: each is verified against the one document it shares most prefix tokens with, and the
   components of the links are the groups of similar documents.
4. Token-group matrix: per token and size band a group has one row, however many members.  Tokens of many
   groups go last in the common order of tokens, so they are hardly ever prefix tokens.  Groups that share a
   prefix token (an early one of the smaller set) and whose bounds (sizes, and tokens shared with anyone) allow a
   link are paired; the members of
   the smaller are queries.  A task holds a block of the larger's members in sub-groups of similar size, with
   the union of their tokens, bounds each query's overlap with each union, and opens only the sub-groups that
   qualify.
5. Components of all links are the result.

Groups that hold a third of all rows are never gathered: minima are salted, groups count as one row per
token, and members are dealt in blocks of a fixed size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodegrain.sources.workspace import spread

from .common import attach_min, bound_batches, bounded, components, row_ids, stage, without
from .kernels import TOKEN_BITS, Words, buffers, distinct_sets, mix, pieces, release, shingles

SIZE, PERCENT = 5, 80
BUCKET_TOKENS = 1 << 20
BAND = float(np.log(1.125))
SUB_GROUP, MEMBER_BLOCK, QUERY_BLOCK = 32, 2048, 4096
#: Tokens of more groups than this go last in the common order of tokens; at most so many are known as such.
HOT_GROUPS, HOT_TOKENS, REORDERINGS = 32, 1 << 20, 3
_U = np.uint64

Tokens = Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]


def shingle_sets(size: int = SIZE) -> Tokens:
    """Tokens of a piece of a text column: flat sorted distinct tokens of each row, and offsets."""

    def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        raw, off = buffers(column)
        row, value = shingles(Words(raw, off), size)
        return distinct_sets(row, value, len(off) - 1)

    return tokens


def _sums(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, values.dtype)
    np.cumsum(values, out=total[1:])
    return total[off[1:]] - total[off[:-1]]


def prefix_length(n: np.ndarray, percent: int) -> np.ndarray:
    """Two sets that link share one of the first ``prefix_length`` tokens of each, in any common order."""
    return n - -(-n * percent // 100) + 1


def early_length(n: np.ndarray, percent: int) -> np.ndarray:
    """Of two sets that link, the smaller one has a token of the other's prefix among this many."""
    return n - -(-n * 2 * percent // (100 + percent)) + 1


def fingerprints(rows: DataFrame, tokens: Tokens) -> DataFrame:
    """(doc_id, n, fp1, fp2) of (doc_id, text) rows."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j in pieces(b.column(1)):
                t, off = tokens(b.column(1).slice(i, j - i))
                first, second = _sums(mix(t + _U(1)), off), _sums(mix(t ^ _U(0x5851F42D4C957F2D)), off)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(np.diff(off), pa.int64()), pa.array(first.view(np.int64)), pa.array(second.view(np.int64))], names=["doc_id", "n", "fp1", "fp2"])

    return rows.mapInArrow(run, "doc_id long, n long, fp1 long, fp2 long")


def shared_counts(rows: DataFrame, tokens: Tokens, total: int) -> DataFrame:
    """(doc_id, n, c): c tokens of the document occur in another document too, or in a few more that
    another's hash resembles (one in 4,096)."""
    bits = max(6, int(np.ceil(np.log2(max(1, total / BUCKET_TOKENS)))))
    shift, low = _U(TOKEN_BITS - bits), _U(max(0, TOKEN_BITS - bits - 32))
    n_buckets = 1 << bits

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, k = TaskContext.get().partitionId(), 0
        for b in batches:
            for i, j in pieces(b.column(1)):
                t, off = tokens(b.column(1).slice(i, j - i))
                ids, n = b.column(0).slice(i, j - i).to_numpy(zero_copy_only=False).astype(np.int64), np.diff(off)
                doc = np.repeat(np.arange(j - i, dtype=np.uint64), n)
                packed = np.sort((t << _U(64 - TOKEN_BITS)) | doc)
                t, doc = packed >> _U(64 - TOKEN_BITS), (packed & _U(4095)).astype(np.uint16)
                new = np.ones(len(t) + 1, bool)
                new[1:-1] = t[1:] != t[:-1]
                alone = new[:-1] & new[1:]
                base = np.bincount(doc[~alone], minlength=j - i).astype(np.uint32)
                many = t[~alone & new[:-1]]
                one, one_doc = t[alone], doc[alone]
                edges = np.arange(n_buckets + 1, dtype=np.uint64) << shift
                at_one, at_many = np.searchsorted(one, edges), np.searchsorted(many, edges)
                cut32 = lambda x: ((x >> low) & _U(0xFFFFFFFF)).astype(np.uint32)
                one, many, piece = cut32(one), cut32(many), task << 24 | k
                k += 1
                out: list[list] = [[], [], [], [], [], []]
                for q in range(n_buckets):
                    mine = q == piece % n_buckets
                    a, z, c, d = at_one[q], at_one[q + 1], at_many[q], at_many[q + 1]
                    if a == z and c == d and not mine:
                        continue
                    info = np.concatenate([ids, n, base.astype(np.int64)]).tobytes() if mine else None
                    for col, x in zip(out, (q, piece, one[a:z].tobytes(), one_doc[a:z].tobytes(), many[c:d].tobytes(), info), strict=True):
                        col.append(x)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int32(), pa.int64(), *[pa.binary()] * 4), strict=True)], names=["bucket", "piece", "one", "doc", "many", "info"])

    def count(group: pa.Table) -> pa.Table:
        release()
        one = [np.frombuffer(x, np.uint32) for x in group["one"].to_pylist()]
        doc = [np.frombuffer(x, np.uint16) for x in group["doc"].to_pylist()]
        many = np.unique(np.concatenate([np.frombuffer(x, np.uint32) for x in group["many"].to_pylist()]))
        both = np.sort(np.concatenate([*one, many, many]))  # a token of ``many`` counts as two
        repeated = np.unique(both[1:][both[1:] == both[:-1]])
        counts = []
        for t, d in zip(one, doc, strict=True):
            at = np.searchsorted(repeated, t)
            hit = np.zeros(len(t), bool) if not len(repeated) else repeated[np.minimum(at, len(repeated) - 1)] == t
            counts.append(np.bincount(d[hit]).astype(np.uint32).tobytes())
        return pa.table({"piece": group["piece"], "counts": pa.array(counts, pa.binary()), "info": group["info"]})

    def gather(group: pa.Table) -> pa.Table:
        release()
        ids, n, total = np.frombuffer(next(x for x in group["info"].to_pylist() if x is not None), np.int64).reshape(3, -1)
        total = total.copy()
        for x in group["counts"].to_pylist():
            c = np.frombuffer(x, np.uint32)
            total[: len(c)] += c
        return pa.table({"doc_id": ids, "n": n, "c": total})

    cutting = rows.mapInArrow(cut, "bucket int, piece long, one binary, doc binary, many binary, info binary")
    counted = cutting.groupBy("bucket").applyInArrow(count, "piece long, counts binary, info binary")
    return counted.groupBy("piece").applyInArrow(gather, "doc_id long, n long, c long")


def _packed_sets(rows: DataFrame, tokens: Tokens) -> DataFrame:
    """(doc_id, n, c, tokens binary) of (doc_id, c, text) rows."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j in pieces(b.column(2)):
                t, off = tokens(b.column(2).slice(i, j - i))
                sets = [t[a:z].tobytes() for a, z in zip(off[:-1], off[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(np.diff(off), pa.int64()), b.column(1).slice(i, j - i), pa.array(sets, pa.binary())], names=["doc_id", "n", "c", "tokens"])

    return rows.mapInArrow(run, "doc_id long, n long, c long, tokens binary").where("n > 0")


def _prefixes(sets: DataFrame, percent: int, hot: np.ndarray | None = None) -> DataFrame:
    """(token, doc_id, n, c, early) for the prefix tokens of each set, in hash order but for the ``hot`` ones
    (by rising frequency), which come last.  Any order that is the same for all sets is a right one."""
    known, place = (np.sort(hot), np.argsort(hot).astype(np.int64)) if hot is not None and len(hot) else (None, None)
    sent = sets.sparkSession.sparkContext.broadcast((known, place))  # at most HOT_TOKENS

    def first(x: np.ndarray, k: int) -> np.ndarray:
        known, place = sent.value
        if known is None:
            return x[:k]
        at = np.minimum(np.searchsorted(known, x), len(known) - 1)
        late = known[at] == x
        cold = x[~late]
        return cold[:k] if len(cold) >= k else np.concatenate([cold, x[late][np.argsort(place[at[late]])][: k - len(cold)]])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            n = b.column(1).to_numpy()
            keep = prefix_length(n, percent)
            t = np.concatenate([first(np.frombuffer(x.as_buffer(), _U), k) for x, k in zip(b.column(3), keep, strict=True)]).view(np.int64)
            at = pa.array(np.repeat(np.arange(len(n)), keep))
            early = np.arange(len(t)) - np.repeat(np.cumsum(keep) - keep, keep) < np.repeat(early_length(n, percent), keep)
            yield pa.RecordBatch.from_arrays([pa.array(t), b.column(0).take(at), b.column(1).take(at), b.column(2).take(at), pa.array(early)], names=["token", "doc_id", "n", "c", "early"])

    return sets.mapInArrow(run, "token long, doc_id long, n long, c long, early boolean")


def _verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of (a, b) pairs those whose sets link."""
    left = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("tokens").alias("x")), "a")
    both = left.join(sets.select(F.col("doc_id").alias("b"), F.col("tokens").alias("y")), "b").select("a", "b", "x", "y")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), _U), np.frombuffer(y.as_buffer(), _U)
                ok.append(links(x, y, percent))
            pick = pa.array(np.flatnonzero(ok))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pick), b.column(1).take(pick)], names=["a", "b"])

    return both.mapInArrow(run, "a long, b long")


def overlap(x: np.ndarray, y: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(x) > len(y):
        x, y = y, x
    if not len(x):
        return 0
    return int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())


def links(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    both = overlap(x, y)
    return 100 * both >= percent * (len(x) + len(y) - both)


class TokenGroups:
    """A block of member sets in sub-groups of similar size, as a token-group matrix."""

    def __init__(self, ids: np.ndarray, sets: list[np.ndarray], size: int = SUB_GROUP):
        order = sorted(range(len(sets)), key=lambda i: (len(sets[i]), sets[i][:1].tolist(), ids[i]))
        self.ids, self.sets = ids[order], [sets[i] for i in order]
        self.cuts = list(range(0, len(sets), size))
        self.size = size
        self.low = np.array([len(self.sets[a]) for a in self.cuts])
        self.high = np.array([len(self.sets[min(a + size, len(sets)) - 1]) for a in self.cuts])
        unions = [np.unique(np.concatenate(self.sets[a : a + size])) for a in self.cuts]
        token, group = np.concatenate(unions), np.repeat(np.arange(len(unions)), [len(u) for u in unions])
        at = np.argsort(token, kind="stable")
        self.token, self.group = token[at], group[at]
        self.opened = 0

    def bound(self, x: np.ndarray) -> np.ndarray:
        """At most so many tokens of x are in any one member of each sub-group."""
        a, z = np.searchsorted(self.token, x), np.searchsorted(self.token, x, side="right")
        n = z - a
        at = np.repeat(a - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return np.minimum(np.bincount(self.group[at], minlength=len(self.cuts)), self.high)

    def search(self, x: np.ndarray, percent: int) -> int | None:
        """Id of a member that links with x."""
        most = self.bound(x)
        fit = (100 + percent) * most >= percent * (len(x) + np.maximum(self.low, most * percent // 100))
        fit &= (100 * self.high >= percent * len(x)) & (100 * len(x) >= percent * self.low)
        for g in np.flatnonzero(fit)[np.argsort(-most[fit], kind="stable")]:
            self.opened += 1
            for i in range(self.cuts[g], min(self.cuts[g] + self.size, len(self.sets))):
                if links(x, self.sets[i], percent):
                    return int(self.ids[i])
        return None


def _search_groups(pairs: DataFrame, sets: DataFrame, label: DataFrame, percent: int) -> DataFrame:
    """(a, b) links between the groups of (small, large, n_small, n_large) pairs: the small one's members are
    the queries.  Members and queries are dealt in blocks."""
    member = sets.select("doc_id", "tokens").join(label.select(F.col("node").alias("doc_id"), "root"), "doc_id")
    asked = pairs.groupBy("large").agg(F.sum("n_small").alias("queries"), F.max("n_large").alias("members"))
    asked = asked.select("large", F.ceil(F.col("members") / MEMBER_BLOCK).cast("int").alias("m"), F.ceil(F.col("queries") / QUERY_BLOCK).cast("int").alias("q"))
    held = member.join(asked, F.col("root") == F.col("large")).select("large", F.pmod(F.xxhash64("doc_id"), F.col("m")).cast("int").alias("mb"), F.explode(F.sequence(F.lit(0), F.col("q") - 1)).alias("qb"), "doc_id", "tokens")
    query = pairs.select("small", "large").join(asked, "large").join(member.withColumnRenamed("root", "small"), "small")
    query = query.select("large", F.explode(F.sequence(F.lit(0), F.col("m") - 1)).alias("mb"), F.pmod(F.xxhash64("doc_id", F.lit(1)), F.col("q")).cast("int").alias("qb"), "doc_id", "tokens")

    def search(both: pa.Table) -> pa.Table:
        release()
        a, b = [], []
        asks = both["asks"].to_numpy()
        left, right = both.filter(pa.array(asks)), both.filter(pa.array(~asks))
        if left.num_rows and right.num_rows:
            unpack = lambda t: [np.frombuffer(x, _U) for x in t["tokens"].to_pylist()]
            groups = TokenGroups(right["doc_id"].to_numpy(), unpack(right))
            for doc, x in zip(left["doc_id"].to_pylist(), unpack(left), strict=True):
                found = groups.search(x, percent)
                if found is not None:
                    a.append(doc)
                    b.append(found)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    both = query.withColumn("asks", F.lit(True)).unionByName(held.withColumn("asks", F.lit(False)))
    return both.groupBy("large", "mb", "qb").applyInArrow(search, "a long, b long")


def _token_groups(sets: DataFrame, label: DataFrame, percent: int) -> DataFrame:
    """(token, band, root, low, high, c, low_s, high_s, c_s): the token-group matrix, for tokens of several
    groups; sizes and bounds of the members with that prefix token, and (s) of those that have it early.

    Tokens of many groups would pair all of them, so they are put last in the common order and the prefixes
    are taken anew, until hardly a token of many groups is left that had not been known as one."""
    band = F.floor(F.log(F.col("n").cast("double")) / BAND + 1e-9).cast("int")
    of = bounded(label.withColumnRenamed("node", "doc_id"), label.count())
    hot = np.zeros(0, _U)
    for turn in range(REORDERINGS + 1):
        rows = _prefixes(sets, percent, hot).join(of, "doc_id")
        every = stage(rows.groupBy("token", band.alias("band"), "root").agg(*(f(x).alias(a + e) for e, of_n, of_c in (("", F.col("n"), F.col("c")), ("_s", F.when(F.col("early"), F.col("n")), F.when(F.col("early"), F.col("c")))) for f, x, a in ((F.min, of_n, "low"), (F.max, of_n, "high"), (F.max, of_c, "c")))), "token-groups")
        span = every.groupBy("token").agg(F.count("*").alias("groups"), F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 < r1")
        if turn < REORDERINGS and len(hot) < HOT_TOKENS:
            found = span.where(F.col("groups") > HOT_GROUPS).orderBy(F.desc("groups"), "token").limit(HOT_TOKENS - len(hot)).select("token").toArrow()
            found = found["token"].to_numpy().view(np.uint64)[::-1]
            new = found[~np.isin(found, hot)]
            hot = np.concatenate([new, hot])
            if len(new):
                continue
        return every.join(span.select("token"), "token", "left_semi")
    raise AssertionError


def _group_pairs(groups: DataFrame, label: DataFrame, percent: int) -> DataFrame:
    """(small, large, n_small, n_large): groups that share a prefix token and whose bounds allow a link."""
    # 100 * overlap >= percent * (x + y - overlap), the overlap being at most either side's c
    small = groups.where(F.col("c_s") * (100 + percent) >= F.col("low_s") * 2 * percent)
    small = small.select("token", F.explode(F.array(*(F.col("band") + i for i in range(int(np.ceil(np.log(100 / percent) / BAND)) + 1)))).alias("band"), F.col("root").alias("ra"), F.col("low_s").alias("la"), F.col("high_s").alias("ha"), F.col("c_s").alias("ca"))
    fits = (F.col("root") != F.col("ra")) & (F.least("c", "ca") * (100 + percent) >= (F.col("low") + F.col("la")) * percent) & (F.col("ha") * 100 >= F.col("low") * percent) & (F.col("high") >= F.col("la"))
    pairs = groups.join(small, ["token", "band"]).where(fits).select(F.least("root", "ra").alias("a"), F.greatest("root", "ra").alias("b")).distinct()
    size = label.groupBy("root").agg(F.count("*").alias("size"))
    sized = pairs.join(size.select(F.col("root").alias("a"), F.col("size").alias("sa")), "a").join(size.select(F.col("root").alias("b"), F.col("size").alias("sb")), "b")
    swap = F.col("sa") > F.col("sb")
    return sized.select(F.when(swap, F.col("b")).otherwise(F.col("a")).alias("small"), F.when(swap, F.col("a")).otherwise(F.col("b")).alias("large"), F.least("sa", "sb").alias("n_small"), F.greatest("sa", "sb").alias("n_large"))


def similar_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SIZE, percent: int = PERCENT, tokens: Tokens | None = None) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row: the number of distinct ``size``-word shingles and the
    smallest doc_id reachable by links of at least ``percent`` / 100 Jaccard similarity.

    With fewer words the whole sequence is the only shingle.  Null or empty texts, and texts of white space,
    have none and link with nothing.  Rows that repeat a doc_id are one document with all of their links;
    rows with a null doc_id link with nothing and have a null component.  An empty table gives none.
    """
    bound_batches(docs.sparkSession)
    tokens = tokens or shingle_sets(size)
    rows = spread(docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")))
    prints = stage(fingerprints(rows, tokens), "fingerprints")
    known = prints.where("n > 0 and doc_id is not null")
    classes = stage(attach_min(known, ["fp1", "fp2", "n"], "doc_id", "rep").select("doc_id", "n", "rep"), "classes")
    per_doc = classes.groupBy("doc_id").agg(F.max(F.col("doc_id") == F.col("rep")).alias("own"))
    copies = stage(per_doc.where("not own").select(F.col("doc_id").alias("_copy")), "copies")
    n_copies, total = copies.count(), classes.where("doc_id = rep").agg(F.sum("n")).first()[0] or 0
    single = rows.where("doc_id is not null").join(bounded(copies, n_copies), F.col("doc_id") == F.col("_copy"), "left_anti")
    able = stage(shared_counts(single, tokens, total).where(F.col("c") * 100 >= F.col("n") * percent).where("n > 0"), "able")
    side = able.groupBy("doc_id").agg(F.max("c").alias("c")).withColumnRenamed("doc_id", "_id")
    sets = stage(_packed_sets(rows.join(bounded(side, able.count()), F.col("doc_id") == F.col("_id")).select("doc_id", "c", "text"), tokens), "sets")
    edges = classes.where("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    prefix = stage(_prefixes(sets, percent), "prefixes")
    hubs = attach_min(prefix.select("token", "doc_id", "n"), ["token"], "doc_id", "hub").where("hub < doc_id")
    best = hubs.groupBy("doc_id", "hub").count().groupBy("doc_id").agg(F.max_by("hub", F.struct("count", -F.col("hub"))).alias("b"))
    linked = stage(_verify(best.select(F.col("doc_id").alias("a"), "b"), sets, percent), "hub-links")
    grouped = components(edges.unionByName(linked))
    label = stage(sets.select(F.col("doc_id").alias("node")).distinct().join(grouped, "node", "left").select("node", F.coalesce("root", "node").alias("root")), "labels")
    pairs = stage(_group_pairs(stage(_token_groups(sets, label, percent), "matrix"), label, percent), "group-pairs")
    if not pairs.isEmpty():
        more = stage(_search_groups(pairs, sets, label, percent), "group-links")
        grouped = components(grouped.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more))
    return prints.join(grouped, F.col("doc_id") == F.col("node"), "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("root", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", **more) -> DataFrame:
    """``docs`` with one document of each group of similar ones, that with the smallest doc_id.

    Rows with no words or a null doc_id stay.  Rows are judged by doc_id and text: different texts under one doc_id are
    documents of their own, and of rows that repeat a doc_id and its text, which has words, any one stays."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    k, t = names[docs.columns.index(key)], names[docs.columns.index(text)]
    plain, _ = row_ids(docs.toDF(*names), k, t)
    found = stage(similar_documents(plain.select("doc", F.col(t).alias("text")), "doc", "text", **more), "similar")
    gone = stage(found.where("component_id <> doc_id").select("doc_id").distinct(), "dropped")
    kept = without(plain, "doc", gone, gone.count())
    twice = stage(found.where("n_shingles > 0 and doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated")
    if n := twice.count():
        again = bounded(twice, n)
        once = kept.join(again, F.col("doc") == F.col("doc_id"), "left_semi").dropDuplicates(["doc"])
        kept = kept.join(again, F.col("doc") == F.col("doc_id"), "left_anti").unionByName(once)
    return kept.select(*names).toDF(*docs.columns)
