"""URL rules by a sort-merge range join on reversed-host keys.

A rule ``(host, path)`` becomes the interval of keys that begin with ``reversed host + NUL + path``: the
labels of the host are reversed, so a host and its subdomains share a beginning.  A url has one key for
each of its host's suffixes that some rule names.  Keys and rules are sorted and swept once together;
intervals of prefixes are nested or disjoint, so a stack holds the rules active at a key and its top is
the longest of that host.  The longest over a url's keys wins.

A list of rules that is counted small is broadcast once, sorted, and swept with each task's urls, which never move.  A
larger one is a table like the urls: their keys are cut into ranges of like size, each rule goes to the ranges that its
interval meets, so that rules open where a range begins are carried into it, and each range is swept by itself.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, bound_batches, discard, stage

RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
#: What a rule that is broadcast takes beside its characters, about, in bytes.
RULE_BYTES = 200
#: Keys of urls in a range, about, and the characters of a range's ends that are compared.
RANGE_KEYS, END = 500_000, 1024
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else ''."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def reverse_host(host: str) -> str:
    return ".".join(reversed(host.split(".")))


def _sweep(keys: list[tuple[str, int]], rules: list[tuple[str, int]], best: list[int], rank: list) -> None:
    """keys: sorted (key, row); rules: sorted (key, rule number).  Keeps each row's best rule so far."""
    stack: list[tuple[str, int]] = []
    r, n = 0, len(rules)
    for key, row in keys:
        while r < n and rules[r][0] <= key:
            while stack and not rules[r][0].startswith(stack[-1][0]):
                stack.pop()
            stack.append(rules[r])
            r += 1
        while stack and not key.startswith(stack[-1][0]):
            stack.pop()
        if stack and (best[row] < 0 or rank[stack[-1][1]] > rank[best[row]]):
            best[row] = stack[-1][1]


class Rules:
    """(verdict, host, path) rules in order of their keys."""

    def __init__(self, rules: Sequence[tuple[str, str, str]]):
        self.rules = list(rules)
        # longest text first, then longest host, then the first given: a strict order of any two rules
        self.rank = [(len(h) + len(p), len(h), -i) for i, (_, h, p) in enumerate(self.rules)]
        first: dict[str, int] = {}
        for i, (_, h, p) in enumerate(self.rules):
            key = reverse_host(h) + "\0" + p
            if key not in first or self.rank[i] > self.rank[first[key]]:
                first[key] = i
        self.ordered, self.named = sorted(first.items()), {reverse_host(h) for _, h, _ in self.rules}

    def judge(self, hosts: Sequence[str], paths: Sequence[str]) -> list[int]:
        """Number of the winning rule of each (host, path), -1 if none fits."""
        best, keys = [-1] * len(hosts), []
        for row, (host, path) in enumerate(zip(hosts, paths, strict=True)):
            at, back = -1, reverse_host(host)
            while True:
                at = back.find(".", at + 1)
                level = back if at < 0 else back[:at]
                if level in self.named:
                    keys.append((f"{level}\0{path}", row))
                if at < 0:
                    break
        keys.sort()
        _sweep(keys, self.ordered, best, self.rank)
        return best


def _small(rules: Sequence[tuple[str, str, str]] | DataFrame, limit: int) -> list[tuple[str, str, str]] | None:
    """The rules as a list if they are counted small enough to be broadcast, else None."""
    if not isinstance(rules, DataFrame):
        return list(rules) if sum(len(h) + len(p) + RULE_BYTES for _, h, p in rules) <= limit else None
    size = rules.agg(F.coalesce(F.sum(F.length("host") + F.length("path") + RULE_BYTES), F.lit(0))).first()[0]
    return [(r["verdict"], r["host"], r["path"]) for r in rules.orderBy("number").collect()] if size <= limit else None


def _swept_alone(small: DataFrame, kind: str, rules: list[tuple[str, str, str]], default: str) -> DataFrame:
    """Sweep each batch of urls with all rules, broadcast."""
    sent = small.sparkSession.sparkContext.broadcast(Rules(rules))

    def sweep(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        held = sent.value.rules
        for batch in batches:
            won = sent.value.judge(batch.column(1).to_pylist(), batch.column(2).to_pylist())
            names = pa.array([None if i < 0 else held[i][1] + held[i][2] for i in won], pa.string())
            verdicts = pa.array([default if i < 0 else held[i][0] for i in won], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, names, verdicts], names=["_key", "host", "path", "rule", "verdict"])

    return small.mapInArrow(sweep, f"_key {kind}, host string, path string, rule string, verdict string")


def _sweep_range(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
    """Rows (part, key, row, rank) in order of part and key, a rule (no row) before the urls of its key: the rank of the
    longest rule open at each url's key.  The rules held are beginnings of one key, so there are no more than it has
    characters."""
    now, stack = None, []
    for batch in batches:
        rows, ranks = [], []
        for part, key, row, rank in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if part != now:
                now, stack = part, []
            while stack and not key.startswith(stack[-1][0]):
                stack.pop()
            if row is None:
                stack.append((key, rank))
            elif stack:
                rows.append(row)
                ranks.append(stack[-1][1])
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(ranks, batch.schema.field("rank").type)], names=["row", "rank"])


def _range_join(small: DataFrame, rules: DataFrame, default: str, range_keys: int) -> DataFrame:
    """The same by a range join of two tables, for rules (verdict, host, path, number) of any number.

    A url's keys are those of its host's suffixes of no more labels than any rule's host has, with as much of its path as
    the longest rule could meet.  Equal keys may fall into several ranges, so a url with a third of all rows is dealt like
    others.  What the driver sees is the two ends of each range."""
    spark = small.sparkSession
    key_of = F.concat(F.array_join(F.reverse(F.split("host", r"\.", -1)), "."), F.lit("\0"), F.col("path"))
    rank = F.struct((F.length("host") + F.length("path")).alias("text"), F.length("host").alias("host"), (-F.col("number")).alias("turn"))
    ranked = stage(rules.select(key_of.alias("key"), rank.alias("rank"), F.size(F.split("host", r"\.", -1)).alias("labels"), F.length("path").alias("chars")).groupBy("key").agg(F.max("rank").alias("rank"), F.max("labels").alias("labels"), F.max("chars").alias("chars")), "url-rules")
    labels, chars = ranked.agg(F.coalesce(F.max("labels"), F.lit(0)), F.coalesce(F.max("chars"), F.lit(0))).first()
    urls = stage(small.withColumn("_row", F.monotonically_increasing_id()), "urls")
    backwards = F.reverse(F.split("host", r"\.", -1))
    levels = F.transform(F.sequence(F.lit(1), F.least(F.size(backwards), F.lit(max(labels, 1)))), lambda n: F.array_join(F.slice(backwards, 1, n), "."))
    keys = urls.select(F.col("_row").alias("row"), F.explode(levels).alias("level"), F.substring("path", 1, chars).alias("path")).select("row", F.concat("level", F.lit("\0"), "path").alias("key"))
    parts = max(spark.sparkContext.defaultParallelism, -(-urls.agg(F.coalesce(F.sum(F.least(F.size(backwards), F.lit(max(labels, 1)))), F.lit(0))).first()[0] // range_keys))
    dealt = stage(keys.repartitionByRange(parts, "key", "row").withColumn("part", F.spark_partition_id()), "url-keys")
    ends = dealt.groupBy("part").agg(F.substring(F.min("key"), 1, END).alias("low"), F.substring(F.max("key"), 1, END).alias("high")).orderBy("part").collect()  # one row a range
    sent = spark.sparkContext.broadcast([(r["part"], r["low"], r["high"] + "\U0010ffff") for r in ends])

    def deal(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        """Each rule once for every range that its interval meets; one too many, as the ends are cut, opens no key."""
        ranges, highs = sent.value, [high for _, _, high in sent.value]
        for batch in batches:
            to, of = [], []
            for i, key in enumerate(batch.column("key").to_pylist()):
                at = bisect_left(highs, key)
                while at < len(ranges) and (ranges[at][1] <= key or ranges[at][1].startswith(key)):
                    to.append(ranges[at][0])
                    of.append(i)
                    at += 1
            met = batch.take(pa.array(of, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(to, pa.int32()), *met.columns], names=["part", "key", "rank"])

    kind = "struct<text:int,host:int,turn:bigint>"
    met = ranked.select("key", F.col("rank").cast(kind).alias("rank")).mapInArrow(deal, f"part int, key string, rank {kind}")
    both = dealt.select("part", "key", "row", F.lit(None).cast(kind).alias("rank")).unionByName(met.select("part", "key", F.lit(None).cast("long").alias("row"), "rank"))
    ordered = both.repartitionById(parts, F.col("part")).sortWithinPartitions("part", "key", F.asc_nulls_first("row"))
    best = ordered.mapInArrow(_sweep_range, f"row long, rank {kind}").groupBy("row").agg(F.max("rank").alias("rank"))
    won = stage(best.select("row", (-F.col("rank.turn")).alias("number")), "url-winners")
    named = rules.select(F.col("number").alias("_number"), F.concat("host", "path").alias("rule"), F.col("verdict").alias("_verdict"))
    # a rule that wins a third of all urls meets them in one row each: its text is joined to the distinct winners, then dealt
    used = stage(won.select("number").distinct().join(named, F.col("number") == F.col("_number")).select("number", "rule", "_verdict"), "url-rules-used")
    salts = F.explode(F.sequence(F.lit(0), F.lit(15)))
    texts = won.withColumn("salt", F.pmod("row", F.lit(16)).cast("int")).join(used.withColumn("salt", salts), ["number", "salt"]).select("row", "rule", "_verdict")
    out = urls.join(texts, F.col("_row") == F.col("row"), "left").select("_key", "host", "path", "rule", F.coalesce("_verdict", F.lit(default)).alias("verdict"))
    discard(spark, ranked._staged_at, dealt._staged_at)
    return out


def judge_urls(df: DataFrame, key: str, url: str, rules: Sequence[tuple[str, str, str]] | DataFrame, default: str = "allow", broadcast_bytes: int = BROADCAST_BYTES, range_keys: int = RANGE_KEYS) -> DataFrame:
    """(key, host, path, rule, verdict) of every row of ``df``, judged by (verdict, host, path) rules, as a list in order or as
    a table with a ``number`` of its own for each rule.

    A null url, or one without ``://``, has an empty host and path and no rule.  Where no rule fits, rule
    is null and the verdict is ``default``.  Of two rules of equal length the longer host wins, then the
    earlier one (the smaller number).  Rules with a null host or path fit nothing.  Repeated rows are judged alike; other columns of ``df`` are not read.
    Rules of more than ``broadcast_bytes`` are joined to the urls by ranges of keys, with the same results.
    """
    bound_batches(df.sparkSession)
    small = df.select(F.col(key).alias("_key"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    if isinstance(rules, DataFrame):
        rules = rules.where("host is not null and path is not null").select("verdict", "host", "path", F.col("number").cast("long").alias("number"))
    held = _small(rules, broadcast_bytes)
    if held is not None:
        return _swept_alone(small, df.schema[key].dataType.simpleString(), held, default).withColumnRenamed("_key", key)
    if not isinstance(rules, DataFrame):
        rules = df.sparkSession.createDataFrame([(v, h, p, i) for i, (v, h, p) in enumerate(rules)], "verdict string, host string, path string, number long")
    return _range_join(small, rules, default, range_keys).withColumnRenamed("_key", key)
