"""WARC, sharding, URL rules and exact top-k."""

import hashlib
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lodegrain.llm import sharding, topk, url_filter, warc


# --- WARC -----------------------------------------------------------------------------------------------


def test_archives_come_back(spark):
    long = "x" * 150
    rows = [(3, "http://a/\r\nX: y", long), (1, "http://b", long), (2, None, "short"), (4, "u", "short"), (5, "u", None), (6, "u", ""), (7, "é", "é" * 60), (8, "u", "é" * 60), (9, "u", "<p>" * 100_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("d")).withColumn("refers_to", F.lit(0))
    got = {r["page_id"]: r for r in warc.round_trip(pages).collect()}
    first = {}
    for p, _, h in sorted(rows, key=lambda r: r[0]):
        first.setdefault(h, p)
    for p, _, h in rows:
        data = (h or "").encode()
        again = len(data) >= 100 and first[h] != p
        assert (got[p]["payload_bytes"], got[p]["payload_digest"], got[p]["record_type"], got[p]["refers_to"]) == (len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", first[h] if again else None)
        assert got[p]["payload"] is None if again else bytes(got[p]["payload"]) == data
    assert warc.round_trip(pages.limit(0)).count() == 0
    twice = spark.createDataFrame([(1, "u", long), (1, "u", long), (None, "u", long)], "page_id long, url string, html string")
    assert sorted(r["record_type"] for r in warc.round_trip(twice).collect()) == ["response", "response", "revisit"]


def test_selected_records_share_reads():
    rows = [("a", 0, 10), ("a", 10, 10), ("a", 500_000, 10), ("b", 0, 10), ("b", 20, 9_000_000), ("b", 9_000_020, 10)]
    assert [(f, b, e, len(h)) for f, b, e, h in warc.ranges(rows)] == [("a", 0, 20, 2), ("a", 500_000, 500_010, 1), ("b", 0, 10, 1), ("b", 20, 9_000_020, 1), ("b", 9_000_020, 9_000_030, 1)]


# --- sharding -------------------------------------------------------------------------------------------


def test_tables_are_even_weighted_and_stable():
    names = [f"s{i}" for i in range(20)]
    count = Counter(sharding.build_table(names, 5003))
    assert max(count.values()) - min(count.values()) <= 1
    heavy = Counter(sharding.build_table(names[:3], 1009, [2, 1, 1]))
    assert abs(heavy[0] - 1009 / 2) < 5
    before, after = sharding.build_table(names, 5003), sharding.build_table(names[:-1], 5003)
    assert sum(a != b for a, b in zip(before, after) if a != 19) < 0.15 * 5003
    assert set(sharding.build_table(names[:3], 101, [0, 1, 2])) == {1, 2}
    for wrong in ((names, 5000), (names[:1], 1), (names[:2], 101, [0, 0]), (names[:2], 101, [1]), (names[:2], 101, [1, 1, 1]), (names[:2], 101, [1, -1]), (["a", "a"], 101), ([], 101)):
        with pytest.raises(ValueError):
            sharding.build_table(*wrong)


def test_filling_is_by_turns_and_preferences():
    """Restated: whole preference lists, and shards that take the first free slot of theirs in turn."""
    names, size = [f"shard-{i:03d}" for i in range(7)], 127
    lists = []
    for n in names:
        d = hashlib.md5(n.encode()).hexdigest()
        first, step = int(d[:16], 16) % size, 1 + int(d[16:], 16) % (size - 1)
        lists.append([(first + j * step) % size for j in range(size)])
        assert sorted(lists[-1]) == list(range(size))
    held = {}
    while len(held) < size:
        for i, order in enumerate(lists):
            if len(held) < size:
                held[next(s for s in order if s not in held)] = i
    assert sharding.build_table(names, size) == [held[s] for s in range(size)]


def test_rows_are_placed(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (None, "c"), (2, None)], "k long, slot string").withColumn("shard", F.lit("x"))
    got = sharding.assign_shards(df, "k", ["p", "q", "r"], 101).collect()
    table = sharding.build_table(["p", "q", "r"], 101)
    for r in got:
        slot = int(hashlib.md5(b"" if r["k"] is None else str(r["k"]).encode()).hexdigest()[:15], 16) % 101
        assert (r["slot"], r["shard"]) == (slot, "pqr"[table[slot]])
    assert len(got) == 4 and sharding.assign_shards(df.limit(0), "k", ["p"], 101).count() == 0
    hot = spark.range(2000).withColumn("k", F.lit(7))
    spread = sharding.assign_shards(hot, "k", [f"s{i}" for i in range(8)], 101, spread_by="id", spread=16)
    assert spread.select("slot").distinct().count() > 8


def test_shards_are_written_in_few_files(spark, tmp_path):
    df = spark.range(3000).withColumn("k", F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id"))).repartition(8)
    sharding.write_shards(df, str(tmp_path / "out"), "k", ["p", "q", "r"], size=101)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 3000 and len(list((tmp_path / "out").rglob("*.parquet"))) <= 6
    want = {(r["id"], r["shard"]) for r in sharding.assign_shards(df, "k", ["p", "q", "r"], 101).collect()}
    assert {(r["id"], r["shard"]) for r in back.collect()} == want


# --- URL rules ------------------------------------------------------------------------------------------


def plain(host, path, rules):
    fit = [(len(h) + len(p), len(h), -i) for i, (_, h, p) in enumerate(rules) if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return -max(fit)[2] if fit else -1


@pytest.mark.parametrize("seed", [3, 100_000])
def test_the_sweep_is_the_longest_rule(seed):
    rng = random.Random(seed)
    host = lambda: ".".join(rng.choices("abc", k=rng.randrange(1, 5)))
    path = lambda: "/" + "".join(rng.choices("xy/", k=rng.randrange(5)))
    rules = [(rng.choice(["block", "allow"]), host(), path()) for _ in range(60)] + [("block", "", "/")]
    hosts, paths = [host() for _ in range(400)] + [""], [path() for _ in range(400)] + [""]
    assert url_filter.Rules(rules).judge(hosts, paths) == [plain(h, p, rules) for h, p in zip(hosts, paths)]


def test_urls(spark):
    rows = [(1, "HTTP://Www.Example.NET/en/x?q"), (2, "http://example.net/x"), (3, "https://a.example.com/de/"), (4, "http://notnet/"), (5, None), (6, "no scheme"), (7, "http://x.org"), (8, "http://h?u=http://y.net/"), (8, "http://h?u=http://y.net/"), (None, "http://a.net#f")]
    df = spark.createDataFrame(rows, "page_id long, url string").withColumn("host", F.lit("z")).withColumn("_key", F.lit(1))
    got = {(r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge_urls(df, "page_id", "url", url_filter.RULES).collect()}
    assert got == {(1, "www.example.net", "/en/x", "example.net/en/", "allow"), (2, "example.net", "/x", "net/", "block"), (3, "a.example.com", "/de/", "example.com/de/", "block"), (4, "notnet", "/", None, "allow"), (5, "", "", None, "allow"), (6, "", "", None, "allow"), (7, "x.org", "", None, "allow"), (8, "h", "", None, "allow"), (None, "a.net", "", None, "allow")}
    assert url_filter.judge_urls(df.limit(0), "page_id", "url", url_filter.RULES).count() == 0
    long = spark.createDataFrame([(1, "http://" + "a." * 20_000 + "net/" + "x" * 200_000)], "page_id long, url string")
    assert url_filter.judge_urls(long, "page_id", "url", url_filter.RULES).first()["verdict"] == "block"


@pytest.mark.parametrize("range_keys", [40, 500_000])
def test_a_range_join_of_rules_judges_as_the_broadcast_ones(spark, range_keys):
    rng = random.Random(range_keys)
    host = lambda: ".".join(rng.choices("abc", k=rng.randrange(1, 5)))
    path = lambda: "/" + "".join(rng.choices("xyé/", k=rng.randrange(5)))
    rules = [(rng.choice(["block", "allow"]), host(), path()) for _ in range(150)] + [("block", "", "/"), ("block", "c", ""), ("block", "a", "/" + "y" * 3000)]
    urls = [f"http://{host()}{path()}?q" for _ in range(600)] + ["http://a.b.c/x/y"] * 300 + [None, "", "no scheme", "http://", "http://.a/", "http://b.a/" + "y" * 5000]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("part", F.lit(1)).withColumn("number", F.lit(2))
    want = {r["page_id"]: tuple(r) for r in url_filter.judge_urls(df, "page_id", "url", rules).collect()}
    for i, h, p, rule, _ in want.values():
        n = plain(h, p, rules)
        assert rule == (None if n < 0 else rules[n][1] + rules[n][2]), (i, h, p)
    table = spark.createDataFrame([(v, h, p, i) for i, (v, h, p) in enumerate(rules)] + [("block", None, "/", 999), ("block", "a", None, 998)], "verdict string, host string, path string, number int")
    for given in (rules, table):
        got = url_filter.judge_urls(df, "page_id", "url", given, broadcast_bytes=0, range_keys=range_keys).collect()
        assert len(got) == len(urls) and {r["page_id"]: tuple(r) for r in got} == want
    assert url_filter.judge_urls(df, "page_id", "url", table.limit(0), broadcast_bytes=-1).where("rule is not null").count() == 0
    assert url_filter.judge_urls(df.limit(0), "page_id", "url", table, broadcast_bytes=0).count() == 0


# --- top-k ----------------------------------------------------------------------------------------------


def test_top_k_is_brute_force(spark):
    rng = random.Random(2)
    vec = lambda s: [rng.gauss(0, s) for _ in range(6)]
    rows = [(i, vec(rng.choice([0.01, 1, 20]))) for i in range(300)] + [(300 + i, [1.0] * 6) for i in range(20)]
    rows += [(400, None), (401, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (402, [float("nan")] * 6), (403, [float("inf")] * 6), (404, [0.0] * 6), (405, [1.0, 2.0]), (406, [2.0, 1.0]), (None, [1.0] * 6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("v", F.lit(1)).withColumn("rank", F.lit(2))
    vectors = topk.integer_vectors(df, "vec_id", "embedding")
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in topk.top_k(vectors, vectors.where("vec_id % 5 = 0"), 5).collect()}
    ints = {i: [math.floor(256 * x) for x in v] for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)}
    want = {}
    for q in ints:
        if q % 5 == 0:
            near = sorted((-sum(x * y for x, y in zip(ints[q], c)), i) for i, c in ints.items() if i != q and len(c) == len(ints[q]))
            want |= {(q, k): (i, -s) for k, (s, i) in enumerate(near[:5], 1)}
    assert got == want
    same = topk.integer_vectors(spark.createDataFrame([(0, [1.0]), (0, [2.0]), (0, [2.0]), (1, [3.0])], "vec_id long, embedding array<double>"), "vec_id", "embedding")
    rows = [(r["query_id"], r["rank"], r["vec_id"], r["score"] // 65536) for r in topk.top_k(same, same.where("vec_id = 0"), 5).collect()]
    assert sorted(rows) == [(0, 1, 1, 3), (0, 1, 1, 6), (0, 2, 0, 2), (0, 2, 0, 4), (0, 3, 0, 2), (0, 3, 0, 2)]
    assert topk.top_k(vectors.limit(0), vectors, 5).count() == 0 and topk.top_k(vectors, vectors.limit(0), 5).count() == 0
