"""Joins that are no equality, and debouncing of a hot key, against brute force."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodegrain.operators import corpus as N
from lodegrain.operators import joins as J
from lodegrain.streaming import events as Z


def plan(df):
    return df._jdf.queryExecution().toString()


@pytest.mark.parametrize("least", [0.6, 0.95, -1.0])
def test_all_pairs_above_a_cosine(spark, least):
    rng = np.random.default_rng(3)
    middle = rng.normal(size=(12, 16))
    x = np.concatenate([middle[rng.integers(0, 12, 220)] + rng.normal(size=(220, 16)) * rng.choice([0.05, 0.4], (220, 1)), np.zeros((1, 16)), np.ones((3, 16)), -np.ones((1, 16))])
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame([*rows, (900, None), (901, [None] + [1.0] * 15)], "k int, v array<double>")
    found = J.similar_vectors(df, "k", "v", least, n_pivots=16, block=16)
    got = {(r["a"], r["b"]): r["similarity"] for r in found.collect()}
    n = np.sqrt((x * x).sum(1))
    cos = (x @ x.T) / np.where(n * n[:, None] > 0, n * n[:, None], 1)
    want = {(i, j): cos[i, j] for i in range(len(x)) for j in range(i + 1, len(x)) if cos[i, j] >= least - 1e-9}
    assert {p for p, s in want.items() if s > least + 1e-9} <= set(got) <= set(want) and all(abs(got[p] - want[p]) < 1e-9 for p in got)
    assert "NestedLoop" not in plan(found) and "Cartesian" not in plan(found)
    assert J.similar_vectors(df.limit(0), "k", "v", least).count() == 0


def test_cells_that_are_far_apart_do_not_meet(spark, monkeypatch):
    """Of well separated clusters each vector asks its own cell only."""
    rng = np.random.default_rng(4)
    middle = np.linalg.qr(rng.normal(size=(32, 8)))[0].T
    x = middle[np.arange(400) % 8] + rng.normal(size=(400, 32)) * 0.005
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "k int, v array<double>")
    found = J.similar_vectors(df, "k", "v", 0.95, n_pivots=32)
    assert found.count() == sum(i % 8 == j % 8 for i in range(400) for j in range(i + 1, 400))


def test_vectors_without_clusters_meet_in_blocks_and_once(spark, monkeypatch):
    """Cells that spare nothing are not made, pairs are not found twice, and those of clusters still have cells."""
    rng = np.random.default_rng(8)
    rows = rng.normal(size=(1500, 24)).astype(np.float32)
    staged, keep = {}, J.stage
    monkeypatch.setattr(J, "stage", lambda df, name: staged.setdefault(name, keep(df, name)))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(rows)], "k int, v array<float>").repartition(3)
    unit = rows.astype(float) / np.sqrt((rows.astype(float) ** 2).sum(1))[:, None]
    near = unit @ unit.T
    for block in (None, 400):
        staged.clear()
        found = J.similar_vectors(df, "k", "v", 0.3, block=block)
        got = [(r["a"], r["b"]) for r in found.collect()]
        assert sorted(got) == [(int(i), int(j)) for i, j in zip(*np.nonzero(np.triu(near, 1) >= 0.3), strict=True)]
        assert staged["cells"].select("cell").distinct().count() == 1
    staged.clear()
    lumps = np.repeat(rng.normal(size=(3, 24)), 1000, 0) + 0.01 * rng.normal(size=(3000, 24))
    J.similar_vectors(spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(lumps)], "k int, v array<double>"), "k", "v", 0.95)
    assert staged["cells"].select("cell").distinct().count() > 1


def test_containment_is_contains(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choices("abc/", k=rng.randrange(0, 14)))
    texts = [(word() + word(),) for _ in range(250)] + [(None,), ("",), ("a.b%_c" * 3,)] + [("src/main/" + word(),) for _ in range(100)]
    parts = [(word(),) for _ in range(120)] + [(None,), ("",), (".b%_",), ("src/main/",), ("éé",)]
    t, p = spark.createDataFrame(texts, "file_path string"), spark.createDataFrame(parts, "path string")
    found = J.containing(t, "file_path", p, "path")
    got = sorted(map(tuple, found.select("file_path", "path").collect()))
    assert got == sorted({(a, b) for (a,) in texts for (b,) in parts if a is not None and b is not None and b in a})
    some = J.containing(t, "file_path", p.where("path <> ''"), "path")
    assert "NestedLoop" not in plan(some) and "Cartesian" not in plan(some)
    assert J.containing(t.limit(0), "file_path", p, "path").count() == 0 and J.containing(t, "file_path", p.limit(0), "path").count() == 0


def test_chunks_of_files(spark):
    chunks = spark.createDataFrame([("p/a/one.py", 0), ("p/a/one.py", 1), ("old/two.txt", 0), ("p/three.md", 0), (None, 0)], "file_path string, chunk_index int")
    files = spark.createDataFrame([("a/one.py",), ("b/two.py",), ("c/none.py",), (None,), ("a/one.py",)], "path string")
    got = sorted((r["path"], r["file_path"], r["chunk_index"]) for r in N.chunks_of_files(files, chunks).collect())
    assert got == [("a/one.py", "p/a/one.py", 0), ("a/one.py", "p/a/one.py", 1), ("b/two.py", "old/two.txt", 0)]


def test_long_chains_of_duplicates_end(spark):
    files = spark.createDataFrame([(i, i) for i in range(40)], "f int, t int")
    pairs = spark.createDataFrame([(i, i + 1, 1.0) for i in range(39)], "a int, b int, similarity double")
    got = {r["duplicate"]: r["keeper"] for r in N.keepers(pairs, files, "t", "f", 0.9).collect()}
    assert got == {i: i - 1 for i in range(1, 40, 2)}


def test_spans_that_nothing_overlaps(spark):
    rng = random.Random(6)
    span = lambda: (lambda a: (rng.choice(["x", "y", None]), a, a + rng.randrange(-1, 12)))(rng.randrange(150))
    spans = [span() for _ in range(150)] + [("x", None, 4), ("z", 1, 2), ("y", 5, 5), ("y", 5, 5)]
    others = [span() for _ in range(25)] + [("x", 3, None), ("y", 0, 4)]
    a = spark.createDataFrame(spans, "f string, b int, e int").withColumn("_to", F.lit("kept"))
    found = J.not_overlapping(a, spark.createDataFrame(others, "f string, b int, e int"), "f", "b", "e")
    full = lambda r: None not in r and r[1] <= r[2]
    hit = lambda s: full(s) and any(full(o) and o[0] == s[0] and o[1] <= s[2] and o[2] >= s[1] for o in others)
    assert sorted(map(str, (tuple(r)[:3] for r in found.collect()))) == sorted(str(s) for s in spans if not hit(s)) and found.columns == a.columns
    assert "Join" not in plan(found)


def folded(rows, delay):
    out, last = [], {}
    for k, t, n in sorted(rows, key=lambda r: (str(r[0]), r[1], r[2])):
        if k not in last or t - last[k] >= delay:
            out.append(n)
            last[k] = t
    return sorted(out)


@pytest.mark.parametrize("delay", [0.5, 3.0, 40.0])
def test_debouncing_of_a_hot_key_over_many_tasks(spark, delay):
    rng = random.Random(9)
    rows = [("hot", rng.randrange(3000) / 4, i) for i in range(3000)] + [(rng.choice(["a", "b", None]), rng.randrange(3000) / 4, 3000 + i) for i in range(300)]
    began = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([(k, began + dt.timedelta(seconds=t), n) for k, t, n in rows] + [("hot", None, 9999)], "k string, ts timestamp, n int").withColumn("_t", F.lit(1)).withColumn("_part", F.lit(2))
    got = Z.debounce(df, "k", "ts", "n", delay, stretch=150)
    assert sorted(r["n"] for r in got.collect()) == folded(rows, delay) and got.columns == df.columns


def test_passages_are_the_fold():
    rng = random.Random(4)
    for _ in range(200):
        times = np.sort(np.array([rng.randrange(60) for _ in range(rng.randrange(1, 25))]))
        delay = rng.randrange(0, 20)
        until, leaves = Z.passages(times, delay)
        for since in range(-5, int(times[0]) + delay + 1):
            now = since
            for t in times:
                now = int(t) + delay if t >= now else now
            i = int(np.searchsorted(until, since))
            assert (int(leaves[i]) if i < len(until) else since) == now
