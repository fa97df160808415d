"""The kept index: versions, segments, tombstones, merging and block-max retrieval."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodegrain.interface import cli, models
from lodegrain.interface.settings import INDEX_DIR
from lodegrain.operators import retrieval as R
from lodegrain.operators import segments as G
from lodegrain.operators.index import open_index
from lodegrain.operators.snapshots import Conflict, SnapshotLog
from lodegrain.plans.search import Searcher
from lodegrain.sources.files import project_files
from lodegrain.streaming import events as Z

WORDS = [f"word{i}" for i in range(60)] + ["the"] * 40
SHAPE = "file_path string, chunk_index int, content string"


def texts(rng, names, n=25):
    return [(f, i, " ".join(rng.choices(WORDS, k=rng.randrange(1, n)))) for f in names for i in range(rng.randrange(1, 4))]


def index_at(spark, path):
    return G.SegmentedIndex(spark, str(path), text=F.col("content"))


def owners(df):
    return df.select("file_path").distinct()


def best(index, queries, k):
    return sorted((r["query_id"], r["rank"], r["file_path"], r["chunk_index"], r["score"]) for r in index.bm25(queries, k).collect())


def same_as_fresh(spark, snapshot, rows, queries, k=10):
    frame = spark.createDataFrame(rows, SHAPE)
    assert sorted(map(tuple, snapshot.rows().select("file_path", "chunk_index", "content").collect())) == sorted(rows)
    fresh = R.build_keyword_index(frame, ["file_path", "chunk_index"], F.col("content"))
    assert best(snapshot, queries, k) == best(fresh, queries, k)


def test_changes_give_what_a_fresh_index_gives(spark, tmp_path, monkeypatch):
    """Files come, change and go; segments pile up and are merged; blocks and parts are small."""
    monkeypatch.setattr(G, "BLOCK", 4)
    monkeypatch.setattr(G, "PART", 60)
    monkeypatch.setattr(G, "FIRST_TIER", 30)
    monkeypatch.setattr(G, "FAN", 3)
    rng = random.Random(3)
    index, held = index_at(spark, tmp_path / "i"), {}
    queries = spark.createDataFrame([(1, "word1 word2 the"), (2, "the"), (3, "word7 word7 word9"), (4, "nothing"), (5, "word3 word4 word5 word6 word8")], "query_id int, query string")
    most = 0
    for step in range(4):
        names = [f"f{i}" for i in range(40)] if step == 0 else rng.sample([f"f{i}" for i in range(60)], 8)
        gone = rng.sample(sorted(held), 3) if step else []
        rows = texts(rng, [n for n in names if n not in gone])
        frame = spark.createDataFrame(rows, SHAPE)
        snapshot = index.update(frame, owners(frame), spark.createDataFrame([(g,) for g in gone], "file_path string"))
        for n in gone:
            held.pop(n, None)
        for n in {r[0] for r in rows}:
            held[n] = [r for r in rows if r[0] == n]
        most = max(most, len(snapshot.content["segments"]))
        if step in (1, 3):
            same_as_fresh(spark, snapshot, [r for rows in held.values() for r in rows], queries)
        assert {r["file_path"] for r in snapshot.owners().collect()} == set(held)
    assert most <= 3 and any(len(index.log.read(v)["segments"]) < len(index.log.read(v - 1)["segments"]) for v in index.log.versions()[1:])
    within = spark.createDataFrame([(f, 0) for f in list(held)[:5]], "file_path string, chunk_index int")
    got = snapshot.bm25(queries, 100, within=within).collect()
    full = {(r["query_id"], r["file_path"], r["chunk_index"]): r["score"] for r in snapshot.bm25(queries, 1000).collect()}
    assert {(r["query_id"], r["file_path"], r["chunk_index"]): r["score"] for r in got} == {k: v for k, v in full.items() if k[1] in list(held)[:5] and k[2] == 0}


def test_blocks_that_cannot_matter_are_not_read(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(G, "BLOCK", 16)
    rng = random.Random(4)
    rows = [(f"f{i}", 0, " ".join(rng.choices(WORDS, k=rng.randrange(5, 60)) + (["needle"] * rng.randrange(1, 9) if i % 300 == 0 else []))) for i in range(3000)]
    frame = spark.createDataFrame(rows, SHAPE)
    snapshot = index_at(spark, tmp_path / "i").update(frame, owners(frame))
    queries = spark.createDataFrame([(1, "needle needle the word1"), (2, "word5")], "query_id int, query string")
    seen = snapshot.search(queries, 5)[1].groupBy("query_id").agg(F.count("*").alias("all"), F.count_if("read").alias("read"))
    got = {r["query_id"]: (r["all"], r["read"]) for r in seen.collect()}
    assert all(r < n / 2 for n, r in got.values()), got
    fresh = R.build_keyword_index(frame, ["file_path", "chunk_index"], F.col("content"))
    assert best(snapshot, queries, 5) == best(fresh, queries, 5)


def test_empty_and_odd_rows(spark, tmp_path):
    index = index_at(spark, tmp_path / "i")
    queries = spark.createDataFrame([(1, "a"), (2, None), (3, "")], "query_id int, query string")
    none = spark.createDataFrame([], SHAPE)
    assert index.snapshot() is None
    assert index.update(none, owners(none)).bm25(queries, 3).isEmpty()
    rows = [("f", 0, None), ("f", 1, ""), ("g", 0, "a " * 20_000), (None, 0, "a")]
    frame = spark.createDataFrame(rows, SHAPE)
    now = index.update(frame, owners(frame))
    assert now.rows().count() == 4 and now.count == 4
    now = index.update(none, spark.createDataFrame([("f",)], "file_path string"))  # a file that has no rows any more
    assert {r["file_path"] for r in now.rows().collect()} == {"g", None} and {r["file_path"] for r in now.owners().collect()} >= {"f", "g"}


class Died(Exception):
    pass


@pytest.mark.parametrize("fatal", range(8))
def test_a_writer_that_dies_leaves_the_old_index(spark, tmp_path, monkeypatch, fatal):
    """Whatever write was the last one: before the rename the old version is read, after it the new one."""
    rows = [("f", 0, "alpha beta"), ("g", 0, "beta gamma")]
    index, frame = index_at(spark, tmp_path / "i"), spark.createDataFrame([("f", 0, "alpha beta"), ("g", 0, "beta gamma")], SHAPE)
    index.update(frame, owners(frame))
    queries, change = spark.createDataFrame([(1, "beta delta")], "query_id int, query string"), spark.createDataFrame([("g", 0, "delta")], SHAPE)
    left = [fatal]
    writer = type(frame.write)

    def dying(real):
        def run(*a, **b):
            if left[0] == 0:
                raise Died
            left[0] -= 1
            return real(*a, **b)

        return run

    with monkeypatch.context() as m:
        m.setattr(writer, "parquet", dying(writer.parquet))
        m.setattr(SnapshotLog, "commit", dying(SnapshotLog.commit))
        try:
            index.update(change, owners(change))
            done = True
        except Died:
            done = False
    now = index_at(spark, tmp_path / "i").snapshot()
    assert now.version == (2 if done else 1)
    rows = [("f", 0, "alpha beta"), ("g", 0, "delta")] if done else rows
    assert sorted(map(tuple, now.rows().collect())) == sorted(rows)
    if fatal in (3, 6):
        again = index.update(change, owners(change))  # the next writer is not held up
        same_as_fresh(spark, again, [("f", 0, "alpha beta"), ("g", 0, "delta")], queries)
        assert index.log.vacuum(keep=1) and index.log.versions() == [again.version]
        same_as_fresh(spark, index.snapshot(), [("f", 0, "alpha beta"), ("g", 0, "delta")], queries)


def test_a_reader_sees_one_version_and_one_writer_wins(spark, tmp_path):
    index = index_at(spark, tmp_path / "i")
    one, two = (spark.createDataFrame([("f", 0, t)], SHAPE) for t in ("old", "new"))
    reader = index.update(one, owners(one))
    plan = reader.rows()  # made before, run after
    index.update(two, owners(two))
    assert [r["content"] for r in plan.collect()] == ["old"] and [r["content"] for r in index.snapshot(1).rows().collect()] == ["old"]
    assert [r["content"] for r in index.snapshot().rows().collect()] == ["new"]
    with pytest.raises(Conflict):
        index.log.commit({"segments": []}, 1)
    assert index.log.versions() == [1, 2] and index.snapshot().version == 2


def test_watch_and_update_search_alike(spark, tmp_path):
    src, index = tmp_path / "src", str(tmp_path / "src" / INDEX_DIR)
    src.mkdir()
    body = "def {0}_reader(path):\n    \"\"\"{0} {1}\"\"\"\n    return open(path).read() + '" + "x" * 150 + "'\n"
    for i in range(3):
        (src / f"m{i}.py").write_text(body.format(f"first{i}", "apples"))
    cli.build(spark, str(src))
    watch = lambda: Z.watch(spark, str(src), index, str(tmp_path / "check"), once=True).awaitTermination()
    watch()
    (src / "m0.py").write_text(body.format("changed", "quinces"))
    (src / "m3.py").write_text(body.format("added", "quinces"))
    (src / "m1.py").unlink()
    watch()
    queries = spark.createDataFrame([(1, "quinces"), (2, "apples reader"), (3, "first1")], "query_id int, query string")
    fresh = Searcher.build(spark.createDataFrame(open_index(spark, index).snapshot().rows().collect(), open_index(spark, index).snapshot().rows().schema), models.hashed_vector)
    assert {r["file_path"] for r in fresh.chunks.collect()} == {"m0.py", "m2.py", "m3.py"}
    kept = cli.opened(spark, str(src))
    assert best(kept.keywords, queries, 5) == best(fresh.keywords, queries, 5) and {r[2] for r in best(kept.keywords, queries, 5) if r[0] == 1} == {"m0.py", "m3.py"}
    assert {r["status"] for r in cli.build(spark, str(src)).collect()} == {"unchanged"}
    (src / "m2.py").write_text(body.format("again", "medlars"))
    assert {r["file_path"]: r["status"] for r in cli.build(spark, str(src)).collect() if r["status"] != "unchanged"} == {"m2.py": "changed"}
    kept = cli.opened(spark, str(src))
    one = spark.createDataFrame([(1, "medlars")], "query_id int, query string")
    assert [r["file_path"] for r in kept.search(one, 3).orderBy("rank").limit(1).collect()] == ["m2.py"]
    assert project_files(spark, str(src)).count() == 3


def test_postings_are_counted_and_packed_in_one_pass():
    """Blocks cross batches of any size, and their bounds are those of their postings."""
    rows = [(i, [f"t{(i * j) % 9}" for j in range(i % 23)]) for i in range(300)]
    batch = pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows]), pa.array([len(t) for _, t in rows], pa.int32()), pa.array([t for _, t in rows], pa.list_(pa.string()))], names=["_doc", "_dl", "_tokens"])
    got = sorted((r["term"], r["_doc"], r["_dl"], r["tf"]) for b in G._tally([batch.slice(0, 100), batch.slice(100)]) for r in b.to_pylist())
    assert got == sorted((w, i, len(t), t.count(w)) for i, t in rows for w in set(t))
    want = sorted((w, d % 2, tf % 3, d, dl, tf) for w, d, dl, tf in got)
    kinds = [pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32()]
    full = pa.RecordBatch.from_arrays([pa.array([r[k] for r in want], t) for k, t in enumerate(kinds)], names=["term", "part", "layer", "_doc", "_dl", "tf"])
    for step in (1, 7, 64, 10_000):
        blocks = [r for b in G._pack([full.slice(o, step) for o in range(0, len(full), step)], 16) for r in b.to_pylist()]
        assert [(r["term"], r["part"], r["layer"], d, dl, tf) for r in blocks for d, tf, dl in zip(r["docs"], r["tfs"], r["dls"], strict=True)] == want
        assert all((r["n"], r["max_tf"], r["min_dl"], r["low"], r["high"]) == (len(r["docs"]), max(r["tfs"]), min(r["dls"]), min(r["docs"]), max(r["docs"])) for r in blocks)
        assert len({(r["term"], r["part"], r["layer"], r["block"]) for r in blocks}) == len(blocks) and max(r["n"] for r in blocks) == 16
