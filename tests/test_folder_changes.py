import random
import shutil

import pytest
from pyspark.sql import functions as F

from lodegrain.operators import index as kept_index
from lodegrain.operators.run_log import ProgressLog, RunLog, counted
from lodegrain.sources import folder_changes as C
from lodegrain.streaming import events as Z


def collected(spark, root, state, check, shares=3, fail=False):
    """The events of one trigger."""
    got = []

    def take(batch, _):
        got.extend((r["file_path"], r["event"]) for r in batch.collect())
        if fail:
            raise RuntimeError("died after reading")

    run = C.folder_changes(spark, str(root), str(state), shares).writeStream.foreachBatch(take).option("checkpointLocation", str(check)).trigger(availableNow=True).start()
    if fail:
        with pytest.raises(Exception, match="died after reading"):
            run.awaitTermination()
    else:
        run.awaitTermination()
    return sorted(got)


def test_each_change_arrives_once_and_again_only_if_its_batch_failed(spark, tmp_path):
    root, state, check = tmp_path / "src", tmp_path / "src" / "state", tmp_path / "check"
    for name in ("a.py", "x/b.py", "x/y/c.py", "x/y/z/d.py", "x-1/e f.py", "build/skipped.py", "x/[i].md"):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(name)
    (root / "loop").symlink_to(root / "x")
    every = ["a.py", "x-1/e f.py", "x/[i].md", "x/b.py", "x/y/c.py", "x/y/z/d.py"]
    assert collected(spark, root, state, check) == [(n, "created") for n in every]
    assert collected(spark, root, state, check) == []
    (root / "x/b.py").write_text("longer than before")
    (root / "x/new.py").write_text("n")
    (root / "a.py").unlink()
    shutil.rmtree(root / "x/y")
    want = [("a.py", "deleted"), ("x/b.py", "modified"), ("x/new.py", "created"), ("x/y/c.py", "deleted"), ("x/y/z/d.py", "deleted")]
    assert collected(spark, root, state, check, fail=True) == want
    (root / "x/later.py").write_text("after the listing of the batch that failed")
    assert collected(spark, root, state, check) == want, "the failed batch as it was, not as the folder is now"
    assert collected(spark, root, state, check) == [("x/later.py", "created")]
    assert collected(spark, root, state, check) == []
    (root / "x/later.py").unlink()
    (root / "x/later.py").mkdir()
    (root / "x/later.py/in.py").write_text("a folder where a file was")
    assert collected(spark, root, state, check) == [("x/later.py", "deleted"), ("x/later.py/in.py", "created")]
    assert all(len(n) <= 2 for n in C.Listings(str(state)).numbers().values()), "old listings go"


def test_differences_are_those_of_sets():
    rng = random.Random(5)
    for _ in range(200):
        made = lambda: {"/".join(rng.choices(["a", "a-", "a.b", "b", "é"], k=rng.randrange(1, 4))): (rng.randrange(2), rng.randrange(2)) for _ in range(rng.randrange(12))}
        before, now = made(), made()
        ordered = lambda d: sorted(((p, *v) for p, v in d.items()), key=lambda e: e[0].split("/"))
        got = {(p, e) for p, e, *_ in C.differences(ordered(before), ordered(now))}
        assert got == {(p, "deleted") for p in before.keys() - now.keys()} | {(p, "created") for p in now.keys() - before.keys()} | {(p, "modified") for p in before.keys() & now.keys() if before[p] != now[p]}


def test_shares_are_all_files_once(tmp_path):
    for i in range(40):
        at = tmp_path / f"d{i % 5}" / f"s{i % 3}" / f"f{i}.py"
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_text("x" * i)
    (tmp_path / "top.md").write_text("t")
    shares = [list(C.walk(str(tmp_path), s, 4)) for s in range(4)]
    found = [e[0] for share in shares for e in share]
    assert len(found) == len(set(found)) == 41 and sum(bool(s) for s in shares) > 1
    assert all(s == sorted(s, key=lambda e: e[0].split("/")) for s in shares)
    with pytest.raises(FileNotFoundError):
        list(C.walk(str(tmp_path / "none"), 0, 1))
    assert C.mounted("file:///a/b") == "/a/b" and C.mounted("/a/b") == "/a/b" and C.mounted("hdfs://h/a") is None and C.mounted("s3a://b/a") is None


def test_watching_reads_what_changed_and_logs_its_counts(spark, tmp_path):
    src, index = tmp_path / "src", str(tmp_path / "index")
    src.mkdir()
    body = "def {0}():\n    return '" + "x" * 150 + "'\n"
    for i in range(4):
        (src / f"m{i}.py").write_text(body.format(f"first{i}"))
    (src / "no_watch.bin").write_text("b")
    watch = lambda: Z.watch(spark, str(src), index, str(tmp_path / "check"), once=True).awaitTermination()
    watch()
    (src / "m0.py").write_text(body.format("changed"))
    watch()  # a change alone, without a new file
    (src / "m1.py").unlink()
    watch()
    watch()
    snapshot = kept_index.open_index(spark, index).snapshot()
    assert {r["file_path"]: r["content"].split(": ")[-1] for r in snapshot.rows().where("chunk_index = 0").collect()} == {"m0.py": "changed", "m2.py": "first2", "m3.py": "first3"}
    runs = [r.asDict() for r in kept_index.indexing_runs(spark, index).orderBy("at").collect()]
    assert [(r["files"], r["new"], r["changed"], r["removed"], r["indexed"], r["failed"]) for r in runs] == [(4, 4, 0, 0, 4, 0), (1, 0, 1, 0, 1, 0), (1, 0, 0, 1, 0, 0)], "other files are neither read nor compared"
    first = kept_index.open_index(spark, index).snapshot(1)
    assert runs[0]["chunks"] == first.rows().count() and runs[0]["seconds"] > 0


def test_counts_of_one_pass_and_of_a_stream(spark, tmp_path):
    seen, df = counted(spark.range(100), n=F.count("*"), even=F.count_if(F.col("id") % 2 == 0))
    df.write.parquet(str(tmp_path / "t"))
    assert seen.get == {"n": 100, "even": 50}
    none, df = counted(spark.range(100).where("id < 0"), n=F.count("*"))
    df.write.parquet(str(tmp_path / "none"))
    assert none.get == {"n": 0}
    log = RunLog(spark, str(tmp_path / "log"))
    assert log.read().isEmpty()
    listener = ProgressLog(log)
    spark.streams.addListener(listener)
    try:
        stream = spark.readStream.schema("id long").parquet(str(tmp_path / "t")).observe("seen", F.max("id").alias("most"))
        run = stream.writeStream.format("noop").queryName("counted").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        run.awaitTermination()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    finally:
        spark.streams.removeListener(listener)
    rows = log.read("stream-batch").collect()
    assert [(r["counts"]["query"], r["counts"]["rows"], r["counts"]["seen.most"]) for r in rows if r["counts"]["rows"] != "0"] == [("counted", "100", "99")]
    assert {r["kind"] for r in log.read().collect()} >= {"stream-start", "stream-batch"}
