import datetime as dt
import threading

import pytest
from pyspark.sql import functions as F

from lodegrain.interface import cli, limits, models, server, settings
from lodegrain.interface.research import Research, TimeBudget
from lodegrain.operators import index as kept_index
from lodegrain.plans.search import Searcher
from lodegrain.sources import site_apis
from lodegrain.streaming import events as Z


def seconds(s):
    return dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)


def test_debounce_of_a_table_and_a_stream(spark, tmp_path):
    times = [("a", 0.0), ("a", 0.5), ("a", 0.9), ("a", 1.4), ("a", 5.0), ("b", 0.2)]
    df = spark.createDataFrame([(k, seconds(s), i) for i, (k, s) in enumerate(times)], "path string, ts timestamp, n int")
    assert sorted(r["n"] for r in Z.debounce(df, "path", "ts", "n", 1.0).collect()) == [0, 3, 4, 5]
    src = str(tmp_path / "in")
    df.write.parquet(src)
    stream = spark.readStream.schema(df.schema).parquet(src)
    run = Z.debounce_stream(stream, "path", "ts", 1.0).writeStream.format("memory").queryName("accepted").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    run.awaitTermination()
    assert spark.table("accepted").count() == 4


def test_file_events(spark):
    kind = "file_path string, size long, mtime int, hash string"
    before = spark.createDataFrame([("a", 1, 1, "x"), ("b", 1, 1, "y"), ("d", 1, 1, "z")], kind)
    now = spark.createDataFrame([("a", 1, 1, "x"), ("b", 1, 2, "y"), ("c", 1, 1, "w")], kind)
    assert {(r["file_path"], r["event"]) for r in Z.file_events(before, now).collect()} == {("b", "modified"), ("c", "created"), ("d", "deleted")}


def test_watching_a_folder(spark, tmp_path):
    src, index = tmp_path / "src", str(tmp_path / "index")
    src.mkdir()
    (src / "a.py").write_text("def f():\n    return 1\n")
    for _ in range(2):
        Z.watch(spark, str(src), index, str(tmp_path / "check"), once=True).awaitTermination()
        (src / "b.py").write_text("def g():\n    return 2\n")
    assert {r["file_path"] for r in kept_index.open_index(spark, index).snapshot().rows().select("file_path").distinct().collect()} == {"a.py", "b.py"}


def test_token_bucket_and_retries():
    now = [0.0]
    bucket = limits.TokenBucket(60, 2, clock=lambda: now[0], sleep=lambda s: now.__setitem__(0, now[0] + s))
    assert [bucket.acquire() for _ in range(4)] == [True] * 4 and abs(now[0] - 2) < 1e-6
    waits, calls = [], []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise ConnectionResetError
        return "ok"

    assert limits.Retry(3, 1.0).call(flaky, sleep=waits.append) == "ok" and waits == [1.0, 2.0]
    with pytest.raises(ValueError):
        limits.Retry().call(lambda: int("x"), sleep=waits.append)


def test_server_frames():
    s = server.SearchServer(("127.0.0.1", 0), lambda q, k: [{"q": q}] * k)
    t = threading.Thread(target=s.serve_forever, daemon=True)
    t.start()
    to = s.server_address
    assert server.ask(to, {"query": "x", "top_k": 2})["count"] == 2 and server.ask(to, {"command": "status"})["query_count"] == 1
    assert not server.ask(to, {"top_k": 2})["success"] and server.ask(to, {"command": "shutdown"})["success"]
    t.join(10)
    assert not t.is_alive()
    s.server_close()


def test_settings(tmp_path):
    (tmp_path / "a").write_text("K=1\n# c\nexport B='two'\n")
    (tmp_path / "b").write_text("K=9\nC=3\n")
    assert settings.read_env([tmp_path / "a", tmp_path / "b", tmp_path / "none"]) == {"K": "1", "B": "two", "C": "3"}
    (tmp_path / settings.INDEX_DIR).mkdir()
    (tmp_path / "x/y").mkdir(parents=True)
    assert settings.nearby_index(tmp_path / "x/y") == (tmp_path / settings.INDEX_DIR).resolve()
    have = ["qwen3:1.7b", "qwen3:4b", "nomic-embed"]
    assert settings.resolve_model("qwen3", have) == "qwen3:1.7b" and settings.resolve_model("qwen3:4b", have) == "qwen3:4b" and settings.resolve_model("zzz", have) is None


def test_hashed_vectors_and_expansion(spark):
    df = spark.createDataFrame([("load the config",), ("",), (None,)], "t string").select(models.hashed_vector(F.col("t")).alias("v")).collect()
    assert abs(sum(x * x for x in df[0]["v"]) - 1) < 1e-5 and df[1]["v"] is None and df[2]["v"] is None
    queries = spark.createDataFrame([(1, "load config"), (2, "x"), (3, None)], "query_id int, query string")
    got = {r["query_id"]: r["expanded"] for r in models.expand_queries(queries, lambda p, t: '"load config file settings"').collect()}
    assert got == {1: "load config file settings", 2: "x", 3: None}


def test_research_rounds(spark, tmp_path):
    answers = iter(["1. first\n2. second", "COVERED: a\nGAPS: b\nCONFIDENCE: LOW\nQUERIES: third query", "COVERED: a\nGAPS:\nCONFIDENCE: HIGH", "Summary."])
    text = "words about the topic at hand that are many " * 60
    found = {"first": ["u1", "u2"], "second": ["u1"], "third query": ["u2", "u3"]}
    run = Research(
        spark, str(tmp_path), "topic", lambda p, t: next(answers), lambda qs: spark.createDataFrame([(u,) for q in qs for u in found[q]], "url string"),
        lambda urls: urls.select("url", F.concat(F.lit("T "), "url").alias("title"), F.concat(F.lit(text), F.md5("url"), F.md5(F.reverse("url"))).alias("content")),
    )
    log = run.run().orderBy("round").collect()
    assert [(r["round"], r["pages"], r["stop"]) for r in log] == [(1, 2, ""), (2, 1, ""), (3, 0, "covered")]
    assert {r["url"] for r in run.pages().collect()} == {"u1", "u2", "u3"} and run.report().startswith("# topic\n\nSummary.")


def test_time_budget():
    now = [0.0]
    b = TimeBudget(30, 5, clock=lambda: now[0])
    assert not b.time_to_stop() and b.next_round() == 10.0
    now[0] = 16 * 60
    assert b.time_to_stop()
    b.rounds += [2.0, 2.0, 2.0]
    assert b.next_round() == 3.0 and not b.time_to_stop()


def fake_fetcher():
    """A class of its own in each call, so that it travels to the workers by value."""

    class FakeFetcher:
        """Pages by url; anything else fails."""

        def fetch(self, url):
            body = "<html><title>T</title><body><article>" + "<p>words of a page that is long enough</p>" * 10 + "</article></body></html>"
            known = {
                "https://a.example/x": (200, "text/html", body), "https://a.example/thin": (200, "text/html", "<article><p>few words, but surely well over fifty characters of them here</p></article>"), "https://a.example/private/y": (200, "text/html", body),
                "https://a.example/robots.txt": (200, "text/plain", "User-agent: *\nDisallow: /private/\n"), "https://dev.to/api/articles/u/s": (200, "application/json", '{"title": "D", "body_markdown": "' + "word " * 60 + '"}'),
            }
            if url not in known:
                raise OSError("no such page")
            status, kind, text = known[url]
            return status, kind, text.encode()

    return FakeFetcher


def test_scraping_is_one_plan(spark, tmp_path):
    urls = ["https://a.example/x", "https://a.example/x", "https://a.example/thin", "https://a.example/private/y", "https://a.example/gone", "https://dev.to/u/s", "https://dev.to/t/python"]
    got = {r["url"]: r["outcome"] for r in cli.scraped(spark, urls, str(tmp_path / "out"), fake_fetcher()).collect()}
    assert got == {"https://a.example/x": "ok", "https://a.example/thin": "thin", "https://a.example/private/y": "robots", "https://a.example/gone": "missing", "https://dev.to/u/s": "ok", "https://dev.to/t/python": "missing"}
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["d.md", "t.md"]
    (tmp_path / cli.BLOCKED).write_text("# never asked\nwww.A.example\n")
    outcomes = cli.read_pages(spark, spark.createDataFrame([(urls[0],)], "url string"), str(tmp_path), fake_fetcher())[1]
    assert [(r["url"], r["outcome"]) for r in outcomes.collect()] == [(urls[0], "blacklisted")]


def test_answers_of_sites_that_cannot_be_read_give_no_page(spark):
    rows = [("https://x.fandom.com/wiki/A", "fandom", '{"error": {"code": "missing"}}', None), ("https://dev.to/a/b", "devto", "no json", None), ("https://dev.to/a/c", "devto", '{"title": "", "body_markdown": "x"}', None), ("https://reddit.com/r/x", "reddit", "[]", None), ("https://stackoverflow.com/questions/1", "stackexchange", '{"items": []}', "{"), ("https://en.wikipedia.org/wiki/A_b", "wikipedia", '{"extract": "some text"}', "<section><p>too short</p></section>"), ("https://doi.org/1", "semantic_scholar", None, None), (None, None, None, None)]
    got = {r["url"]: (r["title"], r["content"]) for r in site_apis.api_pages(spark.createDataFrame(rows, "url string, service string, body string, extra string")).collect()}
    assert got == {"https://en.wikipedia.org/wiki/A_b": ("A b", "some text")}
    asks = spark.createDataFrame([("https://youtu.be/x", "youtube"), ("https://dev.to/t/python", "devto"), ("https://stackoverflow.com/questions/7/a", "stackexchange"), ("https://x.fandom.com/wiki/A/B c", "fandom")], "url string, service string").select("url", site_apis.api_requests(F.col("url"), F.col("service")).alias("a")).collect()
    asks = {r["url"]: r["a"] for r in asks}
    assert asks["https://dev.to/t/python"] is None and asks["https://youtu.be/x"][1] == "https://www.youtube.com/watch?v=x"
    assert asks["https://stackoverflow.com/questions/7/a"][1] == "https://api.stackexchange.com/2.3/questions/7/answers?order=desc&sort=votes&site=stackoverflow&filter=withbody"


def test_models_in_a_chain_and_remembered():
    sent = []
    chat = models.ChatModel("http://h/", "m", send=lambda u, b: sent.append((u, b)) or '{"choices": [{"message": {"content": "yes"}}]}')
    broken = models.ChatModel("http://h", "m", send=lambda u, b: "no json")
    kept = models.RememberedModel(models.first_working([broken, chat]), most=4)
    assert kept("p", 0.1) == kept("p", 0.1) == "yes" and len(sent) == 1 and sent[0][0] == "http://h/v1/chat/completions" and broken("p", 0) is None
    for i in range(6):
        kept(f"q{i}", 0)
    assert len(kept.known) <= 4 and ("q5", 0) in kept.known


def test_a_kept_keyword_index_answers_as_a_new_one(spark, tmp_path):
    (tmp_path / "src").mkdir()
    for i in range(6):
        (tmp_path / "src" / f"m{i}.py").write_text(f"import os\n\n\ndef load_config_{i}(path):\n    \"\"\"Load the configuration number {i} from a path.\"\"\"\n    return open(path).read() + '{'x' * 200}'\n")
    (tmp_path / "env").mkdir()
    (tmp_path / "env" / "skip.py").write_text("x = 1\n" * 50)
    began = {r["status"]: r["count"] for r in cli.build(spark, str(tmp_path)).groupBy("status").count().collect()}
    assert began == {"new": 6} and (tmp_path / settings.INDEX_DIR / "_versions").is_dir()
    queries = spark.createDataFrame([(1, "load_config_3 path"), (2, "configuration number 5")], "query_id int, query string")
    kept = cli.opened(spark, str(tmp_path))
    fresh = Searcher.build(kept.chunks, models.hashed_vector)
    rows = [sorted((r["query_id"], r["file_path"], r["chunk_index"], r["score"]) for r in s.keywords.bm25(queries, 5).collect()) for s in (kept, fresh)]
    assert rows[0] == rows[1] and rows[0]
    stats = kept_index.indexing_stats(spark.createDataFrame([("src/m0.py", "new"), ("src/none.py", "new"), ("src/m1.py", "unchanged")], "file_path string, status string"), kept.chunks, 2.0).first()
    assert (stats["files"], stats["indexed"], stats["failed"], stats["files_per_second"]) == (3, 1, 1, 0.5) and kept_index.index_size(spark, str(tmp_path / settings.INDEX_DIR)) > 1000


def test_entry_without_the_llm_subpackage(tmp_path):
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    repo = Path(__file__).resolve().parent.parent
    shutil.copytree(repo / "lodegrain", tmp_path / "lodegrain", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(repo / "__spark_entry__.py", tmp_path)
    done = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; q = e.queries(); assert q and set(e.oracle_sql()) <= set(q); assert not any(n.startswith('op') for n in q)"], cwd=tmp_path, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})
    assert done.returncode == 0, done.stderr
