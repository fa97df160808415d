import datetime as dt
import json
import random
import re

from pyspark.sql import functions as F

from lodegrain.operators import analytics as A
from lodegrain.operators import corpus as N
from lodegrain.operators import crawl as S
from lodegrain.operators import index as I
from lodegrain.sources import files as fs
from lodegrain.sources import search_engines as E
from lodegrain.sources import sessions, web

LOG = "ts timestamp, domain string, success boolean, word_count int, extractor string, error string"


def at(i):
    return dt.datetime(2024, 1, 1) + dt.timedelta(minutes=i)


def test_domain_stats_and_auto_blacklist(spark):
    rows = [(at(0), "www.a.com", True, 100, "html", None), (at(1), "a.com", True, 51, "pdf", None), (at(2), "a.com", False, 0, "html", "timeout")]
    rows += [(at(10 + i), "b.com", False, 0, None, f"e{i}") for i in range(10)] + [(at(30 + i), "c.com", False, 0, None, "Blocked by robots.txt") for i in range(2)] + [(at(40), "d.com", False, 0, None, "x")]
    stats = A.domain_stats(spark.createDataFrame(rows, LOG))
    got = {r["domain"]: r for r in stats.collect()}
    assert (got["a.com"]["total"], got["a.com"]["success"], got["a.com"]["fail"], got["a.com"]["avg_words"], got["a.com"]["extractors"]) == (3, 2, 1, 75, ["html", "pdf"])
    assert got["b.com"]["errors"] == [f"e{i}" for i in range(5, 10)] and got["b.com"]["avg_words"] == 0
    none = spark.createDataFrame([], "domain string")
    assert {r["domain"] for r in A.auto_blacklist(stats, none, none).collect()} == {"b.com", "c.com"}
    assert A.auto_blacklist(stats, spark.createDataFrame([("b.com",)], "domain string"), spark.createDataFrame([("c.com",)], "domain string")).isEmpty()
    lists = sessions.update_domain_lists(spark.createDataFrame([("c.com", "whitelist", "", "", False)], sessions.LIST_SCHEMA), A.auto_blacklist(stats, none, none), "2024-01-02")
    assert {(r["domain"], r["kind"]) for r in lists.collect()} == {("c.com", "whitelist"), ("b.com", "blacklist")}


def test_rounds_stall_and_growth(spark):
    df = spark.createDataFrame([(1, i, t, 10.0 * i) for i, t in enumerate((900, 400, 300, 700), 1)], "s int, n int, tokens int, sec double")
    got = A.round_metrics(df, "s", "n", "tokens", "sec").orderBy("n").collect()
    assert [r["stalled"] for r in got] == [False, False, True, False] and [r["corpus_tokens"] for r in got] == [900, 1300, 1600, 2300] and got[3]["next_round_estimate"] == 45.0


def test_first_occurrences_and_context(spark):
    df = spark.createDataFrame([(3, "a"), (1, "b"), (2, "a")], "n int, v string")
    assert sorted((r["n"], r["v"]) for r in A.first_occurrences(df, "v", "n").collect()) == [(1, "b"), (2, "a")]
    turns = spark.createDataFrame([(1, i, f"t{i}") for i in range(6)], "c int, n int, t string")
    assert A.recent_context(turns, "c", "n", "t").where("n = 5").first()["context"] == "t2\nt3\nt4"


def fold(pairs, order):
    gone, out = set(), {}
    for i in order:
        for j in order[order.index(i) + 1 :]:
            if i not in gone and j not in gone and frozenset((i, j)) in pairs:
                gone.add(j)
                out[j] = i
    return out


def test_keepers_are_those_of_a_fold(spark):
    rng = random.Random(1)
    for size, n in ((3, 2), (12, 20), (25, 60)):
        pairs = {frozenset(rng.sample(range(size), 2)) for _ in range(n)}
        if size == 3:
            pairs = {frozenset((0, 1)), frozenset((1, 2))}
        times = rng.sample(range(size), size) if size > 3 else [0, 1, 2]
        df = spark.createDataFrame([(*sorted(p), 0.95) for p in pairs], "a int, b int, similarity double")
        files = spark.createDataFrame(list(enumerate(times)), "k int, t int")
        got = {r["duplicate"]: r["keeper"] for r in N.keepers(df, files, "t", "k", 0.9).collect()}
        assert got == fold(pairs, sorted(range(size), key=lambda i: times[i]))


def test_pruning_by_text_with_copies(spark):
    base = "the quick brown fox jumps over the lazy dog and then it goes on for quite a while longer than before"
    rows = [(1, base, 5), (2, base, 1), (3, base + " x", 3), (4, "wholly different words stand in this one", 2), (5, base, 9), (6, None, 1), (7, "", 1), (8, "ab", 1)]
    got = {r["duplicate"]: r["keeper"] for r in N.prune_by_text(spark.createDataFrame(rows, "k int, text string, t int"), "k", "text", "t").collect()}
    assert got == {1: 2, 3: 2, 5: 2}


def test_pruning_reads_whole_texts(spark):
    """Files with the same first 2,000 characters and different rests stay; those that differ early alone are duplicates."""
    rng = random.Random(8)
    prose = lambda letters, n: " ".join("".join(rng.choices(letters, k=6)) for _ in range(n))
    head = prose("abcdefgh", 300)
    rows = [(1, head + prose("ijklmnop", 600), 1), (2, head + prose("qrstuvwx", 600), 2), (3, prose("abcdefgh", 3) + head + prose("yzäöü", 600), 3)]
    rows.append((4, "x" + rows[2][1], 4))
    got = {(r["duplicate"], r["keeper"]) for r in N.prune_by_text(spark.createDataFrame(rows, "k int, text string, t int"), "k", "text", "t").collect()}
    assert len(head) > 2000 and got == {(4, 3)}


def test_trigram_pairs_are_those_of_brute_force(spark):
    rng = random.Random(5)
    words = [rng.choice(["stone", "river", "cloud", "mount"]) for _ in range(40)]
    docs = []
    for i in range(30):
        w = list(words)
        for _ in range(rng.randrange(3)):
            w[rng.randrange(40)] = "".join(rng.choices("abcdefg", k=5))
        docs.append((i, " ".join(w)))
    sets = {}
    for i, t in docs:
        sets.setdefault(frozenset(t[k : k + 3] for k in range(len(t) - 2)), i)
    want = {(min(a, b), max(a, b)) for x, a in sets.items() for y, b in sets.items() if a != b and len(x & y) >= 0.9 * len(x | y)}
    assert {(r["a"], r["b"]) for r in N.trigram_pairs(N.trigram_classes(spark.createDataFrame(docs, "k int, text string"), "k", "text")).collect()} == want


def test_unrelated_texts_with_the_same_trigrams_do_not_meet(spark):
    """Texts of few syllables share most trigrams; only those with an equal part are compared, and no similar pair is lost."""
    rng = random.Random(11)
    syllables = ["".join(rng.choices("abdeiklmnorstu", k=2)) for _ in range(60)]
    docs = [(i, " ".join("".join(rng.choices(syllables, k=3)) for _ in range(rng.choice([2, 3, 5, 20, 60, 120])))) for i in range(250)]
    for i, t in docs[:120]:
        w = t.split(" ")
        w[rng.randrange(len(w))] += rng.choice(["", "x", "zq"])
        docs.append((1000 + i, " ".join(w)))
    sets = {}
    for i, t in docs:
        sets.setdefault(frozenset(t[k : k + 3] for k in range(len(t) - 2)), i)
    want = {(min(a, b), max(a, b)) for x, a in sets.items() for y, b in sets.items() if a != b and 10 * len(x & y) >= 9 * len(x | y)}
    classes = N.trigram_classes(spark.createDataFrame(docs, "k int, text string"), "k", "text").localCheckpoint()
    assert len(want) > 20 and {(r["a"], r["b"]) for r in N.trigram_pairs(classes).collect()} == want
    hashed = classes.where("member = rep").selectExpr("rep", "transform(grams, g -> xxhash64(g)) h").toArrow().combine_chunks().to_batches()
    parts = [(s, r) for b in N._signatures(iter(hashed), 0.9) for s, r in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
    at = {}
    for s, r in parts:
        at.setdefault(s, set()).add(r)
    met = {(a, b) for g in at.values() for a in g for b in g if a < b}
    assert want <= met and len(met) < 0.1 * len(sets) ** 2 / 2


def test_trigram_sets_are_made_by_the_batch_and_meet_by_blocks_as_by_parts(spark):
    """Sets of all sizes, with folded sketches, in blocks of a few; the same pairs by equal parts."""
    rng = random.Random(21)
    docs = []
    for i, size in enumerate([3, 5, 40, 80, 300, 700, 1500, 4000] * 6):
        t = "".join(rng.choices("abcdefghijklmnopqrstuvwxyzé𝄞ß", k=size))
        docs += [(2 * i, t), (2 * i + 1, t[: size - size // 40] + "".join(rng.choices("xyz", k=size // 40)))]
    docs += [(900, None), (901, ""), (902, "ab"), (903, "!!a?b c--")]
    classes = N.trigram_classes(spark.createDataFrame(docs, "k int, text string"), "k", "text").localCheckpoint()
    norm = {i: re.sub(r"[^\w\s]", "", re.sub(r"\s+", " ", (t or "").lower())).strip() for i, t in docs}
    sets = {i: sorted({t[k : k + 3] for k in range(len(t) - 2)}) for i, t in norm.items()}
    assert {r["member"]: r["grams"] for r in classes.collect()} == {i: g for i, g in sets.items() if g}
    reps = {r["rep"] for r in classes.collect()}
    want = {(a, b) for a in reps for b in reps if a < b and 10 * len(set(sets[a]) & set(sets[b])) >= 9 * len(set(sets[a]) | set(sets[b]))}
    assert len(want) > 20 and all({(r["a"], r["b"]) for r in N.trigram_pairs(classes, block=size).collect()} == want for size in (16, 0))
    near = spark.createDataFrame([(a, b) for a in sorted(reps) for b in sorted(reps) if a < b and (a + b) % 3], "a int, b int").localCheckpoint()
    ways = [{(r["a"], r["b"]): r["similarity"] for r in N._similar(near, classes.select("rep", "grams"), 0.6, way).collect()} for way in (True, False)]
    assert ways[0] == ways[1] and {p for p in want if sum(p) % 3} <= set(ways[0])


def test_a_pair_of_trigram_sets_meets_once(spark):
    """The plan has one intersection of the sets, and no union, for the similarity and the filter on it together."""
    sets = [(1, 1, ["abc", "bcd", "cde", "def"]), (2, 2, ["abc", "bcd", "cde", "xyz"]), (3, 3, ["pqr"])]
    found = N.trigram_pairs(spark.createDataFrame(sets, "member int, rep int, grams array<string>"), 0.6)
    assert [tuple(r) for r in found.collect()] == [(1, 2, 0.6)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("array_intersect") == 1 and "array_union" not in plan


def test_pruning_compares_few_of_many_unrelated_files(spark, monkeypatch):
    """What pruning compares in full are the near ones, though all files share most of their trigrams."""
    rng = random.Random(3)
    syllables = ["".join(rng.choices("abdeiklmnorstu", k=2)) for _ in range(40)]
    rows = [(i, " ".join("".join(rng.choices(syllables, k=3)) for _ in range(100)), i) for i in range(150)]
    rows += [(1000 + i, rows[i][1][:-1] + "q", 1000 + i) for i in range(20)]
    staged, keep = {}, N.stage
    monkeypatch.setattr(N, "stage", lambda df, name: staged.setdefault(name, keep(df, name)))
    got = {(r["duplicate"], r["keeper"]) for r in N.prune_by_text(spark.createDataFrame(rows, "k int, text string, t int"), "k", "text", "t").collect()}
    assert got == {(1000 + i, i) for i in range(20)} and staged["trigram-near"].count() == 20


def test_pruning_in_batches_is_a_fold(spark, monkeypatch):
    """Of many files that resemble each other few pairs are compared, and each goes to the oldest keeper that it resembles."""
    rng = random.Random(4)
    words = ["".join(rng.choices("abcdefgh", k=4)) for _ in range(60)]
    rows = [(i, " ".join(rng.sample(words, 60) if i % 3 else rng.choices(words, k=50)), rng.randrange(40)) for i in range(40)]
    for i in range(110):
        w = rows[i % 40][1].split(" ")
        for _ in range(rng.randrange(1, 5)):
            w[rng.randrange(len(w))] = "".join(rng.choices("xyz", k=3))
        rows.append((100 + i, " ".join(w), rng.randrange(40)))
    sets = {k: {t[i : i + 3] for i in range(len(t) - 2)} for k, t, _ in rows}
    close = {frozenset((a, b)) for a in sets for b in sets if a < b and 10 * len(sets[a] & sets[b]) >= 9 * len(sets[a] | sets[b])}
    want = fold(close, [k for _, k in sorted((t, k) for k, _, t in rows)])
    staged, keep = [], N.stage
    monkeypatch.setattr(N, "stage", lambda df, name: [keep(df, name), staged.append(name)][0])
    got = {r["duplicate"]: r["keeper"] for r in N.prune_by_text(spark.createDataFrame(rows, "k int, text string, t int"), "k", "text", "t", batch=3).collect()}
    assert got == want and len(want) > 40 and staged.count("prune-fell") > 1


def test_manifest_diff_and_index(spark, tmp_path):
    src = tmp_path / "src"
    (src / "sub").mkdir(parents=True)
    (src / "node_modules").mkdir()
    (src / "a.py").write_text("def f():\n    return 1\n")
    (src / "sub/b.md").write_text("# Head\n\nSome text that is here.\n")
    (src / "node_modules/x.py").write_text("def no(): pass\n")
    (src / "tool").write_text("#!/bin/bash\necho\n")
    (src / "blob").write_bytes(b"\xff\xfe\x00import ")
    found = {r["file_path"] for r in fs.project_files(spark, str(src)).collect()}
    assert found == {"a.py", "sub/b.md", "tool"}
    out = str(tmp_path / "index")
    assert {r["status"] for r in I.index_files(spark, fs.project_files(spark, str(src)), out).collect()} == {"new"}
    first = I.open_index(spark, out).snapshot().rows().count()
    (src / "a.py").write_text("def f():\n    return 1\n\n\ndef g():\n    return 2\n")
    (src / "sub/b.md").unlink()
    got = {r["file_path"]: r["status"] for r in I.index_files(spark, fs.project_files(spark, str(src)), out).collect()}
    assert got == {"a.py": "changed", "sub/b.md": "removed", "tool": "unchanged"}
    rows = I.open_index(spark, out).snapshot().rows().collect()
    assert {r["file_path"] for r in rows} == {"a.py", "tool"} and len({(r["file_path"], r["chunk_index"]) for r in rows}) == len(rows) and first > 0


def test_scrape_log_skips_broken_lines(spark, tmp_path):
    path = tmp_path / "log.jsonl"
    path.write_text(json.dumps({"ts": "2024-01-01T00:00:00", "url": "http://a.b/c", "domain": "a.b", "success": True}) + "\n\n{broken\n")
    assert sessions.read_scrape_log(spark, str(path)).count() == 1 and sessions.read_scrape_log(spark, str(tmp_path / "none")).count() == 0
    got = sessions.log_entries(spark.createDataFrame([("https://www.A.b/c", "t" * 300, "e" * 300)], "url string, title string, error string")).first()
    assert (got["domain"], len(got["title"]), len(got["error"])) == ("a.b", 120, 200)


def test_sessions(spark, tmp_path):
    for name in ("a-1", "b-2"):
        (tmp_path / name).mkdir()
        (tmp_path / name / "session.json").write_text(json.dumps({"query": name, "other": 1}))
    assert [r["name"] for r in sessions.list_sessions(spark, str(tmp_path)).collect()] == ["b-2", "a-1"]


def test_search_results(spark):
    rows = [(1, "brave", json.dumps({"web": {"results": [{"title": "T", "url": "U", "description": "S"}]}})), (2, "serper", json.dumps({"organic": [{"title": "T", "link": "L"}]})), (3, "tavily", "{broken"), (4, "duckduckgo", '<a class="result__a" href="//d/l/?uddg=http%3A%2F%2Fx.y">N</a><a class="result__snippet">W</a>')]
    got = {r["query_id"]: (r["title"], r["url"], r["snippet"]) for r in E.parse_results(spark.createDataFrame(rows, "query_id int, engine string, payload string")).collect()}
    assert got == {1: ("T", "U", "S"), 2: ("T", "L", ""), 4: ("N", "http://x.y", "W")}
    assert E.pick_engine({"brave": "k", "tavily": "k"}) == "tavily" and E.pick_engine({"brave": "k"}, "brave") == "brave" and E.pick_engine({}) == "duckduckgo"


def test_routes_robots_and_page_files(spark):
    known = {"https://en.wikipedia.org/wiki/X": ("wikipedia", "generic"), "https://arxiv.org/abs/1": (None, "arxiv"), "https://h/a.pdf": (None, "pdf"), "https://dev.to/a": ("devto", "generic"), "https://x.stackexchange.com/q": ("stackexchange", "generic"), "https://github.com/u/r": (None, "github")}
    got = spark.createDataFrame([(u,) for u in known], "url string").select("url", web.direct_fetcher(F.col("url")).alias("a"), web.extractor(F.col("url"), F.lit("text/html")).alias("b")).collect()
    assert {r["url"]: (r["a"], r["b"]) for r in got} == known
    urls = spark.createDataFrame([("http://a.b/x",), ("http://a.b/no/y",), ("http://c.d/no",), ("http://bad.e/",), ("http://a.b/thin",)], "url string")
    robots = spark.createDataFrame([("a.b", "User-agent: *\nDisallow: /no")], "host string, body string")
    pages = spark.createDataFrame([("http://a.b/x", 100), ("http://a.b/thin", 3)], "url string, word_count int")
    out = {r["url"]: r["outcome"] for r in web.scrape_status(urls, pages, spark.createDataFrame([("bad.e",)], "domain string"), robots).collect()}
    assert out == {"http://a.b/x": "ok", "http://a.b/no/y": "robots", "http://c.d/no": "missing", "http://bad.e/": "blacklisted", "http://a.b/thin": "thin"}
    files = web.page_files(spark.createDataFrame([("u1", "A Title", "c", 1, "web"), ("u2", "A title", "d", 1, "web")], "url string, title string, content string, word_count int, source_type string"), "2024-01-01T00")
    assert {r["file_name"] for r in files.collect()} == {"a-title.md", "a-title-1.md"}


def test_attempts_at_one_url_are_judged_by_themselves(spark):
    urls = spark.createDataFrame([(1, "http://a.b/x"), (2, "http://a.b/x"), (3, "http://a.b/x")], "page_id long, url string")
    read = spark.createDataFrame([(1, 100), (2, 3)], "page_id long, word_count int")
    none, robots = spark.createDataFrame([], "domain string"), spark.createDataFrame([], "host string, body string")
    assert {r["page_id"]: r["outcome"] for r in web.scrape_status(urls, read, none, robots, key="page_id").collect()} == {1: "ok", 2: "thin", 3: "missing"}
    by_url = read.join(urls, "page_id").select("url", "word_count")
    assert [tuple(r) for r in web.scrape_status(urls, by_url, none, robots).collect()] == [("http://a.b/x", "a.b", "ok", 100)]


def test_crawl_by_levels(spark):
    link = lambda *to: " ".join(f'<a href="{t}">x</a>' for t in to)
    rows = [(1, "http://a.b/1", link("/2", "http://z.z/")), (2, "http://a.b/2", link("/1", "/3")), (3, "http://a.b/3", "")]
    pages = spark.createDataFrame(rows, "page_id int, url string, html string")
    none = spark.createDataFrame([], "domain string")
    seeds = pages.where("page_id = 1").select("url")
    assert {(r["url"][-1], r["level"]) for r in S.crawl(pages, seeds, 2, None, none).collect()} == {("1", 0), ("2", 1), ("3", 2)}
    assert S.crawl(pages, seeds, 2, 2, none).count() == 2 and S.crawl(pages, seeds, 0, None, none).count() == 1


def test_images(spark):
    got = fs.image_records(spark.createDataFrame([("d/p.png", 20480), ("d/big.png", 11 * 1024 * 1024), ("d/t.txt", 5)], "file_path string, length long")).collect()
    assert [(r["chunk_id"], r["content"]) for r in got] == [("p_img_0", "[Image: p.png] d/p.png (20KB)")]


def test_saved_pages_are_found_by_the_url_in_their_front_matter(spark):
    from lodegrain.sources import web

    pages = spark.createDataFrame([("http://a/1", "T", "says http://a/2 in its text"), ("http://a/2", "T", "---\nsource_url: \"http://a/9\"\n---"), ("http://a/3", "Ü $1", "x")], "url string, title string, content string").withColumn("word_count", F.lit(1)).withColumn("source_type", F.lit("page"))
    files = web.page_files(pages, "2024-01-01").unionByName(spark.createDataFrame([("zz.md", "---\nsource_url: \"http://a/1\"\n---\n"), ("bare.md", "source_url: \"http://a/9\""), ("none.md", None), ("cut.md", "---\nsource_url: http://a/9"), ("plain.md", "---\nsource_url: http://a/4\r\n---")], "file_name string, body string"))
    asked = spark.createDataFrame([("http://a/1", "f"), ("http://a/1", "f"), ("http://a/2", None), ("http://a/9", None), ("http://a/4", None), (None, None)], "url string, file_name string")
    got = sorted(((r["url"] or "", r["file_name"]) for r in web.saved_pages(asked, files).collect()), key=str)
    assert got == [("", None), ("http://a/1", "t.md"), ("http://a/1", "t.md"), ("http://a/2", "t-1.md"), ("http://a/4", "plain.md"), ("http://a/9", None)]
    assert web.saved_pages(asked, files.limit(0)).where("file_name is not null").isEmpty()
