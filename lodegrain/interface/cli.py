"""Command line: python -m lodegrain.interface.cli VERB ..."""

from __future__ import annotations

import argparse
import json
from collections.abc import Callable, Sequence
from datetime import UTC, datetime
from functools import reduce
from pathlib import Path
from urllib.parse import urlencode

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodegrain.functions.text import normalise_domain
from lodegrain.interface.models import ChatModel, RememberedModel, embed_chunks, hashed_vector
from lodegrain.interface.research import Research, TimeBudget
from lodegrain.interface.settings import INDEX_DIR, nearby_index
from lodegrain.operators.analytics import index_stats
from lodegrain.operators.index import index_files, open_index
from lodegrain.operators.segments import Snapshot
from lodegrain.plans.search import Searcher
from lodegrain.sources.files import project_files
from lodegrain.sources.search_engines import parse_results
from lodegrain.sources.web import Fetcher, HttpFetcher, page_files, robots_of, scrape
from lodegrain.streaming.politeness import fetch_all


#: A file of a folder that names the domains it never asks.
BLOCKED = "blocked_domains.txt"


def session() -> SparkSession:
    return SparkSession.builder.appName("lodegrain").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def _index(folder: str) -> str:
    found = nearby_index(folder)
    if found is None:
        raise SystemExit(f"no index at or above {folder}; make one with init")
    return str(found)


def snapshot_of(spark: SparkSession, folder: str) -> Snapshot:
    found = open_index(spark, _index(folder)).snapshot()
    if found is None:
        raise SystemExit(f"the index of {folder} has no version; make one with init")
    return found


def chunks_of(spark: SparkSession, folder: str) -> DataFrame:
    return snapshot_of(spark, folder).rows()


def build(spark: SparkSession, folder: str) -> DataFrame:
    """Index a folder, or bring its index up to date; returns each file's status."""
    return index_files(spark, project_files(spark, folder), str(Path(folder) / INDEX_DIR), embed_chunks)


def opened(spark: SparkSession, folder: str) -> Searcher:
    """The searcher over the latest version of a folder's index."""
    return Searcher.open(snapshot_of(spark, folder), hashed_vector)


def blocked_domains(spark: SparkSession, folder: str) -> DataFrame:
    """(domain) of a folder's list of blocked domains, one a line; none where there is no list."""
    path = Path(folder) / BLOCKED
    lines = [line.strip() for line in path.read_text().splitlines()] if path.is_file() else []
    named = spark.createDataFrame([(line,) for line in lines if line and not line.startswith("#")], "domain string")
    return named.select(normalise_domain(F.col("domain")).alias("domain"))


def read_pages(spark: SparkSession, urls: DataFrame, folder: str, fetcher: Callable[[], Fetcher] = HttpFetcher) -> tuple[DataFrame, DataFrame]:
    """(pages, outcomes) of (url) rows within each host's budget, by its robots.txt and the folder's blocked domains."""
    return scrape(urls, fetcher, blocked_domains(spark, folder), robots_of(urls, fetcher), fetch=fetch_all)


def scraped(spark: SparkSession, urls: list[str], folder: str, fetcher: Callable[[], Fetcher] = HttpFetcher) -> DataFrame:
    """Scrape ``urls`` into markdown files under ``folder``; returns each url's outcome."""
    pages, outcomes = read_pages(spark, spark.createDataFrame([(u,) for u in urls], "url string"), folder, fetcher)
    Path(folder).mkdir(parents=True, exist_ok=True)
    for r in page_files(pages, datetime.now(UTC).isoformat()).toLocalIterator():  # a stated list of urls
        (Path(folder) / r["file_name"]).write_text(r["body"])
    return outcomes


def found_online(spark: SparkSession, query: str, most: int, fetcher: Callable[[], Fetcher] = HttpFetcher) -> DataFrame:
    """Results (title, url, snippet) of a web search without a key."""
    _, _, body = fetcher().fetch("https://html.duckduckgo.com/html/?" + urlencode({"q": query}))
    answers = spark.createDataFrame([(1, "duckduckgo", body.decode("utf-8", errors="replace"))], "query_id int, engine string, payload string")
    return parse_results(answers, most)


def _print(df: DataFrame, limit: int = 100) -> None:
    for r in df.limit(limit).collect():
        print(json.dumps(r.asDict(recursive=True), default=str, ensure_ascii=False))


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lodegrain")
    verbs = p.add_subparsers(dest="verb", required=True)
    for name in ("init", "update", "stats", "info", "status", "debug-schema", "watch"):
        verbs.add_parser(name).add_argument("folder", nargs="?", default=".")
    search = verbs.add_parser("search")
    search.add_argument("query")
    for name in ("find-function", "find-class"):
        verbs.add_parser(name).add_argument("name")
    verbs.add_parser("scrape").add_argument("urls", nargs="+")
    verbs.add_parser("search-web").add_argument("query")
    research = verbs.add_parser("research")
    research.add_argument("topic")
    research.add_argument("--model-url", default="http://localhost:11434")
    research.add_argument("--model", default="qwen3")
    research.add_argument("--minutes", type=float, default=0)
    server = verbs.add_parser("server")
    server.add_argument("--port", type=int, default=7777)
    for name in ("search", "find-function", "find-class", "server", "scrape", "search-web", "research"):
        verbs.choices[name].add_argument("--folder", default=".")
        verbs.choices[name].add_argument("--top-k", type=int, default=10)
    search.add_argument("--type", dest="types", action="append")
    search.add_argument("--language", dest="languages", action="append")
    search.add_argument("--pattern")
    search.add_argument("--context", action="store_true")
    return p


def _research(spark: SparkSession, a: argparse.Namespace) -> None:
    """Rounds of search, scraping and analysis on a topic, by a local model and a web search without a key."""

    def search(queries: list[str]) -> DataFrame:
        found = [found_online(spark, q, a.top_k).select("url") for q in queries]
        return reduce(DataFrame.unionByName, found)

    def read(urls: DataFrame) -> DataFrame:
        pages, _ = read_pages(spark, urls, a.folder)
        return pages.select("url", "title", "content")

    model = RememberedModel(ChatModel(a.model_url, a.model))
    run = Research(spark, a.folder, a.topic, model, search, read, budget=TimeBudget(a.minutes))
    _print(run.run())
    print(run.report())


def main(argv: Sequence[str] | None = None) -> int:
    a = parser().parse_args(argv)
    spark = session()
    if a.verb in ("init", "update"):
        _print(build(spark, a.folder).groupBy("status").count())
        return 0
    if a.verb == "watch":
        from lodegrain.streaming.events import watch

        watch(spark, a.folder, str(Path(a.folder) / INDEX_DIR), str(Path(a.folder) / INDEX_DIR / "watch"), embed_chunks).awaitTermination()
        return 0
    if a.verb == "scrape":
        _print(scraped(spark, a.urls, a.folder))
        return 0
    if a.verb == "search-web":
        _print(found_online(spark, a.query, a.top_k))
        return 0
    if a.verb == "research":
        _research(spark, a)
        return 0
    chunks = chunks_of(spark, a.folder)
    if a.verb in ("stats", "info", "status"):
        _print(index_stats(chunks).orderBy("kind", F.desc("n")))
    elif a.verb == "debug-schema":
        print(chunks.schema.simpleString())
    else:
        searcher = opened(spark, a.folder)
        if a.verb == "find-function":
            _print(searcher.function(a.name, a.top_k).drop("embedding"))
        elif a.verb == "find-class":
            _print(searcher.class_(a.name, a.top_k).drop("embedding"))
        else:
            find = lambda q, k, **more: searcher.search(spark.createDataFrame([(1, q)], "query_id long, query string"), k, **more).orderBy("rank")
            if a.verb == "search":
                _print(find(a.query, a.top_k, chunk_types=a.types, languages=a.languages, file_pattern=a.pattern, include_context=a.context))
            else:
                from lodegrain.interface.server import SearchServer

                with SearchServer(("127.0.0.1", a.port), lambda q, k: [r.asDict(recursive=True) for r in find(q, k).collect()]) as s:
                    s.serve_forever()
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
