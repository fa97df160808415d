"""Answers of web search services as rows (title, url, snippet)."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodegrain.functions import text as T

#: Where each service's answer holds the list, and its fields for title, url and snippet.
LAYOUTS = {"tavily": ("results", ("title", "url", "content")), "brave": ("web.results", ("title", "url", "description")), "serper": ("organic", ("title", "link", "snippet"))}
PRIORITY = ("tavily", "serper", "brave")


class SearchEngine(Protocol):
    """Anything that answers a query with the raw payload of its service."""

    name: str

    def search(self, query: str, max_results: int) -> str: ...


def pick_engine(keys: Mapping[str, str], wanted: str | None = None) -> str:
    """The engine asked for if there is a key for it, else the first with one, else the one without."""
    if wanted and wanted != "auto" and (wanted == "duckduckgo" or keys.get(wanted)):
        return wanted
    return next((e for e in PRIORITY if keys.get(e)), "duckduckgo")


def _json_results(payload: Column, layout: tuple[str, tuple[str, str, str]]) -> Column:
    where, fields = layout
    kind = "array<struct<" + ",".join(f"{f}:string" for f in fields) + ">>"
    for part in reversed(where.split(".")):
        kind = f"struct<{part}:{kind}>"
    got = F.from_json(payload, kind)
    for part in where.split("."):
        got = got[part]
    text = lambda c: F.coalesce(c, F.lit(""))
    return F.transform(got, lambda r: F.struct(*(text(r[f]).alias(n) for f, n in zip(fields, ("title", "url", "snippet"), strict=True))))


def _html_results(payload: Column) -> Column:
    """Links and snippets of a result page, put together by their place."""
    link = r'class="result__a"[^>]*href="([^"]+)"[^>]*>([^<]+)</a>'
    urls, titles = F.regexp_extract_all(payload, F.lit(link), 1), F.regexp_extract_all(payload, F.lit(link), 2)
    notes = F.regexp_extract_all(payload, F.lit(r'class="result__snippet"[^>]*>([^<]+)<'), 1)
    at = F.transform(urls, lambda u, i: F.struct(F.trim(F.get(titles, i)).alias("title"), T.unwrap_redirect(u).alias("url"), F.trim(F.coalesce(F.get(notes, i), F.lit(""))).alias("snippet")))
    return at


def parse_results(answers: DataFrame, max_results: int = 10) -> DataFrame:
    """(query_id, position, title, url, snippet) of (query_id, engine, payload) answers; unreadable ones give none."""
    engine, payload = F.col("engine"), F.col("payload")
    got = F.when(engine == "duckduckgo", _html_results(payload))
    for name, layout in LAYOUTS.items():
        got = got.when(engine == name, _json_results(payload, layout))
    return answers.select("query_id", F.posexplode(F.slice(got, 1, max_results)).alias("position", "r")).select("query_id", "position", "r.*")


def distinct_urls(results: DataFrame) -> DataFrame:
    """The first result of each url, by query and position."""
    from lodegrain.operators.analytics import first_occurrences

    return first_occurrences(results.where("url <> ''"), "url", "query_id", "position")
