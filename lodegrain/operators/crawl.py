"""Crawling over a table of fetched pages: frontier, visited set and domain rules as joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodegrain.functions.text import normalise_domain, url_host
from lodegrain.operators.html import absolute, hrefs
from lodegrain.sources.workspace import stage


def outlinks(pages: DataFrame) -> DataFrame:
    """(page_id, position, link) of every page, links absolute."""
    found = pages.select("page_id", "url", F.posexplode(hrefs(F.col("html"))).alias("position", "href"))
    return found.select("page_id", "position", absolute(F.col("url"), F.col("href")).alias("link"))


def check_domains(urls: DataFrame, blacklist: DataFrame, url: str = "url") -> DataFrame:
    """Add ``domain`` and ``allowed``: false for hosts on the blacklist."""
    listed = blacklist.select(F.col("domain").alias("_blocked"))
    out = urls.withColumn("domain", normalise_domain(url_host(url)))
    return out.join(listed, F.col("domain") == F.col("_blocked"), "left").withColumn("allowed", F.col("_blocked").isNull()).drop("_blocked")


def next_frontier(links: DataFrame, visited: DataFrame, blacklist: DataFrame) -> DataFrame:
    """Distinct (url) of links neither visited nor on a blocked host."""
    fresh = links.select(F.col("link").alias("url")).distinct().join(visited.select("url"), "url", "left_anti")
    return check_domains(fresh, blacklist).where("allowed").select("url")


def crawl(pages: DataFrame, seeds: DataFrame, depth: int, max_pages: int | None, blacklist: DataFrame) -> DataFrame:
    """(url, level) in breadth-first order: pages of the table reached from the seeds within ``depth`` steps, at
    most ``max_pages`` (None: no limit), none twice.  The loop is over levels; each is a join."""
    links = outlinks(pages).join(pages.select("page_id", "url"), "page_id").select("url", "link")
    found = None
    frontier = check_domains(seeds.select("url").distinct(), blacklist).where("allowed").select("url")
    for level in range(depth + 1):
        # each level is written, so the plan of one does not hold those of all before it
        fetched = stage(pages.select("url").distinct().join(frontier, "url", "left_semi").select("url", F.lit(level).alias("level")), "crawl-level")
        found = fetched if found is None else found.unionByName(fetched)
        if level < depth:
            out = links.join(fetched.select("url"), "url", "left_semi")
            frontier = next_frontier(out, found, blacklist)
    return found if max_pages is None else found.orderBy("level", "url").limit(max_pages)


def remaining(attempted: DataFrame, scraped: DataFrame) -> DataFrame:
    """Distinct (url) that were attempted and not scraped."""
    return attempted.select("url").distinct().join(scraped.select("url"), "url", "left_anti")
