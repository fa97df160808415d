"""Web pages: routing of urls, robots rules, fetching (live fetchers are given; a table stands in offline),
and pages as markdown files."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol
from urllib.request import Request, urlopen
from urllib.robotparser import RobotFileParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodegrain.functions import text as T
from lodegrain.operators.crawl import check_domains

MIN_CONTENT = 200
#: Hosts with an API of their own, in the order they are asked.
WIKIS = ("wikipedia.org", "wiktionary.org", "wikimedia.org", "wikibooks.org")
QUESTION_SITES = ("stackoverflow.com", "superuser.com", "serverfault.com", "askubuntu.com", "mathoverflow.net")
ACADEMIC = (
    "semanticscholar.org", "doi.org", "dx.doi.org", "dl.acm.org", "acm.org", "ieeexplore.ieee.org", "ieee.org", "sciencedirect.com", "researchgate.net", "springer.com", "link.springer.com",
    "nature.com", "pubmed.ncbi.nlm.nih.gov", "ncbi.nlm.nih.gov", "wiley.com", "onlinelibrary.wiley.com", "plos.org", "journals.plos.org",
)


class Fetcher(Protocol):
    """Anything that turns a url into (status, content_type, body)."""

    def fetch(self, url: str) -> tuple[int, str, bytes]: ...


def direct_fetcher(url: Column) -> Column:
    """Name of the API that serves a url, null if none does."""
    host = F.lower(T.url_host(url))
    bare = F.regexp_replace(host, r"^www\.", "")
    ends = lambda col, names: col.rlike("(" + "|".join(n.replace(".", r"\.") for n in names) + ")$")
    academic = bare.isin(*ACADEMIC) | ends(bare, tuple(f".{d}" for d in ACADEMIC))
    return (
        F.when(ends(host, WIKIS), "wikipedia").when(host.rlike(r"youtube\.com|youtu\.be"), "youtube").when(bare.isin(*QUESTION_SITES) | F.endswith(bare, F.lit(".stackexchange.com")), "stackexchange")
        .when(host.rlike(r"reddit\.com|redd\.it"), "reddit").when(bare == "dev.to", "devto").when(F.endswith(host, F.lit(".fandom.com")), "fandom").when(academic, "semantic_scholar")
    )


def url_path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[a-zA-Z][\w+.-]*://[^/?#]*([^?#]*)", 1)


def extractor(url: Column, content_type: Column) -> Column:
    """Name of the first extractor that takes a url and content type; ``generic`` takes all."""
    host, path, kind = F.lower(T.url_host(url)), F.lower(url_path(url)), F.lower(F.coalesce(content_type, F.lit("")))
    parts = F.size(F.filter(F.split(path, "/"), lambda p: p != ""))
    return (
        F.when(host.contains("arxiv.org") & path.rlike("^/(abs|pdf|html)/"), "arxiv").when(host.contains("github.com") & kind.contains("text/html") & (parts >= 2), "github")
        .when(kind.contains("pdf") | F.endswith(path, F.lit(".pdf")), "pdf").when(kind.rlike("wordprocessingml|application/msword") | F.endswith(path, F.lit(".docx")), "docx")
        .when(kind.rlike("spreadsheetml|text/csv|application/csv") | path.rlike(r"\.(xlsx|csv|tsv)$"), "spreadsheet").when(kind.contains("presentationml") | F.endswith(path, F.lit(".pptx")), "pptx")
        .when(kind.contains("epub") | F.endswith(path, F.lit(".epub")), "epub").when(kind.contains("rtf") | F.endswith(path, F.lit(".rtf")), "rtf")
        .when(kind.rlike("rss|atom|xml.*feed|feed.*xml") | path.rlike(r"\.(rss|atom|feed)$"), "rss").when(kind.rlike("text/(x-)?markdown|text/plain") | path.rlike(r"\.(md|txt)$"), "markdown").otherwise("generic")
    )


def question_site(host: Column) -> Column:
    """Site parameter of the question sites' API."""
    h = T.normalise_domain(host)
    return F.when(h == "stackoverflow.com", "stackoverflow").when(F.endswith(h, F.lit(".stackexchange.com")), F.regexp_replace(h, r"\.stackexchange\.com$", "")).otherwise(F.regexp_replace(h, r"\.(com|net)", ""))


def video_url(url: Column) -> Column:
    """Short video links in their long form."""
    return F.when(T.url_host(url).contains("youtu.be"), F.concat(F.lit("https://www.youtube.com/watch?v="), F.regexp_replace(url_path(url), "^/+", ""))).otherwise(url)


def robots_allowed(urls: DataFrame, robots: DataFrame, agent: str = "*") -> DataFrame:
    """Add ``robots_ok`` to (url, ...) rows by the rules of (host, body); a host without rules allows all."""
    rules = robots.select(F.col("host").alias("_host"), F.col("body").alias("_rules"))
    with_rules = urls.withColumn("_h", F.lower(T.url_host("url"))).join(rules, F.col("_h") == F.col("_host"), "left").drop("_h", "_host")

    @F.pandas_udf("boolean")
    def allowed(url: pd.Series, body: pd.Series) -> pd.Series:
        parsed: dict[str, RobotFileParser] = {}
        out = []
        for u, b in zip(url, body, strict=True):
            if not b:
                out.append(True)
                continue
            if b not in parsed:
                parsed[b] = RobotFileParser()
                parsed[b].parse(b.splitlines())
            out.append(parsed[b].can_fetch(agent, u))
        return pd.Series(out)

    return with_rules.withColumn("robots_ok", F.when(F.col("_rules").isNull(), True).otherwise(allowed("url", "_rules"))).drop("_rules")


def fetch(urls: DataFrame, fetcher: Callable[[], Fetcher]) -> DataFrame:
    """(url, http_status, content_type, body, error) through a live fetcher, which is made once a task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = fetcher()
        for b in batches:
            rows = []
            for u in b["url"]:
                try:
                    rows.append((u, *client.fetch(u), None))
                except Exception as e:  # noqa: BLE001  a failed fetch is a row
                    rows.append((u, None, None, None, f"{type(e).__name__}: {e}"[:200]))
            yield pd.DataFrame(rows, columns=["url", "http_status", "content_type", "body", "error"])

    return urls.select("url").mapInPandas(run, "url string, http_status int, content_type string, body binary, error string")


def robots_of(urls: DataFrame, fetcher: Callable[[], Fetcher]) -> DataFrame:
    """(host, body) of robots.txt of the hosts of (url) rows; those without one have no row."""
    from lodegrain.sources.workspace import stage

    hosts = urls.select(F.lower(T.url_host("url")).alias("host")).where("host <> ''").distinct()
    asked = fetch(hosts.select(F.concat(F.lit("https://"), "host", F.lit("/robots.txt")).alias("url")), fetcher)
    return stage(asked, "robots").where("http_status = 200").select(F.lower(T.url_host("url")).alias("host"), F.col("body").cast("string").alias("body"))


def scrape_status(urls: DataFrame, extracted: DataFrame, blacklist: DataFrame, robots: DataFrame, min_content: int = MIN_CONTENT, key: str = "url") -> DataFrame:
    """(url, domain, outcome, word_count): blacklisted, robots, missing, thin or ok, in the order a scraper checks.
    ``extracted`` has (url, word_count) of the pages that could be read; of an url read several times the longest counts.

    An url that is asked for several times is judged once.  With a ``key``, in both tables, each attempt is judged by
    what it read itself, and the result has the key too."""
    own = list(dict.fromkeys((key, "url")))
    judged = robots_allowed(check_domains(urls.select(*own).distinct(), blacklist), robots)
    found = judged.join(extracted.groupBy(key).agg(F.max("word_count").alias("word_count")), key, "left")
    outcome = F.when(~F.col("allowed"), "blacklisted").when(~F.col("robots_ok"), "robots").when(F.col("word_count").isNull(), "missing").when(F.col("word_count") < min_content // 5, "thin").otherwise("ok")
    return found.select(*own, "domain", outcome.alias("outcome"), "word_count")


def page_files(pages: DataFrame, scraped_at: str) -> DataFrame:
    """(file_name, body) of (url, title, content, word_count, source_type) pages: front matter, heading, text and
    source; equal names get -1, -2, ... in order of their urls."""
    slug = T.slug("title", default="untitled")
    turn = F.row_number().over(W.partitionBy("_slug").orderBy("url")) - 1
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    front = T.build_frontmatter({"profile": F.lit("scraped"), "generator": quoted(F.lit("lodegrain")), "title": quoted(F.col("title")), "source_url": quoted(F.col("url")), "scraped_at": quoted(F.lit(scraped_at)), "word_count": F.col("word_count"), "source_type": quoted(F.col("source_type")), "content_quality": F.lit("1.0")})
    foot = F.concat(F.lit("\n\n---\n*Source: ["), F.col("url"), F.lit("]("), F.col("url"), F.lit(f") — scraped {scraped_at[:10]}*\n"))
    named = pages.withColumn("_slug", slug).withColumn("_turn", turn)
    name = F.concat("_slug", F.when(F.col("_turn") > 0, F.concat(F.lit("-"), F.col("_turn").cast("string"))).otherwise(""), F.lit(".md"))
    return named.select(name.alias("file_name"), F.concat(front, F.lit("\n# "), F.col("title"), F.lit("\n\n"), F.col("content"), foot).alias("body"))


def saved_pages(pages: DataFrame, files: DataFrame) -> DataFrame:
    """``pages`` with ``file_name``, the first file by name whose front matter names the page's url as its source; null where there
    is none.  ``files`` has (file_name, body) as :func:`page_files` gives them; the url is a key, so texts are not searched.
    A page without url has no file; of files without front matter, or with an empty url, nothing is matched."""
    front = F.regexp_extract("body", r"(?s)\A---\n(.*?)\n---(?:\n|\z)", 1)
    url = F.regexp_extract(front, r'(?m)^source_url: *"?(.*?)"?[ \t\r]*$', 1)
    held = files.select(url.alias("_url"), "file_name").where("_url <> ''").groupBy("_url").agg(F.min("file_name").alias("_file"))
    return pages.drop("file_name").join(held, F.col("url") == F.col("_url"), "left").drop("_url").withColumnRenamed("_file", "file_name")


class HttpFetcher:
    """A live fetcher: one request, with a time limit and at most ``most`` bytes of an answer."""

    def __init__(self, agent: str = "lodegrain/1.0", seconds: float = 15, most: int = 10 * 1024 * 1024):
        self.agent, self.seconds, self.most = agent, seconds, most

    def fetch(self, url: str) -> tuple[int, str, bytes]:
        with urlopen(Request(url, headers={"User-Agent": self.agent}), timeout=self.seconds) as answer:  # noqa: S310
            return answer.status, answer.headers.get("Content-Type", ""), answer.read(self.most)


def scrape(urls: DataFrame, fetcher: Callable[[], Fetcher], blacklist: DataFrame, robots: DataFrame, min_content: int = MIN_CONTENT, fetch: Callable[[DataFrame, Callable[[], Fetcher]], DataFrame] = fetch) -> tuple[DataFrame, DataFrame]:
    """(pages, outcomes) of (url) rows: urls of a site with an API by its answers, the others, if their domain is not
    blocked and robots.txt allows them, by their page; pages of under ``min_content`` / 5 words are thin and left out.

    pages has (url, title, content, word_count, links, source_type), outcomes (url, domain, outcome, word_count).  What
    was fetched is written, so a later action asks no service again.  ``fetch`` makes the requests;
    :func:`lodegrain.streaming.politeness.fetch_all` keeps to each host's budget."""
    from lodegrain.operators.documents import extract
    from lodegrain.sources import site_apis
    from lodegrain.sources.workspace import stage

    every = urls.select("url").where("url is not null").distinct().withColumn("service", direct_fetcher(F.col("url")))
    asked = every.where("service is not null").withColumn("asks", site_apis.api_requests(F.col("url"), F.col("service"))).where("asks is not null")
    answers = stage(fetch(asked.select(F.explode("asks").alias("url")).distinct(), fetcher), "api-answers").where("http_status = 200").select(F.col("url").alias("ask"), F.col("body").cast("string").alias("answer"))
    first = asked.join(answers, F.get("asks", F.lit(0)) == F.col("ask")).drop("ask").withColumnRenamed("answer", "body")
    both = first.join(answers, F.get("asks", F.lit(1)) == F.col("ask"), "left").select("url", "service", "body", F.col("answer").alias("extra"))
    judged = robots_allowed(check_domains(every.where("service is null").select("url"), blacklist), robots)
    bodies = stage(fetch(judged.where("allowed and robots_ok"), fetcher), "bodies").where("http_status = 200")
    columns = ("url", "title", "content", "word_count", "links", "source_type")
    pages = stage(site_apis.api_pages(both).select(*columns).unionByName(extract(bodies).select(*columns)), "scraped")
    named = every.where("service is not null").select("url").join(pages.select("url", "word_count"), "url", "left")
    by_api = named.select("url", T.normalise_domain(T.url_host("url")).alias("domain"), F.when(F.col("word_count").isNull(), "missing").when(F.col("word_count") < min_content // 5, "thin").otherwise("ok").alias("outcome"), "word_count")
    rest = scrape_status(every.where("service is null").select("url"), pages, blacklist, robots, min_content)
    return pages.where(F.col("word_count") >= min_content // 5), rest.unionByName(by_api)
