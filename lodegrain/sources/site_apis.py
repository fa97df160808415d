"""Pages from the answers of site APIs: what to ask a service for a url, and its JSON as markdown.

Everything is a column expression over (url, service, body, extra) rows; only HTML inside an answer goes through the
tree parser.  ``extra`` is the answer to a service's second address, where it has one, and may be null.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from lodegrain.functions import text as T
from lodegrain.operators import html as H
from lodegrain.sources import web

ANSWERS, COMMENTS, LEAST_WORDS, LEAST_SECTION = 5, 5, 10, 20
#: The fields of papers that are asked for; first parts of paths that are no articles; parts of an
#: encyclopedia article that are noise.
PAPER_FIELDS = "title,abstract,authors,year,venue,citationCount,referenceCount,tldr,externalIds,openAccessPdf"
NO_ARTICLES = ("t", "top", "latest", "search", "tags", "settings")
ARTICLE_NOISE = {"mw-ref", "navbox", "sistersitebox", "noprint", "mw-empty-elt"}

_SHAPES = {
    "wikipedia": "title string, extract string, description string",
    "youtube": "title string, author_name string, author_url string",
    "stackexchange": "items array<struct<title:string,body:string,tags:array<string>,score:long,answer_count:long>>",
    "reddit": "array<struct<data:struct<children:array<struct<kind:string,data:struct<title:string,selftext:string,subreddit_name_prefixed:string,score:long,author:string,num_comments:long,url:string,body:string>>>>>>",
    "devto": "title string, body_markdown string, body_html string, user struct<name:string>, tags string, tag_list string, positive_reactions_count long, readable_publish_date string",
    "fandom": "parse struct<title:string,displaytitle:string,wikitext:struct<`*`:string>,categories:array<struct<`*`:string,hidden:string>>>",
    "semantic_scholar": "title string, abstract string, authors array<struct<name:string>>, year long, venue string, citationCount long, referenceCount long, tldr struct<text:string>, externalIds struct<DOI:string,ArXiv:string,PMID:string>, openAccessPdf struct<url:string>",
}
_ANSWERS = "items array<struct<is_accepted:boolean,body:string,score:long>>"


def _markdown(fragment: str | None) -> str:
    if not fragment:
        return ""
    try:
        return H.to_markdown(H.parse(fragment))
    except (ValueError, RecursionError, AssertionError):
        return ""


def _article(page: str | None) -> str:
    """The outermost sections of an encyclopedia article; the whole where there are none."""
    if not page:
        return ""
    try:
        root = H.parse(page)
        for n in list(root.walk()):
            n.children = [c for c in n.children if isinstance(c, str) or not ARTICLE_NOISE & set(c.attrs.get("class", "").split())]
        found, stack = [], [root]
        while stack:
            n = stack.pop()
            if n.tag == "section":
                found.append(H.to_markdown(n))
            else:
                stack += [c for c in reversed(n.children) if isinstance(c, H.Node)]
        return "\n\n".join(x for x in found if len(x.strip()) > LEAST_SECTION) if found else H.to_markdown(root)
    except (ValueError, RecursionError, AssertionError):
        return ""


def _description(page: str | None) -> str:
    try:
        metas = [n.attrs for n in H.parse(page or "").walk() if n.tag == "meta" and n.attrs.get("content")]
    except (ValueError, RecursionError, AssertionError):
        return ""
    return next((m["content"] for k, v in (("name", "description"), ("property", "og:description")) for m in metas if m.get(k) == v), "")


def _each(f: Callable[[str | None], str]) -> Callable[[Column], Column]:
    def run(s: pd.Series) -> pd.Series:
        return pd.Series([f(x) for x in s], dtype=object)

    return lambda c: F.pandas_udf(run, StringType())(c)


html_markdown, article_markdown, page_description = _each(_markdown), _each(_article), _each(_description)


def api_requests(url: Column, service: Column) -> Column:
    """The one or two addresses to ask for a url; null where a url of the service has no such page."""
    parts = F.filter(F.split(web.url_path(url), "/"), lambda p: p != "")
    part = lambda i: F.get(parts, F.lit(i))
    wiki = (part(0) == "wiki") & (F.size(parts) >= 2)
    rest = F.concat(F.lit("https://"), T.url_host(url), F.lit("/api/rest_v1/page/"))
    long, question = web.video_url(url), F.concat(F.lit("https://api.stackexchange.com/2.3/questions/"), part(1))
    site = F.concat(F.lit("?order=desc&sort=votes&site="), web.question_site(T.url_host(url)), F.lit("&filter=withbody"))
    json_url = F.regexp_replace(url, "/+$", "")
    page = F.url_encode(F.url_decode(F.array_join(F.slice(parts, F.lit(2), F.size(parts)), "/")))
    paper = F.replace(F.replace(F.url_encode(T.paper_id(url)), F.lit("%3A"), F.lit(":")), F.lit("%2F"), F.lit("/"))
    return (
        F.when(service == "wikipedia", F.when(wiki, F.array(F.concat(rest, F.lit("summary/"), part(1)), F.concat(rest, F.lit("mobile-html/"), part(1)))))
        .when(service == "youtube", F.array(F.concat(F.lit("https://www.youtube.com/oembed?url="), long, F.lit("&format=json")), long))
        .when(service == "stackexchange", F.when((part(0) == "questions") & part(1).rlike("^[0-9]+$"), F.array(F.concat(question, site), F.concat(question, F.lit("/answers"), site))))
        .when(service == "reddit", F.array(F.when(F.endswith(json_url, F.lit(".json")), url).otherwise(F.concat(json_url, F.lit(".json")))))
        .when(service == "devto", F.when((F.size(parts) >= 2) & ~part(0).isin(*NO_ARTICLES), F.array(F.concat(F.lit("https://dev.to/api/articles/"), part(0), F.lit("/"), part(1)))))
        .when(service == "fandom", F.when(wiki, F.array(F.concat(F.lit("https://"), T.url_host(url), F.lit("/api.php?action=parse&format=json&redirects=1&prop=wikitext%7Ccategories%7Cdisplaytitle&page="), page))))
        .when(service == "semantic_scholar", F.when(T.paper_id(url).isNotNull(), F.array(F.concat(F.lit("https://api.semanticscholar.org/graph/v1/paper/"), paper, F.lit(f"?fields={PAPER_FIELDS}")))))
    )


def _some(c: Column) -> Column:
    """Null for an empty text, so that what is built around it falls away."""
    return F.nullif(c, F.lit(""))


def _bold(label: str, *value: Column | str) -> Column:
    return F.concat(F.lit(f"**{label}:** "), *(F.lit(v) if isinstance(v, str) else v.cast("string") for v in value))


def _stack(*parts: Column) -> Column:
    """The parts that are not null, a line each."""
    return F.concat_ws("\n", *parts)


def _tags(c: Column) -> Column:
    """A list, as JSON or separated by commas, with blanks between."""
    listed = F.from_json(c, "array<string>")
    return _some(F.array_join(F.filter(F.transform(F.coalesce(listed, F.split(c, ",")), lambda x: F.trim(x)), lambda x: x != ""), ", "))


def _question(a: Column, url: Column, extra: Column) -> tuple[Column, Column, Column]:
    q, answers = F.get(a["items"], F.lit(0)), F.slice(F.from_json(extra, _ANSWERS)["items"], 1, ANSWERS)
    heads = F.transform(answers, lambda x, i: F.concat(F.lit("\n## Answer "), (i + 1).cast("string"), F.when(x["is_accepted"], " (Accepted)").otherwise(""), F.lit(" (Score: "), F.coalesce(x["score"], F.lit(0)).cast("string"), F.lit(")\n\n")))
    bodies = [html_markdown(F.get(answers, F.lit(i))["body"]) for i in range(ANSWERS)]
    told = [F.concat(F.get(heads, F.lit(i)), b) for i, b in enumerate(bodies)]
    first = F.concat(_bold("Score", F.coalesce(q["score"], F.lit(0))), F.lit("  |  "), _bold("Answers", F.coalesce(q["answer_count"], F.lit(0))))
    content = _stack(first, _bold("Tags", _some(F.array_join(q["tags"], ", "))), F.concat(F.lit("\n## Question\n\n"), html_markdown(F.coalesce(q["body"], F.lit("")))), *told)
    return F.when(q.isNotNull(), F.coalesce(q["title"], F.lit(""))), content, F.array().cast("array<string>")


def _post(a: Column, url: Column, extra: Column) -> tuple[Column, Column, Column]:
    post = F.get(F.get(a, F.lit(0))["data"]["children"], F.lit(0))["data"]
    no = lambda c: F.coalesce(c, F.lit(0)).cast("string")
    text = lambda c: F.coalesce(c, F.lit(""))
    comments = F.filter(F.slice(F.get(a, F.lit(1))["data"]["children"], 1, COMMENTS), lambda c: c["kind"] == "t1")
    told = F.transform(F.filter(comments, lambda c: _some(c["data"]["body"]).isNotNull()), lambda c: F.concat(F.lit("**u/"), F.coalesce(c["data"]["author"], F.lit("[deleted]")), F.lit("** (Score: "), no(c["data"]["score"]), F.lit("):\n> "), c["data"]["body"], F.lit("\n")))
    link = F.coalesce(post["url"], url)
    outside = (link != url) & (link != "")
    content = _stack(
        F.concat(F.lit("**"), text(post["subreddit_name_prefixed"]), F.lit("**  |  Score: "), no(post["score"]), F.lit("  |  "), no(post["num_comments"]), F.lit(" comments")), _bold("Posted by", "u/", text(post["author"])),
        F.when(outside & ~F.startswith(link, F.lit("https://www.reddit.com")), _bold("Link", link)), F.concat(F.lit("\n"), _some(post["selftext"])), F.when(F.size(comments) > 0, F.concat(F.lit("\n## Top Comments\n"), F.when(F.size(told) > 0, F.concat(F.lit("\n"), F.array_join(told, "\n"))).otherwise(""))),
    )
    return _some(post["title"]), content, F.when(link != url, F.array(link)).otherwise(F.array().cast("array<string>"))


def _paper(a: Column, url: Column, extra: Column) -> tuple[Column, Column, Column]:
    names = _some(F.array_join(F.filter(a["authors"]["name"], lambda x: F.coalesce(x, F.lit("")) != ""), ", "))
    ids = _some(F.concat_ws(" | ", *(F.concat(F.lit(f"{n}: "), _some(a["externalIds"][f])) for n, f in (("DOI", "DOI"), ("arXiv", "ArXiv"), ("PMID", "PMID")))))
    cited, refers, pdf, venue = F.coalesce(a["citationCount"], F.lit(0)), F.coalesce(a["referenceCount"], F.lit(0)), _some(a["openAccessPdf"]["url"]), _some(a["venue"])
    when = F.when(a["year"].isNotNull(), F.when(venue.isNotNull(), _bold("Published", venue, ", ", a["year"])).otherwise(_bold("Year", a["year"])))
    counts = F.when((cited != 0) | (refers != 0), F.concat(_bold("Citations", cited), F.lit("  |  "), _bold("References", refers)))
    short = F.concat(F.lit("## TL;DR\n\n"), _some(a["tldr"]["text"]), F.lit("\n"))
    return _some(a["title"]), _stack(_bold("Authors", names), when, counts, _bold("IDs", ids), _bold("PDF", "[", pdf, "](", pdf, ")"), F.lit(""), short, F.concat(F.lit("## Abstract\n\n"), _some(a["abstract"]))), F.array().cast("array<string>")


def _built(service: str, a: Column, url: Column, extra: Column) -> tuple[Column, Column, Column]:
    """(title, content, links) of a service's answer; a null title or content is no page."""
    none = F.array().cast("array<string>")
    if service == "wikipedia":
        named = F.replace(F.get(F.filter(F.split(web.url_path(url), "/"), lambda p: p != ""), F.lit(1)), F.lit("_"), F.lit(" "))
        body = F.coalesce(_some(article_markdown(extra)), a["extract"])
        about = F.concat(F.lit("*"), _some(a["description"]), F.lit("*\n"))
        return F.coalesce(a["title"], named), F.when(_some(a["extract"]).isNotNull(), _stack(about, body)), none
    if service == "youtube":
        by, at, told = _some(a["author_name"]), _some(a["author_url"]), _some(page_description(extra))
        channel = F.when(at.isNotNull(), _bold("Channel", "[", by, "](", at, ")")).otherwise(_bold("Channel", by))
        return F.coalesce(a["title"], F.lit("YouTube Video")), _stack(channel, _bold("URL", web.video_url(url)), F.concat(F.lit("\n## Description\n\n"), told)), F.when(at.isNotNull(), F.array(at)).otherwise(none)
    if service == "stackexchange":
        return _question(a, url, extra)
    if service == "reddit":
        return _post(a, url, extra)
    if service == "devto":
        body = F.coalesce(_some(a["body_markdown"]), _some(html_markdown(a["body_html"])))
        liked = F.when(F.coalesce(a["positive_reactions_count"], F.lit(0)) != 0, _bold("Reactions", a["positive_reactions_count"]))
        return _some(a["title"]), F.when(body.isNotNull(), _stack(_bold("Author", _some(a["user"]["name"])), _bold("Published", _some(a["readable_publish_date"])), _bold("Tags", _tags(F.coalesce(a["tags"], a["tag_list"]))), liked, F.lit(""), body)), none
    if service == "fandom":
        p = a["parse"]
        shown = F.filter(p["categories"], lambda c: F.coalesce(c["hidden"], F.lit("")).isin("", "false"))
        groups = _some(F.array_join(F.transform(shown, lambda c: F.replace(c["*"], F.lit("_"), F.lit(" "))), ", "))
        content = F.concat(T.wikitext_to_markdown(_some(p["wikitext"]["*"])), F.coalesce(F.concat(F.lit("\n\n"), _bold("Categories", groups)), F.lit("")))
        return F.regexp_replace(F.coalesce(p["displaytitle"], p["title"]), "<[^>]+>", ""), F.when(T.word_count(content) >= LEAST_WORDS, content), none
    return _paper(a, url, extra)


def api_pages(answers: DataFrame) -> DataFrame:
    """(url, title, content, word_count, links, source_type) of (url, service, body, extra) answers.

    An answer that cannot be read, names an error, or lacks what its page is made of gives no row."""
    pages = None
    for service, shape in _SHAPES.items():
        rows = answers.where(F.col("service") == service).select("url", F.from_json("body", shape).alias("a"), F.col("extra").cast("string").alias("extra"))
        title, content, links = _built(service, F.col("a"), F.col("url"), F.col("extra"))
        kind = "academic" if service == "semantic_scholar" else service
        part = rows.select("url", title.alias("title"), content.alias("content"), links.alias("links")).where("title is not null and trim(coalesce(content, '')) <> ''")
        part = part.select("url", "title", "content", T.word_count("content").cast("int").alias("word_count"), "links", F.lit(kind).alias("source_type"))
        pages = part if pages is None else pages.unionByName(part)
    return pages
