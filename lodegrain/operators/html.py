"""HTML pages to markdown, and page-level facts in plain column expressions."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin, urlparse

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Elements that are noise, and where the main content is looked for, in order.
NOISE = {"script", "style", "nav", "footer", "header", "aside", "iframe", "noscript", "svg", "form", "button"}
CONTENT = ("article", "main", '[role="main"]', ".post-content", ".article-content", ".entry-content", "#content", ".content")
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_BLOCK = {"p", "div", "section", "article", "main", "ul", "ol", "li", "table", "tr", "pre", "blockquote", "h1", "h2", "h3", "h4", "h5", "h6", "body", "html", "header", "footer", "figure", "dl", "dt", "dd"}
PAGE_SCHEMA = "url string, title string, content string, word_count int, links array<string>, source_type string"


class Node:
    __slots__ = ("attrs", "children", "parent", "tag")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None):
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []

    def walk(self) -> Iterator[Node]:
        stack = [self]
        while stack:
            n = stack.pop()
            yield n
            stack += [c for c in reversed(n.children) if isinstance(c, Node)]

    def text(self, glue: str = " ") -> str:
        out, stack = [], [self]
        while stack:
            n = stack.pop()
            if isinstance(n, str):
                if n.strip():
                    out.append(n.strip())
            else:
                stack += reversed(n.children)
        return glue.join(out)


#: Elements nested deeper than this are taken as siblings, as browsers do; their text stays.
DEEPEST = 150


class _Tree(HTMLParser):
    """A tolerant tree: unknown end tags are ignored, a missing one ends with its parent."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("[document]", {}, None)
        self.depth = 0
        self.flat: dict[str, int] = {}  # elements that are open below the deepest level

    def handle_starttag(self, tag, attrs):
        if tag in ("p", "li", "tr", "td", "th", "option") and self.at.tag == tag:
            self.at, self.depth = self.at.parent, self.depth - 1
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(node)
        if tag in _VOID:
            return
        if self.depth >= DEEPEST:
            self.flat[tag] = self.flat.get(tag, 0) + 1
        else:
            self.at, self.depth = node, self.depth + 1

    def handle_startendtag(self, tag, attrs):
        self.at.children.append(Node(tag, {k: v or "" for k, v in attrs}, self.at))

    def handle_endtag(self, tag):
        if self.flat.get(tag):
            self.flat[tag] -= 1
            return
        n, up = self.at, 0
        while n is not None and n.tag != tag:
            n, up = n.parent, up + 1
        if n is not None and n.parent is not None:
            self.at, self.depth = n.parent, self.depth - up - 1

    def handle_data(self, data):
        self.at.children.append(data)


def parse(html: str) -> Node:
    tree = _Tree()
    tree.feed(html)
    tree.close()
    return tree.root


def _matches(n: Node, selector: str) -> bool:
    if selector[0] == ".":
        return selector[1:] in n.attrs.get("class", "").split()
    if selector[0] == "#":
        return n.attrs.get("id") == selector[1:]
    if selector[0] == "[":
        key, _, value = selector[1:-1].partition("=")
        return n.attrs.get(key) == value.strip('"')
    return n.tag == selector


def page_title(root: Node, url: str) -> str:
    """og:title, else the title element up to a separator, else the first h1, else the host."""
    first = lambda tag: next((n for n in root.walk() if n.tag == tag), None)
    for n in root.walk():
        if n.tag == "meta" and n.attrs.get("property") == "og:title" and n.attrs.get("content"):
            return n.attrs["content"].strip()
    if (t := first("title")) and (head := re.split(r"\s*[|\-–—]\s*", t.text())[0].strip()):
        return head
    if h := first("h1"):
        return h.text()
    return urlparse(url).netloc


def main_content(root: Node) -> Node:
    for selector in CONTENT:
        found = next((n for n in root.walk() if n is not root and _matches(n, selector)), None)
        if found is not None and len(found.text("")) > 100:
            return found
    every = list(root.walk())
    size: dict[int, int] = {}
    for n in reversed(every):  # children come after their parent, so their sizes are known
        size[id(n)] = sum(len(c.strip()) if isinstance(c, str) else size[id(c)] for c in n.children)
    best = max((n for n in every if n.tag in ("div", "section")), key=lambda n: size[id(n)], default=None)
    if best is not None and size[id(best)]:
        return best
    return next((n for n in every if n.tag == "body"), root)


def _inline(n: Node | str, base: str) -> str:
    if isinstance(n, str):
        return re.sub(r"\s+", " ", n)
    inner = "".join(_inline(c, base) for c in n.children)
    if n.tag == "a" and n.attrs.get("href") and inner.strip():
        return f"[{inner.strip()}]({urljoin(base, n.attrs['href'])})"
    if n.tag == "img" and n.attrs.get("src"):
        return f"![{n.attrs.get('alt', '')}]({urljoin(base, n.attrs['src'])})"
    if n.tag == "code" and inner.strip():
        return f"`{inner.strip()}`"
    if n.tag in ("strong", "b") and inner.strip():
        return f"**{inner.strip()}**"
    if n.tag in ("em", "i") and inner.strip():
        return f"*{inner.strip()}*"
    return "\n" if n.tag == "br" else inner


def _rows(table: Node, base: str) -> list[str]:
    rows = [[_inline(c, base).strip().replace("|", "\\|").replace("\n", " ") for c in r.children if isinstance(c, Node) and c.tag in ("td", "th")] for r in table.walk() if r.tag == "tr"]
    rows = [r for r in rows if r]
    if not rows:
        return []
    width = max(map(len, rows))
    line = lambda r: "| " + " | ".join([*r, *[""] * (width - len(r))]) + " |"
    return [line(rows[0]), "|" + " --- |" * width, *(line(r) for r in rows[1:])]


def to_markdown(node: Node, base: str = "") -> str:
    """Markdown of an element.  Text directly in a container counts; inline pieces keep their blanks."""
    out: list[str] = []
    run: list[str] = []

    def flush() -> None:
        text = re.sub(r" *\n *", "\n", "".join(run)).strip()
        if text:
            out.append(text)
        run.clear()

    def visit(n: Node) -> None:
        for c in n.children:
            if isinstance(c, str) or c.tag not in _BLOCK:
                if isinstance(c, Node) and any(x.tag in _BLOCK for x in c.walk()):
                    visit(c)
                else:
                    run.append(_inline(c, base))
                continue
            flush()
            if re.fullmatch("h[1-6]", c.tag):
                if text := _inline(Node("x", {}, None) if not c.children else c, base).strip():
                    out.append("#" * int(c.tag[1]) + " " + text)
            elif c.tag in ("ul", "ol"):
                items = [_inline(x, base).strip() for x in c.children if isinstance(x, Node) and x.tag == "li"]
                lines = [f"{f'{i}.' if c.tag == 'ol' else '-'} {x}" for i, x in enumerate((x for x in items if x), 1)]
                if lines:
                    out.append("\n".join(lines))
            elif c.tag == "pre":
                code = next((x for x in c.walk() if x.tag == "code"), c)
                lang = next((k[9:] for k in code.attrs.get("class", "").split() if k.startswith("language-")), "")
                raw = "".join(x for x in _texts(c)).strip("\n")
                if raw.strip():
                    out.append(f"```{lang}\n{raw}\n```")
            elif c.tag == "blockquote":
                if text := to_markdown(c, base):
                    out.append("\n".join(f"> {x}" for x in text.split("\n")))
            elif c.tag == "table":
                if rows := _rows(c, base):
                    out.append("\n".join(rows))
            else:
                visit(c)
                flush()
        flush()

    visit(node)
    return "\n\n".join(out)


def _texts(n: Node) -> Iterator[str]:
    for c in n.children:
        if isinstance(c, str):
            yield c
        else:
            yield from _texts(c)


def page_links(root: Node, url: str) -> list[str]:
    """Absolute outbound links in order, each once."""
    out: dict[str, None] = {}
    for n in root.walk():
        href = n.attrs.get("href", "") if n.tag == "a" else ""
        if href and not href.startswith(("#", "javascript:", "mailto:")):
            try:
                full = urljoin(url, href)
            except ValueError:
                continue
            if full.startswith(("http://", "https://")):
                out[full] = None
    return list(out)


def extract_page(url: str, html: str | None) -> dict | None:
    """Title, markdown, words and links of a page; None with under 50 characters of content, or if it cannot be read."""
    if not html:
        return None
    try:
        return _page(url, parse(html))
    except (ValueError, RecursionError, AssertionError):  # a declaration or an address that is not well-formed
        return None


def _page(url: str, root: Node) -> dict | None:
    title = page_title(root, url or "")
    for n in list(root.walk()):
        n.children = [c for c in n.children if isinstance(c, str) or c.tag not in NOISE]
    content = to_markdown(main_content(root), url or "")
    if len(content.strip()) < 50:
        return None
    return {"url": url, "title": title, "content": content, "word_count": len(content.split()), "links": page_links(root, url or ""), "source_type": "web"}


def extract_pages(pages: DataFrame, *keep: str, url: str = "url", html: str = "html") -> DataFrame:
    """One row per page with enough content: ``keep`` columns, then PAGE_SCHEMA."""
    kept = ", ".join(f"{c} {pages.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for row in b.to_dict("records"):
                if page := extract_page(row["_url"], row["_html"]):
                    out.append({c: row[c] for c in keep} | page)
            if out:
                yield pd.DataFrame(out)

    return pages.select(*keep, F.col(url).alias("_url"), F.col(html).alias("_html")).mapInPandas(run, (kept + ", " if kept else "") + PAGE_SCHEMA)


# --- in Catalyst, for scans over many pages -------------------------------------------------------------


def title_tag(html: Column) -> Column:
    """The title element's text, trimmed, '' if there is none."""
    return F.trim(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))


def hrefs(html: Column) -> Column:
    """Link targets in order, with repeats, but fragments, scripts and mail addresses."""
    return F.filter(F.regexp_extract_all(html, F.lit(r'<a\s[^>]*href="([^"]*)"'), 1), lambda h: (h != "") & ~h.rlike("^(#|javascript:|mailto:)"))


def absolute(base: Column, href: Column) -> Column:
    """A link resolved against its page: absolute ones stay, rooted ones get the page's scheme and host, others
    its folder too."""
    root = F.regexp_extract(base, r"^([a-zA-Z][\w+.-]*://[^/?#]*)", 1)
    folder = F.regexp_replace(F.regexp_extract(base, r"^([a-zA-Z][\w+.-]*://[^/?#]*[^?#]*)", 1), r"(?<=[^/:])/[^/]*$", "")
    return F.when(href.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:"), href).when(F.startswith(href, F.lit("/")), F.concat(root, href)).otherwise(F.concat(folder, F.lit("/"), href))
