"""Other formats to markdown: PDF spans, plain text, tables, office files, books, feeds and site pages.

Each extractor takes a url and the fetched bytes.  Office formats are zip archives of XML and are read with the
standard library.  ``extract`` routes in Catalyst and runs the extractor where the bytes are.
"""

from __future__ import annotations

import csv
import io
import re
import xml.etree.ElementTree as ET
import zipfile
from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from pathlib import PurePosixPath
from urllib.parse import urlparse

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodegrain.operators import html as H
from lodegrain.sources.web import extractor

TABLE_ROWS, FEED_ENTRIES, ENTRY_CHARS = 200, 50, 500
SCHEMA = "url string, title string, content string, word_count int, links array<string>, source_type string, metadata map<string,string>"


def _page(url: str, title: str, content: str, kind: str, links: Sequence[str] = (), **meta) -> dict:
    return {"url": url, "title": title, "content": content.strip(), "word_count": len(content.split()), "links": list(links), "source_type": kind, "metadata": {k: str(v) for k, v in meta.items() if v not in (None, "")}}


def _stem(url: str) -> str:
    return PurePosixPath(urlparse(url).path).stem or urlparse(url).netloc


# --- PDF ------------------------------------------------------------------------------------------------


def span_markdown(spans: Sequence[tuple[int, int, float, bool, str]]) -> str:
    """Markdown of (page, line, size, bold, text) spans in order: sizes over 1.15 times that of most characters
    are headings (three levels), short bold lines at a block's beginning are third-level ones."""
    sizes: Counter = Counter()
    for _, _, size, _, text in spans:
        if text.strip():
            sizes[round(size, 1)] += len(text.strip())
    if not sizes:
        return ""
    body = sizes.most_common(1)[0][0]
    level = {s: k for k, s in enumerate(sorted((s for s in sizes if s > body * 1.15), reverse=True)[:3], 2)}
    lines: dict[tuple[int, int], list] = {}
    for page, line, size, bold, text in spans:
        held = lines.setdefault((page, line), ["", None, False])
        held[0] += text
        if text.strip():
            held[1:] = [round(size, 1), bold]
    pages: dict[int, list[str]] = {}
    opened = True
    for (page, _), (text, size, bold) in lines.items():
        if page not in pages:
            pages[page], opened = [], True
        plain = text.strip()
        if not plain:
            continue
        heading = level.get(size) or (3 if bold and size == body and len(plain) < 100 and opened else 0)
        pages[page] += ["", "#" * heading + " " + plain, ""] if heading else [text.rstrip()]
        opened = bool(heading)
    return "\n\n***\n\n".join(t for t in ("\n".join(x) for x in pages.values()) if t.strip())


def join_paragraphs(text: str) -> str:
    """Lines put together to paragraphs; one ends at a blank line, a heading, or where a sentence of more than 80
    characters ends and the next line begins like a new one."""
    out: list[str] = []
    para = ""
    for line in [*text.split("\n"), ""]:
        s = line.strip()
        alone = s.startswith("#") or s == "***"
        if para and (not s or alone or (para[-1] in ".!?\"')\u201d" and (s[0].isupper() or s[0] in "\"\u2018\u201c(-\u2022\u2013\u2014") and len(para) > 80)):
            out += [para, ""]
            para = ""
        if alone:
            out += [line, ""]
        elif s:
            para = f"{para} {s}" if para else s
    return "\n".join(out)


_CAPITALS = re.compile(r"[A-Z][A-Z\s,&:;'\-]{3,}")


def clean_pdf(text: str) -> str:
    """Line ends rejoined, paragraphs rebuilt, lines of capitals as headings, lone page numbers off."""
    lines = []
    for line in join_paragraphs(re.sub(r"([a-z])-\n([a-z])", r"\1\2", text)).split("\n"):
        line = re.sub(" {2,}", " ", line.rstrip())
        s = line.strip()
        title = not s.startswith("#") and 5 <= len(s) <= 80 and _CAPITALS.fullmatch(s) and sum(map(str.isalpha, s)) > len(s) * 0.5
        lines += ["", f"## {s}", ""] if title else [line]
    text = re.sub(r"\n\s*\d{1,4}\s*\n", "\n", "\n".join(lines))
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"\n{4,}", "\n\n***\n\n", text)).strip()


def pdf_markdown(spans: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, content) from a table of spans (key, page, line, position, size, bold, text), one row per document.
    A document is one unit of work, as its sizes decide what is a heading."""
    kind = spans.schema[key].dataType.simpleString()

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["page", "line", "position"])
        body = span_markdown(list(rows[["page", "line", "size", "bold", "text"]].itertuples(index=False, name=None)))
        return pd.DataFrame({key: [rows[key].iloc[0]], "content": [clean_pdf(body)]})

    return spans.groupBy(key).applyInPandas(run, f"{key} {kind}, content string")


# --- text, tables, feeds --------------------------------------------------------------------------------


def markdown_page(url: str, raw: bytes) -> dict | None:
    """Text as it is; the title is the first line's heading or, if short, the line itself, else the file's name."""
    text = raw.decode("utf-8", errors="replace")
    if len(text.strip()) < 20:
        return None
    first = text.strip().split("\n", 1)[0].strip()
    title = first.lstrip("#").strip() if first.startswith("#") else first if len(first) < 200 else ""
    return _page(url, title or _stem(url), text, "markdown")


def markdown_table(rows: Sequence[Sequence[str]]) -> str:
    line = lambda r: "| " + " | ".join(str(c if c is not None else "").strip().replace("|", "\\|") for c in r) + " |"
    return "\n".join([line(rows[0]), line(["---"] * len(rows[0])), *map(line, rows[1:])]) if rows else ""


def csv_page(url: str, raw: bytes, delimiter: str = ",") -> dict | None:
    rows = list(csv.reader(io.StringIO(raw.decode("utf-8", errors="replace")), delimiter=delimiter))
    if not rows:
        return None
    return _page(url, _stem(url), markdown_table(rows[:TABLE_ROWS]), "csv", total_rows=len(rows), columns=len(rows[0]), truncated_at=TABLE_ROWS if len(rows) > TABLE_ROWS else None)


def _local(e: ET.Element) -> str:
    return e.tag.rpartition("}")[2]


def _named(e: ET.Element, *names: str) -> Iterator[ET.Element]:
    return (x for x in e.iter() if _local(x) in names)


def _first(e: ET.Element, name: str) -> str:
    found = next((x for x in e if _local(x) == name), None)
    return "" if found is None else "".join(found.itertext()).strip()


def _plain(text: str) -> str:
    return H.parse(text).text() if "<" in text else text


def feed_page(url: str, raw: bytes) -> dict | None:
    """Entries of an RSS or Atom feed, fifty at most, with date, author and the beginning of the text."""
    try:
        root = ET.fromstring(raw)
    except ET.ParseError:
        return None
    channel = next(_named(root, "channel"), root)
    entries = list(_named(root, "item", "entry"))
    title = _first(channel, "title")
    if not entries and not title:
        return None

    def link(e: ET.Element) -> str:
        return next((x.get("href") or (x.text or "").strip() for x in e if _local(x) == "link" and x.get("rel", "alternate") == "alternate"), "")

    parts = [f"*{d}*\n" for d in [_first(channel, "description") or _first(channel, "subtitle")] if d] + [f"**Site:** [{x}]({x})\n" for x in [link(channel)] if x]
    for e in entries[:FEED_ENTRIES]:
        name, to = _first(e, "title") or "Untitled", link(e)
        author = next((_first(x, "name") or "".join(x.itertext()).strip() for x in e if _local(x) in ("author", "creator")), "")
        about = " | ".join(x for x in (_first(e, "pubDate") or _first(e, "published") or _first(e, "updated"), author and f"by {author}") if x)
        text = _plain(_first(e, "encoded") or _first(e, "content") or _first(e, "description") or _first(e, "summary"))
        text = text[:ENTRY_CHARS] + "..." if len(text) > ENTRY_CHARS else text
        parts.append("\n".join(x for x in (f"### [{name}]({to})" if to else f"### {name}", f"*{about}*" if about else "", f"\n{text}" if text else "") if x))
    return _page(url, title or _stem(url), "\n\n".join(parts), "rss", [x for x in map(link, entries[:FEED_ENTRIES]) if x], entry_count=len(entries), feed_type=_local(root)) if parts else None


# --- office files and books -----------------------------------------------------------------------------


#: Bytes that an archive may unpack to.
LARGEST_UNPACKED = 256 * 1024 * 1024


def _open(raw: bytes) -> zipfile.ZipFile | None:
    """An archive, None for other data; one that would unpack to more than LARGEST_UNPACKED is refused."""
    try:
        z = zipfile.ZipFile(io.BytesIO(raw))
    except zipfile.BadZipFile:
        return None
    if sum(x.file_size for x in z.infolist()) > LARGEST_UNPACKED:
        raise ValueError("the archive unpacks to too much")
    return z


def _core(z: zipfile.ZipFile) -> dict[str, str]:
    if "docProps/core.xml" not in z.namelist():
        return {}
    names = {"title": "title", "creator": "author", "created": "created", "modified": "modified", "lastModifiedBy": "last_modified_by", "subject": "subject", "category": "category"}
    return {names[_local(x)]: (x.text or "").strip() for x in ET.fromstring(z.read("docProps/core.xml")) if _local(x) in names and x.text}


def _word_text(p: ET.Element) -> str:
    return "".join(x.text or "" if _local(x) == "t" else "\t" if _local(x) == "tab" else "" for x in p.iter())


def docx_page(url: str, raw: bytes) -> dict | None:
    """Headings, lists, paragraphs and tables in order."""
    z = _open(raw)
    if z is None or "word/document.xml" not in z.namelist():
        return None
    body, out = next(_named(ET.fromstring(z.read("word/document.xml")), "body")), []
    for e in body:
        if _local(e) == "tbl":
            rows = [[" ".join(_word_text(c).split()) for c in r if _local(c) == "tc"] for r in e if _local(r) == "tr"]
            out.append(markdown_table([r for r in rows if r]))
        elif _local(e) == "p" and (text := _word_text(e).strip()):
            style = next((v for x in _named(e, "pStyle") for k, v in x.attrib.items() if k.endswith("}val")), "")
            m = re.match(r"[Hh]eading ?(\d)", style)
            prefix = "# " if style == "Title" else "#" * min(6, int(m[1])) + " " if m else "- " if "List" in style or next(_named(e, "numPr"), None) is not None else ""
            out.append(prefix + text)
    meta = _core(z)
    content = "\n\n".join(x for x in out if x)
    return _page(url, meta.pop("title", "") or _stem(url), content, "docx", **meta) if content else None


def xlsx_page(url: str, raw: bytes) -> dict | None:
    """A table per sheet, 200 rows at most of each."""
    z = _open(raw)
    if z is None or "xl/workbook.xml" not in z.namelist():
        return None
    texts = ["".join(x.text or "" for x in _named(s, "t")) for s in ET.fromstring(z.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in z.namelist() else []
    names = [s.get("name") for s in _named(ET.fromstring(z.read("xl/workbook.xml")), "sheet")]
    files = sorted((n for n in z.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", n)[0]))
    out, total = [], 0
    for name, file in zip(names, files, strict=False):
        rows = []
        for r in _named(ET.fromstring(z.read(file)), "row"):
            cells: list[str] = []
            for c in r:
                letters = re.match("[A-Z]+", c.get("r", ""))
                at = 0
                for x in letters[0] if letters else "":
                    at = at * 26 + ord(x) - 64
                cells += [""] * (at - 1 - len(cells))
                value = next((x.text or "" for x in _named(c, "v")), "".join(x.text or "" for x in _named(c, "t")))
                cells.append(texts[int(value)] if c.get("t") == "s" and value else value)
            rows.append(cells)
        total += len(rows)
        width = max(map(len, rows), default=0)
        if width:
            out.append(f"## {name}\n\n" + markdown_table([r + [""] * (width - len(r)) for r in rows[:TABLE_ROWS]]))
    return _page(url, _core(z).get("title") or _stem(url), "\n\n".join(out), "xlsx", sheets=len(names), total_rows=total) if out else None


def pptx_page(url: str, raw: bytes) -> dict | None:
    """A section per slide, its texts, tables and notes."""
    z = _open(raw)
    number = lambda n: int(re.search(r"(\d+)\.xml$", n)[1])
    slides = sorted((n for n in z.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=number) if z else []
    out = []
    for n in slides:
        root, parts = ET.fromstring(z.read(n)), []
        for shape in _named(root, "sp"):
            text = "\n".join(t for p in _named(shape, "p") if (t := "".join(x.text or "" for x in _named(p, "t")).strip()))
            kind = next((x.get("type", "") for x in _named(shape, "ph")), "")
            parts += [f"### {text}" if kind in ("title", "ctrTitle") else text] if text else []
        for t in _named(root, "tbl"):
            rows = [["".join(x.text or "" for x in _named(c, "t")) for c in r if _local(c) == "tc"] for r in t if _local(r) == "tr"]
            parts.append(markdown_table([r for r in rows if r]))
        note = f"ppt/notesSlides/notesSlide{number(n)}.xml"
        if note in z.namelist() and (text := " ".join(x.text or "" for x in _named(ET.fromstring(z.read(note)), "t")).strip()):
            parts.append(f"> {text}")
        out.append(f"## Slide {number(n)}\n\n" + "\n\n".join(parts))
    meta = _core(z) if z else {}
    return _page(url, meta.pop("title", "") or _stem(url), "\n\n".join(out), "pptx", slides=len(slides), **meta) if out else None


def epub_page(url: str, raw: bytes) -> dict | None:
    """Chapters in reading order."""
    z = _open(raw)
    if z is None or "META-INF/container.xml" not in z.namelist():
        return None
    opf = next(x.get("full-path") for x in _named(ET.fromstring(z.read("META-INF/container.xml")), "rootfile"))
    book = ET.fromstring(z.read(opf))
    files = {x.get("id"): str(PurePosixPath(opf).parent / x.get("href")) for x in _named(book, "item")}
    chapters = [H.to_markdown(H.parse(z.read(files[x.get("idref")]).decode("utf-8", errors="replace"))) for x in _named(book, "itemref") if files.get(x.get("idref")) in z.namelist()]
    meta = {_local(x): (x.text or "").strip() for x in next(_named(book, "metadata"), []) if _local(x) in ("title", "creator", "language", "publisher", "date")}
    content = "\n\n***\n\n".join(c for c in chapters if c.strip())
    return _page(url, meta.pop("title", "") or _stem(url), content, "epub", chapters=len(chapters), **meta) if content else None


_RTF = re.compile(r"\\([a-z]{1,32})(-?\d{1,10})? ?|\\'([0-9a-f]{2})|\\([^a-z])|([{}])|[\r\n]+|(.)", re.I | re.S)


def rtf_page(url: str, raw: bytes) -> dict | None:
    """The text of the visible groups."""
    out, stack, hidden = [], [], False
    for word, value, byte, symbol, brace, char in _RTF.findall(raw.decode("latin-1")):
        if brace == "{":
            stack.append(hidden)
        elif brace == "}":
            hidden = stack.pop() if stack else False
        elif symbol == "*" or word in ("fonttbl", "colortbl", "stylesheet", "info", "pict"):
            hidden = True
        elif not hidden:
            if word in ("par", "line", "sect", "page"):
                out.append("\n")
            elif word == "tab":
                out.append("\t")
            elif word == "u" and value:
                out.append(chr(int(value) % 65536))
            elif byte:
                out.append(bytes.fromhex(byte).decode("cp1252", errors="replace"))
            elif symbol in ("{", "}", "\\", "~"):
                out.append(" " if symbol == "~" else symbol)
            elif char:
                out.append(char)
    text = "".join(out).strip()
    return _page(url, text.split("\n", 1)[0][:100] or _stem(url), text, "rtf") if len(text) >= 20 else None


# --- site pages -----------------------------------------------------------------------------------------


def _find(root: H.Node, test: Callable[[H.Node], bool]) -> H.Node | None:
    return next((n for n in root.walk() if test(n)), None)


def _has(n: H.Node, *classes: str) -> bool:
    return set(classes) <= set(n.attrs.get("class", "").split())


def arxiv_page(url: str, raw: bytes) -> dict | None:
    """Title, authors, date, subjects and abstract of a paper's page; full articles as any page."""
    text = raw.decode("utf-8", errors="replace")
    if urlparse(url).path.startswith("/html/"):
        page = H.extract_page(url, text)
        return page and page | {"source_type": "arxiv", "metadata": {}}
    root = H.parse(text)
    part = lambda test, label: re.sub(rf"^{label}:?\s*", "", n.text()) if (n := _find(root, test)) else ""
    title = part(lambda n: n.tag == "h1" and _has(n, "title"), "Title")
    authors, day = part(lambda n: _has(n, "authors"), "Authors"), part(lambda n: _has(n, "dateline"), "")
    subjects, abstract = part(lambda n: _has(n, "subjects"), ""), part(lambda n: n.tag == "blockquote" and _has(n, "abstract"), "Abstract")
    if not abstract:
        return None
    lines = [f"**{k}:** {v}" for k, v in (("Authors", authors), ("Submitted", day), ("Subjects", subjects)) if v]
    return _page(url, title or _stem(url), "\n".join([*lines, "", "## Abstract", "", abstract]), "arxiv", authors=authors, subjects=subjects)


def github_page(url: str, raw: bytes) -> dict | None:
    """A repository's description, topics and README, or the code of a file view."""
    root, parts = H.parse(raw.decode("utf-8", errors="replace")), [p for p in urlparse(url).path.split("/") if p]
    title = "/".join(parts[:2])
    readme = _find(root, lambda n: n.tag == "article" and _has(n, "markdown-body"))
    if readme:
        about = _find(root, lambda n: n.tag == "p" and _has(n, "f4", "my-3"))
        topics = [n.text() for n in root.walk() if n.tag == "a" and _has(n, "topic-tag")]
        head = [f"*{about.text()}*"] if about else []
        head += [f"**Topics:** {', '.join(topics)}"] if topics else []
        return _page(url, title, "\n\n".join([*head, H.to_markdown(readme, url)]), "github")
    lines = [n.text("") for n in root.walk() if n.tag == "td" and _has(n, "blob-code")]
    if not lines and (area := _find(root, lambda n: n.tag == "textarea" and n.attrs.get("id") == "read-only-cursor-text-area")):
        lines = "".join(c for c in area.children if isinstance(c, str)).split("\n")
    if lines:
        return _page(url, f"{title}: {parts[-1]}", "```\n" + "\n".join(lines) + "\n```", "github")
    page = H.extract_page(url, raw.decode("utf-8", errors="replace"))
    return page and page | {"source_type": "github", "metadata": {}}


def generic_page(url: str, raw: bytes) -> dict | None:
    page = H.extract_page(url, raw.decode("utf-8", errors="replace"))
    return page and page | {"metadata": {}}


def pdf_page(url: str, raw: bytes) -> dict | None:
    """Needs a PDF reader, which is optional; without one a PDF gives no page."""
    try:
        import pymupdf
    except ImportError:
        return None
    spans = []
    with pymupdf.open(stream=raw, filetype="pdf") as doc:
        meta = doc.metadata or {}
        for p, page in enumerate(doc):
            lines = (line for b in page.get_text("dict")["blocks"] for line in b.get("lines", ()))
            spans += [(p, k, s["size"], bool(s["flags"] & 16), s["text"]) for k, line in enumerate(lines) for s in line["spans"]]
    content = clean_pdf(span_markdown(spans))
    return _page(url, meta.get("title") or _stem(url), content, "pdf", author=meta.get("author")) if content else None


def spreadsheet_page(url: str, raw: bytes) -> dict | None:
    tabs = urlparse(url).path.lower().endswith(".tsv")
    return xlsx_page(url, raw) if raw[:2] == b"PK" else csv_page(url, raw, "\t" if tabs else ",")


EXTRACTORS: dict[str, Callable[[str, bytes], dict | None]] = {"arxiv": arxiv_page, "github": github_page, "pdf": pdf_page, "docx": docx_page, "spreadsheet": spreadsheet_page, "pptx": pptx_page, "epub": epub_page, "rtf": rtf_page, "rss": feed_page, "markdown": markdown_page, "generic": generic_page}


def extract(fetched: DataFrame, *keep: str, extractors: dict[str, Callable[[str, bytes], dict | None]] | None = None, errors: bool = False) -> DataFrame:
    """Pages (SCHEMA, after the columns ``keep``) of (url, content_type, body) rows; what gives no page is left
    out, and so is what an extractor fails on, whatever the failure.  With ``errors`` there is a column ``error``, null
    for pages, and each failure has a row with it and the url."""
    table = EXTRACTORS | (extractors or {})
    kept = "".join(f"{c} {fetched.schema[c].dataType.simpleString()}, " for c in keep)
    blank = {f.split()[0]: None for f in SCHEMA.split(", ")}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for row in b.to_dict("records"):
                try:
                    page, why = table[row["_by"]](row["_url"], bytes(row["_body"])), None
                except Exception as e:  # noqa: BLE001  outside data: a damaged file must not end the run
                    page, why = None, f"{type(e).__name__}: {e}"
                if page or (why and errors):
                    out.append({c: row[c] for c in keep} | blank | (page or {"url": row["_url"]}) | ({"error": why} if errors else {}))
            if out:
                yield pd.DataFrame(out)

    rows = fetched.where("url is not null and body is not null").select(*keep, F.col("url").alias("_url"), extractor(F.col("url"), F.col("content_type")).alias("_by"), F.col("body").cast("binary").alias("_body"))
    return rows.mapInPandas(run, kept + SCHEMA + (", error string" if errors else ""))
