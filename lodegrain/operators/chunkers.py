"""Structure-aware chunkers: a file becomes rows of (content, lines, type, name, language, ...).

One file is one unit of work and is bounded in size on admission, so files are chunked where they are
read (``mapInArrow``) and nothing is shuffled.  The chunk links are set in the same pass.
"""

from __future__ import annotations

import ast
import json
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field, replace
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodegrain.functions.text import detect_language

#: Fixed values: (largest, smallest) chunk in characters by language.
SIZES = {
    "python": (3000, 200), "javascript": (2500, 150), "typescript": (2500, 150), "markdown": (2500, 300), "json": (1000, 50), "yaml": (1500, 100), "text": (2000, 200),
    "bash": (1500, 100), "go": (2500, 150), "java": (3000, 200), "html": (3000, 200), "shell": (2000, 100), "css": (2000, 100), "sql": (2500, 150),
}
DEFAULT_SIZE, OVERLAP, JSON_LIMIT = (2000, 150), 200, 50_000
SCHEMA = "file_path string, chunk_id string, content string, start_line int, end_line int, chunk_type string, name string, language string, file_lines int, chunk_index int, total_chunks int, parent_class string, parent_function string, prev_chunk_id string, next_chunk_id string"

#: Files that a task turns into Python objects at a time, and characters of chunks after which it passes them on.
FILES_AT_ONCE, CHARS_AT_ONCE = 16, 1 << 20


@dataclass
class Chunk:
    content: str
    start: int
    end: int
    kind: str
    name: str = ""
    parent_class: str | None = None
    parent_function: str | None = None


@dataclass
class Options:
    sizes: dict[str, tuple[int, int]] = field(default_factory=lambda: dict(SIZES))
    overlap: int = OVERLAP
    #: Keep the lines outside matched blocks of brace languages and shell as chunks of their own.
    keep_gaps: bool = True


def effective_sizes(language: str, size: int, options: Options) -> tuple[int, int]:
    largest, smallest = options.sizes.get(language, DEFAULT_SIZE)
    return (max(largest // 2, 200), 50) if 0 < size < 500 else (largest, smallest)


def skipped(language: str, content: str) -> bool:
    return len(content.strip()) < 5 or (language == "json" and len(content) > JSON_LIMIT)


def _block(lines: list[str], a: int, b: int, kind: str, name: str, **more) -> Chunk:
    """Lines a..b, counted from 1 and both included."""
    return Chunk("\n".join(lines[a - 1 : b]), a, b, kind, name, **more)


def uncovered(lines: list[str], taken: Iterable[tuple[int, int]], kind: str = "module_code", least: int = 20) -> list[Chunk]:
    """Runs of lines outside the taken ranges with more than ``least`` characters."""
    at, out = 1, []
    for a, b in [*sorted(taken), (len(lines) + 1, len(lines) + 1)]:
        if a > at:
            run = _block(lines, at, a - 1, kind, f"{kind}_{at}")
            if len(run.content.strip()) > least:
                out.append(run)
        at = max(at, b + 1)
    return out


# --- Python ---------------------------------------------------------------------------------------------


def chunk_python(content: str, options: Options) -> list[Chunk]:
    """Header, class heads, methods and functions by syntax tree; by indentation where it does not parse."""
    lines = content.split("\n")
    try:
        tree = ast.parse(content)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return _python_by_lines(lines)
    out, taken = [], []
    tops = [n for n in tree.body if isinstance(n, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef)]
    begin = lambda n: min([n.lineno, *(d.lineno for d in n.decorator_list)])
    if tops and begin(tops[0]) > 1:
        head = _block(lines, 1, begin(tops[0]) - 1, "module_header", "module_header")
        if head.content.strip():
            out.append(head)
        taken.append((1, begin(tops[0]) - 1))
    for node in tops:
        taken.append((begin(node), node.end_lineno))
        if isinstance(node, ast.ClassDef):
            out += _python_class(node, lines, None)
        else:
            out.append(_python_function(node, lines, "async_function" if isinstance(node, ast.AsyncFunctionDef) else "function"))
    out += uncovered(lines, taken)
    if not tops:
        out = [_block(lines, 1, len(lines), "module", "module")]
    return sorted(out, key=lambda c: (c.start, c.end))


def _python_function(node, lines: list[str], kind: str, **more) -> Chunk:
    doc = ast.get_docstring(node)
    first = doc.split("\n")[0].strip()[:60] if doc else ""
    name = f"{node.name}: {first}" if first else node.name
    return _block(lines, node.lineno, node.end_lineno, kind, name, **more)


def _python_class(node: ast.ClassDef, lines: list[str], outer: str | None) -> list[Chunk]:
    begin = min([node.lineno, *(d.lineno for d in node.decorator_list)])
    methods = [n for n in node.body if isinstance(n, ast.FunctionDef | ast.AsyncFunctionDef)]
    init = next((m for m in methods if m.name == "__init__"), None)
    first = node.body[0]
    has_doc = isinstance(first, ast.Expr) and isinstance(getattr(first, "value", None), ast.Constant) and isinstance(first.value.value, str)
    head = lines[begin - 1 : (first.end_lineno if has_doc else node.lineno)]
    if init:
        head = [*head, "", *lines[init.lineno - 1 : init.end_lineno]]
    others = [m for m in methods if m is not init]
    head += [f"    {'async ' if isinstance(m, ast.AsyncFunctionDef) else ''}def {m.name}(...)" for m in others[:5]]
    if len(others) > 5:
        head.append(f"    ... and {len(others) - 5} more")
    out = [Chunk("\n".join(head), begin, init.end_lineno if init else (first.end_lineno if has_doc else node.lineno), "class", node.name, outer)]
    for m in others:
        start = min([m.lineno, *(d.lineno for d in m.decorator_list)])
        named = _python_function(m, lines, "method", parent_class=node.name)
        out.append(replace(named, content="\n".join(lines[start - 1 : m.end_lineno]), start=start))
    for inner in node.body:
        if isinstance(inner, ast.ClassDef):
            out += _python_class(inner, lines, node.name)
    return out


def _python_by_lines(lines: list[str]) -> list[Chunk]:
    heads = [(i, m) for i, x in enumerate(lines, 1) if (m := re.match(r"(?:async\s+)?(def|class)\s+(\w+)", x))]
    out = []
    for k, (i, m) in enumerate(heads):
        stop = heads[k + 1][0] - 1 if k + 1 < len(heads) else len(lines)
        end = i
        for j in range(i + 1, stop + 1):
            if lines[j - 1].strip():
                if not lines[j - 1][:1].isspace() and not lines[j - 1].startswith((")", "]", "}")):
                    break
                end = j
        out.append(_block(lines, i, end, "class" if m[1] == "class" else "function", m[2]))
    return sorted([*out, *uncovered(lines, [(c.start, c.end) for c in out])], key=lambda c: c.start) if out else [_block(lines, 1, len(lines), "module", "module")]


# --- brace languages and shell --------------------------------------------------------------------------

_NAME = r"([A-Za-z_$][\w$]*)"


def _after(modifiers: str, *forms: str) -> str:
    """A declaration: any of the blank-separated ``modifiers``, in any order and number, and one of the ``forms``."""
    words = "|".join(modifiers.split())
    return rf"\s*(?:(?:{words})\s+)*(?:{'|'.join(forms)})"


_JS_BINDING = rf"(?:const|let|var)\s+{_NAME}\s*(?::[^=]+)?=\s*(?:async\b\s*)?"
_JAVA_WORDS = "public private protected static final abstract synchronized native default strictfp sealed"
_JAVA_SEEN = r"(?=[^({]*\b(?:public|private|protected)\b)"
_JAVA_BODY = r"\s*\([^)]*\)[^;]*\{"
#: What begins a declaration on a line, by language: its name is the pattern's one group.
_BRACES: dict[str, list[tuple[str, str]]] = {
    "javascript": [
        (_after("export default abstract declare", rf"class\s+{_NAME}"), "class"),
        (_after("export default async declare", rf"function\b\s*\*?\s*{_NAME}"), "function"),
        (_after("export declare", _JS_BINDING + r"\([^)]*\)(?:\s*:[^=]+)?\s*=>"), "arrow_function"),
        (_after("export declare", _JS_BINDING + r"function\b"), "function"),
    ],
    "go": [(rf"func\b\s*(?:\([^)]*\)\s*)?{_NAME}", "function"), (rf"type\s+{_NAME}(?:\[[^\]]*\])?\s+(?:struct|interface)\b", "type")],
    "java": [
        (_after(_JAVA_WORDS, rf"(?:class|interface|enum|record)\s+{_NAME}"), "class"),
        (_JAVA_SEEN + _after(_JAVA_WORDS, rf"(?:<[^(]*>\s*)?(?!(?:{'|'.join(_JAVA_WORDS.split())})\b)[\w.]+(?:<[^(]*>)?(?:\[\])*\s+{_NAME}{_JAVA_BODY}"), "method"),
        (_JAVA_SEEN + _after(_JAVA_WORDS, rf"{_NAME}{_JAVA_BODY}"), "constructor"),
    ],
}
_BRACES["typescript"] = _BRACES["javascript"]


def brace_change(line: str) -> int:
    """Opened less closed braces of a line, outside strings and line comments."""
    depth, quote, i = 0, "", 0
    while i < len(line):
        c = line[i]
        if quote:
            i += c == "\\"
            quote = "" if c == quote else quote
        elif c in "\"'`":
            quote = c
        elif line.startswith("//", i):
            break
        else:
            depth += (c == "{") - (c == "}")
        i += 1
    return depth


def block_end(lines: list[str], start: int) -> int:
    """Last line of the brace block that begins at line ``start`` (from 1)."""
    depth, opened, comment = 0, False, False
    for j in range(start, len(lines) + 1):
        x = lines[j - 1]
        if comment:
            if "*/" not in x:
                continue
            x, comment = x.split("*/", 1)[1], False
        x = re.sub(r"/\*.*?\*/", "", x)
        if "/*" in x:
            x, comment = x.split("/*", 1)[0], True
        depth += brace_change(x)
        opened = opened or "{" in x
        if opened and depth <= 0:
            return j
        if not opened and j > start + 2:
            return start
    return len(lines)


def chunk_braces(content: str, options: Options, language: str) -> list[Chunk]:
    lines, out, taken, i, classes = content.split("\n"), [], [], 1, []
    while i <= len(lines):
        for pattern, kind in _BRACES[language]:
            m = re.match(pattern, lines[i - 1])
            if m and m[1] not in ("if", "for", "while", "switch", "catch", "return", "new"):
                end = block_end(lines, i)
                owner = next((n for a, b, n in classes if a < i <= b), None)
                out.append(_block(lines, i, end, kind, m[1], parent_class=owner))
                taken.append((i, end))
                if kind == "class" and language == "java":
                    classes.append((i, end, m[1]))  # its methods become chunks too
                else:
                    i = end
                break
        i += 1
    return sorted([*out, *(uncovered(lines, taken) if options.keep_gaps else [])], key=lambda c: (c.start, c.end)) if out else chunk_generic(content, options, language)


def chunk_shell(content: str, options: Options) -> list[Chunk]:
    """Functions in either form; what comes before the first is the preamble."""
    lines, out, i = content.split("\n"), [], 1
    while i <= len(lines):
        m = re.match(r"^\s*(?:function\s+([\w-]+)\s*(?:\(\))?|([\w-]+)\s*\(\))\s*\{?\s*$", lines[i - 1])
        if m:
            end = block_end(lines, i)
            out.append(_block(lines, i, end, "function", m[1] or m[2]))
            i = end
        i += 1
    if not out:
        return chunk_generic(content, options, "shell")
    gaps = uncovered(lines, [(c.start, c.end) for c in out], "module_code")
    if gaps and gaps[0].start < out[0].start:
        gaps[0] = replace(gaps[0], kind="module_header", name="preamble")
    return sorted([*out, *(gaps if options.keep_gaps else gaps[:1])], key=lambda c: c.start)


# --- prose, markup, configuration -----------------------------------------------------------------------


def chunk_generic(content: str, options: Options, language: str) -> list[Chunk]:
    """Cut at a blank line once the smallest size is reached, at the largest size, and at the end."""
    largest, smallest = effective_sizes(language, len(content), options)
    lines, out, held, size, start = content.split("\n"), [], [], 0, 1
    for i, x in enumerate(lines, 1):
        held.append(x)
        size += len(x) + 1
        if (not x.strip() and size >= smallest) or size >= largest or i == len(lines):
            text = "\n".join(held)
            if text.strip():
                out.append(Chunk(text, start, i, "code_block", f"block_{len(out) + 1}"))
            held, size, start = [], 0, i + 1
    return out


def _markdown_parts(content: str) -> Iterator[tuple[str, str, int, int]]:
    """(kind, text, first line, last line) of fenced blocks, tables and paragraphs."""
    lines, i = content.split("\n"), 0
    while i < len(lines):
        x = lines[i]
        if m := re.match(r"^\s*(```+|~~~+)", x):
            j = i + 1
            while j < len(lines) and not lines[j].strip().startswith(m[1]):
                j += 1
            j = min(j, len(lines) - 1)
            yield "code_block", "\n".join(lines[i : j + 1]), i + 1, j + 1
            i = j + 1
        elif x.lstrip().startswith("|") and i + 1 < len(lines) and re.match(r"^\s*\|[\s:|-]+\|?\s*$", lines[i + 1]):
            j = i
            while j + 1 < len(lines) and lines[j + 1].lstrip().startswith("|"):
                j += 1
            yield "table", "\n".join(lines[i : j + 1]), i + 1, j + 1
            i = j + 1
        elif x.strip():
            j = i
            while j + 1 < len(lines) and lines[j + 1].strip() and not re.match(r"^\s*(```|~~~)", lines[j + 1]) and not (lines[j + 1].lstrip().startswith("|") and j + 2 < len(lines) and re.match(r"^\s*\|[\s:|-]+\|?\s*$", lines[j + 2])):
                j += 1
            yield "paragraph", "\n".join(lines[i : j + 1]), i + 1, j + 1
            i = j + 1
        else:
            i += 1


def chunk_markdown(content: str, options: Options) -> list[Chunk]:
    """Sections by heading, cut at the largest size; fenced blocks and tables stay whole, on their own."""
    shift = 0
    if m := re.match(r"^---\n.*?\n---\n", content, re.S):
        content, shift = content[m.end() :], m[0].count("\n")
    largest, _ = effective_sizes("markdown", len(content), options)
    out: list[Chunk] = []
    held: list[tuple[str, int, int]] = []
    title = ""

    def flush() -> None:
        if held:
            text = "\n\n".join(t for t, _, _ in held)
            out.append(Chunk(text, held[0][1], held[-1][2], "section" if title else "document", title or "document"))
            held.clear()

    for kind, text, a, b in _markdown_parts(content):
        a, b = a + shift, b + shift
        if kind != "paragraph":
            lone = held and len(held) == 1 and re.match(r"^#{1,6}\s", held[0][0]) and "\n" not in held[0][0]
            if lone:  # a heading that stands alone goes with what follows
                text, a = f"{held[0][0]}\n\n{text}", held[0][1]
                held.clear()
            else:
                flush()
            out.append(Chunk(text, a, b, kind, title or kind))
            continue
        if m := re.match(r"^(#{1,6})\s+(.+)", text):
            flush()
            title = m[2].split("\n")[0].strip()
        elif held and sum(len(t) for t, _, _ in held) + len(text) > largest:
            flush()
        held.append((text, a, b))
    flush()
    return out


class _Page(HTMLParser):
    """Text runs of a page in order: headings, tables, preformatted blocks and the rest."""

    DROP = {"script", "style", "nav", "footer"}
    BREAK = {"p", "div", "li", "section", "article", "br", "tr", "ul", "ol", "blockquote"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts: list[tuple[str, str]] = []
        self.stack: list[str] = []
        self.text: list[str] = []

    def flush(self, kind: str = "section") -> None:
        text = "".join(self.text)
        text = text.strip("\n") if kind == "code_block" else re.sub(r"[ \t]*\n\s*", "\n", re.sub(r"[ \t]+", " ", text)).strip()
        if text.strip():
            self.parts.append((kind, text))
        self.text = []

    def handle_starttag(self, tag, attrs):
        if tag in self.DROP or self.stack and self.stack[0] in self.DROP:
            if tag in self.DROP:
                self.stack.insert(0, tag)
            return
        if tag in ("h1", "h2", "h3", "h4", "h5", "h6", "table", "pre") and not self.stack:
            self.flush()
            self.stack.append(tag)
        elif tag in ("td", "th"):
            self.text.append(" | ")
        elif tag in self.BREAK:
            self.text.append("\n")

    def handle_endtag(self, tag):
        if self.stack and self.stack[0] == tag:
            self.stack.pop(0)
            if tag in self.DROP:
                return
            self.flush("heading" if tag[0] == "h" else "table" if tag == "table" else "code_block")
        elif tag in self.BREAK:
            self.text.append("\n")

    def handle_data(self, data):
        if not (self.stack and self.stack[0] in self.DROP):
            self.text.append(data)


def chunk_html(content: str, options: Options) -> list[Chunk]:
    page = _Page()
    page.feed(content)
    page.close()
    page.flush()
    out, title, line = [], "", 1
    for kind, text in page.parts:
        n = text.count("\n") + 1
        if kind == "heading":
            title = text.replace("\n", " ")
        elif kind == "section" and out and out[-1].kind == "section" and out[-1].name == (title or "section"):
            out[-1] = replace(out[-1], content=f"{out[-1].content}\n\n{text}", end=line + n - 1)
        else:
            out.append(Chunk(f"{title}\n\n{text}" if title and kind == "section" else text, line, line + n - 1, kind, title or kind))
        line += n
    return out


def chunk_config(content: str, options: Options, language: str) -> list[Chunk]:
    """JSON as one; a section per ``[name]`` or top-level key; else a single one."""
    lines = content.split("\n")
    if language == "json":
        try:
            name = ", ".join(list(json.loads(content))[:5]) if isinstance(json.loads(content), dict) else "json"
        except ValueError:
            name = "json"
        return [_block(lines, 1, len(lines), "config", name or "json")]
    head = re.compile(r"^\[+([^\]]+)\]+\s*$" if language in ("toml", "ini", "config") else r"^([A-Za-z_][\w.-]*)\s*:" if language == "yaml" else r"(?!)")
    starts = [(i, m[1]) for i, x in enumerate(lines, 1) if (m := head.match(x))]
    if not starts:
        return [_block(lines, 1, len(lines), "config", "config")]
    out = [_block(lines, 1, starts[0][0] - 1, "config_section", "header")] if any(x.strip() for x in lines[: starts[0][0] - 1]) else []
    for k, (i, name) in enumerate(starts):
        out.append(_block(lines, i, starts[k + 1][0] - 1 if k + 1 < len(starts) else len(lines), "config_section", name.strip()))
    return out


# --- size, overview, links ------------------------------------------------------------------------------


def _pack(parts: list[tuple[str, int]], largest: int, overlap: int, glue: str) -> list[tuple[str, int, int]]:
    out, held, size = [], [], 0
    for text, line in parts:
        if held and size + len(text) + len(glue) > largest:
            body = glue.join(t for t, _ in held)
            out.append((body, held[0][1], held[-1][1]))
            tail = body[-overlap:] if overlap else ""
            held, size = ([(tail, line)], len(tail)) if tail and len(tail) < largest // 2 else ([], 0)
        held.append((text, line))
        size += len(text) + len(glue)
    if held:
        out.append((glue.join(t for t, _ in held), held[0][1], held[-1][1]))
    return out


def split_large(c: Chunk, largest: int, overlap: int) -> list[Chunk]:
    """By lines with an overlap; by sentences where a piece is still too large; last by hard cuts at blanks."""
    lines = c.content.split("\n")
    packed = _pack([(x, c.start + i) for i, x in enumerate(lines)], largest, overlap, "\n")
    if any(len(t) > 1.1 * largest for t, _, _ in packed):
        sentences = re.split(r"(?<=[.!?])\s+", c.content)
        packed = [(t, c.start, c.end) for t, _, _ in _pack([(s, c.start) for s in sentences], largest, overlap, " ")]
    out = []
    for t, a, b in packed:
        while len(t) > 1.1 * largest:
            cut = t.rfind(" ", largest // 2, largest)
            cut = cut if cut > 0 else largest
            out.append((t[:cut], a, b))
            t = t[cut:].lstrip()
        if t.strip():
            out.append((t, a, b))
    return [replace(c, content=t, start=a, end=min(b, max(a, c.end)), name=c.name if len(out) == 1 else f"{c.name}_part{i}") for i, (t, a, b) in enumerate(out, 1)]


def enforce_sizes(chunks: list[Chunk], language: str, size: int, options: Options) -> list[Chunk]:
    """Split what is too large; merge what is too small into the one before, unless either is a section."""
    largest, smallest = effective_sizes(language, size, options)
    out: list[Chunk] = []
    for c in chunks:
        for p in split_large(c, largest, options.overlap) if len(c.content) > largest else [c]:
            if out and len(p.content) < smallest and "section" not in (p.kind, out[-1].kind) and len(out[-1].content) + len(p.content) < largest:
                out[-1] = replace(out[-1], content=f"{out[-1].content}\n{p.content}", end=max(out[-1].end, p.end))
            else:
                out.append(p)
    return out


def overview(path: str, language: str, chunks: list[Chunk], file_lines: int) -> Chunk:
    """Names by type, fifteen of each."""
    by: dict[str, list[str]] = {}
    for c in chunks:
        by.setdefault(c.kind, []).append(c.name)
    rows = [f"File: {path}", f"Language: {language}", f"Lines: {file_lines}"]
    for kind, names in by.items():
        more = [f"... and {len(names) - 15} more"] if len(names) > 15 else []
        rows.append(f"{kind}: " + ", ".join([*names[:15], *more]))
    return Chunk("\n".join(rows), 1, file_lines, "file_overview", path.rsplit("/", 1)[-1])


def chunk_file(path: str, content: str, language: str, options: Options | None = None) -> list[dict]:
    """Rows of SCHEMA for one file; none for one that is skipped."""
    options = options or Options()
    if skipped(language, content):
        return []
    by: dict[str, Callable[[], list[Chunk]]] = {
        "python": lambda: chunk_python(content, options), "markdown": lambda: chunk_markdown(content, options), "html": lambda: chunk_html(content, options),
        "shell": lambda: chunk_shell(content, options), "bash": lambda: chunk_shell(content, options),
        **{n: (lambda n=n: chunk_braces(content, options, n)) for n in _BRACES}, **{n: (lambda n=n: chunk_config(content, options, n)) for n in ("json", "yaml", "toml", "ini", "config", "xml")},
    }
    chunks = by.get(language, lambda: chunk_generic(content, options, language))()
    chunks = enforce_sizes([c for c in chunks if c.content.strip()], language, len(content), options)
    if not chunks:
        return []
    n = content.count("\n") + 1
    chunks = [overview(path, language, chunks, n), *chunks]
    stem = path.rsplit("/", 1)[-1].rsplit(".", 1)[0]
    ids = [f"{stem}_{i}" for i in range(len(chunks))]
    return [
        {
            "file_path": path, "chunk_id": ids[i], "content": c.content, "start_line": c.start, "end_line": c.end, "chunk_type": c.kind, "name": c.name or f"chunk_{i}", "language": language,
            "file_lines": n, "chunk_index": i, "total_chunks": len(chunks), "parent_class": c.parent_class, "parent_function": c.parent_function,
            "prev_chunk_id": ids[i - 1] if i else None, "next_chunk_id": ids[i + 1] if i + 1 < len(ids) else None,
        }
        for i, c in enumerate(chunks)
    ]


def safe_chunks(path: str, content: str, language: str, options: Options) -> list[dict]:
    """Chunks of a file; one whose structure cannot be read (nested too deep, say) is cut as plain text."""
    try:
        return chunk_file(path, content, language, options)
    except Exception:  # noqa: BLE001  whatever a file holds, it must not end a run over many
        return chunk_file(path, content, "text", options)


def chunk_files(files: DataFrame, options: Options | None = None) -> DataFrame:
    """Chunks of (file_path, content) rows; null contents have none.  A batch is chunked a few files at a time, so a
    worker's memory does not grow with the number of files or of their chunks."""
    options = options or Options()
    kinds = pa.schema([(n, pa.int32() if t == "int" else pa.string()) for n, t in (c.split(" ") for c in SCHEMA.split(", "))])
    rows = files.where("content is not null").select("file_path", "content", detect_language("file_path", "content").alias("language"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size = [], 0
        for b in batches:
            for begin in range(0, b.num_rows, FILES_AT_ONCE):
                for x in b.slice(begin, FILES_AT_ONCE).to_pylist():
                    out += (made := safe_chunks(x["file_path"], x["content"], x["language"], options))
                    size += sum(len(r["content"]) for r in made)
                    if size >= CHARS_AT_ONCE:
                        yield pa.RecordBatch.from_pylist(out, kinds)
                        out, size = [], 0
        if out:
            yield pa.RecordBatch.from_pylist(out, kinds)

    return rows.mapInArrow(run, SCHEMA)


def link_chunks(chunks: DataFrame) -> DataFrame:
    """Set chunk_index, total_chunks and the ids of the neighbours of (file_path, start_line, ...) rows, relationally."""
    from pyspark.sql import Window as W

    w = W.partitionBy("file_path")
    o = w.orderBy("start_line", "end_line")
    out = chunks.withColumn("chunk_index", (F.row_number().over(o) - 1).cast("int")).withColumn("total_chunks", F.count("*").over(w).cast("int"))
    name = F.concat(F.regexp_extract("file_path", r"([^/]+?)(?:\.[^./]*)?$", 1), F.lit("_"), F.col("chunk_index"))
    out = out.withColumn("chunk_id", name)
    o = w.orderBy("chunk_index")
    return out.withColumn("prev_chunk_id", F.lag("chunk_id").over(o)).withColumn("next_chunk_id", F.lead("chunk_id").over(o))


def overviews(chunks: DataFrame) -> DataFrame:
    """One row per file: names by type, fifteen of each, relationally."""
    by = chunks.groupBy("file_path", "chunk_type").agg(F.transform(F.array_sort(F.collect_list(F.struct("start_line", "name"))), lambda s: s["name"]).alias("names"))
    more = F.when(F.size("names") > 15, F.array(F.format_string("... and %d more", F.size("names") - 15))).otherwise(F.array().cast("array<string>"))
    line = F.concat("chunk_type", F.lit(": "), F.concat_ws(", ", F.concat(F.slice("names", 1, 15), more)))
    return by.select("file_path", "chunk_type", line.alias("line")).groupBy("file_path").agg(F.concat_ws("\n", F.transform(F.array_sort(F.collect_list(F.struct("chunk_type", "line"))), lambda s: s["line"])).alias("content"))
