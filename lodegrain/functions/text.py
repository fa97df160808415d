"""Text functions, all as built-in column expressions (they stay in generated code)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ColumnOrName = Column | str


def _col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


# --- tokens ---------------------------------------------------------------------------------------------


def code_tokens(text: ColumnOrName) -> Column:
    """Code-aware tokens: runs of ASCII letters, digits and ``_``, lower-cased; one with underscores is
    followed by its parts, and one in camel case by its humps.  Duplicates stay, in order."""
    # \w is looked up in a table (and is ASCII here), where ranges of characters are tried one by one, at ten times the cost
    spaced = F.regexp_replace(_col(text), r"[^\w ]+", " ")
    words = F.array_remove(F.split(spaced, " "), "")

    def spread(w: Column) -> Column:
        parts = F.filter(F.split(w, "_"), lambda p: p != "")
        humps = F.split(w, "(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])")
        none = F.array().cast("array<string>")
        snake = F.when(w.contains("_") & (F.size(parts) > 1), parts).otherwise(none)
        camel = F.when(F.size(humps) > 1, humps).otherwise(none)
        return F.transform(F.concat(F.array(w), snake, camel), lambda t: F.lower(t))

    # most words have no parts, and are not split; a text without such words needs no function per word at all
    parted = "_|[a-z][A-Z]|[A-Z][A-Z][a-z]"
    each = F.flatten(F.transform(words, lambda w: F.when(w.rlike(parted), spread(w)).otherwise(F.array(F.lower(w)))))
    plain = F.array_remove(F.split(F.lower(spaced), " "), "")
    return F.when(_col(text).rlike(parted), each).otherwise(plain)


def token_counts(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, tokens, terms): how many code tokens a text has, and how many different ones; texts without any are left out."""
    # counted in one lambda, each text is cut once; a filter on what is generated is not run ahead of a dealing of the rows
    counts = F.transform(F.array(code_tokens(text)), lambda t: F.struct(F.size(t).cast("long").alias("tokens"), F.size(F.array_distinct(t)).cast("long").alias("terms")))
    return docs.select(key, F.inline(counts)).where("tokens > 0")


def searchable_text(content: ColumnOrName, name: ColumnOrName, chunk_type: ColumnOrName) -> Column:
    blank = F.lit("")
    return F.concat_ws(" ", F.coalesce(_col(content), blank), F.coalesce(_col(name), blank), F.coalesce(_col(chunk_type), blank))


def word_count(text: ColumnOrName) -> Column:
    """Words between white space; 0 for a null or blank text."""
    trimmed = F.regexp_replace(F.coalesce(_col(text), F.lit("")), r"^\s+|\s+$", "")
    return F.when(trimmed == "", 0).otherwise(F.size(F.split(trimmed, r"\s+")))


def token_estimate(text: ColumnOrName) -> Column:
    """A quarter of the characters, rounded down."""
    return F.floor(F.length(_col(text)) / 4)


def words_to_tokens(words: ColumnOrName) -> Column:
    return F.floor(_col(words) * 4 / 3)


def char_trigrams(text: ColumnOrName) -> Column:
    """The distinct three-character pieces of a text; none under three characters."""
    none = F.array().cast("array<string>")

    def pieces(t: Column) -> Column:
        # a substring is counted out from the text's beginning, so pieces are taken from short runs of it
        runs = F.transform(F.sequence(F.lit(1), F.length(t) - 2, F.lit(48)), lambda i: F.substring(t, i, F.lit(50)))
        every = F.flatten(F.transform(runs, lambda r: F.transform(F.sequence(F.lit(1), F.length(r) - 2), lambda i: F.substring(r, i, F.lit(3)))))
        return F.when(F.length(t) >= 3, F.array_distinct(every)).otherwise(none)

    # as the variable of a lambda the text is made once, not once per piece
    return F.coalesce(F.get(F.transform(F.array(_col(text)), pieces), F.lit(0)), none)


def near_duplicate_text(text: ColumnOrName, limit: int | None = 2000) -> Column:
    """Lower case, white space as one blank, punctuation off, the first ``limit`` characters (None: all), trimmed."""
    t = F.regexp_replace(F.regexp_replace(F.lower(_col(text)), r"(?U)\s+", " "), r"(?U)[^\w\s]", "")
    return F.trim(t if limit is None else F.substring(t, 1, limit))


def jaccard(a: ColumnOrName, b: ColumnOrName) -> Column:
    """Of two arrays as sets; null if either is empty."""
    a, b = _col(a), _col(b)
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def term_recall(found: ColumnOrName, required: ColumnOrName) -> Column:
    required = _col(required)
    return F.when(F.size(required) > 0, F.size(F.array_intersect(_col(found), required)) / F.size(F.array_distinct(required)))


def repetition_ratio(text: ColumnOrName) -> Column:
    """1 - distinct / all words; 0 for a blank text."""
    words = F.filter(F.split(F.coalesce(_col(text), F.lit("")), r"\s+"), lambda w: w != "")
    return F.when(F.size(words) > 0, 1 - F.size(F.array_distinct(words)) / F.size(words)).otherwise(0.0)


# --- vectors --------------------------------------------------------------------------------------------


def dot(a: ColumnOrName, b: ColumnOrName) -> Column:
    return F.aggregate(F.zip_with(_col(a), _col(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def squared_l2(a: ColumnOrName, b: ColumnOrName) -> Column:
    gap = F.zip_with(_col(a), _col(b), lambda x, y: x.cast("double") - y.cast("double"))
    return F.aggregate(gap, F.lit(0.0), lambda s, x: s + x * x)


def cosine(a: ColumnOrName, b: ColumnOrName) -> Column:
    """Null where either vector has length 0."""
    a, b = _col(a), _col(b)
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(size > 0, dot(a, b) / size)


def distance_to_similarity(distance: ColumnOrName) -> Column:
    return 1 / (1 + _col(distance))


# --- names, paths, urls ---------------------------------------------------------------------------------


def slug(text: ColumnOrName, limit: int = 60, default: str = "") -> Column:
    """File-system-safe name: lower case, letters, digits and single hyphens."""
    s = F.regexp_replace(F.regexp_replace(F.lower(_col(text)), r"(?U)^\s+|\s+$", ""), r"(?U)[^\w\s-]", "")
    s = F.regexp_replace(F.regexp_replace(s, r"(?U)[\s_]+", "-"), "-+", "-")
    s = F.substring(F.regexp_replace(s, "^-+|-+$", ""), 1, limit)
    return F.when(s == "", F.lit(default)).otherwise(s)


def session_slug(text: ColumnOrName) -> Column:
    return slug(text, 40, "session")


def normalise_domain(domain: ColumnOrName) -> Column:
    return F.regexp_replace(F.lower(F.trim(_col(domain))), r"^www\.", "")


def url_host(url: ColumnOrName) -> Column:
    """The network location of a url: what stands between ``://`` and the path; '' if there is none."""
    return F.coalesce(F.regexp_extract(_col(url), r"^[a-zA-Z][a-zA-Z0-9+.\-]*://([^/?#]*)", 1), F.lit(""))


def posix_path(path: ColumnOrName) -> Column:
    """Forward slashes, no doubled ones and no leading ``./``."""
    return F.regexp_replace(F.regexp_replace(F.replace(_col(path), F.lit("\\"), F.lit("/")), "(?<!:)/{2,}", "/"), r"^(\./)+", "")


def relative_path(path: ColumnOrName, base: ColumnOrName) -> Column:
    p, b = posix_path(path), F.regexp_replace(posix_path(base), "/+$", "")
    return F.when(F.startswith(p, F.concat(b, F.lit("/"))), F.substr(p, F.length(b) + 2)).otherwise(p)


def file_stem(path: ColumnOrName) -> Column:
    return F.regexp_replace(F.regexp_extract(posix_path(path), "([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")


def file_extension(path: ColumnOrName) -> Column:
    """Lower-case extension with its dot, '' without one."""
    return F.lower(F.regexp_extract(_col(path), r"[^/](\.[^./]+)$", 1))


#: Language by file extension.
LANGUAGES = {
    ".py": "python", ".js": "javascript", ".jsx": "javascript", ".ts": "typescript", ".tsx": "typescript", ".go": "go", ".java": "java",
    ".cpp": "cpp", ".c": "c", ".cs": "csharp", ".rs": "rust", ".rb": "ruby", ".php": "php", ".swift": "swift", ".kt": "kotlin", ".scala": "scala",
    ".md": "markdown", ".markdown": "markdown", ".rst": "restructuredtext", ".txt": "text", ".adoc": "asciidoc", ".asciidoc": "asciidoc",
    ".html": "html", ".htm": "html", ".css": "css", ".sh": "shell", ".bash": "shell", ".zsh": "shell", ".fish": "shell",
    ".json": "json", ".yaml": "yaml", ".yml": "yaml", ".toml": "toml", ".ini": "ini", ".xml": "xml", ".con": "config", ".config": "config",
    ".conf": "config", ".cfg": "config", ".nginx": "config", ".service": "config", ".sql": "sql",
}
#: What speaks for Python (three of them) or JavaScript (one) in a file's first 50 lines.
PYTHON_SIGNS = ("import ", "from ", "def ", "class ", "if __name__", "print(", "len(", "range(", "str(", "int(", "float(", "self.", "__init__", "__main__", "Exception:", "try:", "except:")
JAVASCRIPT_SIGNS = ("function ", "var ", "const ", "let ", "=>")


def detect_language(path: ColumnOrName, content: ColumnOrName) -> Column:
    """By extension, else by a shebang, else by signs in the first 50 lines, else ``unknown``."""
    ext, text = file_extension(path), F.coalesce(_col(content), F.lit(""))
    known = F.create_map(*(F.lit(x) for pair in LANGUAGES.items() for x in pair))
    lines = F.split(text, "\r?\n")
    head = F.concat_ws("\n", F.slice(lines, 1, 50))
    bang = F.lower(F.element_at(lines, 1))
    score = sum((F.when(F.contains(head, F.lit(s)), 1).otherwise(0) for s in PYTHON_SIGNS), F.lit(0))
    script = F.when(bang.contains("python"), "python").when(bang.contains("node") | bang.contains("javascript"), "javascript").when(bang.contains("sh"), "bash")
    has_js = F.lit(False)
    for s in JAVASCRIPT_SIGNS:
        has_js = has_js | F.contains(head, F.lit(s))
    by_content = F.coalesce(F.when(F.startswith(bang, F.lit("#!")), script), F.when(score >= 3, "python").when(has_js, "javascript").otherwise("unknown"))
    return F.coalesce(F.element_at(known, ext), by_content)


# --- ranking and display --------------------------------------------------------------------------------


def score_label(score: ColumnOrName, largest: ColumnOrName | None = None) -> Column:
    """HIGH, GOOD, FAIR, LOW or WEAK, on the scale of fused ranks if the largest score is under 0.1, else on
    that of cosines."""
    s = _col(score)
    ref = s if largest is None else _col(largest)
    scale = lambda *cuts: F.when(s >= cuts[0], "HIGH").when(s >= cuts[1], "GOOD").when(s >= cuts[2], "FAIR").when(s >= cuts[3], "LOW").otherwise("WEAK")
    return F.when(ref < 0.1, scale(0.035, 0.025, 0.018, 0.010)).otherwise(scale(0.7, 0.5, 0.3, 0.1))


def display_lines(content: ColumnOrName, most: int = 10) -> Column:
    """At most about ``most`` lines: the first half, ``...``, the last half."""
    lines, half = F.split(_col(content), "\r?\n"), most // 2
    return F.when(F.size(lines) > most, F.concat_ws("\n", F.slice(lines, 1, half), F.array(F.lit("...")), F.slice(lines, -half, half))).otherwise(F.concat_ws("\n", lines))


def truncate_to_budget(text: ColumnOrName, max_tokens: int, marker: str = "\n[...truncated...]") -> Column:
    t = _col(text)
    return F.when(F.length(t) > max_tokens * 4, F.concat(F.substring(t, 1, max(0, max_tokens * 4 - 20)), F.lit(marker))).otherwise(t)


def compact_number(n: ColumnOrName) -> Column:
    """1234 as 1.2K, 1234567 as 1.2M."""
    n = _col(n)
    return F.when(n >= 1_000_000, F.format_string("%.1fM", n / 1_000_000)).when(n >= 1000, F.format_string("%.1fK", n / 1000)).otherwise(n.cast("string"))


def money(x: ColumnOrName) -> Column:
    return F.format_string("$%.4f", _col(x).cast("double"))


def mask_key(key: ColumnOrName, shown: int = 4) -> Column:
    """Stars but for the first and last ``shown`` characters; all stars for short ones."""
    k = _col(key)
    return F.when(F.length(k) <= 2 * shown, F.repeat(F.lit("*"), F.length(k))).otherwise(F.concat(F.substring(k, 1, shown), F.lit("..."), F.substring(k, -shown, shown)))


def parse_budget_minutes(text: ColumnOrName) -> Column:
    """Minutes of ``2h``, ``30m`` or ``90``; null for anything else."""
    t = F.lower(F.trim(_col(text)))
    n = F.regexp_extract(t, r"^(\d+(?:\.\d+)?)\s*[hm]?$", 1)
    return F.when(n != "", F.when(F.endswith(t, F.lit("h")), n.cast("double") * 60).otherwise(n.cast("double")))


# --- documents, prompts, answers ------------------------------------------------------------------------


def strip_frontmatter(text: ColumnOrName) -> Column:
    """Drop a leading block between ``---`` lines."""
    return F.regexp_replace(_col(text), r"^---\n(?s:.*?)\n---\n", "")


def build_frontmatter(fields: dict[str, Column]) -> Column:
    lines = [F.concat(F.lit(f"{k}: "), F.coalesce(v.cast("string"), F.lit(""))) for k, v in fields.items()]
    return F.concat_ws("\n", F.lit("---"), *lines, F.lit("---"), F.lit(""))


def preprocess_code(code: ColumnOrName, language: ColumnOrName | None = None) -> Column:
    """Trailing blanks and blank lines off, fenced with the language (``python`` if none is given)."""
    lang = F.lit("python") if language is None else _col(language)
    lines = F.filter(F.transform(F.split(F.regexp_replace(_col(code), r"^\s+|\s+$", ""), "\n"), lambda x: F.regexp_replace(x, r"\s+$", "")), lambda x: x != "")
    body = F.concat_ws("\n", lines)
    return F.when((body != "") & (F.coalesce(lang, F.lit("")) != ""), F.concat(F.lit("```"), lang, F.lit("\n"), body, F.lit("\n```"))).otherwise(body)


def embedding_input(text: ColumnOrName, limit: int = 1800) -> Column:
    return F.substring(_col(text), 1, limit)


def embedding_query(query: ColumnOrName) -> Column:
    return F.concat(F.lit("Search for code related to: "), _col(query))


def clean_expansion(answer: ColumnOrName, query: ColumnOrName, max_terms: int = 8) -> Column:
    """The expanded query in a model's answer: unquoted, first line, no punctuation, beginning with the query,
    at most ``max_terms`` words longer than it."""
    q = _col(query)
    a = F.regexp_replace(_col(answer), r"^\s+|\s+$", "")
    a = F.when(F.startswith(a, F.lit('"')) & F.endswith(a, F.lit('"')) & (F.length(a) > 1), F.substr(a, F.lit(2), F.length(a) - 2)).otherwise(a)
    a = F.regexp_replace(F.element_at(F.split(a, "\n"), 1), r"(?U)[^\w\s-]", " ")
    a = F.trim(F.regexp_replace(a, r"(?U)\s+", " "))
    a = F.when(F.startswith(F.lower(a), F.lower(q)), a).otherwise(F.concat(q, F.lit(" "), a))
    return F.concat_ws(" ", F.slice(F.split(F.trim(a), r"\s+"), F.lit(1), word_count(q) + max_terms))


def clean_query_list(answer: ColumnOrName) -> Column:
    """Lines of an answer as queries: numbering stripped, headings, bullets and blank lines dropped."""
    lines = F.transform(F.split(_col(answer), "\n"), lambda x: F.trim(F.regexp_replace(F.trim(x), r"^\d+[.)]\s*", "")))
    return F.filter(lines, lambda x: (x != "") & ~x.rlike("^[#*-]"))


def thinking_part(answer: ColumnOrName) -> Column:
    return F.trim(F.regexp_extract(_col(answer), r"(?s)<think>(.*?)</think>", 1))


def answer_part(answer: ColumnOrName) -> Column:
    return F.regexp_replace(F.regexp_replace(_col(answer), r"(?s)<think>.*?</think>", ""), r"^\s+|\s+$", "")


#: What a model says while it thinks aloud, what it says again and again in doing so, and fillers.
MUSING = ("think", "considering", "actually", "wait", "hmm", "let me")
LOOPING = ("let me think", "i think", "thinking", "consider", "actually", "wait", "hmm", "well")
FILLERS = ("um", "uh", "well", "you know", "like", "basically", "actually", "so", "then", "and", "but", "however")


def _words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def _stutters(words: Column) -> Column:
    """A word four times in a row, whatever punctuation stands before the first and after the last."""
    low = F.transform(words, lambda w: F.lower(w))
    last = F.transform(low, lambda w: F.regexp_extract(w, r"^(\w+)", 1))
    later = lambda x, k: F.slice(x, k + 1, F.size(x))
    rows = F.arrays_zip(F.transform(low, lambda w: F.regexp_extract(w, r"(\w+)$", 1)).alias("a"), later(low, 1).alias("b"), later(low, 2).alias("c"), later(last, 3).alias("d"))
    return F.exists(rows, lambda r: (r["a"] != "") & (r["b"] == r["a"]) & (r["c"] == r["a"]) & (r["d"] == r["a"]))


def response_issue(text: ColumnOrName, elapsed: ColumnOrName | None = None) -> Column:
    """The first fault of a model's answer, null if it has none; in the order too_short, timeout, repetition, thinking,
    rambling, broken JSON.

    Repeats are counted over the answer's words; what patterns remain have no loop over a group, so their
    depth does not grow with the text: an answer of any length is judged.  White space counts as single blanks."""
    t, sec = F.coalesce(_col(text), F.lit("")), F.lit(0.0) if elapsed is None else _col(elapsed)
    flat = F.regexp_replace(t, r"\s+", " ")
    lower, words = F.lower(flat), _words(t)
    thought = t.contains("<think>") & t.contains("</think>")
    said = F.when(thought, _words(F.substr(t, F.instr(t, "</think>") + 8))).otherwise(words)
    times = lambda s: (F.length(lower) - F.length(F.replace(lower, F.lit(s), F.lit("")))) / len(s)
    musing = sum((times(s) for s in MUSING), F.lit(0.0))
    looping = "|".join(f"{p} ?[.,:]* ?{p}" for p in LOOPING)
    # a filler and a blank, then four more blanks before the sentence ends
    filler = rf"(?i)\b(?:{'|'.join(FILLERS)})" + r"\s[^.!?\s]*" * 5
    long_sentences = F.size(F.filter(F.split(t, "[.!?]"), lambda s: F.size(_words(s)) > 50))
    braces = F.regexp_replace(t, "[^{}]+", "")
    field = r'"\w+" ?: ?"[^"]*",? ?'
    return (
        F.when(F.length(F.trim(flat)) < 10, "too_short")
        .when(sec > 120, "timeout")
        .when(_stutters(words), "word_repetition")
        .when(t.rlike(r"(?s)(.{10,50}?)\1\1"), "phrase_repetition")
        .when(~(thought & (F.size(said) < 20)) & (F.size(said) > 10) & (1 - F.size(F.array_distinct(said)) / F.size(said) > 0.7), "high_repetition_ratio")
        .when(lower.rlike(looping), "thinking_loop")
        .when((musing > 5) & (F.size(words) < 200), "excessive_thinking")
        .when(t.rlike(filler), "excessive_filler")
        .when(long_sentences > 2, "excessive_rambling")
        .when(braces.contains("{{{") & t.contains("}"), "broken_json")
        .when(t.contains("{") & t.contains("}") & flat.rlike(field * 4), "json_repetition")
    )


def paper_id(url: ColumnOrName) -> Column:
    """What a paper lookup service takes for a url: its own id, a DOI, an arXiv or PubMed number, else the url."""
    u = _col(url)
    host = normalise_domain(url_host(u))
    path = F.regexp_extract(u, r"^[a-zA-Z][\w+.-]*://[^/?#]*([^?#]*)", 1)
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    last = F.element_at(parts, -1)
    doi = F.regexp_replace(path, "^/+", "")
    digits = F.filter(parts, lambda p: p.rlike("^[0-9]+$"))
    some = lambda c, x: F.when(c, x)
    return (
        F.when(host.contains("semanticscholar.org"), some((F.size(parts) >= 2) & (F.get(parts, F.lit(0)) == "paper"), last))
        .when(host.isin("doi.org", "dx.doi.org"), some(doi != "", F.when(F.startswith(doi, F.lit("10.48550/arXiv.")), F.concat(F.lit("ARXIV:"), F.regexp_replace(doi, r"^10\.48550/arXiv\.", ""))).otherwise(F.concat(F.lit("DOI:"), doi))))
        .when(host.contains("pubmed") | host.contains("ncbi.nlm.nih.gov"), some(F.size(digits) > 0, F.concat(F.lit("PMID:"), F.element_at(digits, -1))))
        .otherwise(F.concat(F.lit("URL:"), u))
    )


def unwrap_redirect(url: ColumnOrName) -> Column:
    """The target of a search engine's redirect link (its ``uddg`` parameter), else the url."""
    u = _col(url)
    target = F.regexp_extract(u, r"[?&]uddg=([^&]+)", 1)
    return F.when(target != "", F.url_decode(target)).otherwise(u)


def _wiki_line(line: Column) -> Column:
    """A list item or a heading of two to five signs in markdown; what follows a heading's end stays."""
    sign = F.regexp_extract(line, "^={2,5}(?!=)", 0)
    n = F.length(sign)
    end = F.position(sign, line, n + 2)  # the title has a character at least
    heading = F.concat(F.repeat(F.lit("#"), n), F.lit(" "), F.trim(F.substr(line, n + 1, end - n - 1)), F.substr(line, end + n))
    return F.when((n > 0) & (end > 0), heading).otherwise(F.regexp_replace(line, r"^\*\s+", "- "))


def wikitext_to_markdown(text: ColumnOrName) -> Column:
    """Templates (five levels), references, comments and tags off; headings, bold, italics and lists in markdown;
    links as their text."""
    t = _col(text)
    for _ in range(5):  # innermost first
        t = F.regexp_replace(t, r"\{\{[^{}]*\}\}", "")
    t = F.regexp_replace(t, r"(?s)<!--.*?-->|<ref\b[^>/]*>.*?</ref>|<[^>]+>", "")
    t = F.regexp_replace(t, r"\[\[(?:[^|\]]+\|)?([^\]]+)\]\]", "$1")  # links between pages, by their label
    t = F.regexp_replace(t, r"\[https?://[^\s\]]+\s*([^\]]*)\]", "$1")
    t = F.concat_ws("\n", F.transform(F.split(t, "\n"), _wiki_line))
    for quotes, mark in (("'''", r"\*\*"), ("''", r"\*")):
        t = F.regexp_replace(t, rf"{quotes}([^\n]+?){quotes}", f"{mark}$1{mark}")
    return F.regexp_replace(F.regexp_replace(t, r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def clean_pdf_text(text: ColumnOrName) -> Column:
    """Hyphenated line ends joined, lines of a paragraph joined, capitals as headings, lone page numbers off."""
    t = F.regexp_replace(_col(text), r"([a-z])-\n([a-z])", "$1$2")
    t = F.regexp_replace(t, r"(?m)^\s*\d{1,4}\s*$", "")
    t = F.regexp_replace(t, r"(?m)^([A-Z][A-Z0-9 ,:&-]{4,})$", "## $1")
    t = F.regexp_replace(t, r"(?<=[a-z,;])\n(?=[a-z])", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(t, "[ \t]+", " "), r"\n{3,}", "\n\n"))


def markdown_row(*cells: ColumnOrName) -> Column:
    """One row of a markdown table; pipes in cells are escaped."""
    return F.concat(F.lit("| "), F.concat_ws(" | ", *(F.replace(F.coalesce(_col(c).cast("string"), F.lit("")), F.lit("|"), F.lit("\\|")) for c in cells)), F.lit(" |"))


def is_embedding_model(name: ColumnOrName) -> Column:
    """Model names that speak of embeddings."""
    return F.lower(_col(name)).rlike("embed|minilm|bge|e5-|nomic|granite-embedding|gte-")
