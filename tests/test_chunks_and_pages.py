import io
import zipfile

import pyarrow as pa

from lodegrain.functions import prompts as P
from lodegrain.operators import chunkers as C
from lodegrain.operators import documents as D
from lodegrain.operators import html as H

PYTHON = '''import os


class Store:
    """Keeps things."""

    def __init__(self):
        self.a = 1

    def get(self, k):
        """Get one."""
        return k

    async def put(self, k):
        return k


def make():
    return Store()
'''


def kinds(path, text, language, **more):
    return [(c["chunk_type"], c["name"]) for c in C.chunk_file(path, text, language, **more)]


def test_python_parts():
    options = C.Options(sizes={"python": (3000, 0)})
    got = [(c.kind, c.name) for c in C.chunk_python(PYTHON, options)]
    assert got == [("module_header", "module_header"), ("class", "Store"), ("method", "get: Get one."), ("method", "put"), ("function", "make")]
    head = next(c for c in C.chunk_python(PYTHON, options) if c.kind == "class").content
    assert "__init__" in head and "def get(...)" in head


def test_markdown_keeps_fences_and_tables_whole():
    text = "---\na: b\n---\n# One\n\n```py\nx = 1\n\ny = 2\n```\n\npara\n\n| a | b |\n|---|---|\n| 1 | 2 |\n"
    got = [(c.kind, c.content.count("\n")) for c in C.chunk_markdown(text, C.Options())]
    assert [k for k, _ in got] == ["code_block", "section", "table"] and "y = 2" in C.chunk_markdown(text, C.Options())[0].content


def test_braces_shell_config_and_edges():
    assert ("function", "run") in [(c.kind, c.name) for c in C.chunk_braces("function run() {\n  if (a) { b('}') }\n}\n", C.Options(), "javascript")]
    assert [c.name for c in C.chunk_shell("A=1\nB=2 # a preamble line\nf() {\n echo\n}\nfunction g {\n echo\n}\n", C.Options()) if c.kind == "function"] == ["f", "g"]
    assert [c.name for c in C.chunk_config("a: 1\n  x: 2\nb: 3\n", C.Options(), "yaml")] == ["a", "b"]
    assert C.chunk_file("e.py", "", "python") == [] and C.chunk_file("x.json", "1" * 60_000, "json") == []
    assert C.brace_change('{ "}" // }') == 1


def test_long_lines_are_split():
    rows = C.chunk_file("a.txt", "word " * 2000, "text")
    assert len(rows) > 4 and all(len(r["content"]) <= 2200 for r in rows)
    assert [r["chunk_index"] for r in rows] == list(range(len(rows))) and rows[1]["prev_chunk_id"] == rows[0]["chunk_id"]


def test_links_and_overviews_as_relations(spark):
    rows = [("d/a.py", i, i, f"n{i}", "function", "c") for i in range(1, 18)]
    df = spark.createDataFrame(rows, "file_path string, start_line int, end_line int, name string, chunk_type string, content string")
    got = C.link_chunks(df).orderBy("chunk_index").collect()
    assert got[0]["prev_chunk_id"] is None and got[1]["prev_chunk_id"] == "a_0" and got[16]["next_chunk_id"] is None and got[0]["total_chunks"] == 17
    assert C.overviews(df).first()["content"].endswith("n15, ... and 2 more")


HTML = '<html><head><title>Page name | Site</title></head><body><nav>menu</nav><article><h1>Head</h1><p>Some <b>bold</b> text with a <a href="/x">link</a> and enough words to count as content of a page, surely.</p><ul><li>one</li><li>two</li></ul><table><tr><th>a</th></tr><tr><td>1|2</td></tr></table><pre><code class="language-py">x = 1</code></pre></article><script>no</script></body></html>'


def test_page_to_markdown():
    p = H.extract_page("https://s.org/d/p", HTML)
    assert p["title"] == "Page name" and "menu" not in p["content"] and p["links"] == ["https://s.org/x"]
    for part in ("# Head", "**bold**", "[link](https://s.org/x)", "- one\n- two", "| 1\\|2 |", "```py\nx = 1\n```"):
        assert part in p["content"]
    assert H.extract_page("u", "<p>short</p>") is None and H.extract_page("u", None) is None


def archive(files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for k, v in files.items():
            z.writestr(k, v)
    return out.getvalue()


W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def test_other_formats(spark):
    docx = archive({"word/document.xml": f'<w:document {W}><w:body><w:p><w:pPr><w:pStyle w:val="Heading2"/></w:pPr><w:r><w:t>Head</w:t></w:r></w:p><w:p><w:r><w:t>Text</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>'})
    xlsx = archive({"xl/workbook.xml": '<workbook><sheets><sheet name="S"/></sheets></workbook>', "xl/worksheets/sheet1.xml": '<worksheet><sheetData><row><c r="A1"><v>1</v></c><c r="C1"><v>3</v></c></row></sheetData></worksheet>'})
    epub = archive({"META-INF/container.xml": '<container><rootfiles><rootfile full-path="o/b.opf"/></rootfiles></container>', "o/b.opf": '<package><metadata><title>Book</title></metadata><manifest><item id="1" href="c.html"/></manifest><spine><itemref idref="1"/></spine></package>', "o/c.html": "<html><body><h1>Ch</h1><p>words</p></body></html>"})
    feed = b"<rss><channel><title>Feed</title><item><title>E</title><link>http://e</link><description>&lt;p&gt;d&lt;/p&gt;</description></item></channel></rss>"
    rows = [("http://h/a.docx", docx), ("http://h/a.xlsx", xlsx), ("http://h/b.epub", epub), ("http://h/f.rss", feed), ("http://h/t.csv", b"a,b\n1,2\n"), ("http://h/r.rtf", rb"{\rtf1{\fonttbl x}Hello brave new world of text\par}"), ("http://h/m.md", b"# Name\ntext that is long enough"), ("http://h/bad.docx", b"no zip"), ("http://h/p", HTML.encode())]
    df = spark.createDataFrame([(u, "", bytearray(b)) for u, b in rows], "url string, content_type string, body binary")
    got = {r["url"].rpartition("/")[2]: r for r in D.extract(df).collect()}
    assert set(got) == {"a.docx", "a.xlsx", "b.epub", "f.rss", "t.csv", "r.rtf", "m.md", "p"}
    assert got["a.docx"]["content"].startswith("## Head\n\nText\n\n| a |") and "| 1 |  | 3 |" in got["a.xlsx"]["content"]
    assert got["b.epub"]["title"] == "Book" and got["b.epub"]["content"] == "# Ch\n\nwords" and "### [E](http://e)\n\nd" in got["f.rss"]["content"]
    assert got["t.csv"]["metadata"] == {"total_rows": "2", "columns": "2"} and got["r.rtf"]["content"] == "Hello brave new world of text" and got["m.md"]["title"] == "Name"


def test_pdf_spans_and_paragraphs(spark):
    spans = [(0, 0, 18.0, False, "Title"), (0, 1, 10.0, True, "Bold head"), (0, 2, 10.0, False, "body text that is by far the most common of all the sizes here"), (0, 3, 10.0, False, "more body")]
    assert "## Title" in D.span_markdown(spans) and "### Bold head" in D.span_markdown(spans)
    assert D.clean_pdf("a broken exam-\nple of\ntext\n\n12\n\nINTRODUCTION\nnext") == "a broken example of text\nINTRODUCTION next"
    df = spark.createDataFrame([(1, p, k, 0, s, b, t) for p, k, s, b, t in spans], "doc_id int, page int, line int, position int, size double, bold boolean, text string")
    assert D.pdf_markdown(df).first()["content"].startswith("## Title")


def test_deep_pages_and_damaged_files_do_not_end_a_run(spark):
    deep = "<html><body>" + "<div>" * 3000 + "<p>" + "words that stay " * 10 + "</p>" + "</div>" * 3000 + "<p>after</p></body></html>"
    page = H.extract_page("http://a.b/c", deep)
    assert page["content"].count("words that stay") == 10 and page["word_count"] >= 30
    assert H.extract_page("http://a.b/c", "<em>" * 5000 + "x" * 80)["content"].strip("*") == "x" * 80
    good = io.BytesIO()
    with zipfile.ZipFile(good, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("word/document.xml", "<document><body><p><r><t>Some text</t></r></p></body></document>" + " " * 5000)
    damaged = bytearray(good.getvalue())
    damaged[60:90] = b"\xff" * 30
    book = io.BytesIO()
    with zipfile.ZipFile(book, "w") as z:
        z.writestr("xl/sharedStrings.xml", "<sst><si><t>a</t></si></sst>")
        z.writestr("xl/workbook.xml", "<workbook><sheets><sheet name='S'/></sheets></workbook>")
        z.writestr("xl/worksheets/sheet1.xml", "<worksheet><sheetData><row><c t='s'><v>99</v></c></row></sheetData></worksheet>")
    rows = [("http://x/a.docx", "", good.getvalue()), ("http://x/b.docx", "", bytes(damaged)), ("http://x/c.xlsx", "", book.getvalue()), ("http://x/d.pdf", "", b"%PDF-1.4 nothing"), ("http://x/e.epub", "", b"PK"), ("http://x/f.pptx", "", None)]
    df = spark.createDataFrame(rows, "url string, content_type string, body binary")
    assert {r["url"] for r in D.extract(df).collect()} == {"http://x/a.docx"}
    seen = {r["url"]: (r["content"], r["error"]) for r in D.extract(df, errors=True).collect()}
    assert seen["http://x/a.docx"][1] is None and "IndexError" in seen["http://x/c.xlsx"][1] and seen["http://x/b.docx"][1]


def test_files_that_cannot_be_parsed_are_cut_as_text(spark):
    rows = [("a.py", "x = " + "-" * 100_000 + "1\n"), ("b.py", PYTHON), ("c.py", "x = " + "(" * 5000), ("d.json", "[" * 20_000), ("e.html", "<div>" * 5000 + "text that is long enough")]
    got = {r["file_path"] for r in C.chunk_files(spark.createDataFrame(rows, "file_path string, content string")).select("file_path").distinct().collect()}
    assert got == {"a.py", "b.py", "c.py", "d.json", "e.html"}


def test_declarations_of_brace_languages():
    def found(language, text):
        return [(c.kind, c.name) for c in C.chunk_braces(text, C.Options(keep_gaps=False), language)]

    js = "export default class Shop {\n}\nexport async function load() {\n}\nfunction* gen() {\n}\nexport const add = async (a, b) => {\n}\nlet old = function () {\n}\nif (x) {\n}\n"
    assert found("javascript", js) == [("class", "Shop"), ("function", "load"), ("function", "gen"), ("arrow_function", "add"), ("function", "old")]
    java = "public final class A {\n  private static final Map<String, int[]> make(int a) {\n  }\n  public A(int b) throws X {\n  }\n  int call(1);\n}\n"
    assert found("java", java) == [("class", "A"), ("method", "make"), ("constructor", "A")]
    assert found("go", "func (s *Set) Add(x int) {\n}\nfunc New() *Set {\n}\ntype Set struct {\n}\n") == [("function", "Add"), ("function", "New"), ("type", "Set")]


def test_a_worker_holds_a_few_files_and_passes_chunks_on(spark, monkeypatch):
    """Files of a batch are turned into chunks a few at a time, and chunks leave before the batch is done."""
    monkeypatch.setattr(C, "CHARS_AT_ONCE", 5000)
    rows = [(f"f{i}.txt", "\n".join(f"line {j} of the file {i}" for j in range(60)), "text") for i in range(200)]
    made = {}
    files = spark.createDataFrame([(r[0], r[1]) for r in rows], "file_path string, content string")
    monkeypatch.setattr(type(files), "mapInArrow", lambda self, f, schema: made.update(f=f, schema=schema))
    C.chunk_files(files)
    batch = pa.RecordBatch.from_pylist([dict(zip(("file_path", "content", "language"), r, strict=True)) for r in rows])
    sizes = [b for b in made["f"](iter([batch]))]
    assert len(sizes) > 20 and max(sum(len(c) for c in b.column(2).to_pylist()) for b in sizes) < 10_000
    got = [r for b in sizes for r in b.to_pylist()]
    assert got == [r for f, text, kind in rows for r in C.chunk_file(f, text, kind)]


def test_excerpts_of_a_large_group_are_not_gathered(spark):
    rows = [(f"d/f{i}.txt", "word " * 300, kind) for i, kind in enumerate(["en"] * 3 + [None] * 2)]
    files = spark.createDataFrame(rows, "path string, content string, language string")
    got = P.corpus_excerpts(files, 900, "language")
    assert {r["path"]: len(r["excerpt"]) for r in got.collect()} == {f"d/f{i}.txt": len(f"### f{i}\n\n") + n + 6 for i, n in enumerate([1199] * 3 + [1500 - 6] * 2)}
    assert "Window" not in got._jdf.queryExecution().optimizedPlan().toString()
