import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodegrain.functions import prompts as P
from lodegrain.functions import text as T


def one(spark, expr, **values):
    kinds = ", ".join(f"{k} {'string' if isinstance(v, str | None.__class__) else 'double'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], kinds).select(expr.alias("x")).first()["x"]


def plain_tokens(text):
    out = []
    for w in re.findall("[a-zA-Z0-9_]+", text):
        parts = [p for p in w.split("_") if p]
        humps = re.split("(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", w)
        out += [w, *(parts if "_" in w and len(parts) > 1 else []), *(humps if len(humps) > 1 else [])]
    return [w.lower() for w in out]


@settings(max_examples=8, deadline=None)
@given(st.lists(st.text(alphabet="aAbBzZ_1 -ü.", max_size=30), min_size=20, max_size=40))
def test_tokens_are_those_of_a_plain_restatement(spark, texts):
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.code_tokens("t").alias("x")).collect()
    assert all(r["x"] == plain_tokens(r["t"]) for r in got)


def test_tokens_of_known_names(spark):
    assert one(spark, T.code_tokens("t"), t="getHTTPServer my_VarName _x über") == ["gethttpserver", "get", "http", "server", "my_varname", "my", "varname", "my_var", "name", "_x", "ber"]


def test_labels_on_both_scales(spark):
    score = lambda s, m: one(spark, T.score_label("s", "m"), s=s, m=m)
    assert [score(s, 0.7) for s in (0.7, 0.5, 0.3, 0.1, 0.05)] == ["HIGH", "GOOD", "FAIR", "LOW", "WEAK"]
    assert [score(s, 0.05) for s in (0.035, 0.025, 0.018, 0.010, 0.001)] == ["HIGH", "GOOD", "FAIR", "LOW", "WEAK"]


def test_slugs_and_domains(spark):
    assert one(spark, T.slug("t"), t="  Über Größe: a_b -- c! ") == "über-größe-a-b-c"
    assert one(spark, T.session_slug("t"), t="!!!") == "session"
    assert one(spark, T.normalise_domain("t"), t=" WWW.Example.COM ") == "example.com"


def test_budget_words_and_ratio(spark):
    assert one(spark, T.parse_budget_minutes("t"), t="1h") == 60 and one(spark, T.parse_budget_minutes("t"), t="30m") == 30
    assert one(spark, T.parse_budget_minutes("t"), t="90") == 90 and one(spark, T.parse_budget_minutes("t"), t="soon") is None
    assert one(spark, T.word_count("t"), t=None) == 0 and one(spark, T.word_count("t"), t=" a\tb ") == 2
    assert one(spark, T.repetition_ratio("t"), t="a a a b") == 0.5


def test_language_by_extension_shebang_and_signs(spark):
    rows = [("a.py", "", "python"), ("b.TSX", "", "typescript"), ("run", "#!/bin/bash\n", "bash"), ("x", "import os\ndef f():\n  class A:", "python"), ("y", "const a = 1", "javascript"), ("z", "words", "unknown"), ("n", None, "unknown")]
    got = spark.createDataFrame(rows, "p string, c string, want string").withColumn("got", T.detect_language("p", "c")).collect()
    assert all(r["got"] == r["want"] for r in got), got


def test_paper_ids(spark):
    known = {"https://www.semanticscholar.org/paper/T/abc123": "abc123", "https://doi.org/10.1/x": "DOI:10.1/x", "https://doi.org/10.48550/arXiv.2101.00001": "ARXIV:2101.00001", "https://pubmed.ncbi.nlm.nih.gov/123/": "PMID:123", "https://aclanthology.org/P1": "URL:https://aclanthology.org/P1", "https://doi.org/": None}
    got = spark.createDataFrame([(u,) for u in known], "u string").select("u", T.paper_id("u").alias("x")).collect()
    assert {r["u"]: r["x"] for r in got} == known


def test_wikitext(spark):
    text = "{{Infobox {{x}} }}== Head ==\n'''bold''' and ''it'' [[Page|text]] [[Other]] [http://a.b c d]<ref name=x/><ref>no</ref>\n* item\n<!-- gone -->"
    assert one(spark, T.wikitext_to_markdown("t"), t="=== A ===\n==B== c\n=====E=====\n''x'' [https://a.b] [[p|q]]\n\n\n\n==\n* y") == "### A\n## B c\n##### E\n*x*  q\n\n==\n- y"
    assert one(spark, T.wikitext_to_markdown("t"), t=text) == "## Head\n**bold** and *it* text Other c d\n- item"


def test_response_issues(spark):
    plain = " ".join(f"w{i}." for i in range(300))
    known = {
        "short": "too_short", "no no no no no no this is so": "word_repetition", "A fine answer that says what was asked for, in plain words.": None,
        "(yes yes YES, yes) and more of it": None, "he said (yes yes YES yes) and no more.": "word_repetition", "over and over we go; over and over we go; over and over we go; it ends.": "phrase_repetition",
        "z " * 60_000: "word_repetition", "ab cd ef gh. " * 20_000: "phrase_repetition", plain: None, "aa bb cc bb aa cc aa cc bb bb aa cc cc bb aa.": "high_repetition_ratio",
        "<think>" + plain + "</think> Yes. It is.": None, "Good. Hmm, hmm that is odd.": "thinking_loop", "Think. Rethink. Wait. Actually. Thinker. Let me be. Hmm.": "excessive_thinking",
        "It was fine but one two three four.": None, "It was fine but one two three four five.": "excessive_filler", ". ".join(" ".join(f"v{k}x{i}" for i in range(60)) for k in range(3)): "excessive_rambling",
        "It is {a {b {c in the end}": "broken_json", 'Here: {"a": "1", "b" : "2","c":"3",  "d":"4"}': "json_repetition", '{"a": "1", "b": "2", "c": "3"}': None, "well" + " " * 100_000 + "done, as it seems.": "phrase_repetition",
    }
    got = spark.createDataFrame([(u,) for u in known], "u string").select("u", T.response_issue("u").alias("x")).collect()
    assert {r["u"]: r["x"] for r in got} == known


def test_analysis_parser():
    got = P.parse_analysis('COVERED: a, b\nGAPS: c\nCONFIDENCE: high\nQUERIES: "one two", "three"\n- another query')
    assert got == {"covered": ["a", "b"], "gaps": ["c"], "queries": ["one two", "three", "another query"], "confidence": "HIGH"}
    assert P.parse_analysis(None)["confidence"] == "LOW"


def test_excerpts_share_a_budget(spark):
    rows = [("a.md", "---\nk: v\n---\n# Title\n" + "word " * 400), ("b.md", "short")]
    got = {r["path"]: r["excerpt"] for r in P.corpus_excerpts(spark.createDataFrame(rows, "path string, content string"), 10).collect()}
    assert got["a.md"].startswith("### Title\n\n# Title") and got["a.md"].endswith("word [...]") and len(got["a.md"]) < 830
    assert got["b.md"] == "### b\n\nshort"


def test_wider_helpers(spark):
    assert one(spark, T.mask_key("t"), t="abcdefghijkl") == "abcd...ijkl" and one(spark, T.unwrap_redirect("t"), t="//d/?uddg=https%3A%2F%2Fa.b&x") == "https://a.b"
    assert one(spark, T.compact_number(F.col("n")), n=1234.0) == "1.2K" and one(spark, T.display_lines("t", 4), t="1\n2\n3\n4\n5\n6") == "1\n2\n...\n5\n6"


def test_tokens_are_counted_after_the_rows_are_dealt(spark):
    """A filter that is run below the dealing would cut all texts in the few tasks that read them."""
    docs = spark.createDataFrame([(1, "a_b c a_b"), (2, "..."), (3, None), (4, "oneTwo")], "k int, text string")
    got = T.token_counts(docs.repartition(3), "k", "text")
    assert {tuple(r) for r in got.collect()} == {(1, 7, 4), (4, 3, 3)}
    below = got._jdf.queryExecution().optimizedPlan().toString().split("Repartition")[1]
    assert "split" not in below and "Filter" not in below
