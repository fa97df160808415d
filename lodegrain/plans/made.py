"""More queries of the catalogue: files, pages, answers and addresses made from the test tables, and plain relational ones.

What is made has a known structure, which the SQL states from the table on its own terms: the SQL never sees the
made text, only the rows that it was made from.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodegrain.functions import text as T
from lodegrain.operators import analytics as A
from lodegrain.operators import chunkers as C
from lodegrain.operators import corpus as N
from lodegrain.operators import crawl as S
from lodegrain.operators import documents as D
from lodegrain.operators import index as I
from lodegrain.operators import retrieval as R
from lodegrain.operators.run_log import RunLog, counted
from lodegrain.plans.catalogue import lines, query, rounds, scrape_log, table
from lodegrain.sources import files as files_source
from lodegrain.sources import site_apis, web
from lodegrain.sources.workspace import discard, stage, work_path

PAD = "x" * 240


def texts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text is not null")


def md5(c: Column) -> Column:
    return F.md5(c.cast("binary"))


def nations(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nation")


def made_files(rows: DataFrame, by: str, order: str, parts: Column, suffix: str, head: str = "") -> DataFrame:
    """(file_path, content): a file per group, its parts in order with a blank line between them."""
    body = F.concat_ws("\n", F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), parts.alias("part")))), lambda x: x["part"]))
    return rows.groupBy(by).agg(body.alias("body")).select(F.concat(F.lit("made/"), F.col(by).cast("string"), F.lit(suffix)).alias("file_path"), F.concat(F.lit(head), F.col("body")).alias("content"))


def text_of(*pieces: str | Column) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in pieces))


# --- texts ----------------------------------------------------------------------------------------------


@query("SELECT doc_id, md5(coalesce(text, '') || ' ' || coalesce(source, '') || ' ' || coalesce(lang, '')) AS text_md5 FROM documents")
def r1_searchable_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", md5(T.searchable_text("text", "source", "lang")).alias("text_md5"))


@query("WITH l AS (SELECT doc_id, string_split_regex(text, '\\r?\\n') AS x FROM documents WHERE text IS NOT NULL) SELECT doc_id, md5(array_to_string(CASE WHEN len(x) > 4 THEN x[1:2] || ['...'] || x[len(x) - 1:len(x)] ELSE x END, chr(10))) AS shown_md5 FROM l")
def r19_display_lines(spark: SparkSession, d: str) -> DataFrame:
    return texts(spark, d).select("doc_id", md5(T.display_lines("text", 4)).alias("shown_md5"))


@query("SELECT doc_id, md5('---' || chr(10) || 'id: ' || doc_id || chr(10) || 'lang: ' || coalesce(lang, '') || chr(10) || '---' || chr(10) || text) AS with_md5, md5(text) AS without_md5 FROM documents WHERE text IS NOT NULL")
def n3_frontmatter(spark: SparkSession, d: str) -> DataFrame:
    made = F.concat(T.build_frontmatter({"id": F.col("doc_id"), "lang": F.col("lang")}), "text")
    return texts(spark, d).select("doc_id", md5(made).alias("with_md5"), md5(T.strip_frontmatter(made)).alias("without_md5"))


@query("SELECT doc_id, md5(substr(text, 1, 1800)) AS input_md5, 'Search for code related to: ' || coalesce(lang, '') AS asked FROM documents WHERE text IS NOT NULL")
def n15_embedding_texts(spark: SparkSession, d: str) -> DataFrame:
    return texts(spark, d).select("doc_id", md5(T.embedding_input("text")).alias("input_md5"), T.embedding_query(F.coalesce("lang", F.lit(""))).alias("asked"))


@query("""WITH n AS (SELECT n_nationkey AS k, lower(n_name) AS n FROM nation)
SELECT k, CASE k % 3 WHEN 0 THEN n || ' trade goods and ports' WHEN 1 THEN n || ' ships rivers' ELSE n || ' a b c d e f g h' END AS expanded FROM n""")
def n16_expansions(spark: SparkSession, d: str) -> DataFrame:
    """Answers of a model: quoted, with punctuation and more lines, without the query, or too long."""
    n = F.lower("n_name")
    answer = F.when(F.col("n_nationkey") % 3 == 0, text_of('"', n, ' trade, goods; and   ports!"\nmore')).when(F.col("n_nationkey") % 3 == 1, F.lit("  ships, rivers\n")).otherwise(text_of(n, " a b c d e f g h i j k"))
    return nations(spark, d).select(F.col("n_nationkey").alias("k"), T.clean_expansion(answer, n).alias("expanded"))


@query("""WITH l AS (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(trim(x), '^\\d+[.)]\\s*', ''))) AS x FROM documents WHERE text IS NOT NULL)
SELECT doc_id, CAST(len(list_filter(x, lambda v: v <> '' AND NOT regexp_matches(v, '^[#*-]'))) AS INTEGER) AS n, md5(array_to_string(list_filter(x, lambda v: v <> '' AND NOT regexp_matches(v, '^[#*-]')), '|')) AS queries_md5 FROM l""")
def n18_query_lists(spark: SparkSession, d: str) -> DataFrame:
    found = T.clean_query_list("text")
    return texts(spark, d).select("doc_id", F.size(found).alias("n"), md5(F.concat_ws("|", found)).alias("queries_md5"))


@query("SELECT conv_id, turn, md5(trim(text)) AS thought_md5, role || ' says' AS answer FROM conversations WHERE text IS NOT NULL")
def n20_thinking(spark: SparkSession, d: str) -> DataFrame:
    made = text_of("<think>", F.col("text"), "</think>\n\n", F.col("role"), " says \n")
    return table(spark, d, "conversations").where("text is not null").select("conv_id", "turn", md5(T.thinking_part(made)).alias("thought_md5"), T.answer_part(made).alias("answer"))


@query("SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN c_custkey * 60.0 WHEN 1 THEN c_custkey * 1.0 WHEN 2 THEN c_custkey * 1.0 WHEN 3 THEN (c_custkey + 0.5) * 60 END AS minutes FROM customer")
def n21_time_budgets(spark: SparkSession, d: str) -> DataFrame:
    k, key = F.col("c_custkey") % 5, F.col("c_custkey").cast("string")
    made = F.when(k == 0, F.concat(key, F.lit("h"))).when(k == 1, F.concat(F.lit(" "), key, F.lit(" M"))).when(k == 2, key).when(k == 3, F.concat(key, F.lit(".5H"))).otherwise(F.concat(key, F.lit("d")))
    return table(spark, d, "customer").select("c_custkey", T.parse_budget_minutes(made).alias("minutes"))


@query("""WITH n AS (SELECT o_orderkey AS k, o_orderkey * 100 + 37 AS n, o_totalprice AS p FROM orders)
SELECT k, CASE WHEN n >= 1000000 THEN printf('%.1fM', n / 1000000) WHEN n >= 1000 THEN printf('%.1fK', n / 1000) ELSE CAST(n AS VARCHAR) END AS short, printf('$%.4f', p) AS cost FROM n""")
def n22_short_numbers(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), T.compact_number(F.col("o_orderkey") * 100 + 37).alias("short"), T.money("o_totalprice").alias("cost"))


@query("SELECT doc_id, 'src/' || coalesce(source, 'none') || '/doc.' || doc_id || '.TXT' AS path, coalesce(source, 'none') || '/doc.' || doc_id || '.TXT' AS below, 'doc.' || doc_id AS stem, '.txt' AS extension FROM documents")
def n23_paths(spark: SparkSession, d: str) -> DataFrame:
    made = text_of(".\\src\\\\", F.coalesce("source", F.lit("none")), "//doc.", F.col("doc_id"), ".TXT")
    return table(spark, d, "documents").select("doc_id", T.posix_path(made).alias("path"), T.relative_path(made, F.lit("./src/")).alias("below"), T.file_stem(made).alias("stem"), T.file_extension(made).alias("extension"))


@query("SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'https://www.youtube.com/watch?v=id' || page_id ELSE url END AS long, CASE page_id % 3 WHEN 0 THEN 'stackoverflow' WHEN 1 THEN 'math' ELSE 'askubuntu' END AS site FROM pages")
def n25_site_addresses(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("page_id") % 3
    made = F.when(k == 0, text_of("https://youtu.be/id", F.col("page_id"))).otherwise(F.col("url"))
    host = F.when(k == 0, "www.StackOverflow.com").when(k == 1, "math.stackexchange.com").otherwise("askubuntu.com")
    return table(spark, d, "pages").select("page_id", web.video_url(made).alias("long"), web.question_site(host).alias("site"))


@query("SELECT n_nationkey, '| ' || n_name || '\\|x |  | ' || n_regionkey || ' |' AS line FROM nation")
def n26_table_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = nations(spark, d).select("n_nationkey", F.concat("n_name", F.lit("|x")).alias("a"), F.lit(None).cast("string").alias("b"), F.col("n_regionkey").alias("c"))
    return rows.select("n_nationkey", T.markdown_row("a", "b", "c").alias("line"))


@query("SELECT c_custkey, CASE WHEN length(k) <= 8 THEN repeat('*', length(k)) ELSE k[1:4] || '...' || k[-4:] END AS masked FROM (SELECT c_custkey, substr(md5(CAST(c_custkey AS VARCHAR)), 1, CAST(c_custkey % 20 AS INTEGER)) AS k FROM customer)")
def n27_masked_keys(spark: SparkSession, d: str) -> DataFrame:
    key = F.substring(F.md5(F.col("c_custkey").cast("string").cast("binary")), F.lit(1), (F.col("c_custkey") % 20).cast("int"))
    return table(spark, d, "customer").select("c_custkey", T.mask_key(key).alias("masked"))


_TURNS = "w AS (SELECT conv_id, turn, list_distinct(list_filter(string_split(lower(text), ' '), lambda x: x <> '')) AS w FROM conversations WHERE text IS NOT NULL)"


@query("WITH " + _TURNS + """ SELECT a.conv_id, a.turn, CASE WHEN len(a.w) > 0 AND len(b.w) > 0 THEN round(len(list_intersect(a.w, b.w)) / len(list_distinct(a.w || b.w)), 9) END AS jaccard,
CASE WHEN len(b.w) > 0 THEN round(len(list_intersect(a.w, b.w)) / len(b.w), 9) END AS recall FROM w a JOIN w b ON a.conv_id = b.conv_id AND a.turn = b.turn + 1""")
def n29_term_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Words of each turn against those of the turn before."""
    words = table(spark, d, "conversations").where("text is not null").select("conv_id", "turn", F.filter(F.split(F.lower("text"), " "), lambda x: x != "").alias("w"))
    both = words.join(words.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("w").alias("v")), ["conv_id", "turn"])
    return both.select("conv_id", "turn", F.round(T.jaccard("w", "v"), 9).alias("jaccard"), F.round(T.term_recall("w", "v"), 9).alias("recall"))


@query("SELECT n_nationkey, '## ' || n_name || chr(10) || '**bold** and *it* ' || n_name || ' of region link' || chr(10) || '- item ' || n_regionkey AS markdown FROM nation")
def x17_wikitext(spark: SparkSession, d: str) -> DataFrame:
    name = F.col("n_name")
    made = text_of("{{Infobox|x={{y|", name, "}}}}== ", name, " ==\n'''bold''' and ''it'' [[Page_", name, "|", name, "]]<ref name=a>no [[x]]</ref> of [[region]] [https://a.b/c link]<ref name=x/>\n* item ", F.col("n_regionkey"), "<!-- gone\n -->")
    return nations(spark, d).select("n_nationkey", T.wikitext_to_markdown(made).alias("markdown"))


@query("""SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'abc' || page_id WHEN 1 THEN 'DOI:10.1/x' || page_id WHEN 2 THEN 'ARXIV:2101.' || page_id WHEN 3 THEN 'PMID:' || page_id WHEN 4 THEN NULL ELSE 'URL:https://aclanthology.org/P' || page_id END AS paper FROM pages""")
def x18_paper_ids(spark: SparkSession, d: str) -> DataFrame:
    k, i = F.col("page_id") % 6, F.col("page_id")
    made = (
        F.when(k == 0, text_of("https://www.semanticscholar.org/paper/Title/abc", i)).when(k == 1, text_of("https://doi.org/10.1/x", i)).when(k == 2, text_of("https://doi.org/10.48550/arXiv.2101.", i))
        .when(k == 3, text_of("https://pubmed.ncbi.nlm.nih.gov/", i, "/")).when(k == 4, F.lit("https://dx.doi.org/")).otherwise(text_of("https://aclanthology.org/P", i))
    )
    return table(spark, d, "pages").select("page_id", T.paper_id(made).alias("paper"))


@query("SELECT page_id, url AS target FROM pages WHERE url IS NOT NULL")
def s16_redirects(spark: SparkSession, d: str) -> DataFrame:
    """Redirect links of a search page, unwrapped; every other link is direct."""
    wrapped = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("//links.example/l/?kh=1&uddg="), F.url_encode("url"), F.lit("&rut=x"))).otherwise(F.col("url"))
    return table(spark, d, "pages").where("url is not null").select("page_id", T.unwrap_redirect(wrapped).alias("target"))


# --- files ----------------------------------------------------------------------------------------------


@query("""SELECT doc_id, CASE doc_id % 8 WHEN 0 THEN 'python' WHEN 1 THEN 'typescript' WHEN 2 THEN 'python' WHEN 3 THEN 'bash' WHEN 4 THEN 'python' WHEN 5 THEN 'javascript' WHEN 6 THEN 'unknown' ELSE 'markdown' END AS language FROM documents""")
def k1_languages(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id") % 8
    path = F.when(k == 0, "a/b.py").when(k == 1, "c.TSX").when(k == 7, "d.md").otherwise("bare")
    body = F.when(k == 2, "#!/usr/bin/env python3\n").when(k == 3, "#!/bin/sh\n").when(k == 4, "import os\ndef f():\n    self.x = 1").when(k == 5, "let a = 1").when(k == 6, "some words")
    return table(spark, d, "documents").select("doc_id", T.detect_language(path, body).alias("language"))


@query("""SELECT doc_id, CASE doc_id % 7 WHEN 0 THEN n_chars * 100 <= 1000000 WHEN 1 THEN false WHEN 2 THEN true WHEN 3 THEN false WHEN 4 THEN true WHEN 5 THEN false ELSE false END AS admitted,
CASE doc_id % 7 WHEN 0 THEN n_chars * 100 <= 1048576 WHEN 4 THEN false WHEN 2 THEN true ELSE false END AS watched FROM documents WHERE n_chars IS NOT NULL""")
def s2_admission(spark: SparkSession, d: str) -> DataFrame:
    """By size, by an excluded folder, by a whole name, by extension, by a look into a bare file, by a hidden name."""
    k = F.col("doc_id") % 7
    path = F.when(k == 0, "src/a.py").when(k == 1, "environment/a.py").when(k == 2, "docs/README").when(k == 3, "bin/a.exe").when(k == 4, "bin/run").when(k == 5, "bin/blob").otherwise("src/.hidden")
    body = F.when(k == 4, "#!/bin/sh\necho").otherwise("plain words").cast("binary")
    size = F.when(k == 0, F.col("n_chars") * 100).otherwise(F.lit(10))
    return table(spark, d, "documents").where("n_chars is not null").select("doc_id", files_source.admitted(path, size, body).alias("admitted"), files_source.watchable(path, size).alias("watched"))


@query("""SELECT 'shop/pics/p' || p_partkey || '.png' AS file_path, '[Image: p' || p_partkey || '.png] pics/p' || p_partkey || '.png (' || CAST(CAST(round_even(p_size * 700 / 1024.0, 0) AS INTEGER) AS VARCHAR) || 'KB)' AS content FROM part""")
def s5_image_records(spark: SparkSession, d: str) -> DataFrame:
    made = table(spark, d, "part").select(text_of("shop/pics/p", F.col("p_partkey"), ".png").alias("file_path"), (F.col("p_size") * 700).cast("long").alias("length"))
    return files_source.image_records(made).select("file_path", "content")


_RANKED = "n AS (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS j FROM nation)"


@query("WITH " + _RANKED + """ SELECT 'made/' || n_regionkey || '.py' AS file_path, 'function' AS chunk_type, 'f_' || n_nationkey || ': Makes ' || n_name || '.' AS name, CAST(3 + 10 * j AS INTEGER) AS start_line, CAST(5 + 10 * j AS INTEGER) AS end_line, NULL AS parent_class FROM n
UNION ALL SELECT 'made/' || n_regionkey || '.py', 'class', 'C' || n_nationkey, CAST(7 + 10 * j AS INTEGER), CAST(9 + 10 * j AS INTEGER), NULL FROM n
UNION ALL SELECT 'made/' || n_regionkey || '.py', 'method', 'm', CAST(10 + 10 * j AS INTEGER), CAST(11 + 10 * j AS INTEGER), 'C' || n_nationkey FROM n""")
def k4_python_chunks(spark: SparkSession, d: str) -> DataFrame:
    """A file per region with a function and a class per nation, by their places in the syntax tree."""
    k, name = F.col("n_nationkey"), F.col("n_name")
    part = text_of("def f_", k, "(a):\n", '    """Makes ', name, '."""\n', f'    return "{PAD}"\n\n', "class C", k, f':\n    """{PAD}"""\n    def __init__(self): self.x = "{PAD}"\n    def m(self):\n        return "{PAD}"\n')
    made = made_files(nations(spark, d), "n_regionkey", "n_nationkey", part, ".py", "import os\n\n")
    return C.chunk_files(made).where("chunk_type in ('function', 'class', 'method')").select("file_path", "chunk_type", "name", "start_line", "end_line", "parent_class")


@query("WITH " + _RANKED + """, k(suffix, kind, before) AS (VALUES ('.js', 'function', 'g_'), ('.go', 'function', 'G'), ('.sh', 'function', 's_'))
SELECT 'made/' || n_regionkey || suffix AS file_path, kind AS chunk_type, before || n_nationkey AS name, CAST(1 + 4 * j AS INTEGER) AS start_line, CAST(3 + 4 * j AS INTEGER) AS end_line FROM n, k""")
def k10_declarations(spark: SparkSession, d: str) -> DataFrame:
    """Functions of brace languages and of shell, with braces in strings and comments inside."""
    k, out = F.col("n_nationkey"), None
    for suffix, head, inside in ((".js", ("export async function g_", "(a) {\n"), f'  return "}} {PAD}"; // }}\n'), (".go", ("func G", "(a int) string {\n"), f'\treturn "{{ {PAD}" /* }} */\n'), (".sh", ("s_", "() {\n"), f'  echo "{PAD}"\n')):
        made = made_files(nations(spark, d), "n_regionkey", "n_nationkey", text_of(head[0], k, head[1], inside, "}\n"), suffix)
        out = made if out is None else out.unionByName(made)
    return C.chunk_files(out).where("chunk_type = 'function'").select("file_path", "chunk_type", "name", "start_line", "end_line")


@query("WITH " + _RANKED + """ SELECT 'made/' || n_regionkey || '.md' AS file_path, n_name AS name, CAST(1 + 4 * j AS INTEGER) AS start_line, CAST(3 + 4 * j AS INTEGER) AS end_line, md5('## ' || n_name || chr(10) || chr(10) || repeat('words of ' || n_name || ' ', 40)) AS content_md5 FROM n""")
def k17_markdown_sections(spark: SparkSession, d: str) -> DataFrame:
    """A section per heading, with the paragraph that follows it."""
    name = F.col("n_name")
    made = made_files(nations(spark, d), "n_regionkey", "n_nationkey", F.concat(F.lit("## "), name, F.lit("\n\n"), F.repeat(F.concat(F.lit("words of "), name, F.lit(" ")), 40), F.lit("\n")), ".md")
    return C.chunk_files(made).where("chunk_type = 'section'").select("file_path", "name", "start_line", "end_line", md5(F.col("content")).alias("content_md5"))


@query("WITH " + _RANKED + """ SELECT 'made/' || n_regionkey || s AS file_path, 'K' || n_nationkey AS name, CAST(1 + 3 * j AS INTEGER) AS start_line FROM n, (VALUES ('.yaml'), ('.toml')) AS t(s)""")
def k18_config_sections(spark: SparkSession, d: str) -> DataFrame:
    """Top-level keys of YAML and sections of TOML."""
    k = F.col("n_nationkey")
    made = made_files(nations(spark, d), "n_regionkey", "n_nationkey", text_of("K", k, f':\n  v: "{PAD}"\n'), ".yaml").unionByName(made_files(nations(spark, d), "n_regionkey", "n_nationkey", text_of("[K", k, f']\nv = "{PAD}"\n'), ".toml"))
    return C.chunk_files(made).where("name like 'K%'").select("file_path", "name", "start_line")


@query("""WITH n AS (SELECT n_regionkey, string_agg('| ' || n_nationkey || ' | ' || n_name || '\\|x |', chr(10) ORDER BY n_nationkey) AS body, count(*) AS n FROM nation GROUP BY 1)
SELECT 'http://made/r' || n_regionkey || '.csv' AS url, 'r' || n_regionkey AS title, 'csv' AS source_type, md5('| key | name |' || chr(10) || '| --- | --- |' || chr(10) || body) AS content_md5, CAST(n + 1 AS VARCHAR) AS total_rows FROM n""")
def x10_spreadsheets(spark: SparkSession, d: str) -> DataFrame:
    body = F.concat_ws("\n", F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda x: F.concat(x["n_nationkey"].cast("string"), F.lit(',"'), x["n_name"], F.lit('|x"'))))
    made = nations(spark, d).groupBy("n_regionkey").agg(body.alias("body")).select(text_of("http://made/r", F.col("n_regionkey"), ".csv").alias("url"), F.lit("text/csv").alias("content_type"), F.concat(F.lit("key,name\n"), "body").cast("binary").alias("body"))
    return D.extract(made).select("url", "title", "source_type", md5(F.col("content")).alias("content_md5"), F.col("metadata")["total_rows"].alias("total_rows"))


@query("SELECT 'http://made/' || doc_id || '.md' AS url, CASE doc_id % 2 WHEN 0 THEN 'Title ' || doc_id ELSE 'plain first line ' || doc_id END AS title, md5(CASE doc_id % 2 WHEN 0 THEN '# Title ' || doc_id ELSE 'plain first line ' || doc_id END || chr(10) || chr(10) || 'in the language ' || lang) AS content_md5 FROM documents WHERE lang IS NOT NULL")
def x8_text_pages(spark: SparkSession, d: str) -> DataFrame:
    head = F.when(F.col("doc_id") % 2 == 0, text_of("# Title ", F.col("doc_id"))).otherwise(text_of("plain first line ", F.col("doc_id")))
    made = table(spark, d, "documents").where("lang is not null").select(text_of("http://made/", F.col("doc_id"), ".md").alias("url"), F.lit("text/markdown").alias("content_type"), F.concat(head, F.lit("\n\nin the language "), "lang", F.lit("\n" + " " * 20)).cast("binary").alias("body"))
    return D.extract(made).select("url", "title", md5(F.col("content")).alias("content_md5"))


@query("SELECT 'http://made/' || n_nationkey || '.rtf' AS url, 'Nation ' || n_name || ' {é}' AS title, 'Nation ' || n_name || ' {é}' || chr(10) || 'in region' || chr(9) || n_regionkey AS content FROM nation")
def x13_rich_text(spark: SparkSession, d: str) -> DataFrame:
    made = nations(spark, d).select(text_of("http://made/", F.col("n_nationkey"), ".rtf").alias("url"), F.lit("application/rtf").alias("content_type"), text_of("{\\rtf1\\ansi{\\fonttbl{\\f0 Hidden;}}{\\*\\x gone}\\b Nation\\b0  ", F.col("n_name"), " \\{\\'e9\\}\\par in region\\tab ", F.col("n_regionkey"), "}").cast("binary").alias("body"))
    return D.extract(made).select("url", "title", "content")


@query("""WITH l AS (SELECT doc_id, coalesce(source, 'none') || '/' || doc_id || '.txt' AS file_path, text, string_split(text, chr(10)) AS x FROM documents WHERE text IS NOT NULL AND length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) >= 5)
SELECT file_path, 'block_1' AS name, 1 AS start_line, CAST(len(x) AS INTEGER) AS end_line, md5(text) AS content_md5 FROM l WHERE len(list_filter(x, lambda v: trim(v) = '')) = 0 AND length(text) + 1 < CASE WHEN length(text) < 500 THEN 1000 ELSE 2000 END""")
def k14_whole_files(spark: SparkSession, d: str) -> DataFrame:
    """Texts without a blank line that are smaller than the largest chunk: each is one chunk, as it is."""
    held = texts(spark, d).select(text_of(F.coalesce("source", F.lit("none")), "/", F.col("doc_id"), ".txt").alias("file_path"), F.col("text").alias("content"))
    small = held.where("length(content) + 1 < case when length(content) < 500 then 1000 else 2000 end and not exists(split(content, '\\n'), v -> trim(v) = '')")
    return C.chunk_files(small).where("chunk_type = 'code_block'").select("file_path", "name", "start_line", "end_line", md5(F.col("content")).alias("content_md5"))


@query("""WITH n AS (SELECT n_nationkey AS k, n_name AS n FROM nation), nl AS (SELECT chr(10) AS x)
SELECT 'http://made/' || k AS url, CASE k % 7 WHEN 6 THEN 'academic' WHEN 0 THEN 'wikipedia' WHEN 1 THEN 'youtube' WHEN 2 THEN 'stackexchange' WHEN 3 THEN 'reddit' WHEN 4 THEN 'devto' ELSE 'fandom' END AS source_type, 'T ' || n AS title,
CASE k % 7 WHEN 0 THEN '*about ' || n || '*' || x || x || 'extract of ' || n
WHEN 1 THEN '**Channel:** [' || n || '](http://c/' || k || ')' || x || '**URL:** http://made/' || k || x || x || '## Description' || x || x || 'told ' || n
WHEN 2 THEN '**Score:** ' || k || '  |  **Answers:** 2' || x || '**Tags:** a, b' || x || x || '## Question' || x || x || 'why **' || n || '**' || x || x || '## Answer 1 (Accepted) (Score: 5)' || x || x || 'so' || x || x || '## Answer 2 (Score: 1)' || x || x || 'no'
WHEN 3 THEN '**r/x**  |  Score: ' || k || '  |  2 comments' || x || '**Posted by:** u/' || n || x || '**Link:** http://out/' || k || x || x || 'self' || x || x || '## Top Comments' || x || x || '**u/z** (Score: 3):' || x || '> good' || x
WHEN 4 THEN '**Author:** ' || n || x || '**Published:** Jan 1' || x || '**Tags:** p, q' || x || '**Reactions:** 7' || x || x || 'body ' || n
WHEN 5 THEN '## ' || n || x || 'one two three four five six seven eight nine' || x || x || '**Categories:** A b'
ELSE '**Authors:** ' || n || ', B' || x || '**Published:** V, 2020' || x || '**Citations:** ' || k || '  |  **References:** 2' || x || '**IDs:** DOI: d | PMID: p' || x || '**PDF:** [u](u)' || x || x || '## TL;DR' || x || x || 'short' || x || x || '## Abstract' || x || x || 'abs ' || n END AS content FROM n, nl""")
def x15_site_apis(spark: SparkSession, d: str) -> DataFrame:
    """Answers of seven services, made from the nations, as pages."""
    k, n = F.col("n_nationkey"), F.col("n_name")
    bodies = {
        "wikipedia": (('{"title":"T ', n, '","extract":"extract of ', n, '","description":"about ', n, '"}'), None),
        "youtube": (('{"title":"T ', n, '","author_name":"', n, '","author_url":"http://c/', k, '"}'), ('<html><head><meta name="description" content="told ', n, '"></head></html>')),
        "stackexchange": (('{"items":[{"title":"T ', n, '","body":"<p>why <b>', n, '</b></p>","tags":["a","b"],"score":', k, ',"answer_count":2}]}'), ('{"items":[{"is_accepted":true,"body":"<p>so</p>","score":5},{"is_accepted":false,"body":"<p>no</p>","score":1}]}',)),
        "reddit": (('[{"data":{"children":[{"kind":"t3","data":{"title":"T ', n, '","selftext":"self","subreddit_name_prefixed":"r/x","score":', k, ',"author":"', n, '","num_comments":2,"url":"http://out/', k, '"}}]}},{"data":{"children":[{"kind":"t1","data":{"author":"z","body":"good","score":3}},{"kind":"more","data":{}}]}}]'), None),
        "devto": (('{"title":"T ', n, '","body_markdown":"body ', n, '","user":{"name":"', n, '"},"tags":"p, q","positive_reactions_count":7,"readable_publish_date":"Jan 1"}'), None),
        "fandom": (('{"parse":{"title":"x","displaytitle":"<i>T ', n, '</i>","wikitext":{"*":"== ', n, ' ==\\none two three four five six seven eight nine"},"categories":[{"*":"A_b"},{"*":"I","hidden":"true"}]}}'), None),
        "semantic_scholar": (('{"title":"T ', n, '","abstract":"abs ', n, '","authors":[{"name":"', n, '"},{"name":"B"}],"year":2020,"venue":"V","citationCount":', k, ',"referenceCount":2,"tldr":{"text":"short"},"externalIds":{"DOI":"d","PMID":"p"},"openAccessPdf":{"url":"u"}}'), None),
    }
    service, body, extra = F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(None).cast("string")
    for i, (name, (one, two)) in enumerate(bodies.items()):
        service, body = F.when(k % 7 == i, name).otherwise(service), F.when(k % 7 == i, text_of(*one)).otherwise(body)
        extra = F.when(k % 7 == i, text_of(*two)).otherwise(extra) if two else extra
    answers = nations(spark, d).select(text_of("http://made/", k).alias("url"), service.alias("service"), body.alias("body"), extra.alias("extra"))
    return site_apis.api_pages(answers).select("url", "source_type", "title", "content")


# --- crawling and sessions ------------------------------------------------------------------------------


@query("""WITH RECURSIVE n AS (SELECT count(*) AS n FROM pages), r(i, level) AS (SELECT 1, 0 UNION ALL SELECT c, level + 1 FROM (SELECT level, unnest([2 * i, 2 * i + 1]) AS c FROM r WHERE level < 4), n WHERE c <= n AND c % 7 <> 3)
SELECT 'http://h' || (i % 7) || '.example/p' || i AS url, CAST(level AS INTEGER) AS level FROM r""")
def s13_crawl_tree(spark: SparkSession, d: str) -> DataFrame:
    """Pages that link as a binary tree, crawled from its root to depth four; one host is blocked, and so is what only it
    leads to.  Links are relative, absolute, repeated, and back to where they came from."""
    n = table(spark, d, "pages").count()
    i = F.col("i")
    url = lambda x: text_of("http://h", x % 7, ".example/p", x)
    link = lambda x: F.concat(F.lit('<a href="'), x, F.lit('">x</a>'))
    made = spark.range(1, n + 1).select(F.col("id").alias("i")).select(i.alias("page_id"), url(i).alias("url"), F.concat(link(url(2 * i)), link(url(2 * i + 1)), link(url(2 * i)), link(url(F.floor(i / 2))), link(F.lit("#top"))).alias("html"))
    blocked = spark.createDataFrame([("h3.example",)], "domain string")
    return S.crawl(made, made.where("page_id = 1").select("url"), 4, None, blocked)


@query("""WITH a AS (SELECT user_id % 40 AS k, event_id, user_id FROM events),
st AS (SELECT k, count(*) AS n FROM a GROUP BY k)
SELECT 'd' || k AS domain, CASE WHEN k % 4 = 1 THEN 'Auto-blocked: robots.txt denied access (' || least(n, CASE WHEN k % 8 = 1 THEN 2 ELSE 1000000 END) || ' times)' ELSE 'Auto-blocked: ' || n || ' consecutive failures, 0 successes' END AS reason
FROM st WHERE (k % 4 = 1 AND least(n, CASE WHEN k % 8 = 1 THEN 2 ELSE 1000000 END) >= 2 OR k % 4 = 2 AND n >= 5) AND k NOT IN (10, 14)""")
def a6_auto_blacklist_rules(spark: SparkSession, d: str) -> DataFrame:
    """Domains with a success, with refusals by robots.txt (some with two attempts only), with other failures, and listed ones."""
    log = table(spark, d, "events").select((F.col("user_id") % 40).alias("k"), "ts", "event_id")
    turn = F.row_number().over(W.partitionBy("k").orderBy("ts", "event_id"))
    log = log.withColumn("turn", turn).where("k % 8 <> 1 or turn <= 2")
    made = log.select(F.col("ts").cast("timestamp").alias("ts"), text_of("www.D", F.col("k")).alias("domain"), ((F.col("k") % 4).isin(0, 3) & (F.col("turn") == 1)).alias("success"), F.lit(1).alias("word_count"), F.lit("x").alias("extractor"), F.when(F.col("k") % 4 == 1, "Blocked by Robots.txt").otherwise("timeout").alias("error"))
    listed = lambda *names: spark.createDataFrame([(n,) for n in names], "domain string")
    return A.auto_blacklist(A.domain_stats(made), listed("d10"), listed("d14"))


@query("""SELECT page_id, CASE page_id % 9 WHEN 0 THEN 'wikipedia' WHEN 1 THEN 'youtube' WHEN 2 THEN 'stackexchange' WHEN 3 THEN 'reddit' WHEN 4 THEN 'devto' WHEN 5 THEN 'fandom' WHEN 6 THEN 'semantic_scholar' END AS api,
CASE page_id % 9 WHEN 0 THEN 'pdf' WHEN 1 THEN 'docx' WHEN 2 THEN 'spreadsheet' WHEN 3 THEN 'rss' WHEN 4 THEN 'epub' WHEN 5 THEN 'markdown' WHEN 6 THEN 'rtf' WHEN 7 THEN 'arxiv' ELSE 'github' END AS by FROM pages""")
def x16_all_routes(spark: SparkSession, d: str) -> DataFrame:
    known = ["https://fr.wikipedia.org/wiki/X.pdf", "https://m.youtube.com/a.docx", "https://math.stackexchange.com/q.csv", "https://old.reddit.com/r.rss", "https://dev.to/b.epub", "https://x.fandom.com/w.txt", "https://www.nature.com/p.rtf", "https://arxiv.org/abs/1", "https://github.com/a/b"]
    url = F.element_at(F.array(*map(F.lit, known)), (F.col("page_id") % 9 + 1).cast("int"))
    return table(spark, d, "pages").select("page_id", web.direct_fetcher(url).alias("api"), web.extractor(url, F.lit("text/html; charset=utf-8")).alias("by"))


@query("""SELECT 'd' || doc_id AS file_path, CASE WHEN n_chars < 200 THEN 'new' WHEN n_chars > 4000 THEN 'removed' WHEN doc_id % 5 IN (1, 2, 3) THEN 'changed' ELSE 'unchanged' END AS status FROM documents WHERE n_chars IS NOT NULL""")
def j11_manifest_rules(spark: SparkSession, d: str) -> DataFrame:
    """A manifest in which sizes, times or hashes differ, each alone."""
    k = F.col("doc_id") % 5
    rows = table(spark, d, "documents").where("n_chars is not null").select(text_of("d", F.col("doc_id")).alias("file_path"), F.col("n_chars").alias("size"), F.lit(7).alias("mtime"), F.lit("same").alias("hash"), k.alias("k"))
    old = rows.where("size >= 200").select("file_path", F.when(F.col("k") == 1, F.col("size") + 1).otherwise(F.col("size")).alias("size"), F.when(F.col("k") == 2, 8).otherwise(F.col("mtime")).alias("mtime"), F.when(F.col("k") == 3, "old").otherwise(F.col("hash")).alias("hash"))
    return I.manifest_diff(rows.where("size <= 4000").drop("k"), old)


@query("""SELECT n_nationkey, 'def of ' || n_name AS parent FROM nation""")
def r13_parents(spark: SparkSession, d: str) -> DataFrame:
    """Methods as results, a class per region and nation beside them: each result has its class, the first of that name."""
    k = F.col("n_nationkey")
    methods = nations(spark, d).select(text_of("f", F.col("n_regionkey")).alias("file_path"), (k * 3).alias("chunk_index"), text_of("body ", k).alias("content"), F.lit("m").alias("name"), F.lit("method").alias("chunk_type"), F.lit(1).alias("start_line"), F.lit(2).alias("end_line"), text_of("C", k).alias("parent_class"))
    heads = [nations(spark, d).select(text_of("f", F.col("n_regionkey")).alias("file_path"), (k * 3 + i).alias("chunk_index"), text_of(word, F.col("n_name")).alias("content"), text_of("C", k).alias("name"), F.lit("class").alias("chunk_type"), F.lit(1).alias("start_line"), F.lit(2).alias("end_line"), F.lit(None).cast("string").alias("parent_class")) for i, word in ((1, "def of "), (2, "again "))]
    got = R.with_context(methods, methods.unionByName(heads[0]).unionByName(heads[1]))
    return got.select((F.col("chunk_index") / 3).cast("int").alias("n_nationkey"), F.col("parent_chunk.content").alias("parent"))


@query("""WITH b AS (SELECT url, regexp_replace(lower(regexp_extract(url, '://([^/?#]*)', 1)), '^www\\.', '') AS domain, page_id FROM pages WHERE url IS NOT NULL)
SELECT url, domain, CASE WHEN ends_with(domain, '.net') THEN 'blacklisted' WHEN regexp_matches(url, '://[^/]*/de/') AND ends_with(domain, '.org') THEN 'robots' WHEN page_id % 5 = 0 THEN 'missing' WHEN page_id % 5 = 1 THEN 'thin' ELSE 'ok' END AS outcome FROM b""")
def s11_scrape_outcomes(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "pages").where("url is not null").select("page_id", "url")
    host = F.lower(T.url_host("url"))
    blocked = pages.select(T.normalise_domain(T.url_host("url")).alias("domain")).where("domain like '%.net'").distinct()
    robots = pages.select(host.alias("host")).where("host like '%.org'").distinct().withColumn("body", F.lit("User-agent: *\nDisallow: /de/\n"))
    read = pages.where("page_id % 5 <> 0").select("page_id", F.when(F.col("page_id") % 5 == 1, 39).otherwise(40).alias("word_count"))
    return web.scrape_status(pages, read, blocked, robots, key="page_id").select("url", "domain", "outcome")


@query("""WITH f AS (SELECT url, min('page-' || page_id || '.md') AS file_name FROM pages WHERE url IS NOT NULL AND page_id % 4 <> 0 GROUP BY url)
SELECT page_id, pages.url, f.file_name FROM pages LEFT JOIN f ON pages.url = f.url""")
def j8_saved_pages(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "pages").select("page_id", "url", F.coalesce("html", F.lit("")).alias("content"))
    read = pages.where("url is not null and page_id % 4 <> 0").select("url", text_of("page ", F.col("page_id")).alias("title"), "content", F.lit(1).alias("word_count"), F.lit("page").alias("source_type"))
    files = web.page_files(read, "2024-01-01T00:00:00")
    return web.saved_pages(pages.select("page_id", "url"), files).select("page_id", "url", "file_name")


@query("""SELECT count(*) AS files, count(text) AS indexed, count(*) - count(text) AS failed, CAST(sum(CASE WHEN text IS NOT NULL THEN len(string_split(text, chr(10))) END) AS BIGINT) AS chunks FROM documents""")
def a4_counted_while_written(spark: SparkSession, d: str) -> DataFrame:
    read = F.col("text").isNotNull()
    rows = table(spark, d, "documents").select("doc_id", "text", F.size(F.split("text", "\n", -1)).alias("n"))
    seen, rows = counted(rows, files=F.count("*"), indexed=F.count_if(read), failed=F.count_if(~read), chunks=F.sum(F.when(read, F.col("n")).cast("long")))
    discard(stage(rows, "counted"))
    log = RunLog(spark, work_path(spark, "runs"))
    log.append("indexing", seen.get)
    return log.read("indexing").select(*(F.element_at("counts", c).cast("long").alias(c) for c in ("files", "indexed", "failed", "chunks")))


@query("SELECT user_id, round(avg(n), 2) AS mean_seconds, string_agg(CASE WHEN t < 500 THEN 'LOW' WHEN t < 2000 THEN 'MEDIUM' ELSE 'HIGH' END, '>' ORDER BY day) AS trend, CAST(sum(t) AS BIGINT) AS tokens, count(*) AS rounds FROM (SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, CAST(sum(floor(value * 10)) AS BIGINT) AS t, count(*) AS n FROM events GROUP BY ALL) GROUP BY user_id")
def a9_session_report(spark: SparkSession, d: str) -> DataFrame:
    """A research session per user: mean length of a round, confidence in order of rounds, totals."""
    label = F.when(F.col("tokens") < 500, "LOW").when(F.col("tokens") < 2000, "MEDIUM").otherwise("HIGH")
    return A.session_report(rounds(spark, d).withColumn("confidence", label), "user_id", "day", "seconds", "tokens", "confidence").withColumn("trend", F.concat_ws(">", "trend"))


@query("WITH log AS (SELECT 'd' || user_id AS domain, event_type <> 'error' AS ok FROM events) SELECT domain, count(*) AS attempts, count(*) FILTER (WHERE ok) AS successes, count(*) FILTER (WHERE NOT ok) AS failures FROM log GROUP BY domain HAVING count(*) FILTER (WHERE NOT ok) >= 1")
def a10_domain_counters(spark: SparkSession, d: str) -> DataFrame:
    return A.domain_counters(scrape_log(spark, d)).where("failures >= 1")


@query("SELECT page_id, host FROM (SELECT page_id, lower(regexp_extract(url, '://([^/?#]*)', 1)) AS host FROM pages WHERE url IS NOT NULL) WHERE page_id % 3 <> 0")
def u5_not_yet_scraped(spark: SparkSession, d: str) -> DataFrame:
    """Attempted addresses without the scraped ones."""
    pages = table(spark, d, "pages").where("url is not null")
    left = S.remaining(pages.select("url"), pages.where("page_id % 3 = 0").select("url"))
    return left.join(pages, "url").select("page_id", F.lower(T.url_host("url")).alias("host"))


@query("""WITH p AS (SELECT source, doc_id, length(text) AS relevance FROM documents WHERE text IS NOT NULL AND length(text) >= 300) SELECT source, doc_id, CAST(row_number() OVER (PARTITION BY source ORDER BY relevance DESC, doc_id) AS INTEGER) AS place FROM p""")
def f12_active_files(spark: SparkSession, d: str) -> DataFrame:
    rows = texts(spark, d).select("source", "doc_id", F.length("text").alias("relevance"), (F.length("text") < 300).alias("is_pruned"))
    return N.active_files(rows, "source", "relevance", "doc_id").select("source", "doc_id", "place")


@query("SELECT vec_id, round(least(greatest(s, 0) / m, 1.0), 9) AS score FROM (SELECT vec_id, label, list_sum([CAST(x AS DOUBLE) * CAST(x AS DOUBLE) FOR x IN embedding]) AS s, max(list_sum([CAST(x AS DOUBLE) * CAST(x AS DOUBLE) FOR x IN embedding])) OVER (PARTITION BY label) AS m FROM embeddings)")
def r5_normalised_scores(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings").select(F.col("label").alias("query_id"), "vec_id", T.dot("embedding", "embedding").alias("score"))
    return R.normalised(rows).select("vec_id", F.round("score", 9).alias("score"))


@query("""WITH l AS (SELECT doc_id, lang, text FROM documents WHERE text IS NOT NULL), c AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM l)
SELECT n.doc_id, count(*) AS lines FROM l n JOIN c ON c.doc_id = n.doc_id WHERE contains(c.line, 'the') AND trim(c.line) <> '' AND regexp_replace(c.line, '^\\s+|\\s+$', '', 'g') <> 'the' GROUP BY n.doc_id""")
def f7_lines_with_a_name(spark: SparkSession, d: str) -> DataFrame:
    """Results that hold an identifier, without those that are the identifier itself."""
    found = lines(spark, d).join(texts(spark, d).select("doc_id"), "doc_id").withColumn("query", F.lit("the"))
    return R.without_self(R.holding(found, "query"), "query").groupBy("doc_id").agg(F.count("*").alias("lines"))


@query("SELECT n_nationkey AS duplicate, n_nationkey % 5 AS keeper, CASE WHEN n_nationkey < 20 THEN 1.0 ELSE 0.9 END AS similarity FROM nation WHERE n_nationkey BETWEEN 5 AND 20")
def m10_vector_prune(spark: SparkSession, d: str) -> DataFrame:
    """A file per nation with two vectors, those of a region alike; the last of each region is only close to the others,
    and a judge was asked about one of these."""
    k, r = F.col("n_nationkey"), F.col("n_nationkey") % 5
    at = lambda x, first: F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: F.when(i == r, x).when(i == r + 5, first).otherwise(0.0))
    mean = F.when(k < 20, at(F.lit(1.0), F.lit(0.0))).otherwise(at(F.lit(0.9), F.lit(0.19**0.5)))
    two = nations(spark, d).select("n_nationkey", F.explode(F.array(F.transform(mean, lambda x: x * 0.5), F.transform(mean, lambda x: x * 1.5))).alias("v"))
    judged = spark.createDataFrame([(0, 20, True, False)], "a int, b int, same boolean, corroborates boolean")
    got = N.prune_by_vector(nations(spark, d), two, "n_nationkey", "v", "n_nationkey", judged)
    return got.select("duplicate", "keeper", F.round("similarity", 6).alias("similarity"))


@query("SELECT n_nationkey, 'made/n' || n_nationkey || '.md' AS path, CASE WHEN n_nationkey % 2 = 0 THEN 2 ELSE 1 END AS chunks FROM nation WHERE n_nationkey >= 10")
def j7_session_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Chunks by the path of a session's file, and where no chunk has it by its name."""
    k = F.col("n_nationkey")
    some = nations(spark, d).where("n_nationkey >= 10")
    chunks = some.select(F.explode(F.when(k % 2 == 0, F.array(*(text_of("root/made/n", k, ".md") for _ in range(2)))).otherwise(F.array(text_of("old/n", k, ".txt")))).alias("file_path"))
    files = some.select("n_nationkey", text_of("made/n", k, ".md").alias("path"))
    return N.chunks_of_files(files, chunks).groupBy("path").agg(F.count("*").cast("int").alias("chunks")).join(files, "path").select("n_nationkey", "path", "chunks")


# --- plain relational work over the other tables --------------------------------------------------------


@query("SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS avg_discount, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL")
def ext_pricing_summary(spark: SparkSession, d: str) -> DataFrame:
    shipped = table(spark, d, "lineitem").where("l_shipdate <= timestamp '1998-09-02'")
    return shipped.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.round(F.avg("l_discount"), 6).alias("avg_discount"), F.count("*").alias("n"))


@query("""SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_regionkey <= 2 GROUP BY n_name""")
def ext_local_suppliers(spark: SparkSession, d: str) -> DataFrame:
    t = lambda n: table(spark, d, n)
    sold = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
    local = sold.join(t("supplier"), (F.col("l_suppkey") == F.col("s_suppkey")) & (F.col("c_nationkey") == F.col("s_nationkey"))).join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return local.join(t("region").where("r_regionkey <= 2"), F.col("n_regionkey") == F.col("r_regionkey")).groupBy("n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@query("SELECT o_orderpriority, count(*) AS n FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 45) GROUP BY 1")
def ext_large_orders(spark: SparkSession, d: str) -> DataFrame:
    large = table(spark, d, "lineitem").where("l_quantity > 45").select("l_orderkey")
    return table(spark, d, "orders").join(large, F.col("o_orderkey") == F.col("l_orderkey"), "left_semi").groupBy("o_orderpriority").agg(F.count("*").alias("n"))


@query("SELECT p_brand, p_type, round(avg(l_quantity), 6) AS mean_qty, approx.m AS cheapest FROM part JOIN lineitem ON p_partkey = l_partkey JOIN (SELECT p_brand AS b, min(p_retailprice) AS m FROM part GROUP BY 1) approx ON approx.b = p_brand WHERE p_size BETWEEN 5 AND 20 GROUP BY ALL")
def ext_parts_by_brand(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part")
    least = part.groupBy(F.col("p_brand").alias("b")).agg(F.min("p_retailprice").alias("cheapest"))
    some = part.where("p_size between 5 and 20").join(table(spark, d, "lineitem"), F.col("p_partkey") == F.col("l_partkey")).groupBy("p_brand", "p_type").agg(F.round(F.avg("l_quantity"), 6).alias("mean_qty"))
    return some.join(least, F.col("p_brand") == F.col("b")).drop("b")


@query("SELECT o_custkey, o_orderkey, CAST(row_number() OVER w AS INTEGER) AS place, round(sum(o_totalprice) OVER (w ROWS UNBOUNDED PRECEDING), 2) AS running FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)")
def ext_running_totals(spark: SparkSession, d: str) -> DataFrame:
    w = W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, d, "orders").select("o_custkey", "o_orderkey", F.row_number().over(w).alias("place"), F.round(F.sum("o_totalprice").over(w.rowsBetween(W.unboundedPreceding, 0)), 2).alias("running"))
