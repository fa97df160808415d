"""The catalogue: a query per operator over the test tables, and its SQL, written on its own terms.

``embeddings`` for chunk vectors with their label as file, ``events`` for a scrape log and for file events.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodegrain.functions import prompts as P
from lodegrain.functions import text as T
from lodegrain.interface.models import hashed_vector
from lodegrain.operators import analytics as A
from lodegrain.operators import chunkers as C
from lodegrain.operators import corpus as N
from lodegrain.operators import crawl as S
from lodegrain.operators import html as H
from lodegrain.operators import index as I
from lodegrain.operators import retrieval as R
from lodegrain.operators.joins import containing, not_overlapping, similar_vectors
from lodegrain.operators.segments import SegmentedIndex
from lodegrain.plans.search import Searcher
from lodegrain.sources import web
from lodegrain.sources.workspace import spread, work_path
from lodegrain.streaming import events as Z

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
TOP = 10


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


# --- the tables in their roles --------------------------------------------------------------------------


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def files(spark: SparkSession, d: str) -> DataFrame:
    path = F.concat(F.coalesce("source", F.lit("none")), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return table(spark, d, "documents").select("doc_id", path.alias("file_path"), F.col("text").alias("content"), F.col("lang").alias("language"), "n_chars")


def lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines as chunks: the first of a file is a section, the others are paragraphs."""
    cut = files(spark, d).where("content is not null").select("doc_id", "file_path", "language", F.posexplode(F.split("content", "\n")).alias("chunk_index", "content")).where("trim(content) <> ''")
    return cut.select(
        "doc_id", "file_path", "chunk_index", (F.col("chunk_index") + 1).alias("start_line"), (F.col("chunk_index") + 1).alias("end_line"), "content", F.substring_index("content", " ", 1).alias("name"),
        F.when(F.col("chunk_index") == 0, "section").otherwise("paragraph").alias("chunk_type"), "language",
    )


_LINES = """
l AS (SELECT doc_id, coalesce(source, 'none') || '/' || doc_id || '.txt' AS file_path, lang AS language, string_split(text, chr(10)) AS x FROM documents WHERE text IS NOT NULL),
chunks AS (
  SELECT doc_id, file_path, CAST(i - 1 AS INTEGER) AS chunk_index, CAST(i AS INTEGER) AS start_line, x[i] AS content, string_split(x[i], ' ')[1] AS name,
         CASE WHEN i = 1 THEN 'section' ELSE 'paragraph' END AS chunk_type, language
  FROM (SELECT *, unnest(range(1, len(x) + 1)) AS i FROM l) WHERE trim(x[i]) <> '')"""


def _tokens(name: str, key: str, source: str, text: str) -> str:
    """CTEs that end in ``name`` (key, term)."""
    return f"""
{name}_w AS (SELECT {key}, unnest(regexp_extract_all({text}, '[a-zA-Z0-9_]+')) AS w FROM {source}),
{name} AS (
  SELECT {key}, lower(w) AS term FROM {name}_w
  UNION ALL SELECT {key}, lower(unnest(p)) FROM (SELECT {key}, list_filter(string_split(w, '_'), lambda x: x <> '') AS p FROM {name}_w WHERE contains(w, '_')) WHERE len(p) > 1
  UNION ALL SELECT {key}, lower(unnest(h)) FROM (SELECT {key}, string_split(regexp_replace(regexp_replace(w, '([a-z])([A-Z])', '\\1 \\2', 'g'), '([A-Z])([A-Z][a-z])', '\\1 \\2', 'g'), ' ') AS h FROM {name}_w) WHERE len(h) > 1)"""


# --- tokens and keyword search --------------------------------------------------------------------------


@query("WITH" + _tokens("t", "doc_id", "documents", "text") + " SELECT doc_id, count(*) AS tokens, count(DISTINCT term) AS terms FROM t GROUP BY doc_id")
def r2_tokenize_counts(spark: SparkSession, d: str) -> DataFrame:
    return T.token_counts(spread(files(spark, d)), "doc_id", "content")


def _document_index(spark: SparkSession, d: str) -> R.KeywordIndex:
    return R.build_keyword_index(files(spark, d).where("content is not null"), ["doc_id"], F.col("content"))


_BM25 = "WITH" + _tokens("t", "doc_id", "documents", "text") + """,
tf AS (SELECT term, doc_id, count(*) AS tf FROM t GROUP BY ALL),
n AS (SELECT count(*) AS n FROM documents WHERE text IS NOT NULL),
dl AS (SELECT doc_id, count(*) AS dl FROM t GROUP BY doc_id),
mean AS (SELECT (SELECT count(*) FROM t) / n AS avgdl FROM n),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
raw AS (SELECT term, df, ln((n - df + 0.5) / (df + 0.5)) AS raw FROM df, n),
idf AS (SELECT term, df, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM raw) ELSE raw END AS idf FROM raw)"""


@query(_BM25 + " SELECT term, df, round(idf, 6) AS idf FROM idf")
def r3_term_stats(spark: SparkSession, d: str) -> DataFrame:
    return _document_index(spark, d).terms.select("term", "df", F.round("idf", 6).alias("idf"))


_BM25_TOP = _BM25 + "," + _tokens("q", "item_id", "benchmark", "text") + """,
asked AS (SELECT item_id AS query_id, term, count(*) AS qtf FROM q GROUP BY ALL),
s AS (SELECT query_id, tf.doc_id, round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 9) AS score
      FROM asked JOIN tf USING (term) JOIN idf USING (term) JOIN dl ON dl.doc_id = tf.doc_id, mean GROUP BY ALL),
k AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM s)"""


@query(_BM25_TOP + " SELECT query_id, rank, doc_id, round(score, 6) AS score FROM k WHERE rank <= 10 AND score > 0")
def r4_bm25_batch(spark: SparkSession, d: str) -> DataFrame:
    queries = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return R.bm25(_document_index(spark, d), queries, TOP).select("query_id", "rank", "doc_id", F.round("score", 6).alias("score"))


@query(_BM25_TOP + " SELECT query_id, rank, doc_id, round(score, 6) AS score FROM k WHERE rank <= 10 AND score > 0")
def r4_segmented_index(spark: SparkSession, d: str) -> DataFrame:
    """The same from an index that is kept in segments: documents come in two changes, those of the first with wrong texts,
    which the third puts right, and rows that have no document go again."""
    docs = files(spark, d).where("content is not null").select("doc_id", "content")
    index = SegmentedIndex(spark, work_path(spark, "index"), "doc_id", ["doc_id"], F.col("content"))
    early = F.col("doc_id") < docs.agg(F.avg("doc_id")).first()[0]
    index.update(docs.where(early).withColumn("content", F.reverse("content")), docs.where(early).select("doc_id"))
    extra = docs.where(~early).withColumn("doc_id", -1 - F.col("doc_id"))
    later = docs.where(~early).unionByName(extra)
    index.update(later, later.select("doc_id"))
    now = index.update(docs.where(early), docs.where(early).select("doc_id"), extra.select("doc_id"))
    queries = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return now.bm25(queries, TOP).select("query_id", "rank", "doc_id", F.round("score", 6).alias("score"))


_LABEL = "CASE WHEN m < 0.1 THEN CASE WHEN {0} >= .035 THEN 'HIGH' WHEN {0} >= .025 THEN 'GOOD' WHEN {0} >= .018 THEN 'FAIR' WHEN {0} >= .010 THEN 'LOW' ELSE 'WEAK' END WHEN {0} >= .7 THEN 'HIGH' WHEN {0} >= .5 THEN 'GOOD' WHEN {0} >= .3 THEN 'FAIR' WHEN {0} >= .1 THEN 'LOW' ELSE 'WEAK' END"


@query(_BM25_TOP + f", f AS (SELECT *, 1.0 / (60 + rank) AS rrf, max(1.0 / (60 + rank)) OVER (PARTITION BY query_id) AS m FROM k WHERE rank <= 10 AND score > 0) SELECT query_id, rank, doc_id, round(rrf, 6) AS score, {_LABEL.format('rrf')} AS label FROM f")
def r9_bm25_only_search(spark: SparkSession, d: str) -> DataFrame:
    """Keyword search alone, as without a model: one ranked list is fused, and labelled."""
    queries = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    fused = R.fuse([(R.bm25(_document_index(spark, d), queries, TOP), 0.3)], ["doc_id"])
    best = F.max("score").over(W.partitionBy("query_id"))
    return fused.select("query_id", F.col("first_rank").alias("rank"), "doc_id", F.round("score", 6).alias("score"), T.score_label("score", best).alias("label"))


# --- vectors --------------------------------------------------------------------------------------------

_MEAN = """
p AS (SELECT label, unnest(range(1, len(embedding) + 1)) AS i, unnest(embedding) AS x FROM embeddings),
c AS (SELECT label, i, avg(CAST(x AS DOUBLE)) AS m FROM p GROUP BY ALL)"""

_KNN = """WITH""" + _MEAN + """,
v AS (SELECT vec_id, unnest(range(1, len(embedding) + 1)) AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings),
s AS (SELECT c.label AS query_id, v.vec_id, round(sum((v.x - c.m) * (v.x - c.m)), 9) AS distance FROM v JOIN c USING (i) GROUP BY ALL),
k AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS INTEGER) AS rank FROM s)"""


def _label_means(spark: SparkSession, d: str) -> DataFrame:
    return A.mean_vectors(table(spark, d, "embeddings"), "label", "embedding")


def _nearest(spark: SparkSession, d: str, k: int) -> DataFrame:
    queries = _label_means(spark, d).select(F.col("label").alias("query_id"), F.col("mean").alias("query_vector"))
    return R.nearest(table(spark, d, "embeddings"), queries, k, ["vec_id"])


@query(_KNN + " SELECT query_id, rank, vec_id, round(distance, 6) AS distance, round(1 / (1 + distance), 6) AS score FROM k WHERE rank <= 10")
def r6_knn_batch(spark: SparkSession, d: str) -> DataFrame:
    """The vectors nearest to the mean of each label."""
    return _nearest(spark, d, TOP).select("query_id", "rank", "vec_id", F.round("distance", 6).alias("distance"), F.round("score", 6).alias("score"))


@query("WITH" + _MEAN + " SELECT label, CAST(i AS INTEGER) AS i, round(m, 6) AS m FROM c")
def a12_mean_vectors(spark: SparkSession, d: str) -> DataFrame:
    return _label_means(spark, d).select("label", F.posexplode("mean").alias("i", "m")).select("label", (F.col("i") + 1).alias("i"), F.round("m", 6).alias("m"))


@query("WITH" + _MEAN + """, s AS (SELECT x.label AS a, y.label AS b, sum(x.m * y.m) / (sqrt(sum(x.m * x.m)) * sqrt(sum(y.m * y.m))) AS s FROM c x JOIN c y ON x.i = y.i AND x.label < y.label GROUP BY ALL)
SELECT a, b, round(s, 6) AS similarity FROM s WHERE s >= -1""")
def m10_vector_pairs(spark: SparkSession, d: str) -> DataFrame:
    return N.vector_pairs(table(spark, d, "embeddings"), "label", "embedding", -1.0).select("a", "b", F.round("similarity", 6).alias("similarity"))


@query("""WITH v AS (SELECT vec_id, [CAST(x AS DOUBLE) FOR x IN embedding] AS v FROM embeddings WHERE embedding IS NOT NULL),
s AS (SELECT x.vec_id AS a, y.vec_id AS b, list_cosine_similarity(x.v, y.v) AS s FROM v x JOIN v y ON x.vec_id < y.vec_id)
SELECT a, b, round(s, 6) AS similarity FROM s WHERE s >= 0.3""")
def m10_close_vectors(spark: SparkSession, d: str) -> DataFrame:
    """All pairs of vectors above a cosine, by cells and angles."""
    return similar_vectors(table(spark, d, "embeddings"), "vec_id", "embedding", 0.3).select("a", "b", F.round("similarity", 6).alias("similarity"))


_PATHS = "SELECT coalesce(source, 'none') || '/' || doc_id || '.txt' AS file_path, length(text) || '.txt' AS part, source, length(text) AS n, lang FROM documents WHERE text IS NOT NULL"


@query(f"WITH p AS ({_PATHS}) SELECT DISTINCT t.file_path, q.part FROM p t JOIN (SELECT DISTINCT part FROM p) q ON contains(t.file_path, q.part)")
def j7_contained_paths(spark: SparkSession, d: str) -> DataFrame:
    """Paths of documents that hold a name made from the length of one, anywhere in them."""
    docs = files(spark, d).where("content is not null")
    return containing(docs, "file_path", docs.select(F.concat(F.length("content").cast("string"), F.lit(".txt")).alias("part")), "part")


@query(f"""WITH p AS ({_PATHS}), s AS (SELECT source, n % 5000 AS b, n % 5000 + n % 97 AS e, part FROM p), o AS (SELECT source, n % 4999 AS b, n % 4999 + n % 31 AS e FROM p WHERE lang = 'en')
SELECT source, b AS begin_at, e AS end_at, part FROM s WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.source = s.source AND o.b <= s.e AND o.e >= s.b)""")
def j12_uncovered_spans(spark: SparkSession, d: str) -> DataFrame:
    """Spans made of the lengths of documents, nested and overlapping, that no span of another kind overlaps."""
    n = F.length("text").cast("long")
    docs = table(spark, d, "documents").where("text is not null")
    spans = docs.select("source", (n % 5000).alias("begin_at"), (n % 5000 + n % 97).alias("end_at"), F.concat(n.cast("string"), F.lit(".txt")).alias("part"))
    others = docs.where("lang = 'en'").select("source", (n % 4999).alias("begin_at"), (n % 4999 + n % 31).alias("end_at"))
    return not_overlapping(spans, others, "source", "begin_at", "end_at")


@query(_KNN + """,
o AS (SELECT v.vec_id, round(sum(v.x), 9) AS s FROM v GROUP BY 1),
a AS (SELECT query_id, vec_id, rank, 0 AS list FROM k WHERE rank <= 30
      UNION ALL SELECT c.query_id, o.vec_id, CAST(row_number() OVER (PARTITION BY c.query_id ORDER BY o.s DESC, o.vec_id) AS INTEGER), 1 FROM o, (SELECT DISTINCT query_id FROM k) c QUALIFY row_number() OVER (PARTITION BY c.query_id ORDER BY o.s DESC, o.vec_id) <= 30)
SELECT query_id, vec_id, round(sum(CASE list WHEN 0 THEN 1.4 ELSE 0.6 END / (60 + rank)), 6) AS score, CAST(count(*) AS INTEGER) AS retriever_count FROM a GROUP BY ALL""")
def r8_rrf(spark: SparkSession, d: str) -> DataFrame:
    """Two ranked lists: nearest vectors, and the largest sums of components."""
    total = F.round(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double")), 9)
    best = table(spark, d, "embeddings").select("vec_id", total.alias("s")).orderBy(F.desc("s"), "vec_id").limit(30)
    second = best.withColumn("rank", F.row_number().over(W.orderBy(F.desc("s"), "vec_id"))).crossJoin(_label_means(spark, d).select(F.col("label").alias("query_id")))
    fused = R.fuse([(_nearest(spark, d, 30), 0.7), (second, 0.3)], ["vec_id"])
    return fused.select("query_id", "vec_id", F.round("score", 6).alias("score"), "retriever_count")


# --- ranking --------------------------------------------------------------------------------------------


def _scored_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines scored by their length, the benchmark's first item being the query of all."""
    return lines(spark, d).select(F.lit(1).alias("query_id"), "*", F.least(F.length("content") / 400.0, F.lit(1.0)).alias("score"), F.lit("readme of the and tion").alias("query"))


_SCORED = "WITH" + _LINES + ", sc AS (SELECT *, least(length(content) / 400.0, 1.0) AS score FROM chunks)"


@query(_SCORED + """,
b AS (SELECT *, max(score) OVER () AS best, lower(trim(string_split(lower(name), ':')[1])) AS nm, regexp_replace(content, '^\\s+|\\s+$', '', 'g') AS tr FROM sc),
g AS (SELECT *, length(nm) >= 3 AND contains('readme of the and tion', nm) AS hit FROM b),
f AS (SELECT *, CASE WHEN hit THEN 1.2 + (least(length(nm), 8) - 3) * 0.12 ELSE 1 END * CASE WHEN length(tr) < 50 THEN 0.9 ELSE 1 END AS f FROM g)
SELECT doc_id, chunk_index, round(CASE WHEN score >= 0.5 * best THEN score * CASE WHEN hit THEN f ELSE least(f, 1.15) END ELSE score END, 6) AS score FROM f""")
def r10_rerank(spark: SparkSession, d: str) -> DataFrame:
    return R.rerank(_scored_lines(spark, d)).select("doc_id", "chunk_index", F.round("score", 6).alias("score"))


@query(_SCORED + """,
u AS (SELECT *, start_line - lag(start_line) OVER w AS gap FROM sc WHERE score >= 0.5 WINDOW w AS (PARTITION BY file_path ORDER BY start_line)),
i AS (SELECT *, sum(CASE WHEN gap <= 2 THEN 0 ELSE 1 END) OVER (PARTITION BY file_path ORDER BY start_line) AS isl FROM u)
SELECT file_path, min(start_line) AS start_line, max(start_line) AS end_line, md5(string_agg(content, chr(10) ORDER BY start_line)) AS content_md5, round(max(score), 6) AS score FROM i GROUP BY file_path, isl""")
def r12_consolidate(spark: SparkSession, d: str) -> DataFrame:
    found = R.consolidate(_scored_lines(spark, d).where("score >= 0.5"))
    return found.select("file_path", "start_line", "end_line", F.md5(F.col("content").cast("binary")).alias("content_md5"), F.round("score", 6).alias("score"))


@query("WITH" + _LINES + """, w AS (SELECT c.doc_id, c.chunk_index, md5(p.content) AS before_md5, md5(n.content) AS after_md5 FROM chunks c
LEFT JOIN chunks p ON p.file_path = c.file_path AND p.chunk_index = c.chunk_index - 1 LEFT JOIN chunks n ON n.file_path = c.file_path AND n.chunk_index = c.chunk_index + 1) SELECT * FROM w""")
def r13_context(spark: SparkSession, d: str) -> DataFrame:
    chunks = lines(spark, d)
    got = R.with_context(chunks, chunks)
    return got.select("doc_id", "chunk_index", F.md5(F.col("context_before").cast("binary")).alias("before_md5"), F.md5(F.col("context_after").cast("binary")).alias("after_md5"))


@query("WITH" + _LINES + """ SELECT doc_id, chunk_index, name FROM chunks WHERE chunk_type = 'section' AND contains(lower(name), 'the')
ORDER BY CASE WHEN trim(string_split(lower(name), ':')[1]) = 'the' THEN 0 ELSE 1 END, file_path, chunk_index LIMIT 20""")
def r15_find_by_name(spark: SparkSession, d: str) -> DataFrame:
    return R.find_by_name(lines(spark, d), "the", ["section"], 20).select("doc_id", "chunk_index", "name")


@query("WITH" + _LINES + " SELECT doc_id, chunk_index, language FROM chunks WHERE chunk_type = 'section' AND language IN ('en', 'de') AND regexp_full_match(file_path, 'src1.*\\.txt')")
def f3_post_filter(spark: SparkSession, d: str) -> DataFrame:
    return R.post_filter(lines(spark, d), ["section"], ["en", "de"], "src1*.txt").select("doc_id", "chunk_index", "language")


@query()
def r11_diversity(spark: SparkSession, d: str) -> DataFrame:
    """A greedy choice, beyond SQL; tested against a plain restatement."""
    return R.diversify(_scored_lines(spark, d).withColumn("seq", F.col("doc_id") * 100_000 + F.col("chunk_index")).orderBy(F.desc("score"), "seq").limit(6 * TOP), TOP).select("doc_id", "chunk_index")


@query()
def search_hybrid(spark: SparkSession, d: str) -> DataFrame:
    """Every benchmark item as a query over all lines, by words and (offline, hashed) vectors; rows only, as the
    order-dependent choice is in it."""
    chunks = lines(spark, d)
    searcher = Searcher.build(chunks.withColumn("embedding", hashed_vector(F.col("content"))), hashed_vector)
    queries = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return searcher.search(queries, TOP).select("query_id", "rank", "file_path", "start_line", "end_line", F.round("score", 6).alias("score"), "label")


# --- chunks ---------------------------------------------------------------------------------------------


@query("""WITH l AS (SELECT doc_id, coalesce(source, 'none') || '/' || doc_id || '.txt' AS p, text FROM documents WHERE text IS NOT NULL AND length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) >= 5)
SELECT p AS file_path, CAST(len(string_split(text, chr(10))) AS INTEGER) AS file_lines FROM l""")
def k14_generic_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of all documents as text files; the SQL checks which files have any, and their lines."""
    return C.chunk_files(files(spark, d)).groupBy("file_path").agg(F.max("file_lines").alias("file_lines"))


@query("WITH" + _LINES + """, n AS (SELECT file_path, chunk_index, row_number() OVER w - 1 AS k, count(*) OVER (PARTITION BY file_path) AS t, regexp_extract(file_path, '([^/]+)\\.txt$', 1) AS stem FROM chunks WINDOW w AS (PARTITION BY file_path ORDER BY start_line))
SELECT file_path, CAST(k AS INTEGER) AS chunk_index, CAST(t AS INTEGER) AS total_chunks, stem || '_' || k AS chunk_id, CASE WHEN k > 0 THEN stem || '_' || (k - 1) END AS prev_chunk_id, CASE WHEN k < t - 1 THEN stem || '_' || (k + 1) END AS next_chunk_id FROM n""")
def k20_links(spark: SparkSession, d: str) -> DataFrame:
    return C.link_chunks(lines(spark, d)).select("file_path", "chunk_index", "total_chunks", "chunk_id", "prev_chunk_id", "next_chunk_id")


@query("WITH" + _LINES + """, t AS (SELECT file_path, chunk_type, list(name ORDER BY start_line) AS names FROM chunks GROUP BY ALL),
r AS (SELECT file_path, chunk_type, chunk_type || ': ' || array_to_string(names[1:15], ', ') || CASE WHEN len(names) > 15 THEN ', ... and ' || (len(names) - 15) || ' more' ELSE '' END AS line FROM t)
SELECT file_path, md5(string_agg(line, chr(10) ORDER BY chunk_type)) AS overview_md5 FROM r GROUP BY file_path""")
def k19_overview(spark: SparkSession, d: str) -> DataFrame:
    return C.overviews(lines(spark, d)).select("file_path", F.md5(F.col("content").cast("binary")).alias("overview_md5"))


@query("SELECT page_id, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) AS title FROM pages")
def x1_title(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", H.title_tag(F.col("html")).alias("title"))


@query()
def x1_html_extract(spark: SparkSession, d: str) -> DataFrame:
    """Pages to markdown: a tree parser's work, beyond SQL; tested on pages with known results."""
    return H.extract_pages(table(spark, d, "pages"), "page_id").select("page_id", "title", "word_count", F.size("links").alias("n_links"), F.md5(F.col("content").cast("binary")).alias("content_md5"))


@query()
def k13_html_chunks(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "pages").select(F.concat(F.col("page_id").cast("string"), F.lit(".html")).alias("file_path"), F.col("html").alias("content"))
    return C.chunk_files(pages).groupBy("file_path", "chunk_type").agg(F.count("*").alias("n"))


# --- urls and crawling ----------------------------------------------------------------------------------

_HREFS = """h AS (SELECT page_id, url, unnest(list_filter(regexp_extract_all(html, '<a\\s[^>]*href="([^"]*)"', 1), lambda x: x <> '' AND NOT regexp_matches(x, '^(#|javascript:|mailto:)'))) AS href FROM pages)"""


@query("WITH " + _HREFS + " SELECT page_id, count(*) AS n, count(DISTINCT href) AS n_distinct FROM h GROUP BY page_id")
def x1_links(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", F.explode(H.hrefs(F.col("html"))).alias("href")).groupBy("page_id").agg(F.count("*").alias("n"), F.count_distinct("href").alias("n_distinct"))


@query("SELECT page_id, coalesce(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.\\-]*://([^/?#]*)', 1), '') AS host, regexp_replace(lower(trim(coalesce(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.\\-]*://([^/?#]*)', 1), ''))), '^www\\.', '') AS domain FROM pages")
def n2_domains(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", T.url_host("url").alias("host"), T.normalise_domain(T.url_host("url")).alias("domain"))


@query("""WITH p AS (SELECT DISTINCT url, regexp_replace(lower(regexp_extract(url, '://([^/?#]*)', 1)), '^www\\.', '') AS dom FROM pages WHERE url IS NOT NULL)
SELECT dom AS domain, count(*) FILTER (WHERE NOT ends_with(dom, '.net')) AS allowed, count(*) FILTER (WHERE ends_with(dom, '.net')) AS blocked FROM p GROUP BY dom""")
def j10_check_domains(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "pages").where("url is not null").select("url").distinct()
    listed = pages.select(T.normalise_domain(T.url_host("url")).alias("domain")).where("domain like '%.net'").distinct()
    return S.check_domains(pages, listed).groupBy("domain").agg(F.count_if("allowed").alias("allowed"), F.count_if(~F.col("allowed")).alias("blocked"))


# --- statistics -----------------------------------------------------------------------------------------


@query("WITH" + _LINES + """ SELECT 'total' AS kind, NULL AS value, count(*) AS n FROM chunks UNION ALL SELECT 'files', NULL, count(DISTINCT file_path) FROM chunks
UNION ALL SELECT 'chunk_type', chunk_type, count(*) FROM chunks GROUP BY 2 UNION ALL SELECT 'language', language, count(*) FROM chunks GROUP BY 2""")
def a1_index_stats(spark: SparkSession, d: str) -> DataFrame:
    return A.index_stats(lines(spark, d))


def scrape_log(spark: SparkSession, d: str) -> DataFrame:
    ok = F.col("event_type") != "error"
    return table(spark, d, "events").select(
        F.col("ts").cast("timestamp").alias("ts"), F.concat(F.lit("www.D"), F.col("user_id").cast("string")).alias("domain"), ok.alias("success"), F.floor(F.col("value") * 10).cast("int").alias("word_count"),
        F.col("event_type").alias("extractor"), F.when(~ok, F.get_json_object("props", "$.k")).alias("error"), "event_id", "user_id",
    )


_LOG = "log AS (SELECT event_id, ts, 'd' || user_id AS domain, event_type <> 'error' AS success, CAST(floor(value * 10) AS INTEGER) AS word_count, event_type AS extractor, CASE WHEN event_type = 'error' THEN json_extract_string(props, '$.k') END AS error FROM events)"
_STATS = _LOG + """,
e AS (SELECT domain, error, min(ts) AS seen FROM log WHERE NOT success AND error IS NOT NULL GROUP BY ALL),
e5 AS (SELECT domain, list(error ORDER BY seen, error) AS errors FROM (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY seen DESC, error DESC) AS k FROM e) WHERE k <= 5 GROUP BY domain),
st AS (SELECT domain, count(*) AS total, count(*) FILTER (WHERE success) AS success, count(*) FILTER (WHERE NOT success) AS fail, CAST(coalesce(sum(word_count) FILTER (WHERE success), 0) AS BIGINT) AS total_words, list(DISTINCT extractor ORDER BY extractor) AS extractors FROM log GROUP BY domain)"""


@query("WITH " + _STATS + " SELECT domain, total, success, fail, total_words, array_to_string(extractors, ',') AS extractors, coalesce(array_to_string(errors, ','), '') AS errors, CASE WHEN success > 0 THEN CAST(total_words // success AS BIGINT) ELSE 0 END AS avg_words FROM st LEFT JOIN e5 USING (domain)")
def a5_domain_stats(spark: SparkSession, d: str) -> DataFrame:
    return A.domain_stats(scrape_log(spark, d)).withColumn("extractors", F.concat_ws(",", "extractors")).withColumn("errors", F.concat_ws(",", "errors"))


@query("WITH " + _LOG + " SELECT domain, round(count(*) FILTER (WHERE success) / count(*), 3) AS success_rate FROM log GROUP BY domain")
def a8_success_rate(spark: SparkSession, d: str) -> DataFrame:
    rounds = scrape_log(spark, d).select(T.normalise_domain("domain").alias("domain"), F.lit(1).alias("attempts"), F.col("success").cast("int").alias("successes"))
    return A.success_rate(rounds, "attempts", "successes", "domain")


@query("WITH " + _LOG + ", c AS (SELECT domain, error, count(*) AS n FROM log WHERE NOT success AND error IS NOT NULL GROUP BY ALL) SELECT domain, string_agg(error || '=' || n, ',' ORDER BY error) AS failures FROM c GROUP BY domain")
def a11_failures_by_reason(spark: SparkSession, d: str) -> DataFrame:
    got = A.failures_by_reason(scrape_log(spark, d).where("error is not null").withColumn("domain", T.normalise_domain("domain")), "domain")
    pairs = F.transform(F.map_entries("failures"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return got.select("domain", F.concat_ws(",", pairs).alias("failures"))


def rounds(spark: SparkSession, d: str) -> DataFrame:
    """A session per user and a round per day."""
    return table(spark, d, "events").groupBy("user_id", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.sum(F.floor(F.col("value") * 10)).cast("long").alias("tokens"), F.count("*").alias("seconds"))


_ROUNDS = "r AS (SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, CAST(sum(floor(value * 10)) AS BIGINT) AS tokens, count(*) AS seconds FROM events GROUP BY ALL)"


@query("WITH " + _ROUNDS + """ SELECT user_id, day, tokens, seconds, CAST(sum(tokens) OVER (w ROWS UNBOUNDED PRECEDING) AS BIGINT) AS corpus_tokens, round(avg(seconds) OVER (w ROWS 2 PRECEDING) * 1.5, 6) AS next_round_estimate,
tokens < 500 AND coalesce(lag(tokens) OVER w < 500, false) AS stalled FROM r WINDOW w AS (PARTITION BY user_id ORDER BY day)""")
def w3_round_metrics(spark: SparkSession, d: str) -> DataFrame:
    got = A.round_metrics(rounds(spark, d), "user_id", "day", "tokens", "seconds")
    return got.withColumn("next_round_estimate", F.round("next_round_estimate", 6))


@query("SELECT source, count(*) FILTER (WHERE NOT p) AS active_files, count(*) FILTER (WHERE p) AS pruned_files, CAST(coalesce(sum(w) FILTER (WHERE NOT p), 0) AS BIGINT) AS total_words, CAST(coalesce(sum(t) FILTER (WHERE NOT p), 0) AS BIGINT) AS total_tokens FROM (SELECT source, length(text) < 200 AS p, len(regexp_extract_all(text, '[^ \\t\\n\\v\\f\\r]+')) AS w, length(text) // 4 AS t FROM documents WHERE text IS NOT NULL) GROUP BY source")
def a7_session_summary(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").where("text is not null").select("source", (F.length("text") < 200).alias("is_pruned"), T.word_count("text").alias("words"), T.token_estimate("text").alias("tokens"))
    return A.session_summary(rows, "source")


_MANIFEST = "m AS (SELECT lang AS language, length(text) AS size, len(string_split(text, chr(10))) AS chunks FROM documents WHERE text IS NOT NULL)"
_PATTERNS = _MANIFEST + ", top AS (SELECT language, count(*) AS n FROM m GROUP BY 1 ORDER BY n DESC, language DESC LIMIT 1), pt AS (SELECT count(*) AS total_files, CAST(sum(chunks) AS BIGINT) AS total_chunks, avg(chunks / greatest(1.0, size / 1000)) AS ratio, avg(size) AS mean, count(*) FILTER (WHERE size > 10000) AS large_files, count(*) FILTER (WHERE size < 500) AS small_files FROM m)"


def manifest(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text is not null").select(F.col("lang").alias("language"), F.length("text").alias("size"), F.size(F.split("text", "\n")).alias("chunks"))


@query("WITH " + _PATTERNS + " SELECT total_files, total_chunks, round(ratio, 6) AS avg_chunk_ratio, round(mean, 6) AS avg_file_size, large_files, small_files, language AS dominant, n AS dominant_files FROM pt, top")
def a14_manifest_patterns(spark: SparkSession, d: str) -> DataFrame:
    return A.manifest_patterns(manifest(spark, d)).withColumn("avg_chunk_ratio", F.round("avg_chunk_ratio", 6)).withColumn("avg_file_size", F.round("avg_file_size", 6))


@query("WITH " + _PATTERNS + """, a AS (SELECT large_files > 5 AS l, ratio < 1 AS lo, ratio > 3 AS hi, small_files / total_files > 0.3 AS s FROM pt)
SELECT round(least(1.0, 0.5 + CASE WHEN l THEN 0.1 ELSE 0 END + CASE WHEN lo THEN 0.15 ELSE 0 END + CASE WHEN hi THEN 0.1 ELSE 0 END + CASE WHEN s THEN 0.1 ELSE 0 END), 6) AS confidence,
CAST(CASE WHEN l THEN 8 ELSE 0 END + CASE WHEN lo THEN 12 ELSE 0 END + CASE WHEN hi THEN 5 ELSE 0 END + CASE WHEN s THEN 3 ELSE 0 END AS INTEGER) AS expected_improvement FROM a""")
def a15_advice(spark: SparkSession, d: str) -> DataFrame:
    return A.tuning_advice(A.manifest_patterns(manifest(spark, d))).select("confidence", "expected_improvement")


@query("SELECT role, count(*) AS calls, CAST(sum(i) AS BIGINT) AS input_tokens, CAST(sum(o) AS BIGINT) AS output_tokens, round((sum(i) * 0.5 + sum(o) * 1.5) / 1e6, 6) AS cost FROM (SELECT role, length(text) // 4 AS i, length(text) // 8 AS o FROM conversations WHERE text IS NOT NULL) WHERE i <> 0 OR o <> 0 GROUP BY role")
def a16_model_cost(spark: SparkSession, d: str) -> DataFrame:
    usage = table(spark, d, "conversations").where("text is not null").select("role", T.token_estimate("text").alias("input_tokens"), F.floor(F.length("text") / 8).alias("output_tokens"))
    return A.model_cost(usage, 0.5, 1.5, "role")


@query("SELECT conv_id, turn, CASE WHEN len(w) > 0 THEN round(1 - len(list_distinct(w)) / len(w), 6) ELSE 0 END AS ratio FROM (SELECT conv_id, turn, regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\v\\f\\r]+') AS w FROM conversations)")
def a17_repetition(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select("conv_id", "turn", F.round(T.repetition_ratio("text"), 6).alias("ratio"))


@query("SELECT conv_id, turn, md5(coalesce(string_agg(text, chr(10)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), '')) AS context_md5 FROM conversations")
def w9_recent_context(spark: SparkSession, d: str) -> DataFrame:
    got = A.recent_context(table(spark, d, "conversations"), "conv_id", "turn", "text")
    return got.select("conv_id", "turn", F.md5(F.col("context").cast("binary")).alias("context_md5"))


@query("SELECT text_md5, min(doc_id) AS doc_id FROM (SELECT md5(text) AS text_md5, doc_id FROM documents WHERE text IS NOT NULL) GROUP BY text_md5")
def w8_first_occurrence(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").where("text is not null").select(F.md5(F.col("text").cast("binary")).alias("text_md5"), "doc_id")
    return A.first_occurrences(rows, "text_md5", "doc_id")


# --- texts ----------------------------------------------------------------------------------------------


@query("SELECT doc_id, sha256(text) AS sha, length(text) // 4 AS tokens, len(regexp_extract_all(text, '[^ \\t\\n\\v\\f\\r]+')) AS words FROM documents WHERE text IS NOT NULL")
def n13_hash_and_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("sha"), T.token_estimate("text").alias("tokens"), T.word_count("text").cast("long").alias("words"))


@query("SELECT doc_id, substr(CASE WHEN length(text) > 400 THEN text[1:380] || chr(10) || '[...truncated...]' ELSE text END, 1, 500) AS t FROM documents WHERE text IS NOT NULL")
def n7_truncate(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.substring(T.truncate_to_budget("text", 100), 1, 500).alias("t"))


@query("""WITH p AS (SELECT page_id, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) AS t FROM pages)
SELECT page_id, substr(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(t), '^\\s+|\\s+$', '', 'g'), '[^\\p{L}\\p{M}\\p{N}_\\s\\-]', '', 'g'), '[\\s_]+', '-', 'g'), '-+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 60) AS slug FROM p""")
def n1_slug(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", T.slug(H.title_tag(F.col("html"))).alias("slug"))


@query("""WITH w AS (SELECT doc_id, regexp_replace(text, '^[ \\t\\n\\v\\f\\r]+|[ \\t\\n\\v\\f\\r]+$', '', 'g') AS t FROM documents WHERE text IS NOT NULL),
b AS (SELECT doc_id, array_to_string(list_filter(list_transform(string_split(t, chr(10)), lambda x: regexp_replace(x, '[ \\t\\n\\v\\f\\r]+$', '')), lambda x: x <> ''), chr(10)) AS b FROM w)
SELECT doc_id, md5(CASE WHEN b <> '' THEN '```python' || chr(10) || b || chr(10) || '```' ELSE b END) AS body_md5 FROM b""")
def n14_preprocess(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.md5(T.preprocess_code("text").cast("binary")).alias("body_md5"))


@query()
def n19_response_issues(spark: SparkSession, d: str) -> DataFrame:
    """Back references are beyond DuckDB's expressions; tested on answers with known faults."""
    return table(spark, d, "conversations").select("conv_id", "turn", T.response_issue("text").alias("issue"))


@query("""WITH t AS (SELECT doc_id, trim(substr(regexp_replace(regexp_replace(lower(text), '[\\s\\x0B\\x{85}\\p{Z}]+', ' ', 'g'), '[^\\p{L}\\p{M}\\p{N}\\p{Pc}\\s\\x0B]', '', 'g'), 1, 2000)) AS t FROM documents WHERE text IS NOT NULL),
s AS (SELECT doc_id, list_distinct([t[i:i + 2] FOR i IN range(1, length(t) - 1)]) AS s FROM t WHERE length(t) >= 3),
c AS (SELECT list_sort(s) AS s, min(doc_id) AS rep FROM s GROUP BY 1),
g AS (SELECT rep, len(s) AS n, unnest(s) AS g FROM c),
o AS (SELECT a.rep AS a, b.rep AS b, a.n AS na, b.n AS nb, count(*) AS k FROM g a JOIN g b ON a.g = b.g AND a.rep < b.rep AND 10 * least(a.n, b.n) >= 9 * greatest(a.n, b.n) GROUP BY ALL)
SELECT a, b, round(k / (na + nb - k), 6) AS similarity FROM o WHERE 10 * k >= 9 * (na + nb - k)""")
def m11_trigram_pairs(spark: SparkSession, d: str) -> DataFrame:
    classes = N.trigram_classes(table(spark, d, "documents"), "doc_id", "text", limit=2000)
    return N.trigram_pairs(classes).select("a", "b", F.round("similarity", 6).alias("similarity"))


@query()
def m11_prune(spark: SparkSession, d: str) -> DataFrame:
    """Keepers are settled in order of time, beyond SQL; tested against a plain fold."""
    return N.prune_by_text(table(spark, d, "documents"), "doc_id", "text", "doc_id").withColumn("similarity", F.round("similarity", 6))


@query()
def n8_corpus_excerpts(spark: SparkSession, d: str) -> DataFrame:
    rows = files(spark, d).where("content is not null").select(F.col("file_path").alias("path"), "content", "language")
    return P.corpus_excerpts(rows, 8000, "language").select("path", F.md5(F.col("excerpt").cast("binary")).alias("excerpt_md5"))


# --- changes and events ---------------------------------------------------------------------------------


@query("""WITH RECURSIVE e AS (SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
r AS (SELECT user_id, event_id, ts, k, true AS ok, ts AS last FROM e WHERE k = 1
UNION ALL SELECT e.user_id, e.event_id, e.ts, e.k, e.ts - r.last >= INTERVAL 3600 SECOND, CASE WHEN e.ts - r.last >= INTERVAL 3600 SECOND THEN e.ts ELSE r.last END FROM r JOIN e ON e.user_id = r.user_id AND e.k = r.k + 1)
SELECT event_id FROM r WHERE ok""")
def z2_debounce(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events").select("user_id", "event_id", "ts")
    return Z.debounce(events, "user_id", "ts", "event_id", 3600.0).select("event_id")


@query("""WITH RECURSIVE e AS (SELECT event_id, ts, row_number() OVER (ORDER BY ts, event_id) AS k FROM events),
n AS MATERIALIZED (SELECT k, min(k) OVER (ORDER BY ts RANGE BETWEEN INTERVAL 600 SECOND FOLLOWING AND UNBOUNDED FOLLOWING) AS nk FROM e),
r AS (SELECT CAST(1 AS BIGINT) AS k UNION ALL SELECT n.nk FROM r JOIN n USING (k) WHERE n.nk IS NOT NULL)
SELECT event_id FROM e WHERE k IN (SELECT k FROM r)""")
def z2_debounce_hot(spark: SparkSession, d: str) -> DataFrame:
    """All events under one key, over all tasks."""
    events = table(spark, d, "events").select(F.lit("all").alias("path"), "event_id", "ts")
    return Z.debounce(events, "path", "ts", "event_id", 600.0, stretch=2000).select("event_id")


@query("SELECT CAST(date_trunc('hour', ts) AS TIMESTAMP) AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def ext_tumbling_events(spark: SparkSession, d: str) -> DataFrame:
    """An extension: hourly windows."""
    return Z.windowed_counts(table(spark, d, "events"), "ts", "event_type").select(F.col("begin").cast("timestamp_ntz").alias("hour"), "event_type", "n", F.round("total", 4).alias("total"))
