"""The queries of this subpackage, by name, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, clustering, decontaminate, language_id, lm_score, minhash_dedup, ngram_join, sharding, substring_dedup, topk, url_filter, warc, whitening
from .common import table

#: The tokenizer file, at the same place on every machine.
TOKENIZER = str(public_tokenizers.path("word_bpe_49k.json"))
SHARDS = [f"shard-{i:03d}" for i in range(64)]


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeated_spans(table(spark, sf_dir, "documents"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = language_id.fold(F.col("doc_id"), 5) == 0
    model = language_id.fit(docs.where(~held_out))
    return language_id.identify(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", SHARDS)


def op5_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = lm_score.score_documents(table(spark, sf_dir, "documents"), language_id.fold(F.col("doc_id"), 7) != 2)
    return scored.select("doc_id", (~F.col("is_train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), "page_id", "url", url_filter.RULES)


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_documents(table(spark, sf_dir, "documents"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(table(spark, sf_dir, "documents"), TOKENIZER)


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.integer_vectors(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return topk.top_k(vectors, vectors.where("vec_id % 50 = 0"), 5)


def op11_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op13_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.cluster_vectors(table(spark, sf_dir, "embeddings"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline  # it reads this module

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_substring_dedup, op2_warc, op3_language_id, op4_sharding, op5_lm_score, op6_url_filter, op7_ngram_join, op8_bpe, op9_decontaminate, op10_topk, op11_minhash_dedup, op12_whitening, op13_clustering, pipeline)}


_OP2 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, strlen(h) AS payload_bytes, sha256(h) AS payload_digest FROM p),
m AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS least FROM d)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id > least THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id > least THEN least END AS refers_to
FROM m"""

_OP6 = """
WITH u AS (
  SELECT page_id,
         translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
r(verdict, h, p) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
hit AS (
  SELECT u.page_id, u.host, u.path, r.h || r.p AS rule, r.verdict,
         row_number() OVER (PARTITION BY u.page_id ORDER BY length(r.h || r.p) DESC NULLS LAST) AS k
  FROM u LEFT JOIN r ON (u.host = r.h OR u.host LIKE '%.' || r.h) AND starts_with(u.path, r.p))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM hit WHERE k = 1"""

_OP7 = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
         ELSE list_distinct([array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)]) END AS s FROM w),
t AS MATERIALIZED (SELECT doc_id, len(s) AS n, hash(unnest(s)) AS t FROM s),
o AS (SELECT a.doc_id AS x, b.doc_id AS y FROM t a JOIN t b ON a.t = b.t AND a.doc_id < b.doc_id
      GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
e AS MATERIALIZED (SELECT x, y FROM o UNION ALL SELECT y, x FROM o),
r(doc_id, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.y, r.root FROM r JOIN e ON e.x = r.doc_id),
m AS (SELECT doc_id, min(root) AS component_id FROM r GROUP BY doc_id)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, m.component_id FROM s JOIN m USING (doc_id)"""

_OP11 = f"""
SELECT doc_id, n_shingles, component_id, doc_id = component_id AS kept
FROM ({_OP7.replace("len(w) < 5", "len(w) < 4").replace("w[i:i + 4]", "w[i:i + 3]").replace("len(w) - 3", "len(w) - 2")})"""

_OP10 = """
WITH v AS (
  SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum([q.v[i] * c.v[i] FOR i IN range(1, len(q.v) + 1)]) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0),
k AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM k WHERE rank <= 5"""


def _op4() -> str:
    slots = sharding.build_table(SHARDS)
    return f"""
WITH s AS (SELECT doc_id, CAST(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15))::BIGINT % {sharding.TABLE_SIZE} AS INTEGER) AS slot FROM documents),
t AS (SELECT unnest([{",".join(map(str, slots))}]) AS i, unnest(range({sharding.TABLE_SIZE})) AS slot)
SELECT doc_id, slot, printf('shard-%03d', i) AS shard FROM s JOIN t USING (slot)"""


def _op13() -> str:
    """Lloyd's rounds written out, one after another; a floor of a quotient is exact, by the remainder."""
    each = range(1, clustering.DIMENSION + 1)
    parts = [f"""
WITH v AS MATERIALIZED (
  SELECT vec_id, [CAST(floor({clustering.SCALE} * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) = {clustering.DIMENSION} AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
h AS (SELECT *, row_number() OVER (ORDER BY sha256('{clustering.SEED}:' || vec_id)) - 1 AS c FROM v),
c0 AS MATERIALIZED (SELECT CAST(c AS INTEGER) AS c, v FROM h WHERE c < {clustering.K})"""]
    for r in range(clustering.ROUNDS + 1):
        parts.append(f"""
d{r} AS (SELECT vec_id, c{r}.c, list_sum([(a[1] - a[2]) * (a[1] - a[2]) FOR a IN list_zip(v.v, c{r}.v)]) AS d, v.v FROM v, c{r}),
a{r} AS MATERIALIZED (SELECT * FROM d{r} QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, c) = 1)""")
        if r < clustering.ROUNDS:
            sums = ", ".join(f"sum(v[{i}]) AS s{i}" for i in each)
            mean = ", ".join(f"CAST((s{i} - ((s{i} % n) + n) % n) // n AS BIGINT)" for i in each)
            parts.append(f"""
s{r} AS (SELECT c, count(*)::HUGEINT AS n, {sums} FROM a{r} GROUP BY c),
c{r + 1} AS MATERIALIZED (SELECT c, coalesce(m, v) AS v FROM c{r} LEFT JOIN (SELECT c, [{mean}] AS m FROM s{r}) USING (c))""")
    last = clustering.ROUNDS
    return ",".join(parts) + f"""
SELECT vec_id, c AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia,
       CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c{last}.v, ',')) AS centroid_sha256
FROM a{last} JOIN c{last} USING (c)"""


def oracle_sql() -> dict[str, str]:
    return {"op2_warc": _OP2, "op4_sharding": _op4(), "op6_url_filter": _OP6, "op7_ngram_join": _OP7, "op10_topk": _OP10, "op11_minhash_dedup": _OP11, "op13_clustering": _op13()}
