"""Hybrid search over an index of chunks: both retrievers, fusion, filters, ranking, diversity, neighbours."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodegrain.functions import text as T
from lodegrain.operators import retrieval as R
from lodegrain.operators.segments import Snapshot
from lodegrain.sources.workspace import bounded

KEY = ("file_path", "chunk_index")


@dataclass
class Searcher:
    """An opened index.  ``chunks`` has the chunk columns, and ``embedding`` if there are vectors; without them,
    or without a function for query vectors, keywords alone are used.  All methods take a batch of queries
    (query_id, query), a stated set, and answer it in one plan."""

    chunks: DataFrame
    keywords: R.KeywordIndex | Snapshot
    query_vector: Callable[[Column], Column] | None = None

    @classmethod
    def open(cls, snapshot: Snapshot, query_vector: Callable[[Column], Column] | None = None) -> Searcher:
        """Over a version of a kept index: nothing but the queries is tokenized."""
        return cls(snapshot.rows(), snapshot, query_vector)

    @classmethod
    def build(cls, chunks: DataFrame, query_vector: Callable[[Column], Column] | None = None) -> Searcher:
        return cls(chunks, R.build_keyword_index(chunks, KEY, T.searchable_text("content", "name", "chunk_type")), query_vector)

    def search(
        self, queries: DataFrame, top_k: int = 10, *, chunk_types: Sequence[str] | None = None, languages: Sequence[str] | None = None, file_pattern: str | None = None,
        semantic_weight: float = 0.7, bm25_weight: float = 0.3, include_context: bool = False, expanded: str = "query", prefilter: bool = False, now: Column | None = None,
    ) -> DataFrame:
        """Rows (query_id, rank, score, label, file_path, ...) per query, best first.

        Retrieval uses the column ``expanded``, ranking the query itself.  Filters follow the retrievers' limits
        unless ``prefilter`` is set.  Ties go to the better place in the first list.
        """
        chunks = R.post_filter(self.chunks, chunk_types, languages, file_pattern) if prefilter else self.chunks
        asked = queries.select("query_id", F.col(expanded).alias("_asked"))
        fetch = top_k * R.OVERFETCH
        lists = []
        if self.query_vector is not None and "embedding" in chunks.columns:
            vectors = asked.select("query_id", self.query_vector(F.col("_asked")).alias("query_vector")).where("query_vector is not null")
            lists.append((R.nearest(chunks.where("embedding is not null"), vectors, fetch, KEY), semantic_weight))
        words = self.keywords.bm25(asked, fetch, "_asked", chunks.select(*KEY) if prefilter else None)
        lists.append((words, bm25_weight))
        hits = words.select("query_id").distinct().withColumn("_words", F.lit(True))
        fused = R.fuse(lists, KEY).join(hits, "query_id", "left").withColumn("semantic_only", F.col("_words").isNull()).drop("_words")
        columns = [c for c in self.chunks.columns if c != "embedding"]
        n = queries.count()
        rows = bounded(fused, n * fetch * 2).join(self.chunks.select(*columns), list(KEY)).join(bounded(queries.select("query_id", "query"), n), "query_id")
        rows = R.rerank(R.post_filter(rows, chunk_types, languages, file_pattern), "query", now)
        rows = rows.withColumn("seq", F.col("first_list") * 1_000_000 + F.col("first_rank"))
        out = R.consolidate(R.diversify(rows, top_k))
        best = F.max("score").over(R.W.partitionBy("query_id"))
        rank = F.row_number().over(R.W.partitionBy("query_id").orderBy(F.desc("score"), "file_path", "start_line"))
        out = out.withColumn("label", T.score_label("score", best)).withColumn("rank", rank)
        if include_context:
            owners = self.chunks.select("file_path", "chunk_index", "parent_class") if "parent_class" in self.chunks.columns else None
            out = R.with_context(out.join(owners, list(KEY), "left") if owners is not None else out, self.chunks)
        return out

    def similar(self, snippets: DataFrame, top_k: int = 10, exclude_self: bool = True) -> DataFrame:
        """Chunks like each (query_id, query) snippet; equal ones are left out."""
        found = self.search(snippets, top_k * 2 if exclude_self else top_k, semantic_weight=0.8, bm25_weight=0.2)
        if exclude_self:
            strip = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
            own = snippets.select("query_id", strip(F.col("query")).alias("_own"))
            found = found.join(own, "query_id").where(strip(F.col("content")) != F.col("_own")).drop("_own")
        return self._first(found, top_k)

    def explain(self, topics: DataFrame, top_k: int = 5) -> DataFrame:
        return self.search(topics.withColumn("query", R.example_query(F.col("query"))), top_k)

    def usage(self, names: DataFrame, top_k: int = 10) -> DataFrame:
        """Chunks that hold each (query_id, query) identifier."""
        found = self.search(names.withColumn("query", R.usage_query(F.col("query"))), top_k * 2)
        held = found.join(names.select("query_id", F.col("query").alias("_name")), "query_id").where(F.contains("content", "_name")).drop("_name")
        return self._first(held, top_k)

    def function(self, name: str, limit: int = 5) -> DataFrame:
        return R.find_by_name(self.chunks, name, R.FUNCTION_TYPES, limit)

    def class_(self, name: str, limit: int = 5) -> DataFrame:
        return R.find_by_name(self.chunks, name, ("class",), limit)

    @staticmethod
    def _first(found: DataFrame, top_k: int) -> DataFrame:
        again = F.row_number().over(R.W.partitionBy("query_id").orderBy("rank"))
        return found.withColumn("rank", again).where(F.col("rank") <= top_k)
