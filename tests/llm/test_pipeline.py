"""The corpus pipeline over the smallest tables: what stages return and that clean documents stay."""

import base64
import random

import corpus_pipeline as P
from lodegrain.llm import language_id, registry

SMALL = "/root/testdata/sf0.001"


def test_registry_names():
    assert [n for n in registry.queries() if n.startswith("op")] == [f"op{i}_{n}" for i, n in enumerate(("substring_dedup", "warc", "language_id", "sharding", "lm_score", "url_filter", "ngram_join", "bpe", "decontaminate", "topk", "minhash_dedup", "whitening", "clustering"), 1)]
    assert set(registry.oracle_sql()) <= set(registry.queries()) and "pipeline" in registry.queries()


def test_stages_hand_on_documents(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    before, columns = docs, docs.columns
    for k, (name, step) in enumerate(P.STAGES):
        out = step(spark, before, SMALL)
        out.write.parquet(str(tmp_path / str(k)))
        after = spark.read.parquet(str(tmp_path / str(k)))
        if k < len(P.STAGES) - 1:
            assert after.columns == columns, name
            lost = before.join(after.select("doc_id"), "doc_id", "left_anti")
            if k == 0:
                assert after.count() >= 0.8 * before.count()
                clean = lost.where("length(text) > 400 and lang is not null").count()
                assert clean <= 0.02 * before.count()
            before = after
    assert sorted(after.columns) == ["decoded_sha256", "doc_id", "ids_sha256", "n_tokens"] and after.count() == before.count()


def test_languages_not_learnt_go(spark):
    rows = [(i, w, lang) for i, (w, lang) in enumerate([("der die das und nicht ist ein eine mit auf", "de"), ("the and of that with this from have not are", "en")] * 30)] + [(99, "12345 !!", None), (100, None, None)]
    docs = spark.createDataFrame([(i, t, lang, "s", 1) for i, t, lang in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r["doc_id"] for r in P.by_language(spark, docs, SMALL).collect()}
    assert kept == set(range(60)) and language_id.fit(docs) is not None


def test_without_labels_nothing_is_decided(spark):
    docs = spark.createDataFrame([(i, "the and of that with this from have not are", None, "s", 1) for i in range(20)], "doc_id long, text string, lang string, source string, n_chars long")
    assert P.by_language(spark, docs, SMALL).count() == 20


def test_texts_in_no_learnt_language_go(spark):
    """Texts of other languages, encoded junk and random letters have letters, but are none of the learnt."""
    rng = random.Random(3)
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    strange = [
        "kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan heille on annettu järki ja omatunto",
        "wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw są oni obdarzeni rozumem",
        "все люди рождаются свободными и равными в своем достоинстве и правах",
        "人人生而自由在尊严和权利上一律平等",
        *("".join(rng.choices("abcdefghijklmnopqrstuvwxyz      ", k=400)) for _ in range(20)),
        *(base64.b64encode(rng.randbytes(300)).decode() for _ in range(20)),
    ]
    extra = spark.createDataFrame([(10**6 + i, t, None, "s", len(t)) for i, t in enumerate(strange)], docs.select("doc_id", "text", "lang", "source", "n_chars").schema)
    kept = {r[0] for r in P.by_language(spark, docs.select(extra.columns).unionByName(extra), SMALL).select("doc_id").collect()}
    assert sum(i >= 10**6 for i in kept) <= 0.05 * len(strange)
    prose = [r[0] for r in docs.where("length(text) > 200 and lang is not null").select("doc_id").collect()]
    assert len(prose) > 50 and sum(i in kept for i in prose) >= 0.98 * len(prose)


def test_odd_tables_go_through(spark, tmp_path):
    """Null ids and texts, repeated ids, extra columns with clashing names, and an empty table."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(60)
    odd = [(None, None), (None, "the and of"), (7, ""), (10**7, "x" * 300_000), (10**7, "the words of that text " * 30), (10**7, "the words of that text " * 30)]
    extra = spark.createDataFrame([(i, t, None, None, None) for i, t in odd], docs.select("doc_id", "text", "lang", "source", "n_chars").schema)
    docs = docs.select(extra.columns).unionByName(extra).selectExpr("*", "'a' as doc", "1 as c0", "2 as root", "'b' as spans", "3 as token")
    docs.write.parquet(str(tmp_path / "in"))
    for start in ("in", "none"):
        before = spark.read.parquet(str(tmp_path / "in"))
        before = before if start == "in" else before.limit(0)
        columns = before.columns
        for k, (name, step) in enumerate(P.STAGES):
            path = str(tmp_path / f"{start}-{k}")
            step(spark, before, SMALL).write.parquet(path)
            before = spark.read.parquet(path)
            assert k == len(P.STAGES) - 1 or before.columns == columns, name
        assert (before.count() == 0) == (start == "none")
