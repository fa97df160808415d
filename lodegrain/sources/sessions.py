"""Scrape logs (JSON lines), research sessions (a folder with session.json) and domain lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from lodegrain.functions import text as T

LOG_SCHEMA = "ts timestamp, url string, domain string, extractor string, success boolean, word_count int, title string, source_type string, http_status int, error string, content_length int, has_main_content boolean, session_query string, doc_metadata map<string,string>"
SESSION_SCHEMA = "query string, created string, engine string, status string, pages_scraped int, rounds int, depth int, max_pages int"
METRICS_SCHEMA = (
    "file_registry array<struct<path:string,url:string,title:string,char_count:int,word_count:int,token_estimate:int,source_type:string,scraped_at:string,round_added:int,relevance_score:double,duplicate_of:string,is_pruned:boolean>>,"
    "round_snapshots array<struct<round_num:int,files_added:int,tokens_added:int,phase_times:map<string,double>,queries_used:array<string>,scrape_failures_by_reason:map<string,int>>>,"
    "domain_stats map<string,struct<success:int,fail:int>>, confidence_history array<string>"
)
LIST_SCHEMA = "domain string, kind string, added string, reason string, auto boolean"


def _missing(e: AnalysisException) -> bool:
    return "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e)


def _read_or_empty(read, spark: SparkSession, schema: str) -> DataFrame:
    try:
        return read()
    except AnalysisException as e:
        if not _missing(e):
            raise
        return spark.createDataFrame([], schema)


def read_scrape_log(spark: SparkSession, path: str) -> DataFrame:
    """Entries of a log; blank and corrupt lines are skipped, a missing log is empty."""
    return _read_or_empty(lambda: spark.read.schema(LOG_SCHEMA).option("mode", "DROPMALFORMED").json(path).where("url is not null"), spark, LOG_SCHEMA)


def log_entries(attempts: DataFrame, now=None) -> DataFrame:
    """Rows of the log's form from (url, extractor, success, ...) attempts: the domain is that of the url, title,
    error and query are cut to 120, 200 and 100 characters; columns that are not given are null."""
    have = set(attempts.columns)
    get = lambda c, kind: F.col(c).cast(kind) if c in have else F.lit(None).cast(kind)
    cut = lambda c, n: F.substring(F.coalesce(get(c, "string"), F.lit("")), 1, n)
    kinds = {x.split()[0]: x.split()[1] for x in LOG_SCHEMA.split(", ")}
    special = {
        "ts": now if now is not None else F.current_timestamp(), "domain": T.normalise_domain(T.url_host("url")), "title": cut("title", 120), "error": cut("error", 200), "session_query": cut("session_query", 100),
        "doc_metadata": F.transform_values(get("doc_metadata", kinds["doc_metadata"]), lambda _, v: F.substring(v, 1, 100)),
    }
    return attempts.select(*(special.get(c, get(c, k)).alias(c) for c, k in kinds.items()))


def append_scrape_log(attempts: DataFrame, path: str) -> None:
    log_entries(attempts).write.mode("append").json(path)


def list_sessions(spark: SparkSession, root: str) -> DataFrame:
    """(name, ...) of every folder with a session.json below ``root``, last name first; unknown keys are ignored."""
    read = lambda: spark.read.schema(SESSION_SCHEMA).option("multiLine", True).json(f"{root}/*/session.json").select(F.regexp_extract(F.input_file_name(), "([^/]+)/session.json$", 1).alias("name"), "*")
    return _read_or_empty(read, spark, f"name string, {SESSION_SCHEMA}").orderBy(F.desc("name"))


def read_metrics(spark: SparkSession, root: str) -> DataFrame:
    """The metrics of every session below ``root``, one row each."""
    read = lambda: spark.read.schema(METRICS_SCHEMA).option("multiLine", True).json(f"{root}/*/metrics.json").select(F.regexp_extract(F.input_file_name(), "([^/]+)/metrics.json$", 1).alias("session"), "*")
    return _read_or_empty(read, spark, f"session string, {METRICS_SCHEMA}")


def session_files(metrics: DataFrame) -> DataFrame:
    """(session, path, words, tokens, is_pruned, ...) from :func:`read_metrics`."""
    return metrics.select("session", F.inline("file_registry")).withColumnRenamed("word_count", "words").withColumnRenamed("token_estimate", "tokens")


def session_rounds(metrics: DataFrame) -> DataFrame:
    return metrics.select("session", F.inline("round_snapshots"))


def read_domain_lists(spark: SparkSession, path: str) -> DataFrame:
    """(domain, kind whitelist or blacklist, added, reason, auto)."""
    return _read_or_empty(lambda: spark.read.schema(LIST_SCHEMA).json(path), spark, LIST_SCHEMA)


def update_domain_lists(lists: DataFrame, found: DataFrame, today: str) -> DataFrame:
    """``lists`` with the (domain, reason) rows of an automatic blacklist added; listed domains stay as they are."""
    fresh = found.join(lists.select("domain"), "domain", "left_anti").select("domain", F.lit("blacklist").alias("kind"), F.lit(today).alias("added"), "reason", F.lit(True).alias("auto"))
    return lists.unionByName(fresh)
