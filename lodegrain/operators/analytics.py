"""Aggregations and windows over indexes, scrape logs, sessions and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodegrain.functions import text as T

ROBOTS_LIMIT, FAIL_LIMIT = 2, 5
STALL_TOKENS = 500


def index_stats(chunks: DataFrame) -> DataFrame:
    """(kind, value, n): total chunks, files, and chunks by type and language, in one pass of grouping sets."""
    by = chunks.groupingSets([[], ["chunk_type"], ["language"]], "chunk_type", "language").agg(F.count("*").alias("n"), F.count_distinct("file_path").alias("files"), F.grouping_id().alias("g"))
    rows = by.select(F.when(F.col("g") == 3, "total").when(F.col("g") == 1, "chunk_type").otherwise("language").alias("kind"), F.when(F.col("g") == 1, F.col("chunk_type")).when(F.col("g") == 2, F.col("language")).alias("value"), "n", "files", "g")
    return rows.select("kind", "value", "n").unionByName(rows.where("g = 3").select(F.lit("files").alias("kind"), F.lit(None).cast("string").alias("value"), F.col("files").alias("n")))


def domain_stats(log: DataFrame) -> DataFrame:
    """Per domain of a scrape log (ts, domain, success, word_count, extractor, error): attempts, words of the
    successful ones, extractors by name, and the last five different errors by first sight."""
    log = log.withColumn("domain", T.normalise_domain("domain"))
    first = log.where("not success and error is not null").groupBy("domain", "error").agg(F.min("ts").alias("seen"))
    late = W.partitionBy("domain").orderBy(F.desc("seen"), F.desc("error"))  # five a domain before any list is made
    first = first.withColumn("k", F.row_number().over(late)).where("k <= 5")
    errors = first.groupBy("domain").agg(F.transform(F.array_sort(F.collect_list(F.struct("seen", "error"))), lambda x: x["error"]).alias("errors"))
    ok = F.col("success")
    counted = log.groupBy("domain").agg(F.count("*").alias("total"), F.count_if(ok).alias("success"), F.count_if(~ok).alias("fail"), F.sum(F.when(ok, F.col("word_count")).otherwise(0)).alias("total_words"), F.array_sort(F.collect_set("extractor")).alias("extractors"))
    return counted.join(errors, "domain", "left").withColumn("errors", F.coalesce("errors", F.array().cast("array<string>"))).withColumn("avg_words", F.when(F.col("success") > 0, F.floor(F.col("total_words") / F.col("success"))).otherwise(0))


def auto_blacklist(stats: DataFrame, whitelist: DataFrame, blacklist: DataFrame) -> DataFrame:
    """(domain, reason) of the domains to block: no success, and robots.txt named in two failures or five
    attempts; listed domains are exempt."""
    robots = F.exists("errors", lambda e: F.lower(e).contains("robots.txt"))
    hit = stats.where((F.col("success") == 0) & ((robots & (F.col("fail") >= ROBOTS_LIMIT)) | (F.col("total") >= FAIL_LIMIT)))
    free = hit.join(whitelist.select("domain"), "domain", "left_anti").join(blacklist.select("domain"), "domain", "left_anti")
    reason = F.when(robots & (F.col("fail") >= ROBOTS_LIMIT), F.format_string("Auto-blocked: robots.txt denied access (%d times)", "fail")).otherwise(F.format_string("Auto-blocked: %d consecutive failures, 0 successes", "fail"))
    return free.select("domain", reason.alias("reason"))


def failing_domains(attempts: DataFrame, failures: int = 2) -> DataFrame:
    """Domains with at least so many failures and no success."""
    return attempts.groupBy("domain").agg(F.count_if(~F.col("success")).alias("fail"), F.count_if("success").alias("ok")).where((F.col("fail") >= failures) & (F.col("ok") == 0)).select("domain", "fail")


def success_rate(rounds: DataFrame, attempts: str, successes: str, *by: str) -> DataFrame:
    return rounds.groupBy(*by).agg(F.coalesce(F.round(F.sum(successes) / F.nullif(F.sum(attempts), F.lit(0)), 3), F.lit(0.0)).alias("success_rate"))


def round_metrics(rounds: DataFrame, session: str, order: str, tokens: str, seconds: str) -> DataFrame:
    """Per round: corpus growth (running tokens), the estimate of the next round (mean of the last three by one
    and a half), and stall (this and the last round both under 500 tokens)."""
    w = W.partitionBy(session).orderBy(order)
    return rounds.select(
        "*",
        F.sum(tokens).over(w.rowsBetween(W.unboundedPreceding, 0)).alias("corpus_tokens"),
        (F.avg(seconds).over(w.rowsBetween(-2, 0)) * 1.5).alias("next_round_estimate"),
        ((F.max(tokens).over(w.rowsBetween(-1, 0)) < STALL_TOKENS) & (F.row_number().over(w) >= 2)).alias("stalled"),
    )


def session_summary(files: DataFrame, *by: str) -> DataFrame:
    """Totals over active files, and how many were pruned."""
    live = ~F.col("is_pruned")
    return files.groupBy(*by).agg(F.count_if(live).alias("active_files"), F.count_if("is_pruned").alias("pruned_files"), F.sum(F.when(live, F.col("words")).otherwise(0)).alias("total_words"), F.sum(F.when(live, F.col("tokens")).otherwise(0)).alias("total_tokens"))


def failures_by_reason(attempts: DataFrame, *by: str) -> DataFrame:
    """A map from reason to count, per group."""
    counted = attempts.where("not success").groupBy(*by, "error").agg(F.count("*").alias("n"))
    return counted.groupBy(*by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("error", "n")))).alias("failures"))


def manifest_patterns(manifest: DataFrame) -> DataFrame:
    """One row: files, chunks, mean chunks a KB, mean size, large and small files, the most frequent language."""
    top = manifest.groupBy("language").agg(F.count("*").alias("n")).agg(F.max_by("language", F.struct("n", "language")).alias("dominant"), F.max("n").alias("dominant_files"))
    per_kb = F.col("chunks") / F.greatest(F.lit(1.0), F.col("size") / 1000)
    return manifest.agg(F.count("*").alias("total_files"), F.sum("chunks").alias("total_chunks"), F.avg(per_kb).alias("avg_chunk_ratio"), F.avg("size").alias("avg_file_size"), F.count_if(F.col("size") > 10000).alias("large_files"), F.count_if(F.col("size") < 500).alias("small_files")).crossJoin(F.broadcast(top))


def tuning_advice(patterns: DataFrame) -> DataFrame:
    """(changes, confidence, expected_improvement, apply): rules over :func:`manifest_patterns`."""
    share = F.col("dominant_files") / F.col("total_files")
    ratio = F.col("avg_chunk_ratio")
    rules = [
        ((share > 0.3) & (F.col("dominant") == "python") & (ratio < 1.5), "Increase Python chunk size to 3000 for better function context", 0.2, 15),
        ((share > 0.3) & (F.col("dominant") == "markdown") & (ratio < 1.2), "Use header-based chunking for Markdown files", 0.15, 10),
        (F.col("large_files") > 5, "Reduce streaming threshold to 5KB for better large file handling", 0.1, 8),
        (ratio < 1.0, "Reduce chunk size for more granular search results", 0.15, 12),
        (ratio > 3.0, "Increase chunk size to reduce overhead", 0.1, 5),
        (F.col("small_files") / F.col("total_files") > 0.3, "Skip files smaller than 300 bytes to improve focus", 0.1, 3),
    ]
    changes = F.array_compact(F.array(*(F.when(c, F.lit(t)) for c, t, _, _ in rules)))
    sure = F.round(F.least(F.lit(1.0), sum((F.when(c, F.lit(x)).otherwise(0.0) for c, _, x, _ in rules), F.lit(0.5))), 6)
    gain = sum((F.when(c, F.lit(x)).otherwise(0) for c, _, _, x in rules), F.lit(0))
    return patterns.select(changes.alias("changes"), sure.alias("confidence"), gain.alias("expected_improvement")).withColumn("apply", F.col("confidence") > 0.7)


def model_cost(usage: DataFrame, input_price: float, output_price: float, *by: str) -> DataFrame:
    """Tokens and cost (prices per million); rows of zero tokens are ignored."""
    used = usage.where((F.col("input_tokens") != 0) | (F.col("output_tokens") != 0))
    total = used.groupBy(*by).agg(F.count("*").alias("calls"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"))
    return total.withColumn("cost", F.round((F.col("input_tokens") * input_price + F.col("output_tokens") * output_price) / 1e6, 6))


def recent_context(turns: DataFrame, session: str, order: str, entry: str, last: int = 3) -> DataFrame:
    """Add ``context``: the ``last`` entries before each one, by line."""
    w = W.partitionBy(session).orderBy(order).rowsBetween(-last, -1)
    return turns.withColumn("context", F.concat_ws("\n", F.collect_list(entry).over(w)))


def first_occurrences(rows: DataFrame, by: str, *order: str) -> DataFrame:
    """The first row of each value, by order.  The minimum is taken before anything is shuffled, so a value
    with any number of rows is one row from each task."""
    whole = F.struct(*(F.col(c) for c in (*order, *(c for c in rows.columns if c not in order and c != by))))
    first = rows.groupBy(by).agg(F.min(whole).alias("_r"))
    return first.select(by, "_r.*").select(*rows.columns)


def mean_vectors(vectors: DataFrame, by: str, vector: str) -> DataFrame:
    """Mean of the vectors of each group, component by component."""
    parts = vectors.select(by, F.posexplode(vector).alias("i", "x"))
    mean = parts.groupBy(by, "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return mean.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("mean"))


def session_report(rounds: DataFrame, session: str, order: str, seconds: str, tokens: str, confidence: str) -> DataFrame:
    """Per session: mean seconds of a round (two digits), the confidences in order of the rounds, tokens and rounds."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(confidence).alias("c")))), lambda x: x["c"])
    return rounds.groupBy(session).agg(F.round(F.avg(seconds), 2).alias("mean_seconds"), ordered.alias("trend"), F.sum(tokens).alias("tokens"), F.count("*").alias("rounds"))


def domain_counters(log: DataFrame) -> DataFrame:
    """(domain, attempts, successes, failures) of a scrape log."""
    return log.groupBy(T.normalise_domain("domain").alias("domain")).agg(F.count("*").alias("attempts"), F.count_if("success").alias("successes"), F.count_if(~F.col("success")).alias("failures"))


def corpus_totals(files: DataFrame) -> DataFrame:
    """(files, words, tokens) of a corpus, pruned files left out."""
    live = files.where(~F.col("is_pruned"))
    return live.agg(F.count("*").alias("files"), F.coalesce(F.sum("words"), F.lit(0)).alias("words"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"))
