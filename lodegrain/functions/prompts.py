"""Prompts and answers of language models as column expressions, and the parsers that need a fold."""

from __future__ import annotations

import re
from functools import reduce
from operator import and_

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodegrain.sources.workspace import bounded, stage

ANALYSIS_SCHEMA = "covered array<string>, gaps array<string>, queries array<string>, confidence string"
_KEYS = ("COVERED", "GAPS", "CONFIDENCE")


def prompt_budget(max_tokens: int, template: str) -> int:
    """Tokens left for context: a fifth is kept for the answer."""
    return max_tokens - len(template) // 4 - int(max_tokens * 0.20)


def corpus_excerpts(files: DataFrame, budget: int, *by: str) -> DataFrame:
    """(by..., path, excerpt): each file's title and beginning, sharing ``budget`` tokens but at least 200 each;
    front matter is dropped and an excerpt ends at a blank."""
    text = F.when(F.startswith(F.col("content"), F.lit("---")) & (F.locate("---", F.col("content"), 4) > 0), F.trim(F.regexp_replace("content", r"(?s)^---.*?---\s*", ""))).otherwise(F.col("content"))
    # files are counted by a grouped count that is joined, not by a window, which would gather a group's texts in one task
    counts = files.groupBy(*(F.col(c).alias(f"_by{i}") for i, c in enumerate(by))).agg(F.count("*").alias("_files"))
    same = reduce(and_, (F.col(c).eqNullSafe(F.col(f"_by{i}")) for i, c in enumerate(by)), F.lit(True))
    share = F.greatest(F.lit(200), F.floor(F.lit(budget) / F.col("_files"))) * 4
    stem = F.regexp_replace(F.regexp_extract("path", "([^/]*)$", 1), r"\.[^.]*$", "")
    head = F.regexp_extract("_text", r"(?m)^# (.*)$", 1)
    cut = F.substring(F.col("_text"), F.lit(1), F.col("_share").cast("int"))
    excerpt = F.when(F.length("_text") > F.col("_share"), F.concat(F.regexp_replace(cut, r"(?s) [^ ]*$", ""), F.lit(" [...]"))).otherwise(F.col("_text"))
    counts = stage(counts, "files-of-groups")
    rows = files.join(bounded(counts, counts.count()), same).withColumn("_text", text).withColumn("_share", share)
    return rows.select(*by, "path", F.concat(F.lit("### "), F.when(head != "", F.trim(head)).otherwise(stem), F.lit("\n\n"), excerpt).alias("excerpt"))


def synthesis_prompt(results: DataFrame, most: int = 8, chars: int = 500) -> DataFrame:
    """(query_id, context): the best results of each query, the beginning of each."""
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "file_path", "start_line"))
    item = F.concat(F.lit("File: "), "file_path", F.lit("\nType: "), "chunk_type", F.lit("\n"), F.substring("content", 1, chars))
    kept = results.withColumn("_n", rank).where(F.col("_n") <= most)
    return kept.groupBy("query_id").agg(F.concat_ws("\n\n---\n\n", F.transform(F.array_sort(F.collect_list(F.struct("_n", item.alias("t")))), lambda s: s["t"])).alias("context"))


def parse_analysis(answer: str | None) -> dict:
    """Topics, gaps, queries and confidence from an answer in ``KEY: value`` lines.  A stray line of more than
    five characters counts as a query, wherever it stands."""
    found: dict = {"covered": [], "gaps": [], "queries": [], "confidence": "LOW"}
    listed = lambda s: [t.strip() for t in s.split(",") if t.strip()]
    for line in map(str.strip, (answer or "").split("\n")):
        key, colon, rest = line.partition(":")
        key, rest = key.upper() if colon else "", rest.strip()
        if key == "COVERED":
            found["covered"] = listed(rest)
        elif key == "GAPS":
            found["gaps"] = listed(rest)
        elif key == "CONFIDENCE":
            found["confidence"] = rest.upper() if rest.upper() in ("LOW", "MEDIUM", "HIGH") else found["confidence"]
        elif key == "QUERIES":
            if quoted := re.findall(r'"([^"]+)"', rest):
                found["queries"] += quoted
            elif rest:
                found["queries"] += [q.strip("\"'") for q in listed(rest)] if "," in rest and len(rest) > 50 else [rest]
        elif line and not line.upper().startswith(_KEYS):
            plain = line.lstrip("- •*0123456789.) ")
            found["queries"] += [plain] if len(plain) > 5 else []
    return found


def analysis(answer: Column) -> Column:
    """A struct of :func:`parse_analysis`."""

    @F.pandas_udf(ANALYSIS_SCHEMA)
    def parse(text: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([parse_analysis(t) for t in text], columns=["covered", "gaps", "queries", "confidence"])

    return parse(answer)
