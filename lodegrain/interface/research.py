"""The research loop: analyse, search, scrape, prune, in rounds, over tables.

The driver holds the loop's few numbers; pages, attempts and results are tables in a session's folder.  The
language model, the search engine and the scraper are given.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodegrain.functions import prompts as P
from lodegrain.functions import text as T
from lodegrain.interface.models import ANALYSIS, QUERIES, LanguageModel
from lodegrain.operators import analytics as A
from lodegrain.operators.corpus import prune_by_text

PAGE_SCHEMA = "url string, title string, content string, round int"


@dataclass
class TimeBudget:
    """Minutes for all rounds (0: no limit).  The next round is expected to take one and a half times the mean of
    the last three, ten minutes at first."""

    minutes: float = 0
    roundup: float = 5
    clock: Callable[[], float] = time.time
    rounds: list[float] = field(default_factory=list)

    def __post_init__(self):
        self.began = self.clock()

    def left(self) -> float:
        return max(0.0, self.minutes - (self.clock() - self.began) / 60) if self.minutes > 0 else float("inf")

    def next_round(self) -> float:
        last = self.rounds[-3:]
        return 1.5 * sum(last) / len(last) if last else 10.0

    def time_to_stop(self) -> bool:
        return self.left() < self.next_round() + self.roundup


@dataclass
class Research:
    """A session on ``topic``, kept under ``path``.

    ``search(queries)`` gives (url, ...) rows, ``scrape(urls)`` gives (url, title, content) rows of the urls that
    could be read."""

    spark: SparkSession
    path: str
    topic: str
    model: LanguageModel
    search: Callable[[list[str]], DataFrame]
    scrape: Callable[[DataFrame], DataFrame]
    budget: TimeBudget = field(default_factory=TimeBudget)
    max_rounds: int = 5
    context_tokens: int = 8000
    queries_per_round: int = 3

    def pages(self) -> DataFrame:
        return self.spark.read.schema(PAGE_SCHEMA).parquet(f"{self.path}/pages")

    def analyse(self, pages: DataFrame) -> dict:
        """What the model finds covered and missing, from excerpts that fit its context."""
        room = P.prompt_budget(self.context_tokens, ANALYSIS)
        rows = P.corpus_excerpts(pages.select(F.col("url").alias("path"), "content"), room).orderBy("path").limit(max(1, room // 200))
        corpus = "\n\n---\n\n".join(r["excerpt"] for r in rows.select("excerpt").collect())  # at most room // 200 rows
        return P.parse_analysis(self.model(ANALYSIS.format(topic=self.topic, corpus=corpus or "(no sources yet)"), 0.3))

    def run(self) -> DataFrame:
        """All rounds; returns (round, pages, tokens, confidence, stop).  The pages are under ``path``."""
        self.spark.createDataFrame([], PAGE_SCHEMA).write.mode("ignore").parquet(f"{self.path}/pages")
        log: list[tuple] = []
        for turn in range(1, self.max_rounds + 1):
            began, pages = self.budget.clock(), self.pages()
            stalled = len(log) >= 2 and all(r[2] < A.STALL_TOKENS for r in log[-2:])
            if self.budget.time_to_stop() or stalled:
                log.append((turn, 0, 0, "", "stalled" if stalled else "time"))
                break
            found = self.analyse(pages) if turn > 1 else {"gaps": [], "queries": [], "confidence": "LOW"}
            if found["confidence"] == "HIGH" and not found["gaps"]:
                log.append((turn, 0, 0, "HIGH", "covered"))
                break
            asked = found["queries"][: self.queries_per_round]
            if not asked:
                answer = self.model(QUERIES.format(n=self.queries_per_round, topic=self.topic), 0.5) or ""
                asked = [q for q in (self.spark.range(1).select(T.clean_query_list(F.lit(answer)).alias("q")).first()["q"]) if q][: self.queries_per_round] or [self.topic]
            fresh = self.search(asked).select("url").where("url <> ''").distinct().join(pages.select("url"), "url", "left_anti")
            got = self.scrape(fresh).select("url", "title", "content", F.lit(turn).alias("round"))
            got.write.mode("append").parquet(f"{self.path}/pages")
            new = self.pages().where(F.col("round") == turn).agg(F.count("*"), F.coalesce(F.sum(T.token_estimate("content")), F.lit(0))).first()
            if turn % 2 == 0 or turn == self.max_rounds:
                self.prune()
            log.append((turn, new[0], int(new[1]), found["confidence"], ""))
            self.budget.rounds.append((self.budget.clock() - began) / 60)
        return self.spark.createDataFrame(log, "round int, pages int, tokens int, confidence string, stop string")

    def prune(self) -> None:
        """Write the near-duplicates among the pages, oldest kept, to ``path``/pruned."""
        prune_by_text(self.pages(), "url", "content", "round").write.mode("overwrite").parquet(f"{self.path}/pruned")

    def active_pages(self) -> DataFrame:
        try:
            gone = self.spark.read.parquet(f"{self.path}/pruned")
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.pages()
        return self.pages().join(gone.select(F.col("duplicate").alias("url")), "url", "left_anti")

    def report(self) -> str:
        """The title, a summary by the model and the list of sources."""
        rows = self.active_pages().select("title", "url", T.word_count("content").alias("words")).orderBy(F.desc("words"), "url").limit(500).collect()
        sources = "\n".join(f"- **{r['title']}** ({r['words']} words): {r['url']}" for r in rows)
        summary = self.model(f"Summarise what these sources say on {self.topic}:\n{sources}", 0.3) or "No summary could be made."
        return f"# {self.topic}\n\n{summary}\n\n## Sources\n\n{sources}\n"
