"""Polite fetching as a stream: a queue and a token bucket for each host, as state, and timers for what has to wait.

Urls arrive in any order.  A host's urls wait in its state, in order of arrival; as many leave at once as its bucket
allows, and a timer wakes the host when the next one may leave.  A host of millions of urls is spread over time, and holds
up no other: its task only moves urls from the queue, a few at each timer.  What leaves is fetched after the state,
dealt over all tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from lodegrain.functions import text as T
from lodegrain.interface.limits import RATES
from lodegrain.operators.crawl import check_domains
from lodegrain.sources.web import Fetcher, fetch, robots_allowed
from lodegrain.sources.workspace import work_path

FETCHED = "url string, http_status int, content_type string, body binary, error string"
PERMITS = "host string, url string, at_ms long"
#: Urls that leave one host at one timer, at most.
MOST_AT_ONCE = 1000


@dataclass
class Bucket:
    """A token bucket as values: ``level`` tokens at time ``at`` (milliseconds)."""

    per_minute: float
    burst: int
    level: float
    at: int

    @classmethod
    def full(cls, per_minute: float, burst: int, now: int) -> Bucket:
        return cls(per_minute, burst, float(burst), now)

    def take(self, wanted: int, now: int) -> int:
        """How many of ``wanted`` calls may be made at ``now``; a clock that goes back counts as standing still."""
        if now > self.at:
            self.level, self.at = min(self.burst, self.level + (now - self.at) * self.per_minute / 60_000), now
        n = min(wanted, int(self.level + 1e-9))
        self.level = max(0.0, self.level - n)
        return n

    def next_at(self) -> int:
        """When the next whole token is there; never earlier, for the rounding."""
        return self.at + max(1, int(-(-(1 - self.level) * 60_000 // self.per_minute)))


class HostQueue(StatefulProcessor):
    """State of a host: its bucket, the waiting urls by number, and the numbers of the first and of the next one."""

    def __init__(self, per_minute: float, burst: int):
        self.per_minute, self.burst = per_minute, burst

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.bucket = handle.getValueState("bucket", "level double, at long, first long, next long")
        self.waiting = handle.getMapState("waiting", "number long", "url string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803  names of the interface
        now = timerValues.getCurrentProcessingTimeInMs()
        level, at, first, last = self.bucket.get() if self.bucket.exists() else (float(self.burst), now, 0, 0)
        for frame in rows:
            for url in frame["url"]:
                self.waiting.updateValue((last,), (url,))
                last += 1
        yield from self._leave(key, now, Bucket(self.per_minute, self.burst, level, at), first, last)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = timerValues.getCurrentProcessingTimeInMs()
        level, at, first, last = self.bucket.get()
        yield from self._leave(key, now, Bucket(self.per_minute, self.burst, level, at), first, last)

    def _leave(self, key, now: int, bucket: Bucket, first: int, last: int) -> Iterator[pd.DataFrame]:
        n = bucket.take(min(last - first, MOST_AT_ONCE), now)
        urls = []
        for k in range(first, first + n):
            urls.append(self.waiting.getValue((k,))[0])
            self.waiting.removeKey((k,))
        self.bucket.update((bucket.level, bucket.at, first + n, last))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if first + n < last:
            self.handle.registerTimer(bucket.next_at())
        elif bucket.level < self.burst:  # forget the host when its bucket is full again
            self.handle.registerTimer(bucket.at + int((self.burst - bucket.level) * 60_000 / self.per_minute) + 1)
        else:
            self.bucket.clear()
        if n:
            yield pd.DataFrame({"host": pd.Series([key[0]] * n, dtype=object), "url": pd.Series(urls, dtype=object), "at_ms": [now] * n})

    def close(self) -> None:
        pass


def permits(urls: DataFrame, per_minute: float | None = None, burst: int | None = None) -> DataFrame:
    """(host, url, at_ms) of a stream of (url) rows, each when its host's budget allows it to be fetched.  Urls without a
    host are none.  Needs the RocksDB state store; the query that runs it has a processing-time trigger, which is the
    resolution of the waits."""
    rate, most = per_minute or RATES["scraper"][0], burst or RATES["scraper"][1]
    hosts = urls.select(F.lower(T.url_host("url")).alias("host"), "url").where("host <> ''")
    return hosts.groupBy("host").transformWithStateInPandas(HostQueue(rate, most), PERMITS, "Append", "ProcessingTime")


def fetch_politely(urls: DataFrame, fetcher: Callable[[], Fetcher], blacklist: DataFrame, robots: DataFrame, per_minute: float | None = None, burst: int | None = None) -> DataFrame:
    """(url, http_status, content_type, body, error) of a stream of (url) rows: blocked domains and what robots.txt
    forbids are left out before they take a place in a queue; what may leave is dealt over all tasks and fetched."""
    wanted = robots_allowed(check_domains(urls.select("url"), blacklist), robots).where("allowed and robots_ok").select("url")
    return fetch(permits(wanted, per_minute, burst).select("url").repartition(urls.sparkSession.sparkContext.defaultParallelism), fetcher)


def fetch_all(urls: DataFrame, fetcher: Callable[[], Fetcher], per_minute: float | None = None, burst: int | None = None, tick: str = "1 second") -> DataFrame:
    """(url, http_status, content_type, body, error) of a finite table of (url) rows, none over its host's budget.

    The urls are written and streamed through the hosts' queues until each was fetched, or failed; urls without a host
    fail.  What a batch fetched is written before the next one begins."""
    spark = urls.sparkSession
    state_settings(spark)
    path = work_path(spark, "polite")
    urls.select("url").distinct().write.parquet(f"{path}/urls")
    asked = spark.read.schema("url string").parquet(f"{path}/urls")
    hosted = F.coalesce(T.url_host("url"), F.lit("")) != ""
    wanted, done, failed = asked.where(hosted).count(), [0], []

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/fetched/{number}")
        done[0] += spark.read.schema(FETCHED).parquet(f"{path}/fetched/{number}").count()

    if wanted:
        allowed = permits(spark.readStream.schema("url string").parquet(f"{path}/urls"), per_minute, burst)
        bodies = fetch(allowed.select("url").repartition(spark.sparkContext.defaultParallelism), fetcher)
        query = bodies.writeStream.foreachBatch(keep).option("checkpointLocation", f"{path}/state").trigger(processingTime=tick).start()
        try:
            while done[0] < wanted and query.isActive:
                query.awaitTermination(0.2)
            if query.exception() is not None:
                failed.append(query.exception())
        finally:
            query.stop()
    if failed:
        raise failed[0]
    none = asked.where(~hosted).selectExpr("url", "CAST(NULL AS INT) AS http_status", "CAST(NULL AS STRING) AS content_type", "CAST(NULL AS BINARY) AS body", "'no host' AS error")
    return spark.read.schema(FETCHED).parquet(f"{path}/fetched/*").unionByName(none) if wanted else none


def state_settings(spark) -> None:
    """The state store that timers and maps need; set before the query is started, unless the session names its own."""
    key = "spark.sql.streaming.stateStore.providerClass"
    if "RocksDB" not in spark.conf.get(key, ""):
        spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


