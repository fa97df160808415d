"""Per-host budgets: in a simulated clock, and as a stream with timers."""

import random
import time

from pyspark.sql import functions as F

from lodegrain.streaming import politeness as P


def test_no_host_is_over_its_rate_and_none_waits_for_another():
    rng, now = random.Random(1), 1_000_000
    rate, burst = 30, 5
    queues = {"hot": 400, **{f"h{i}": 3 for i in range(50)}}
    buckets = {h: P.Bucket.full(rate, burst, now) for h in queues}
    left = {h: [] for h in queues}
    due = dict.fromkeys(queues, now)
    while any(queues.values()):
        now += rng.randrange(1, 900)  # timers fire late, by any amount
        for h in queues:
            if queues[h] and due[h] <= now:
                n = buckets[h].take(queues[h], now)
                queues[h] -= n
                left[h] += [now] * n
                due[h] = buckets[h].next_at()
                assert n or due[h] > now
    for h, at in left.items():
        for i in range(len(at)):
            for j in range(i + 1, len(at)):
                assert j - i + 1 <= burst + (at[j] - at[i]) * rate / 60_000 + 1e-6
    assert all(at[-1] - 1_000_000 < 1000 for h, at in left.items() if h != "hot")
    assert left["hot"][-1] - 1_000_000 < (400 - burst) * 60_000 / rate * 1.6


def test_a_clock_that_goes_back_gives_nothing():
    b = P.Bucket.full(60, 2, 5000)
    assert (b.take(5, 5000), b.take(5, 1000), b.take(5, 5500), b.take(5, 6000)) == (2, 0, 0, 1)
    assert b.next_at() == 7000


def test_a_stream_of_urls(spark, tmp_path):
    class Noting:
        def fetch(self, url):
            return 200, "text/html", f"{url} {time.time()}".encode()

    P.state_settings(spark)
    urls = [f"http://hot.example/{i}" for i in range(9)] + [f"http://cold{i}.example/x" for i in range(4)] + ["http://hot.example/private/1", "http://blocked.example/", "no host"]
    spark.createDataFrame([(u,) for u in urls], "url string").coalesce(1).write.parquet(str(tmp_path / "in"))
    blocked = spark.createDataFrame([("blocked.example",)], "domain string")
    robots = spark.createDataFrame([("hot.example", "User-agent: *\nDisallow: /private/")], "host string, body string")
    stream = spark.readStream.schema("url string").parquet(str(tmp_path / "in"))
    got = P.fetch_politely(stream, Noting, blocked, robots, per_minute=60, burst=3)
    query = got.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(processingTime="500 milliseconds").start()
    try:
        until = time.time() + 150
        rows = []
        while time.time() < until and len(rows) < 13:
            time.sleep(2)
            assert query.exception() is None
            if (tmp_path / "out" / "_spark_metadata").exists():
                rows = spark.read.schema("url string, body binary").parquet(str(tmp_path / "out")).select("url", F.col("body").cast("string").alias("b")).collect()
    finally:
        query.stop()
    assert sorted(r["url"] for r in rows) == sorted(u for u in urls if "private" not in u and "blocked" not in u and u != "no host")
    hot = sorted(float(r["b"].split()[1]) for r in rows if "hot" in r["url"])
    assert hot[-1] - hot[0] >= 4  # three at once, six more at one a second
