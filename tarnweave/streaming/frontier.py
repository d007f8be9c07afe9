"""A crawl frontier as a stream: each host's state is its next free slot, so that requests to a host are apart, in order of arrival, across restarts."""

from __future__ import annotations

import time
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tarnweave.functions import html, urls

#: What happens to an address: it is found, and later fetched or failed, then with the slot and the attempt of its request.
EVENTS = "host string, url string, status string, slot long, attempt int"
#: What is to be done: fetch it at its slot (milliseconds) or later, or nothing more as it was given up.
REQUESTS = "host string, url string, action string, slot long, attempt int"


def scheduled(events: DataFrame, delay: int = 1000, backoff: int = 60_000, attempts: int = 3) -> DataFrame:
    """Requests for a stream of events: one for each address found, and one more after each failure until `attempts` were made, `backoff` later and twice that with each attempt. Slots of a host lie at least `delay` apart. All in milliseconds.

    Repeated addresses and answers are dropped where they are spread by address, before rows come together by host; a host's state is one number, and its rows pass by in Arrow batches.
    Rows without a host or an address, and answers without a slot, are left out.
    """

    def requests(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now, free = int(time.time() * 1000), state.get[0] if state.exists else 0
        for part in parts:
            out = []
            for url, status, slot, attempt in zip(part["url"], part["status"], part["slot"], part["attempt"]):
                n = 1 if status == "found" else int(attempt) + 1
                if n > attempts:
                    out.append((key[0], url, "give up", int(slot), int(attempt)))
                    continue
                at = max(now + (backoff * 2 ** (n - 2) if n > 1 else 0), free)
                free = at + max(1, delay)
                out.append((key[0], url, "fetch", at, n))
            yield pd.DataFrame(out, columns=["host", "url", "action", "slot", "attempt"]).astype({"slot": "int64", "attempt": "int32"})
        state.update((free,))

    told = events.where("host is not null and url is not null and (status = 'found' or status in ('failed', 'fetched') and slot is not null)")
    new = told.dropDuplicates(["url", "status", "slot"]).where("status <> 'fetched'")
    return new.groupBy("host").applyInPandasWithState(requests, REQUESTS, "free long", "append", GroupStateTimeout.NoTimeout)


def answered(requests: DataFrame, pages: DataFrame) -> DataFrame:
    """The events that fetching gives, where pages (url, html) come from a table or an archive: fetched or failed, and each link of a fetched page as found. Of pages with one address the first by text counts."""
    kept = pages.where("url is not null").groupBy("url").agg(F.min(F.coalesce("html", F.lit(""))).alias("html"))
    met = requests.where("action = 'fetch'").join(kept, "url", "left")
    event = lambda host, url, status, slot, attempt: F.struct(host.alias("host"), url.alias("url"), status.alias("status"), slot.alias("slot"), attempt.alias("attempt"))
    answer = event(F.col("host"), F.col("url"), F.when(F.col("html").isNull(), "failed").otherwise("fetched"), F.col("slot"), F.col("attempt"))
    links = F.transform(html.page_links("html", "url"), lambda x: event(urls.host_of(x["url"]), x["url"], F.lit("found"), F.lit(None).cast("long"), F.lit(0)))
    return met.select(F.explode(F.concat(F.array(answer), F.coalesce(F.array_distinct(links), F.array().cast(f"array<struct<{EVENTS}>>")))).alias("e")).select("e.*")


def crawl(spark: SparkSession, folder: str, pages: DataFrame, seeds: DataFrame | None = None, rounds: int = 100, **limits: int) -> int:
    """Crawls pages from seeds (url) until nothing is under way or `rounds` are over; returns the rounds that had work.

    Two streams feed each other: events become requests (folder/requests), requests become events (folder/answers). Both end in files that count once their batch is committed,
    so a crawl that was stopped anywhere goes on with the same call, and no request is made twice. Seeds are given to the first call only.
    """
    if seeds is not None:
        seeds.select(urls.host_of("url").alias("host"), "url", F.lit("found").alias("status"), F.lit(None).cast("long").alias("slot"), F.lit(0).alias("attempt")).write.mode("overwrite").parquet(f"{folder}/seeds")
        spark.createDataFrame([], EVENTS).write.mode("ignore").parquet(f"{folder}/answers")

    def ran(stream: DataFrame, name: str) -> bool:
        query = stream.writeStream.format("parquet").option("path", f"{folder}/{name}").option("checkpointLocation", f"{folder}/state of {name}").trigger(availableNow=True).start()
        query.awaitTermination()
        return any(p["numInputRows"] for p in query.recentProgress)

    read = lambda schema, name: spark.readStream.schema(schema).parquet(f"{folder}/{name}")
    for k in range(rounds):
        worked = ran(scheduled(read(EVENTS, "seeds").union(read(EVENTS, "answers")), **limits), "requests")
        if not ran(answered(read(REQUESTS, "requests"), pages), "answers") and not worked:
            return k
    return rounds
