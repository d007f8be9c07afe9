"""The frontier: each address asked for once, slots of a host apart and in order, retries, lost answers, a restart in the middle."""

import pytest

from tarnweave.streaming.frontier import EVENTS, crawl, scheduled

SITE = {
    "https://a.org/": '<a href="/1">1</a><a href="/2">2</a><a href="https://b.org/">b</a><a href="/1">1</a>',
    "https://a.org/1": '<a href="/">home</a><a href="/3">3</a>',
    "https://a.org/2": '<a href="/gone">gone</a>',
    "https://a.org/3": "",
    "https://b.org": '<a href="https://a.org/3">3</a><a href="/x">x</a>',
    "https://b.org/x": None,
}


@pytest.fixture
def site(spark):
    return spark.createDataFrame([(u.rstrip("/") if u != "https://a.org/" else "https://a.org", h) for u, h in SITE.items()], "url string, html string")


def found(spark, folder):
    return spark.read.parquet(f"{folder}/requests").collect()


def test_crawl_goes_on_after_a_stop_and_asks_once(spark, site, tmp_path):
    folder, seeds = str(tmp_path / "crawl"), spark.createDataFrame([("https://a.org",)], "url string")
    assert crawl(spark, folder, site, seeds, rounds=1, delay=50, backoff=0, attempts=2) == 1
    assert {r["url"] for r in found(spark, folder)} == {"https://a.org"}
    assert crawl(spark, folder, site, delay=50, backoff=0, attempts=2) > 0
    rows = found(spark, folder)
    fetches = [r for r in rows if r["action"] == "fetch"]
    firsts = sorted(r["url"] for r in fetches if r["attempt"] == 1)
    assert firsts == ["https://a.org", "https://a.org/1", "https://a.org/2", "https://a.org/3", "https://a.org/gone", "https://b.org", "https://b.org/x"]
    assert [(r["url"], r["attempt"]) for r in fetches if r["attempt"] > 1] == [("https://a.org/gone", 2)]
    assert [(r["url"], r["attempt"]) for r in rows if r["action"] == "give up"] == [("https://a.org/gone", 2)]
    for host in ("a.org", "b.org"):
        slots = sorted(r["slot"] for r in fetches if r["host"] == host)
        assert all(b - a >= 50 for a, b in zip(slots, slots[1:]))
    assert crawl(spark, folder, site, delay=50, backoff=0, attempts=2) == 0


def test_repeats_do_nothing_and_failures_wait(spark, tmp_path):
    inbox, out = str(tmp_path / "in"), str(tmp_path / "out")

    def step(rows):
        spark.createDataFrame(rows, EVENTS).write.mode("append").parquet(inbox)
        stream = scheduled(spark.readStream.schema(EVENTS).parquet(inbox), delay=10, backoff=5000, attempts=2)
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
        return sorted((r["url"], r["action"], r["attempt"]) for r in spark.read.parquet(out).collect())

    assert step([("h", "u", "found", None, 0), ("h", "u", "found", None, 0), (None, "v", "found", None, 0), ("h", None, "found", None, 0), ("h", "u", "failed", None, 1)]) == [("u", "fetch", 1)]
    slot = spark.read.parquet(out).first()["slot"]
    again = step([("h", "u", "found", None, 0), ("h", "u", "failed", slot, 1), ("h", "u", "failed", slot, 1)])
    assert again == [("u", "fetch", 1), ("u", "fetch", 2)]
    later = spark.read.parquet(out).where("attempt = 2").first()["slot"]
    assert later >= slot + 5000
    assert step([("h", "u", "failed", later, 2)]) == [("u", "fetch", 1), ("u", "fetch", 2), ("u", "give up", 2)]
