"""Phrase lists, crawl budgets, rows at places, tolerant records: each against a plain model."""

import json
import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from tarnweave.functions.phrases import lists_found, phrase_hits
from tarnweave.operators import tables
from tarnweave.operators.graph import crawled
from tarnweave.operators.profile import rows_at, stored_differences
from tarnweave.operators.reports import first_middle_last
from tarnweave.sources.files import tolerant


def test_phrases(spark):
    r = random.Random(2)
    lists = {"a": ["ab", "abc", "b", ""], "b": ["bca", "b", "日本"], "none": []}
    texts = [None, "", "xyz", "日本語ab日本"] + ["".join(r.choice("abcx") for _ in range(30)) for _ in range(60)]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "id long, text string").repartition(3)
    got = {r.id: r for r in df.select("id", phrase_hits(F.col("text"), lists).alias("all"), phrase_hits(F.col("text"), lists, longest=True).alias("long"), lists_found(phrase_hits(F.col("text"), lists)).alias("names")).collect()}
    for k, t in enumerate(texts):
        t = t or ""
        every = sorted({(i, i + len(p), n, p) for n, ps in lists.items() for p in ps if p for i in range(len(t)) if t.startswith(p, i)})
        assert [(h.start, h.stop, h.list, h.phrase) for h in got[k].all] == every
        want = []
        for n, ps in lists.items():
            at = 0
            while at < len(t):
                best = max((p for p in ps if p and t.startswith(p, at)), key=len, default=None)
                if best:
                    want.append((at, at + len(best), n, best))
                at += len(best) if best else 1
        assert [(h.start, h.stop, h.list, h.phrase) for h in got[k].long] == sorted(want)
        assert got[k].names == sorted({n for _, _, n, _ in every})


@pytest.mark.parametrize("budget,depth", [(1, None), (7, None), (40, None), (1000, None), (1000, 2), (0, None)])
def test_crawl_is_a_queue(spark, budget, depth):
    r = random.Random(budget)
    edges = list({(f"n{r.randrange(60)}", f"n{r.randrange(60)}"): 0 for _ in range(110)})
    edges = [(a, b, k) for k, (a, b) in enumerate(edges)] + [("n0", f"x{k}", 1000 - k) for k in range(12)] + [("n1", None, 5)]
    df = spark.createDataFrame(edges, "src string, dst string, pos long").where("dst is not null").repartition(4)
    found, queue = {}, deque()
    for n in ("n0", "n1"):
        if len(found) < budget:
            found[n] = (0, None, len(found))
            queue.append(n)
    while queue:
        n = queue.popleft()
        if depth is not None and found[n][0] == depth:
            continue
        for _, b, _ in sorted((e for e in edges if e[0] == n and e[1]), key=lambda e: (e[2], e[1])):
            if b not in found and len(found) < budget:
                found[b] = (found[n][0] + 1, n, len(found))
                queue.append(b)
    got = crawled(df, spark.createDataFrame([("n1",), ("n0",), ("n0",)], "node string"), budget, depth).collect()
    assert {x.node: (x.depth, x.parent, x.place) for x in got} == found


def test_rows_at_places(spark):
    r = random.Random(8)
    rows = [("hot" if r.random() < 0.5 else r.choice(["a", "b", None]), r.choice([None, 1.5, *map(float, range(9))]), k) for k in range(3000)] + [("one", 1.0, 9)]
    df = spark.createDataFrame(rows, "k string, v double, id long").repartition(5)
    n = F.col("n")
    got = sorted(map(tuple, rows_at(df, ["k"], ["v"], {"first": F.lit(0), "half": F.call_function("div", n, F.lit(2)), "last": n - 1, "far": F.lit(10**9), "no": F.lit(None)}).collect()), key=str)
    by = {}
    for x in sorted(rows, key=lambda x: (x[1] is not None, x[1] or 0, x[2])):
        by.setdefault(x[0], []).append(x)
    assert got == sorted([(*own[at], name) for own in by.values() for name, at in (("first", 0), ("half", len(own) // 2), ("last", len(own) - 1))], key=str)
    named = sorted(map(tuple, first_middle_last(df, ["k"], "v").collect()), key=str)
    assert named == sorted([(*own[at], name) for own in by.values() for at, name in {len(own) - 1: "last", len(own) // 2: "middle", 0: "first"}.items()], key=str)
    assert rows_at(df.limit(0), ["k"], ["v"], {"first": F.lit(0)}).count() == 0


def test_tolerant_records(spark, tmp_path):
    texts = ['{"n": 3, "name": "x", "tags": ["a"]}', '{"n": "many", "title": " t ", "name": " "}', '{"n": 2.5e0, "else": {"a": 1}}', "{broken", "[1, 2]", "7", None, "", "{}", '{"n": null, "tags": "none"}', '{"count": 4, "n": ""}']
    df = spark.createDataFrame([(k, t, "kept") for k, t in enumerate(texts)], "id long, text string, other string")
    fields, candidates = {"n": "int", "name": "string", "tags": "array<string>"}, {"name": ["name", "title"], "n": ["n", "count"]}
    got = {r.id: r for r in tolerant(df, "text", fields, candidates).collect()}
    assert len(got) == len(texts) and {r.other for r in got.values()} == {"kept"}
    assert (got[0].n, got[0].name, got[0].tags, got[0].rescued) == (3, "x", ["a"], None)
    assert (got[1].n, got[1].name, got[1].rescued) == (None, " t ", {"n": "many"})
    assert json.loads(got[2].rescued["else"]) == {"a": 1}
    assert [got[k].rescued for k in (3, 4, 5, 6, 7, 8)] == [{"$": "{broken"}, {"$": "[1, 2]"}, {"$": "7"}, None, {"$": ""}, None]
    assert got[9].rescued == {"tags": "none"} and (got[10].n, got[10].rescued) == (4, None)
    # The same over a stream.
    df.write.json(str(tmp_path / "in"))
    stream = tolerant(spark.readStream.schema(df.schema).json(str(tmp_path / "in")), "text", fields, candidates)
    q = stream.writeStream.format("memory").queryName("rescued_rows").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination()
    assert sorted(map(str, spark.table("rescued_rows").collect())) == sorted(map(str, got.values()))


def test_stored_differences(spark):
    rows = [(k, f"v{k}", float(k)) for k in range(500)] + [(None, "null key", 1.0), (7, "second", None), (7, "second", None)]
    wanted = spark.createDataFrame(rows, "k long, v string, x double").repartition(3)
    assert stored_differences(wanted, wanted.repartition(7), "k", 16).count() == 0
    changed = [r for r in rows if r[0] not in (3, 4)] + [(3, "other", 3.0), (900, "new", 0.0), (5, "v5", 5.0), (None, "null key", 1.0), (7, "second", None)]
    got = {tuple(r) for r in stored_differences(spark.createDataFrame(changed, wanted.schema), wanted, "k", 16).collect()}
    assert got == {(3, 1, 1, "changed"), (4, 0, 1, "missing"), (900, 1, 0, "surplus"), (5, 2, 1, "doubled"), (None, 2, 1, "doubled"), (7, 4, 3, "doubled")}
    assert stored_differences(wanted.limit(0), wanted, "k", 16).count() == 501 and stored_differences(wanted.limit(0), wanted.limit(0), "k").count() == 0


def test_aliases_are_found_longest_first_and_short_ones_as_words_of_any_alphabet(spark):
    names = {"cs": "C", "ai": "A", "data science": "D", "science": "S"}
    texts = ["cs and data science", "écs", "cs", "aics science", "ai, science of data", "", None, "x" * 100_000 + " ai"]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").select("k", tables._aliases(F.col("t"), names, 3).alias("found")).collect()
    assert [r["found"] for r in sorted(rows)] == ["D", None, "C", "S", "S", None, None, "A"]
