import json
import random

import pytest
from pyspark.sql import functions as F

from tarnweave.operators import dedup, graph, layout, merge, profile, reports
from tarnweave.sources import files
from tarnweave.streaming import incremental


def test_envelopes_and_records(spark, tmp_path):
    (tmp_path / "e.json").write_text(json.dumps({"source": "s", "chunks": [{"id": "a", "n": 1}, {"id": "b"}]}))
    assert [tuple(r) for r in files.envelope(spark, str(tmp_path / "e.json"), "chunks", "id string, n int").collect()] == [("a", 1), ("b", None)]
    for k, data in enumerate(([{"url": "u", "t": "x"}], {"pages": [{"url": "u", "t": "x"}]}, {"u": {"t": "x"}})):
        (tmp_path / f"r{k}.json").write_text(json.dumps(data))
        assert [tuple(r) for r in files.records(spark, str(tmp_path / f"r{k}.json"), ["chunks", "pages"], "url string, t string").select("url", "t").collect()] == [("u", "x")]


def test_binary_documents(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.7 x")
    (tmp_path / "b.pdf").write_bytes(b"<html>")
    assert {r.file: r.status for r in files.binary_documents(spark, str(tmp_path)).collect()} == {"a.pdf": "DOWNLOADED", "b.pdf": "NOT_A_PDF"}


def test_sinks(spark, tmp_path):
    df = spark.range(5)
    files.write_envelope(df, str(tmp_path / "e"), "src", "stage", n_even=F.count_if(F.col("id") % 2 == 0))
    assert spark.read.json(str(tmp_path / "e/envelope")).first().asDict() == {"source": "src", "stage": "stage", "n_rows": 5, "n_even": 3}
    files.write_report(df, str(tmp_path / "c"))
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).count() == 5
    assert files.promote(df, str(tmp_path / "p"), "1").count() == 5


def test_incremental_pages_once(spark, tmp_path):
    page = lambda k: (k, f"https://x.org/{k}/", f"<title>t{k}</title><body>b{k}</body>")
    schema = "page_id long, url string, html string"
    for rows in ([page(1), page(2)], [page(3)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        incremental.run_once(incremental.page_stream(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp"))
    out = spark.read.parquet(str(tmp_path / "out"))
    assert sorted((r.page_id, r.url, r.title, r.text) for r in out.collect()) == [(k, f"https://x.org/{k}", f"t{k}", f"b{k}") for k in (1, 2, 3)]


def test_breadth_first_limits(spark):
    edges = spark.createDataFrame([("a", "b", 0), ("b", "c", 0), ("c", "d", 0), ("a", "c", 1)], "src string, dst string, pos int")
    root = spark.sql("SELECT 'a' AS node")
    assert {r.node: r.depth for r in graph.breadth_first(edges, root).collect()} == {"a": 0, "b": 1, "c": 1, "d": 2}
    assert graph.breadth_first(edges, root, most_depth=1).count() == 3
    assert graph.breadth_first(edges, root, most_nodes=1).count() == 1


def test_blank_keys_stay(spark):
    df = spark.createDataFrame([(0, ""), (1, ""), (2, "u"), (3, "u"), (4, None), (5, None)], "pos int, url string")
    kept, repeated = dedup.first_wins(df, ["url"], ["pos"], blank_free="url")
    assert sorted(r.pos for r in kept.collect()) == [0, 1, 2, 4, 5] and [r.pos for r in repeated.collect()] == [3]


def test_numbers_run_over_partitions(spark):
    df = spark.range(50).select((F.col("id") * 37 % 50).alias("v"))
    assert {r.v: r.id for r in dedup.numbered(df, "x", ["v"]).collect()} == {v: f"x_{v + 1:03d}" for v in range(50)}


def test_checks_and_missing(spark):
    df = spark.createDataFrame([(1, "a", []), (2, "", ["x"]), (3, None, None)], "id int, t string, l array<string>")
    assert {r.check: (r.passed, r.status) for r in profile.checks(df, some=F.count("*") > 0, texts=F.count("t") == F.count("*")).collect()} == {"some": (True, "FAIL"), "texts": (False, "FAIL")}
    assert [r.missing for r in profile.missing_fields(df, ["id", "t", "l", "z"], "blank").orderBy("id").collect()] == [["l", "z"], ["t", "z"], ["t", "l", "z"]]


def test_plug_ins(spark):
    df = spark.createDataFrame([("a",), ("bb",)], "text string")
    got = reports.embedded(df, "text", lambda: lambda xs: [[float(len(x)), 0.0] for x in xs]).collect()
    assert {r.text: r.embedding for r in got} == {"a": [1.0, 0.0], "bb": [1.0, 0.0]}

    def reader(data):
        if data == b"bad":
            raise ValueError
        return [("native", x) for x in data.decode().split("|")]

    docs = spark.createDataFrame([("p", bytearray(b"x|y")), ("q", bytearray(b"bad"))], "path string, content binary")
    assert sorted((r.path, r.page, r.text) for r in reports.extracted(docs, reader).collect()) == [("p", 1, "x"), ("p", 2, "y")]

    def attempt(size):
        if size > 1000:
            raise MemoryError
        return "ok"

    assert reports.shrinking(attempt) == (960, "ok")
    with pytest.raises(MemoryError):
        reports.shrinking(attempt, (1600,))


def test_hash_eligible_and_addresses(spark):
    df = spark.createDataFrame([("a", "DOWNLOADED", "/x"), ("b", "FAILED", None), ("c", "DOWNLOADED", "")], "url string, status string, local_path string")
    ok, rest = reports.hash_eligible(df)
    assert [r.url for r in ok.collect()] == ["a"] and {r.url: r.dedup_error for r in rest.collect()} == {"b": "status FAILED", "c": "missing file"}
    docs = spark.createDataFrame([("u", [("v",), ("u",)]), ("w", None)], "canonical_url string, aliases array<struct<url:string>>")
    assert {r.canonical_url: r.all_urls for r in reports.all_urls(docs).collect()} == {"u": ["u", "v"], "w": ["w"]}


def test_promotion_keeps_a_backup(spark, tmp_path):
    path = str(tmp_path / "p")
    assert files.version_of(spark, path) is None
    files.promote(spark.range(5), path, "1", "id")
    files.promote(spark.range(7), path, "2", "id")
    assert files.current(spark, path).count() == 7 and files.version_of(spark, path, "previous") == "1"
    with pytest.raises(ValueError, match="exists"):
        files.promote(spark.range(1), path, "2")
    with pytest.raises(ValueError, match="unique"):
        files.promote(spark.sql("SELECT * FROM VALUES (1), (1) AS t(id)"), path, "3", "id")
    assert files.version_of(spark, path) == "2" and not (tmp_path / "p/version=3").exists()
    assert files.rolled_back(spark, path).count() == 5 and files.version_of(spark, path, "previous") == "2"


def test_addresses_at_any_depth(spark):
    doc, urls = {"url": "deepest"}, ["deepest"]
    for k in range(21):
        doc = {"url": f"u{k}", "kids": [doc, {"x": {"url": " "}}]} if k % 2 else {"inner": {"a": doc}, "url": f"u{k}"}
        urls.append(f"u{k}")
    df = spark.createDataFrame([(json.dumps(doc),), ("[]",)], "t string").select(F.parse_json("t").alias("doc"))
    assert sorted(r.url for r in files.url_records(df).collect()) == sorted(urls)
    assert files.url_records(df.limit(0)).count() == 0


def test_gaps_across_partitions(spark):
    r = random.Random(3)
    rows = [(k, v) for k in ("hot", None, "x") for v in r.choices(range(0, 4000, 7), k=500 if k == "hot" else 20)] + [("hot", None), ("y", None), ("z", 4)]
    got = layout.gap_clusters(spark.createDataFrame(rows, "k string, v int"), ["k"], "v", F.lit(20)).collect()
    for key in {k for k, _ in rows}:
        values = sorted(v for k, v in rows if k == key and v is not None)
        want, n = {}, 0
        for a, b in zip([values[0] if values else 0, *values], values):
            n += b - a > 20
            want[b] = n
        assert len([x for x in got if x.k == key]) == sum(k == key for k, _ in rows)
        assert {x.v: x.cluster for x in got if x.k == key and x.v is not None} == want


def test_samples(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("v"))
    assert [r.v for r in reports.every_nth(df, ["v"], 900, 100, 6).orderBy("v").collect()] == [0, 100, 200, 300, 400, 500]
    assert reports.every_nth(df.limit(0), ["v"], 9, 2, 3).count() == 0
    few = spark.createDataFrame([("a", k) for k in range(4)] + [("b", 9), ("c", 1), ("c", 2)], "k string, v int")
    assert sorted((r.k, r.v, r["sample"]) for r in reports.first_middle_last(few, ["k"], "v").collect()) == [("a", 0, "first"), ("a", 2, "middle"), ("a", 3, "last"), ("b", 9, "first"), ("c", 1, "first"), ("c", 2, "middle")]


def test_fields_from_the_best_row(spark):
    rows = [("k", 1, "", "b1"), ("k", 2, "a2", None), ("k", 3, "a3", "b3"), ("l", 4, None, "")]
    got = merge.fill_missing(spark.createDataFrame(rows, "k string, n int, a string, b string"), "k", ["a", "b"], F.lit(0), "n").collect()
    assert sorted(map(tuple, got)) == [("k", "a2", "b1"), ("l", None, None)]
