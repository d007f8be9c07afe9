"""Queries beside their SQL on small tables of cases that the given ones lack."""

import hashlib
import random

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tarnweave.operators import answers, graph, tables, vector
from tarnweave.plans.queries import ORACLES, QUERIES
from tarnweave.sources import pdf_words


def same(spark, folder, name, **given):
    """Whether a query of these tables gives what its SQL does; and its rows."""
    con = duckdb.connect()
    for t, df in given.items():
        df.write.mode("overwrite").parquet(f"{folder}/{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet/*.parquet')")
    df = QUERIES[name](spark, str(folder))
    columns = sorted(df.columns)
    got = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
    sql = con.execute(ORACLES[name])
    other = [c[0] for c in sql.description]
    want = sorted((tuple(r[other.index(c)] for c in columns) for r in sql.fetchall()), key=repr)
    assert sorted(other) == columns and got == want
    return got


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


@pytest.mark.parametrize("name", ["q_nearest", "q_nearest_indexed", "q_retrieval_audit"])
def test_distances_alike_when_rounded_are_ties(spark, tmp_path, name):
    rows = [(0, [0.0, 0.0], 0)] + [(k, [1.0, 1e-4 * (40 - k)], k % 3) for k in range(1, 40)]
    same(spark, tmp_path, name, embeddings=vectors(spark, rows))


def py_near(rows, query, k):
    pairs = []
    for i, v, _ in rows:
        if i != query[0]:
            none = v is None or len(v) != len(query[1]) or None in v
            pairs.append((none, 0.0 if none else sum((a - b) ** 2 for a, b in zip(v, query[1])), i))
    return [(i, None if none else round(d, 9)) for none, d, i in sorted(pairs)[:k]]


@pytest.mark.parametrize("block", [4096, 3])
def test_nearest_knows_copies_nulls_and_lengths(spark, monkeypatch, block):
    r = random.Random(8)
    rows = [(k, [float(r.randint(-3, 3)) for _ in range(4)], 0) for k in range(60)] + [(100 + k, [1.0, 2.0, 3.0, 0.0], 0) for k in range(40)]
    odd = [(200, None, 0), (201, [1.0, None, 0.0, 0.0], 0), (202, [1.0, 2.0], 0), (203, [], 0)]
    monkeypatch.setattr(vector, "ROWS", 16 if block == 3 else 1 << 15)
    for some, k in ((rows + odd, 5), (rows[:3] + odd, 6)):
        asked = [(i, v) for i, v, _ in some if i % 7 == 0 or i == 2]
        q = spark.createDataFrame(asked, "query_id long, embedding array<float>")
        got = {}
        for x in vector.nearest(vectors(spark, some), q, k, block=block).orderBy("query_id", "rank_no").collect():
            got.setdefault(x.query_id, []).append((x.vec_id, None if x.distance is None else round(x.distance, 9)))
        assert got == {i: py_near(some, (i, v), k) for i, v in asked if v is not None} | {i: [(j, None) for j in sorted(x[0] for x in some if x[0] != i)[:k]] for i, v in asked if v is None}


@pytest.mark.parametrize("name", ["q_retrieve", "q_source_keys", "q_confidence"])
def test_retrieved_are_among_the_nearest(spark, tmp_path, name):
    rows = [(0, [0.0, 0.0], 0)] + [(k, [1.0 + k / 100, 0.0], 1 if k < 8 else k % 3) for k in range(1, 30)]
    same(spark, tmp_path, name, embeddings=vectors(spark, rows))


#: Labels of a query's candidates, nearest first, and which of them are its results: at most 4 of a label, then filled up.
CROWDED = [([1] * 12 + [2] * 5 + [3] * 3, [1, 2, 3, 4, 13, 14, 15, 16]), ([1] * 9 + [2] + [1] * 9 + [3], [1, 2, 3, 4, 10, 20, 5, 6]), ([1] * 20 + [2] * 9, [1, 2, 3, 4, 5, 6, 7, 8])]


def crowded(spark, labels):
    return vectors(spark, [(0, [0.0, 0.0], 0)] + [(k, [1.0 + k / 100, 0.0], n) for k, n in enumerate(labels, 1)])


@pytest.mark.parametrize("labels, want", CROWDED)
def test_candidates_behind_the_nearest_become_results(spark, tmp_path, labels, want):
    same(spark, tmp_path, "q_retrieve", embeddings=crowded(spark, labels))
    got = QUERIES["q_retrieve"](spark, str(tmp_path)).where("query_id = 0").orderBy("rank_no").collect()
    assert [(r.rank_no, r.vec_id, r.label) for r in got] == [(n, k, labels[k - 1]) for n, k in enumerate(want, 1)]


@pytest.mark.parametrize("labels, want", CROWDED)
def test_context_is_of_the_diversified_results(spark, tmp_path, labels, want):
    docs = spark.createDataFrame([(k, f"text {k}", f"source {n}") for k, n in enumerate(labels, 1)], "doc_id long, text string, source string")
    got = same(spark, tmp_path, "q_context_blocks", embeddings=crowded(spark, labels), documents=docs)
    blocks = [f"[SOURCE {n}]\nTitle: source {labels[k - 1]}\nType: page\nEVIDENCE:\ntext {k}" for n, k in enumerate(want, 1)]
    assert got == [(hashlib.sha256(("\n" + "-" * 70 + "\n").join(blocks).encode()).hexdigest(), 0)]


@pytest.mark.parametrize("labels, want", CROWDED)
def test_source_keys_are_those_of_the_diversified_results(spark, tmp_path, labels, want):
    got = same(spark, tmp_path, "q_source_keys", embeddings=crowded(spark, labels))
    assert got == sorted((0, {1: "url::u1", 2: "title::t2", 3: "pdf::f3"}[n]) for n in {labels[k - 1] for k in want})


def test_addresses_with_other_fragments_are_others(spark, tmp_path):
    rows = [(4 * k, f"https://x.example.net/a{k % 3}{end}", "<a href=\"/p\">Fees</a>") for k, end in enumerate(["", "#top", "/", "#top", "/#b", "//"] * 4)]
    assert len(same(spark, tmp_path, "q_url_classes", pages=spark.createDataFrame(rows, "page_id long, url string, html string"))) > 3


SAID = ["below", "underä 60", "ällover 70", "over 60 morningé", "ß55.5 ecat", "77ü", "éa1ä in lahore", "nmß", "ä12.5 fest", "less than"]


@pytest.mark.parametrize("name", ["q_commands", "q_typed_entities", "q_question_routes", "q_entities", "q_typed_questions"])
def test_words_end_at_other_letters(spark, tmp_path, name):
    rows = [(3 * k, 0, "user", said) for k, said in enumerate(SAID * 5)]
    own = {t: spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("lineitem", "orders", "customer")} if name == "q_typed_questions" else {}
    same(spark, tmp_path, name, conversations=spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), **own)


def counting(spark, df, column):
    """df, and how often a row of it is computed."""
    n = spark.sparkContext.accumulator(0)
    return df.withColumn(column, F.udf(lambda x: n.add(1) or x, df.schema[column].dataType).asNondeterministic()(column)), n


def test_levels_read_edges_that_are_computed_once(spark):
    edges, n = counting(spark, spark.range(8).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"), F.lit(0).alias("pos")), "dst")
    found = graph.breadth_first(edges, spark.sql("SELECT 0L AS node"))
    assert found.count() == 9 and n.value == 8


def joined_rows(plan):
    """Rows that the joins of an executed plan gave."""
    own = plan.metrics().apply("numOutputRows").value() if "Join" in plan.nodeName() else 0
    return own + sum(joined_rows(plan.children().apply(k)) for k in range(plan.children().size()))


def test_backfill_joins_one_candidate_to_a_key(spark, tmp_path):
    lines = [(k, 1 + k % 7, 1, n, [None, "", "A", "R"][(k + n) % 4]) for k in range(40) for n in range(1, 4)]
    orders = [(k, k % 5) for k in range(60)]
    own = {"lineitem": spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_returnflag string"), "orders": spark.createDataFrame(orders, "o_orderkey long, o_custkey long")}
    same(spark, tmp_path, "q_backfill", **own)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = QUERIES["q_backfill"](spark, str(tmp_path))
        assert len(df.collect()) == 60
        assert joined_rows(df._jdf.queryExecution().executedPlan()) <= 3 * 60
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


@pytest.mark.parametrize("name", ["q_merit_answers", "q_table_answers"])
def test_questions_of_one_key_are_answered_as_in_sql(spark, tmp_path, name):
    said = ["", "61.5 merit", "cs at lahore, 70.5", "category A1", "ai in ksk", None]
    rows = [(k, t, "user", said[(k + t) % 6]) for k in range(40) for t in range(2)] + [(k, 0, "user", said[k % 6] or "x") for k in range(30)] + [(1, 1000, "user", "80.5"), (3, None, "user", "none")]
    own = {t: spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("lineitem", "orders", "customer")}
    same(spark, tmp_path, name, conversations=spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), **own)


def test_answers_are_put_together_once_for_equal_questions(spark, monkeypatch):
    seen = []
    plain = tables.asked
    monkeypatch.setattr(tables, "asked", lambda records, asked: seen.append(asked.count()) or plain(records, asked))
    records = spark.createDataFrame([("Main Campus (LHR)", "Data Science", "A1", "Morning", "ECAT", 70.0, 1)], "campus string, program string, category string, session string, admission_type string, closing_merit double, page int")
    asks = spark.range(90).select(F.col("id").alias("qid"), F.lit(None).cast("string").alias("q_program"), F.lit("Main Campus (LHR)").alias("q_campus"), F.lit(None).cast("string").alias("q_category"), (F.col("id") % 3 + 60).cast("double").alias("q_aggregate"))
    got = answers.merit_answers(records, asks, "page").collect()
    assert len(got) == 90 and {r.kind for r in got} == {"merit_check"} and len({r.answer for r in got}) == 3 and seen == [3]


def test_a_text_is_searched_for_aliases_once(spark):
    plan = spark.range(1).select(tables.program(F.col("id").cast("string")).alias("x"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all(") == 1 and "lambda" not in plan


def test_pdf_tables_are_made_by_all_partitions_a_few_files_at_a_time(spark, tmp_path, monkeypatch):
    rows = [(k, "x", "en", "src", 1) for k in range(3000)] + [(None, "x", "en", "src", 1)] * 2
    read = []
    plain = pdf_words.pdf_words
    monkeypatch.setattr(pdf_words, "pdf_words", lambda files, **kw: read.append(files) or plain(files, **kw))
    same(spark, tmp_path, "q_pdf_tables", documents=spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int"))
    sizes = read[0].select("file").mapInArrow(lambda bs: (pa.RecordBatch.from_arrays([pa.array([b.num_rows])], ["n"]) for b in bs), "n long").select("n", F.spark_partition_id().alias("part")).collect()
    assert len({r.part for r in sizes}) == 4 and sum(r.n for r in sizes) == 429
