import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as p
from tests.llm.conftest import row
from tests.llm.test_decontamination import brute as windows
from tests.llm.test_line_dedup import brute as lines
from tests.llm.test_simhash import similar_roots

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    r = random.Random(8)
    vocabulary = ["".join(r.choice("abcdefghilmnoprstu") for _ in range(r.randint(2, 8))) for _ in range(400)] + "the of and to in is it that for on".split() * 20
    text = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    items = [(k, text(20)) for k in range(5)]
    passage = text(60)
    rows = [text(80) + "\n" + text(40) for _ in range(30)]
    rows += [text(50) + "\n" + passage for _ in range(6)] + [text(60) + " " + items[k][1].upper() + " " + text(20) for k in range(5)]
    near = [text(150).split(" ") for _ in range(3)]
    rows += [" ".join([*t[: 40 * k + 20], f"other{k}", *t[40 * k + 21 :]]) for t in near for k in range(3)]
    rows += [rows[3], rows[4].replace(" ", "  "), None, "", "few words", "### $$$ &&& " * 30, "BUY NOW!!! " * 40]
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame([row(k, t)[:5] for k, t in enumerate(rows)], SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, items


def test_stages(spark, folder):
    path, items = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns, seen = docs.columns, []
    for name, stage in p.STAGES[:-1]:
        before = [(x.doc_id, x.text) for x in docs.collect()]
        docs = p.saved(stage(spark, docs, path), "test")
        assert docs.columns == columns
        after = sorted((x.doc_id, x.text) for x in docs.collect())
        assert all(x.n_chars == len(x.text) for x in docs.collect())
        if name == "quality_rules":
            assert {d for d, _ in before} - {d for d, _ in after} >= {52, 53, 54, 55, 56} and set(range(41)) <= {d for d, _ in after}
        elif name == "line_dedup":
            assert after == sorted((d, t) for d, t, *_ in lines(before, 2, 20))
        elif name == "simhash_near_dedup":
            top = similar_roots(before)
            assert after == sorted((d, t) for d, t in before if top[d] == d) and {d for d in range(41, 50) if top[d] == d} <= {41, 44, 47}
        else:
            assert after == sorted((d, t) for d, t in before if windows(t, items)[1] == 0) and len(after) < len(before)
        seen.append(len(after))
    packed = p.STAGES[-1][1](spark, docs, path)
    assert packed.select("doc_id").distinct().count() == seen[-1]
    assert p.run(spark, path).groupBy("doc_id").agg(F.sum("length")).count() == seen[-1]


def test_repeated_ids_and_extra_columns(spark, tmp_path):
    """Rows of one id and different texts are different documents; columns of names that stages use inside are carried along."""
    a, b = ("the river and the hill in the green valley of stone and wood that is far from here " + x for x in ("one", "two of a kind with much more to say about it"))
    rows = [(1, a, "en", "s", len(a), "r", 7), (1, b, "en", "s", len(b), "r", 8), (1, a, "en", "s", len(a), "r", 9), (None, a + " and more", "en", "s", 1, "r", 10), (3, None, "en", "s", None, "r", 11)]
    docs = spark.createDataFrame(rows, SCHEMA + ", `row key` string, n_links int")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in p.STAGES[:-1]:
        if name == "quality_rules":
            continue
        out = stage(spark, docs, str(tmp_path))
        assert [c for c in out.columns if c != "n_links"] == [c for c in docs.columns if c != "n_links"], name
        assert out.where("doc_id = 1").select("text").distinct().count() >= 1


def test_empty_tables(spark, folder, tmp_path):
    path, _ = folder
    for name in ("documents", "benchmark"):
        spark.read.parquet(f"{path}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert p.run(spark, str(tmp_path)).count() == 0
