"""Versioned stores: one of two writers wins, readers see a whole version, untouched parts keep their files; an index built on them finds what all pairs do."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnweave.operators import vector
from tarnweave.operators.index import VectorIndex
from tarnweave.sources.versions import Conflict, KeyedTable, Store


@pytest.fixture
def people(spark, tmp_path):
    rows = [(k, f"name {k}", k % 5) for k in range(300)] + [(None, "nobody", 0)]
    out = KeyedTable(spark, str(tmp_path / "t"), "id", 8)
    out.created(spark.createDataFrame(rows, "id long, name string, n int"))
    return out, {r[0]: r for r in rows}


def held(table, version=None):
    return {r.id: tuple(r) for r in table.rows(version).collect()}


def test_merge_rewrites_touched_buckets_only(spark, people):
    table, want = people
    before = table.store.manifest()
    changes = [(3, "three", 1), (900, "new", 2), (None, "somebody", 9)]
    after = table.merged(spark.createDataFrame(changes, "id long, name string, n int"), spark.createDataFrame([(4,), (5000,)], "id long"))
    want |= {r[0]: r for r in changes}
    del want[4]
    assert held(table) == want and len(held(table, before.version)) == 301
    same = [k for k in before.parts if before.parts[k] == after.parts.get(k)]
    assert len(same) == 8 - len(after.changed) and len(after.changed) <= 5
    # Back again, as a new version; then what no kept version names is deleted.
    back = table.store.rolled_back(before.version)
    assert len(held(table)) == 301 and back.version == 3
    assert table.store.vacuumed(1) == len(after.parts) - len(same) and len(held(table)) == 301


def test_changes_of_one_key(spark, people):
    table, want = people
    twice = spark.createDataFrame([(1, "a", 1), (1, "b", 2)], "id long, name string, n int")
    with pytest.raises(ValueError, match="several changes"):
        table.merged(twice)
    table.merged(twice, order="n")
    assert held(table)[1] == (1, "b", 2)


def test_of_two_writers_one_wins(spark, people):
    table, want = people
    base = table.store.manifest()
    names = sorted(base.parts)
    rows = table.store.read("rows", [names[0]], base)
    mine = table.store.written(rows.withColumn("name", F.lit("mine")), "rows", table._bucket())
    theirs = table.store.written(rows.withColumn("name", F.lit("theirs")), "rows", table._bucket())
    other = table.store.written(table.store.read("rows", [names[1]], base).withColumn("name", F.lit("other")), "rows", table._bucket())
    assert table.store.committed(base, theirs).version == 2
    with pytest.raises(Conflict):
        table.store.committed(base, mine)
    # Other parts: both changes are in the version after.
    assert table.store.committed(base, other).version == 3
    names_now = {r.name for r in table.rows().collect()}
    assert {"theirs", "other"} <= names_now and "mine" not in names_now
    assert not table.store.put(base)


def test_killed_writers_leave_a_whole_version(spark, people, monkeypatch):
    table, want = people
    change = spark.createDataFrame([(3, "three", 1)], "id long, name string, n int")
    for step in ("written", "put"):
        done = getattr(Store, step)

        def killed(self, *x, done=done, step=step):
            if step == "written":
                done(self, *x)
            raise KeyboardInterrupt

        monkeypatch.setattr(Store, step, killed)
        with pytest.raises(KeyboardInterrupt):
            table.merged(change)
        monkeypatch.setattr(Store, step, done)
        assert held(table) == want and table.store.versions() == [1]
    # A manifest that was begun but not put.
    (table.store._fs.create(table.store._at("log/.half"), True)).close()
    assert held(table) == want
    table.merged(change)
    assert held(table)[3] == (3, "three", 1) and table.store.vacuumed() > 0 and held(table)[3] == (3, "three", 1)


def test_empty_tables(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), "id", 4)
    none = spark.createDataFrame([], "id long, name string")
    table.created(none)
    assert held(table) == {}
    table.merged(spark.createDataFrame([(1, "a")], none.schema))
    table.merged(none)
    table.merged(none, spark.createDataFrame([(1,)], "id long"))
    assert held(table) == {}
    assert Store(spark, str(tmp_path / "none")).manifest().version == 0


@pytest.fixture
def vectors(spark):
    r = np.random.default_rng(4)
    middles = r.normal(size=(6, 8)) * 4
    rows = [(int(k), (middles[k % 6] + r.normal(size=8)).tolist(), f"x{k}") for k in range(400)]
    rows += [(400 + k, middles[0].tolist(), "same") for k in range(30)] + [(None, middles[0].tolist(), "no id"), (999, None, "no vector")]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, name string").repartition(3)


def same_as_all_pairs(index, rows, k=4, n_probe=1):
    queries = rows.where("vec_id % 9 = 0 and embedding is not null").select(F.col("vec_id").alias("query_id"), "embedding")
    found, n_parts = index.nearest(queries, k, n_probe)
    got = sorted((r.query_id, r.rank_no, r.vec_id, round(r.distance, 6), r.name) for r in found.collect())
    known = rows.where("vec_id is not null and embedding is not null")
    assert got == sorted((r.query_id, r.rank_no, r.vec_id, round(r.distance, 6), r.name) for r in vector.nearest(known, queries, k).collect())
    return n_parts


def test_deleted_and_given_is_gone(spark, tmp_path):
    rows = spark.createDataFrame([(k, [float(k)]) for k in range(10)], "vec_id long, embedding array<double>")
    index = VectorIndex(spark, str(tmp_path / "i"))
    index.build(rows.where("vec_id < 6"), 2)
    index.upsert(rows.where("vec_id > 3"), rows.where("vec_id in (1, 4, 7)").select("vec_id"))
    assert sorted(r.vec_id for r in index.rows().collect()) == [0, 2, 3, 5, 6, 8, 9]


@pytest.mark.parametrize("part_rows", [1 << 17, 20])
def test_index_is_all_pairs(spark, tmp_path, vectors, part_rows):
    index = VectorIndex(spark, str(tmp_path / "i"), part_rows=part_rows, id_parts=4)
    first = index.build(vectors.where("vec_id < 300 or vec_id >= 400 or vec_id is null"), 6)
    same_as_all_pairs(index, vectors.where("vec_id < 300 or vec_id >= 400"))
    # One query opens few of the parts.
    _, opened = index.nearest(vectors.where("vec_id = 7").select(F.col("vec_id").alias("query_id"), "embedding"), 3, 1)
    assert opened < len(first.numbers)
    moved = vectors.where("vec_id in (8, 14)").withColumn("embedding", F.transform("embedding", lambda x: -x))
    changes = vectors.where("vec_id >= 300 and vec_id < 310").unionByName(moved)
    second = index.upsert(changes, spark.createDataFrame([(20,), (5555,), (None,)], "vec_id long"))
    now = vectors.where("(vec_id < 310 or vec_id >= 400) and vec_id not in (8, 14, 20)").unionByName(moved)
    same_as_all_pairs(index, now)
    assert {r.vec_id for r in index.rows().collect()} == {r.vec_id for r in now.where("embedding is not null").collect()}
    untouched = [p for p in first.parts if p.startswith("list/") and first.parts[p] == second.parts.get(p)]
    if part_rows == 20:
        assert len(untouched) > 3
    assert index.rows(first.version).count() == 330
