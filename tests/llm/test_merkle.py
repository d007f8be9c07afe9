import random
import zlib
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

import tarnweave.llm.merkle as merkle
from tarnweave.llm.merkle import folded, leaf, manifest

from .conftest import SCHEMA, row

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def H(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def field(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def tree(leaves):
    """The levels of one tree, and each leaf's siblings."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([H(*last[k : k + 2]) for k in range(0, len(last), 2)])
    paths = [[(level[i >> k ^ 1] if i >> k ^ 1 < len(level) else None, bool(i >> k & 1)) for k, level in enumerate(levels[:-1])] for i in range(len(leaves))]
    return levels[-1][0], paths


def model(rows):
    by = {}
    for r in rows:
        by.setdefault(r["lang"], []).append((r["doc_id"] is not None, r["doc_id"] or 0, H(*(field(r[f]) for f in FIELDS)), r["doc_id"]))
    langs = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    done = {x: ([e[3] for e in sorted(by[x], key=lambda e: e[:3])], [e[2] for e in sorted(by[x], key=lambda e: e[:3])]) for x in langs}
    trees = {x: tree(leaves) for x, (_, leaves) in done.items()}
    root, tops = tree([trees[x][0] for x in langs])
    return sorted(((i, h, trees[x][0], root, [*p, *tops[k]]) for k, x in enumerate(langs) for i, h, p in zip(*done[x], trees[x][1])), key=repr)


def check(df, want):
    got = df.withColumn("folded", folded(F.col("leaf"), F.col("path"))).collect()
    assert sorted(((r.doc_id, r.leaf, r.subroot, r.root, [(s.digest, s.left) for s in r.path]) for r in got), key=repr) == want
    assert all(r.folded == r.root for r in got)


@pytest.mark.parametrize("span", [1, 2, 10])
def test_trees(spark, span):
    r = random.Random(span)
    sizes = {None: 3, "": 1, "en": 70, "z": 2, "é": 64, "zz": 65, "a": 5}
    rows = [(r.choice([None, *range(-50, 99)]), r.choice(["", "some text", "more\ntext é"]), lang, r.choice(["s", None]), r.choice([None, 4]), "x", None, 7, "k", 1, 2, 3, 4) for lang, n in sizes.items() for _ in range(n)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    check(manifest(df, span=span), model([x.asDict() for x in df.collect()]))


def test_nulls_ties_and_long_texts(spark, docs):
    same = [row(5, "same")] * 40 + [row(5, "other")] * 3 + [row(None, None), row(None, None), row(6, "x" * 3_000_000)]
    df = docs.unionAll(spark.createDataFrame(same, SCHEMA))
    check(manifest(df), model([x.asDict() for x in df.collect()]))


def test_one_leaf_and_none(spark, no_docs):
    assert manifest(no_docs).count() == 0
    one = spark.createDataFrame([row(1, "a")], SCHEMA)
    got = manifest(one).collect()
    assert [(r.leaf == r.subroot == r.root, r.path) for r in got] == [(True, [])]


def test_broadcast_or_not_is_the_same(docs, monkeypatch):
    monkeypatch.setattr(merkle, "BROADCAST_ROWS", 0)
    check(manifest(docs), model([x.asDict() for x in docs.collect()]))


def test_a_changed_row_is_found(docs):
    also = F.when(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, leaf([F.col(f) if f != "n_chars" else F.col("n_chars") + 1 for f in FIELDS]))
    rows = manifest(docs, also=also).withColumn("folded", folded(F.coalesce("also", "leaf"), F.col("path"))).collect()
    assert any(r.also for r in rows)
    for r in rows:
        assert (r.folded == r.root) == (r.also is None or r.also == r.leaf)
        assert (r.also is not None) == (zlib.crc32(str(r.doc_id).encode()) % 7 == 0)
