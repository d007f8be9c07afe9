import random

import numpy as np
from pyspark.sql import functions as F

from tarnweave.llm.quality_classifier import features, fit, score
from tarnweave.llm.shared import text_bytes
from tests.llm.conftest import SCHEMA, row


def test_features_stay_inside_texts():
    import pyarrow as pa

    texts = ["ab", "", "hello big world", "x", "hello big world"]
    own = [[b.tolist() for b, _ in features(*text_bytes(pa.array([t.encode()], pa.large_binary())))] for t in texts]
    for k, (b, first) in enumerate(features(*text_bytes(pa.array([t.encode() for t in texts], pa.large_binary())))):
        parts = [b[first[i] : first[i + 1]].tolist() for i in range(len(texts))]
        assert parts == [o[k] if k < len(o) else [] for o in own]


def test_held_out_accuracy(spark):
    r = random.Random(1)
    good = lambda: " ".join(r.choice(["stone", "river", "green", "walks", "house", "table"]) + r.choice(["", "s", "ed"]) for _ in range(30))
    bad = lambda: " ".join(r.choice(["BUY", "CLICK", "WIN", "###", "$$$"]) + r.choice(["!", "!!", ""]) for _ in range(30))
    rows = [row(k, good() if k % 3 else bad()) for k in range(600)] + [row(1000, None), row(1001, "")]
    labels = [(k, int(k % 3 > 0), 0) for k in range(600)] + [(5, None, None), (None, 1, 0), (7, 1, 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    model = fit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), may_learn=F.col("doc_id") % 5 > 0)
    got = {r.doc_id: r.score for r in score(docs, model).collect()}
    assert np.mean([(got[k] >= 0.5) == (k % 3 > 0) for k in range(0, 600, 5)]) > 0.98
    assert got[1000] == got[1001] and 0 < got[1000] < 1


def test_nothing(spark, docs, no_docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert score(no_docs, fit(no_docs, none)).count() == 0
    assert {r.score for r in score(docs, fit(docs, none)).collect()} == {0.5}
    one = spark.createDataFrame([(4, 1, 0)], "doc_id long, quality int, toxic int")
    assert all(r.score > 0.5 for r in score(docs, fit(docs, one)).collect())
