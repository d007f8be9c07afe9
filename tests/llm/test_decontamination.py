import random
import re

import pytest

from tarnweave.llm.decontamination import contamination
from tests.llm.conftest import SCHEMA, row


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(text, items, size=10):
    words, hit, found = words_of(text), set(), set()
    for item, t in items:
        own = words_of(t)
        for s in range(max(1, len(own) - size + 1) if own else 0):
            w = own[s : s + size]
            for k in range(len(words) - len(w) + 1):
                if words[k : k + len(w)] == w:
                    hit |= set(range(k, k + len(w)))
                    found.add(str(item))
    return len(words), len(hit), sorted(found)


@pytest.fixture(scope="module")
def both(spark):
    r = random.Random(11)
    vocabulary = "a b the of été zoo x1 north south-east Über".split()
    text = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    items = [(k, text(r.choice([0, 1, 3, 9, 10, 11, 25]))) for k in range(30)] + [(90, None), (91, "rare word here"), (91, "rare word here"), (92, "a a a a a a a a a a a a")]
    rows = [None, "", "...", text(5)]
    for k in range(40):
        t = text(r.randint(0, 40))
        rows.append(t + " " + (r.choice(items)[1] or "").upper().replace(" ", ", ") + "; " + text(r.randint(0, 9)))
    rows += ["a " * 200, rows[-1], rows[-1]]
    return rows, items


@pytest.mark.parametrize("block", [8 << 20, 300])
def test_against_brute_force(spark, both, block):
    rows, items = both
    docs = spark.createDataFrame([row(k, t) for k, t in enumerate(rows)], SCHEMA)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: (r.n_words, sum(x.stop - x.start for x in r.spans), r["items"]) for r in contamination(docs, bench, block_bytes=block).collect()}
    assert got == {k: brute(t, items) for k, t in enumerate(rows)}


def test_nothing(spark, docs, no_docs):
    empty = spark.createDataFrame([], "item_id long, text string")
    assert contamination(no_docs, empty).count() == 0
    assert contamination(docs, empty).where("size(items) > 0").count() == 0
