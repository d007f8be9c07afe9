import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tarnweave.llm import lm_scoring
from tarnweave.llm.lm_scoring import Block, Weights, grams, lm_scores, low_orders
from tarnweave.llm.shared import lowered, text_bytes


def held(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5 == 1


HELD = lambda: F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 1


def tokens(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")), None]


@pytest.fixture(scope="module")
def scored(docs):
    return lm_scores(docs, HELD(), chunk_bytes=20_000).collect()


def test_base_against_brute_force(docs, scored):
    rows = docs.select("doc_id", "text").collect()
    c = Counter(t for r in rows if not held(r.doc_id) for t in tokens(r.text))
    n, v = sum(c.values()), len(c)
    want = sorted((r.doc_id, held(r.doc_id), len(tokens(r.text)), sum(c[t] > 0 for t in tokens(r.text)), n, round(sum(math.log10((c[t] + 0.5) / (n + 0.5 * (v + 1))) for t in tokens(r.text)), 6)) for r in rows)
    assert sorted((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in scored) == want


def test_score_does_not_depend_on_dealing(docs, scored):
    for parts in (1, 16):
        again = lm_scores(docs.repartition(parts), HELD(), chunk_bytes=20_000).collect()
        a, b = (sorted((r.doc_id, r.score) for r in x) for x in (scored, again))
        assert np.allclose(a, b, rtol=1e-6) and all(s <= 0 for _, s in a)


def test_model_is_a_distribution():
    r = np.random.default_rng(1)
    for context in (b"hello", b" a bc", b"\xff\xff\xffab"):
        gram = np.uint64(int.from_bytes(context, "big") << 8) | np.arange(256, dtype=np.uint64)
        count = r.integers(0, 9, 256)
        block = Block(gram, count, low_orders(gram & np.uint64(0xFFFFFF), count))
        p = 10 ** block.costs(Weights(None, r.normal(size=(lm_scoring.GATES, lm_scoring.STEPS)).astype(np.float32)))
        assert abs(p.sum() - 1) < 1e-4


def test_grams():
    texts = ["", "ab", "a longerword b", "longerword"]
    gram, first = grams(*text_bytes(pa.array([t.encode() for t in texts], pa.large_binary())))
    assert np.diff(first).tolist() == [len(t) + 1 for t in texts]
    for k, t in enumerate(texts):
        own = gram[first[k] : first[k + 1]]
        b = b"\xff" * 5 + t.encode() + b"\xff"
        assert [int(x) & (1 << 48) - 1 for x in own] == [int.from_bytes(b[i : i + 6], "big") for i in range(len(t) + 1)]
    # what follows a long word depends on the whole word, wherever it stands
    a, b = gram[first[2] : first[3]], gram[first[3] : first[4]]
    assert int(a[11]) >> 48 == int(b[9]) >> 48 > 0 and int(b[5]) >> 48 == 0 and int(b[6]) >> 48 > 0


def test_learning_helps(spark):
    rows = [(k, "the quick brown fox jumps over the lazy dog and the dog sleeps " * 4) for k in range(60)] + [(1000, "zqxj wvkq jjxz qqpw")]
    got = {r.doc_id: r.bits_per_byte for r in lm_scores(spark.createDataFrame(rows, "doc_id long, text string"), F.col("doc_id") > 50).collect()}
    assert got[55] < 1 < 4 < got[1000]


def test_nothing(docs, no_docs):
    assert lm_scores(no_docs, HELD()).count() == 0
    rows = lm_scores(docs, F.lit(True)).collect()
    assert {r.train_tokens for r in rows} == {0} and {r.n_known for r in rows} == {0} and {r.base_score for r in rows} == {0.0}
    assert lowered(np.zeros(0, np.uint8)).size == 0


def word_before(text, k):
    """The word so far; if it is short, with the white space or what leads the text before it."""
    start = k
    while start > 0 and text[start - 1] not in b" \t\n\x0b\x0c\r":
        start -= 1
    return text[start:k] if k - start >= 5 else text[start - 1 : k] if start else (b"\xff" * 5 + text[:k])[-5:]


def test_score_against_a_slow_model(spark, monkeypatch):
    """Scores from counts in dictionaries, one bit at a time, with the weights and the map that were learned."""
    monkeypatch.setattr(lm_scoring, "UNIT", 50)
    kept, fit = [], lm_scoring.fit
    monkeypatch.setattr(lm_scoring, "fit", lambda table: kept.append(fit(table)) or kept[-1])
    r = random.Random(2)
    rows = [(k, "".join(r.choice(["a", "b", "ab", "longword", " ", "  ", "\t", "é", "Xy"]) for _ in range(30))) for k in range(60)] + [(60, ""), (61, "a"), (62, " b"), (63, None)]
    got = {x.doc_id: x.score for x in lm_scores(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), HELD(), chunk_bytes=600).collect()}
    model, pad = kept[0][1], b"\xff" * 5
    seen = Counter()

    def contexts(text, k, j, byte):
        lead = pad + text[:k]
        return [(order, (word_before(text, k) if order == lm_scoring.WORD else lead[-order:]), j, (256 | byte) >> (8 - j)) for order in lm_scoring.ORDERS]

    def symbols(text):
        text = lowered(np.frombuffer((text or "").encode(), np.uint8)).tobytes()
        return [(text, k, (text + b"\xff")[k]) for k in range(len(text) + 1)]

    for d, t in rows:
        for text, k, byte in symbols(t) if not held(d) else ():
            seen.update((c, byte >> (7 - j) & 1) for j in range(8) for c in contexts(text, k, j, byte))
    for d, t in rows:
        total = 0
        for text, k, byte in symbols(t):
            for j in range(8):
                n = [(seen[c, 0], seen[c, 1]) for c in contexts(text, k, j, byte)]
                level = [sum(sum(x) >= least for least in (1, 2, 4, 16)) for x in n]
                gate = (j * 5 + level[-1]) * 5 + level[-2]
                z = float(np.clip(sum(w * x for w, x in zip(model.weights[gate], [*(math.log(b + 0.25) - math.log(a + 0.25) for a, b in n), 1])), -12, 12))
                z = 0.5 * (z + model.refine[gate, round(min(8, max(-8, z)) * 2) + 16])
                total -= math.log10(1 + math.exp(-z if byte >> (7 - j) & 1 else z))
        assert abs(total - got[d]) < 1e-4 * max(1, abs(total)), (d, t, total, got[d])


def test_many_equal_rows(spark):
    """Rows that would fill a chunk are one on the way; they count, and come back, each."""
    rows = [(None, "same text again")] * 70 + [(3, "same text again")] * 30 + [(k, f"text {k}") for k in range(10, 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    many, few = (lm_scores(docs, HELD(), chunk_bytes=n).collect() for n in (400, 1 << 20))
    assert len(many) == len(few) == len(rows) and {r.held_out for r in many if r.doc_id is None} == {False}
    columns = lambda out: sorted((r.doc_id or 0, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in out)
    assert columns(many) == columns(few)
    assert many[0].train_tokens == sum(len(tokens(t)) for d, t in rows if d is None or not held(d))


def test_learning_takes_two_rounds(spark, monkeypatch):
    docs = spark.createDataFrame([(k, f"some words of a text number {k} and then some more") for k in range(40)], "doc_id long, text string")
    sizes, collected = [], lm_scoring._collected
    monkeypatch.setattr(lm_scoring, "_collected", lambda table, make, size: sizes.append(size) or collected(table, make, size))
    assert lm_scores(docs, HELD()).count() == 40 and sizes == [1401, 1401, 13200]


def test_grams_travel_without_empty_planes():
    r = np.random.default_rng(3)
    gram = np.unique(r.integers(0, 1 << 63, 500).astype(np.uint64) << np.uint64(1) | np.uint64(1))
    for count in (np.zeros(gram.size, np.int64), np.ones(gram.size, np.int64), r.integers(0, 1 << 40, gram.size)):
        packed = lm_scoring._pack_grams(gram, count)
        assert all((a == b).all() for a, b in zip(lm_scoring._unpack_grams(packed), (gram, count), strict=True))
        assert len(lm_scoring._plain(packed)) <= (8 + (int(count.max()).bit_length() + 7) // 8) * gram.size + 10


def test_counts_are_looked_up_once_for_neighbours():
    """A block's work goes by the contexts that differ, not by its grams."""
    gram = np.sort(np.uint64(0x6162636465) << np.uint64(8) | np.arange(64, dtype=np.uint64))
    rows = {j: (head, zeros, ones) for j, head, zeros, ones in low_orders(gram & np.uint64(0xFFFFFF), np.ones(64, np.int64))[2].counts(gram)}
    assert [rows[j][0].size for j in range(8)] == [1, 1, 1, 2, 4, 8, 16, 32]
    assert [(int(rows[j][1].sum()), int(rows[j][2].sum())) for j in range(8)] == [(64, 0), (64, 0), *[(32, 32)] * 6]


def test_grams_by_hash():
    """Equal grams stand together, in the order of whole hashes, though upper bits of some hashes agree."""
    r = np.random.default_rng(1)
    h = np.concatenate([np.repeat(r.integers(0, 1 << 63, 50).astype(np.uint64), 3), np.uint64(7 << 40) + r.integers(0, 5, 100).astype(np.uint64)])
    r.shuffle(h)
    gram = h * np.uint64(pow(int(lm_scoring._ODD), -1, 1 << 64))
    for some in (gram, gram[h >> np.uint64(40) != 7], gram[:0]):
        order, head = lm_scoring._by_hash(some, np.unique(some).size)
        hashes = some * lm_scoring._ODD
        assert (hashes[order] == np.sort(hashes)).all() and (hashes[order[head]] == np.unique(hashes)).all() and (np.sort(order) == np.arange(some.size)).all()


def test_long_words_of_swapped_parts(spark):
    a, b = "a" * 64 + "b" * 64, "b" * 64 + "a" * 64
    rows = lm_scores(spark.createDataFrame([(1, a), (2, f"{a} {b}")], "doc_id long, text string"), F.col("doc_id") == 2).collect()
    assert {r.doc_id: r.n_known for r in rows} == {1: 2, 2: 2}
