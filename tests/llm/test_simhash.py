import random
import re
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash

from tarnweave.llm import similar_sets, simhash
from tarnweave.llm.simhash import components, family, forest, links, near_duplicates
from tests.llm.conftest import SCHEMA, row


def brute(text, size=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[k : k + size]) for k in range(max(1, len(words) - size + 1))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def roots(pairs, nodes):
    up = {x: x for x in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {x: find(x) for x in nodes}


def test_fingerprints_and_components(docs):
    rows = docs.select("doc_id", "text").collect()
    fp = [(r.doc_id, brute(r.text)) for r in rows]
    want = roots([(a, b) for (a, x), (b, y) in combinations(fp, 2) if (x ^ y).bit_count() <= 3], {d for d, _ in fp})
    got = near_duplicates(docs).collect()
    assert sorted((r.doc_id, r.fingerprint, r.component_id) for r in got) == sorted((d, f"{x:016x}", want[d]) for d, x in fp)


def test_nothing(no_docs):
    assert near_duplicates(no_docs).count() == 0


def test_families_meet_every_five():
    for width in (3, 4, 5):
        assert all(any(set(s) <= set(m) for s in family(width)) for m in combinations(range(8), 5))


def pairs_of(found):
    return [tuple(map(int, x)) for x in zip(*found, strict=True)]


def test_forest_spans_small_and_large_groups():
    r = random.Random(2)
    base = r.getrandbits(40) << 24
    small = np.unique(np.array([base | r.getrandbits(24) for _ in range(300)] + [base | 1 << k for k in range(20)], np.uint64).view(np.int64))
    pairs = [(int(a), int(b)) for a, b in combinations(small, 2) if (int(a) ^ int(b)).bit_count() <= 3]
    assert set(roots(pairs_of(forest(small)), map(int, small)).items()) == set(roots(pairs, map(int, small)).items())
    large = np.unique(np.array([base | (r.getrandbits(13) << 5) for _ in range(12000)], np.uint64).view(np.int64))
    assert large.size > 4096 and forest(large)[0].size == large.size - 1


def test_links_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(simhash, "HOT", 8)
    r = random.Random(3)
    fps = {r.getrandbits(64) for _ in range(300)}
    for x in list(fps)[:60]:
        for _ in range(6):
            y = x
            for _ in range(r.randint(1, 4)):
                y ^= 1 << r.randrange(64)
            fps.add(y)
    hot = r.getrandbits(64)
    fps |= {hot ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)) for _ in range(80)}
    signed = [x - (1 << 64) if x >> 63 else x for x in sorted(fps)]
    pairs = [(a, b) for a, b in combinations(signed, 2) if ((a ^ b) & (1 << 64) - 1).bit_count() <= 3]
    found = links(spark.createDataFrame([(x,) for x in signed], "fp long"), len(signed))
    mine = [tuple(x) for x in found.collect()]
    assert all(((a ^ b) & (1 << 64) - 1).bit_count() <= 63 for a, b in mine)
    assert roots(mine, signed) == roots(pairs, signed)
    top = {x.node: x.root for x in components(found, spark).collect()}
    assert {x: top.get(x, x) for x in signed} == roots(pairs, signed)


def sets_of(text, size=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(words[k : k + size]) for k in range(max(1, len(words) - size + 1))) if words else frozenset()


def similar_texts():
    """Texts with copies of 0 to 30 changed words, a group of near copies, and a passage that many texts share."""
    r = random.Random(12)
    text = lambda n: [f"w{r.randint(0, 5000)}" for _ in range(n)]
    out = [None, "", " ", "one two", "One two", "a b c d e", "a b c d e f"]
    passage = text(40)
    for k in range(40):
        base = text(r.randint(5, 160)) + passage * (k % 2)
        out.append(" ".join(base))
        for _ in range(3):
            own = list(base)
            for _ in range(r.choice([0, 1, 2, 3, 5, 8, 30])):
                own[r.randrange(len(own))] = f"x{r.randint(0, 99)}"
            out.append(" ".join(own))
    base = text(120)
    for k in range(60):
        own = list(base)
        for _ in range(r.randint(1, 3)):
            own[r.randrange(len(own))] = f"y{r.randint(0, 999)}"
        out.append(" ".join(own))
    return out


def similar_roots(rows, size=5, similarity=0.8):
    sets, fp = [(d, sets_of(t, size)) for d, t in rows], {d: brute(t, size) for d, t in rows}
    near = lambda a, x, b, y: (fp[a] ^ fp[b]).bit_count() <= 3 or x == y or (x and y and len(x & y) >= similarity * len(x | y) - 1e-9)
    return roots([(a, b) for (a, x), (b, y) in combinations(sets, 2) if near(a, x, b, y)], {d for d, _ in rows})


def test_similar_sets_lose_nothing(spark, monkeypatch):
    rows = [(k, t) for k, t in enumerate(similar_texts())]
    docs = spark.createDataFrame([row(d, t) for d, t in rows], SCHEMA).repartition(3)
    want = similar_roots(rows)
    for common in (4, 64):
        monkeypatch.setattr(similar_sets, "COMMON", common)
        got = {r.doc_id: r.component_id for r in near_duplicates(docs, 5, similarity=0.8).collect()}
        assert got == want
    assert len(set(want.values())) < len(rows) - 80
    missed = {r.doc_id: r.component_id for r in near_duplicates(docs, 5).collect()}
    assert len(set(missed.values())) > len(set(want.values()))


def test_similar_sets_of_nothing_and_repeated_ids(spark, no_docs):
    assert near_duplicates(no_docs, 5, similarity=0.8).count() == 0
    words = " ".join(f"w{k}" for k in range(40))
    rows = [(1, words), (1, "other words altogether"), (2, words + " more"), (None, None), (None, "")]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 5, similarity=0.8).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in got) == [(0, 0), (0, 0), (1, 1), (1, 1), (2, 1)]


def test_signatures_bound_differences():
    r = np.random.default_rng(5)
    sets = [np.unique(r.integers(0, 1 << similar_sets.WIDTH, n).astype(np.uint64)) for n in (0, 1, 30, 500, 5000)]
    sets += [np.unique(np.concatenate([x[: x.size * 9 // 10], r.integers(0, 1 << similar_sets.WIDTH, x.size // 12).astype(np.uint64)])) for x in sets]
    at = np.concatenate([[0], np.cumsum([x.size for x in sets])])
    out = similar_sets.signatures(np.concatenate(sets), at)
    i, j = np.array(list(combinations(range(len(sets)), 2))).T
    sizes, differ = similar_sets._differing(out.take(pa.array(i)), out.take(pa.array(j)))
    apart = np.array([np.setxor1d(sets[a], sets[b]).size for a, b in zip(i, j, strict=True)])
    assert (differ <= apart).all() and sizes.tolist() == [sets[a].size + sets[b].size for a, b in zip(i, j, strict=True)]
    # Sets without a common shingle differ in nearly half of the places of the smaller one.
    assert differ[(i == 3) & (j == 4)] > 400 and differ[(i == 4) & (j == 9)] <= apart[(i == 4) & (j == 9)] < 1200
