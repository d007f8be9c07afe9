import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from corpus_pipeline import by_line_dedup
from tarnweave.llm import line_dedup
from tarnweave.llm.line_dedup import dedup_lines, within
from tarnweave.llm.queries import op4_line_dedup
from tests.llm.conftest import SCHEMA, row


def distance(a, b):
    prev = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        cur = [i]
        for j, y in enumerate(b, 1):
            cur.append(min(prev[j] + 1, cur[-1] + 1, prev[j - 1] + (x != y)))
        prev = cur
    return prev[-1]


def edited(r, s, n):
    s = list(s)
    for _ in range(n):
        k = r.randrange(len(s) + 1)
        what = r.randrange(3)
        if what == 0:
            s.insert(k, r.choice("abé😀 "))
        elif k < len(s):
            if what == 1:
                del s[k]
            else:
                s[k] = r.choice("abcñ")
    return "".join(s)


@pytest.mark.parametrize("edits", [1, 2, 3])
def test_bit_parallel_distance(spark, edits):
    r = random.Random(edits)
    pairs = [("", ""), ("", "ab"), ("abc", ""), ("a" * 50, "a" * (50 + edits)), ("a" * 50, "a" * (51 + edits))]
    for _ in range(400):
        a = "".join(r.choice("ab c") for _ in range(r.randint(0, 30)))
        pairs.append((a, edited(r, a, r.randint(0, edits + 2))))
    rows = spark.createDataFrame(pairs, "a string, b string").select("a", "b", within(F.col("a"), F.col("b"), edits).alias("near")).collect()
    for x in rows:
        assert x.near == (distance(x.a, x.b) <= edits), (x.a, x.b)


def brute(rows, edits, least):
    """(id, text) to (id, text, lines that count, removed, links)."""
    at = {}
    for d, t in rows:
        for k, line in enumerate((t or "").split("\n")):
            x = line.strip(" \t\r\x0b\x0c")
            if len(x) >= least:
                at.setdefault(x, []).append((d, k))
    first = {x: min(v) for x, v in at.items()}
    links = {x: set() for x in at}
    for a, b in combinations(at, 2):
        if abs(len(a) - len(b)) <= edits and distance(a, b) <= edits:
            links[a].add(b)
            links[b].add(a)
    late = {x for x in at if any(first[y] < first[x] for y in links[x])}
    out = []
    for d, t in rows:
        kept, n, gone, linked = [], 0, 0, 0
        for k, line in enumerate((t or "").split("\n")):
            x = line.strip(" \t\r\x0b\x0c")
            if len(x) >= least:
                n += 1
                linked += len(links[x])
                if x in late or first[x] != (d, k):
                    gone += 1
                    continue
            kept.append(line)
        out.append((d, None if t is None else "\n".join(kept), n, gone, linked))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def rows():
    r = random.Random(9)
    base = ["".join(r.choice("abcde fgh éñ") for _ in range(r.randint(18, 45))).strip() + "x" for _ in range(25)]
    lines = base + [edited(r, r.choice(base), r.randint(1, 3)) for _ in range(60)] + ["short", "", "  ", "\t" + base[0] + "  "]
    out = [(k, "\n".join(r.choice(lines) for _ in range(r.randint(1, 12)))) for k in range(40)]
    return [*out, (100, None), (101, ""), (102, "\n\n"), (103, base[3] + "\n" + base[3]), (104, "w" * 5000), (105, "w" * 5001)]


@pytest.mark.parametrize("limit", [1 << 20, -1])
def test_against_brute_force(spark, rows, limit):
    docs = spark.createDataFrame([row(d, t) for d, t in rows], SCHEMA).repartition(3)
    got = dedup_lines(docs, broadcast_rows=limit)
    assert got.columns == [*docs.columns, "n_lines", "n_removed", "n_links"]
    assert sorted(((x.doc_id, x.text, x.n_lines, x.n_removed, x.n_links) for x in got.collect()), key=str) == brute(rows, 2, 20)
    assert {(x.id, x.fp) for x in got.collect()} == {("x", 7)}


def test_equal_rows_are_one_document(spark):
    text = "a line that is long enough to count\nanother line that is long enough too"
    docs = spark.createDataFrame([row(5, text), row(5, text), row(6, text)], SCHEMA)
    assert sorted((x.doc_id, x.text) for x in dedup_lines(docs).collect()) == [(5, text), (5, text), (6, "")]


def test_null_and_text_ids(spark):
    text = "a line that is long enough to count"
    docs = spark.createDataFrame([row(None, text), row(-9, text)], SCHEMA)
    assert {(x.doc_id, x.text) for x in dedup_lines(docs).collect()} == {(None, text), (-9, "")}
    named = spark.createDataFrame([("b", text), ("a", text + "\nx")], "doc_id string, text string")
    assert {(x.doc_id, x.text) for x in dedup_lines(named).collect()} == {("a", text + "\nx"), ("b", "")}


def test_short_lines_are_merged_if_equal(spark, tmp_path):
    long = "a line that is long enough to count"
    rows = [(1, "Read more\n" + long + "\n\n}"), (2, " Read more \nRead mode\n\n}\nx"), (3, long + "!\nRead more\nRead more"), (4, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = [(1, rows[0][1], 3, 0, 1), (2, "Read mode\n\nx", 4, 2, 0), (3, "", 3, 3, 1), (4, "", 0, 0, 0)]
    assert sorted(tuple(x) for x in dedup_lines(docs, exact_chars=1).collect()) == want
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = op4_line_dedup(spark, str(tmp_path)).select("doc_id", "n_lines", "n_removed", "n_links").collect()
    assert sorted(map(tuple, got)) == [(d, *n) for d, _, *n in want]
    staged = by_line_dedup(spark, docs.withColumn("n_chars", F.length("text")), str(tmp_path)).select("doc_id", "text").collect()
    assert sorted(map(tuple, staged)) == [(d, t) for d, t, *_ in want]


def test_nothing(no_docs):
    assert dedup_lines(no_docs).count() == 0


def test_clashing_names_and_repetition(spark):
    rows = [(1, "a line that is long enough to count\nx", "u", 1, 2), (2, "a line that is long enough to count!", "v", 3, 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `gone places` string, N_LINKS int, least int")
    once = dedup_lines(docs)
    assert once.columns == ["doc_id", "text", "gone places", "least", "n_lines", "n_removed", "n_links"]
    assert sorted(map(tuple, once.collect())) == [(1, rows[0][1], "u", 2, 1, 0, 1), (2, "", "v", 4, 1, 1, 1)]
    assert sorted((r.doc_id, r.text, r.n_removed, r.least) for r in dedup_lines(once).collect()) == [(1, rows[0][1], 0, 2), (2, "", 0, 4)]


def test_one_id_with_different_texts(spark):
    line = "a line that is long enough to count"
    docs = spark.createDataFrame([(5, line + "\none"), (5, line + "\ntwo"), (7, line)], "doc_id long, text string")
    got = dedup_lines(docs).collect()
    assert sorted(r.n_removed for r in got) == [0, 1, 1] and sum(line in r.text for r in got) == 1 and [r.text for r in got if r.doc_id == 7] == [""]


@pytest.mark.parametrize("rounds", [0, 1, 5])
def test_hot_keys_are_split(spark, monkeypatch, rounds):
    """Lines that share most characters: pairs under narrower keys and in blocks are those of brute force."""
    monkeypatch.setattr(line_dedup, "HOT_PAIRS", 8)
    monkeypatch.setattr(line_dedup, "BLOCK", 4)
    monkeypatch.setattr(line_dedup, "ROUNDS", rounds)
    r = random.Random(21)
    lines = ["all of these lines begin alike " + "".join(r.choice("abcdefghij") for _ in range(6)) for _ in range(120)]
    lines += [edited(r, r.choice(lines), r.randint(1, 3)) for _ in range(60)] + [f"Order no. {k:05d} has been sent" for k in range(0, 400, 7)]
    rows = [(k, "\n".join(lines[3 * k : 3 * k + 3])) for k in range(len(lines) // 3 + 1)]
    docs = spark.createDataFrame([row(d, t) for d, t in rows], SCHEMA)
    got = sorted(((x.doc_id, x.text, x.n_lines, x.n_removed, x.n_links) for x in dedup_lines(docs).collect()), key=str)
    assert got == brute(rows, 2, 20)


def test_pairs_under_hot_keys_grow_with_the_lines(spark, monkeypatch):
    seen, meeting = [], line_dedup._meeting
    monkeypatch.setattr(line_dedup, "HOT_PAIRS", 1 << 10)
    for n in (1500, 3000):
        r = random.Random(n)
        rows = [(k, "x" * 30 + "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(15))) for k in range(n)]
        lines = spark.createDataFrame(rows, "id long, line string").selectExpr("id", "line", "length(line) n", "cast(id as decimal(38,0)) least")
        met = []
        monkeypatch.setattr(line_dedup, "_meeting", lambda rows, limit, f=meeting: met.append(f(rows, limit)) or met[-1])
        monkeypatch.setattr(line_dedup, "free", lambda *x: None)
        line_dedup.line_links(lines, 2, 1 << 20)
        seen.append(sum(m[0].groupBy("key").agg(F.expr("count_if(indexed) * count(*)").alias("pairs")).agg(F.coalesce(F.sum("pairs"), F.lit(0))).first()[0] for m in met))
        assert met[-1][1].isEmpty()
    assert seen[1] < 3 * seen[0] + 10_000


def template(n, seed=1):
    signs = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    return random.Random(seed).sample([f"See section {x} of the report, signed by the clerk {y} on duty" for x in signs for y in signs], n)


def test_lines_that_are_all_linked_are_counted_without_comparing(spark):
    for n in (500, 3844):
        docs = spark.createDataFrame([row(k, t) for k, t in enumerate(template(n))], SCHEMA).repartition(4)
        got = dedup_lines(docs).collect()
        assert {r.n_links for r in got} == {n - 1} and [r.doc_id for r in got if r.text] == [0]


@pytest.mark.parametrize("rounds", [0, 1, 5])
def test_cliques_against_brute_force(spark, monkeypatch, rounds):
    """Cliques that overlap, lines near them, of other lengths and at three places apart."""
    monkeypatch.setattr(line_dedup, "HOT_PAIRS", 16)
    monkeypatch.setattr(line_dedup, "BLOCK", 8)
    monkeypatch.setattr(line_dedup, "ROUNDS", rounds)
    r = random.Random(rounds)
    lines = template(60) + [f"See section {r.choice('xyz')} of the report, signed by the clerk {r.choice('abc')} on dut{r.choice('uvw')}" for _ in range(60)]
    lines += [edited(r, r.choice(lines), r.randint(1, 3)) for _ in range(50)] + [f"page {k} of 1000 pages in all" for k in range(100, 130)]
    rows = [(k, "\n".join(lines[2 * k : 2 * k + 2])) for k in range(len(lines) // 2 + 1)]
    docs = spark.createDataFrame([row(d, t) for d, t in rows], SCHEMA)
    assert sorted(((x.doc_id, x.text, x.n_lines, x.n_removed, x.n_links) for x in dedup_lines(docs).collect()), key=str) == brute(rows, 2, 20)
