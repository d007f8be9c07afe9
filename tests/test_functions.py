"""Meaning of expressions on small rows: traps of text, rules and order, and models in plain Python."""

import random
import re

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from tarnweave.functions import chunking, classify, html, text, urls
from tarnweave.operators import layout, merge, tables, vector

SITE = classify.Site("admission.example.edu", "example")


def one(spark, e, **values):
    kinds = ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'int' if isinstance(v, int) else 'string'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], kinds).select(e.alias("x")).first().x


# -- text


def test_unicode_space(spark):
    assert one(spark, text.collapse("t"), t="  a b \n c ") == "a b c"
    assert one(spark, text.strip("t"), t=" a b\n") == "a b"
    assert one(spark, text.words("t"), t=" a b  c") == ["a", "b", "c"]
    assert one(spark, text.collapse("t"), t=None) == ""


def py_quality(t):
    words, n = t.split(), max(len(t), 1)
    letters = [c for c in t if c.isascii() and c.isalpha()]
    vowel = sum(c in "aeiouAEIOU" for c in letters) / len(letters) if letters else 0.0
    odd = 0
    for w in words:
        core = re.sub("[-./]", "", w)
        odd += bool(re.search("[_~{}]", w)) or (any(c.isdigit() for c in core) and any(c.isalpha() for c in core))
    ratio = odd / len(words) if words else 0.0
    if not t.strip():
        return "empty"
    if (len(words) >= 10 and ratio > 0.15) or vowel < 0.25:
        return "likely_garbled"
    return "likely_non_english_or_garbled" if len(letters) / n < 0.35 else "ok"


@pytest.mark.parametrize("t", ["", "  ", "plain words of a page", "bcdfg hjkl", "a1b c_d {x} " * 5 + "more good words", "e 123 456 789 101112 ...", "éééé aaa ooo", "A-1 b/2 c.3 and some other words in here ok", "ünïcödé"])
def test_quality_flags(spark, t):
    assert one(spark, text.quality("t")["flag"], t=t) == py_quality(t)


def test_empty_is_not_skipped(spark):
    assert one(spark, text.skip_reason(text.quality("t")["flag"]), t="") is None
    assert one(spark, text.skip_reason(text.quality("t")["flag"]), t="bcd fgh") == "low_quality_ocr_output"


def test_issues_dates_snippets(spark):
    assert one(spark, text.text_issues("t"), t="12345 67890 !!!!!!!!!! ��") == ["very_short", "replacement_characters", "punctuation_noise"]
    assert one(spark, text.text_issues("t"), t="1 2 3 4 5 6 7") == ["high_digit_ratio"]
    assert one(spark, text.date_signals("t"), t="on 12 March 2026, 1/2/2026 and 12 march 2026") == ["1/2/2026", "12 March 2026", "2026"]
    assert one(spark, text.snippet("t", ["b"], 2, 3), t="aaaaBcccc") == "aaBcc"
    assert one(spark, text.snippet("t", ["z"]), t="aaaa") == ""
    assert one(spark, text.clean_ocr("t"), t="| a \t b || c |\n\n \x07| |\nd") == "a b | c\nd".replace(" | ", " | ")
    assert one(spark, text.course_codes("t"), t="CS101 EE2020 cs101 CS101") == ["CS101", "EE2020"]


# -- chunks


def py_windows(t, size, overlap):
    w = t.split()
    if not w:
        return []
    if len(w) <= size:
        return [t]
    out, k = [], 0
    while True:
        out.append(" ".join(w[k : k + size]))
        if k + size >= len(w):
            return out
        k += size - overlap


@pytest.mark.parametrize("n", [0, 1, 7, 8, 9, 12, 13, 50])
def test_word_windows(spark, n):
    t = "  ".join(f"w{k}" for k in range(n))
    assert one(spark, chunking.word_windows("t", 8, 3), t=t) == py_windows(t, 8, 3)


def py_pack(words, most):
    out, cur = [], ""
    for w in words:
        joined = f"{cur} {w}" if cur else w
        if len(joined) <= most:
            cur = joined
        else:
            out += [cur] if cur else []
            cur = w
    return out + ([cur] if cur else [])


def py_sentences(t, target, most):
    out, cur = [], ""
    for s in (x.strip() for x in re.split(r"(?<=[.!?])\s+", t)):
        if not s:
            continue
        if len(s) > most:
            out += [cur] if cur else []
            out += py_pack(s.split(), most)
            cur = ""
        elif not cur:
            cur = s
        elif len(cur) + 1 + len(s) > target:
            out.append(cur)
            cur = s
        else:
            cur += " " + s
    return out + ([cur] if cur else [])


def test_sentence_chunks(spark):
    r = random.Random(1)
    texts = ["", "One. Two! Three?", "x" * 50, "a " * 40 + "."] + [" ".join("".join(r.choice("abc") for _ in range(r.randint(1, 12))) + r.choice(["", "", ".", "!"]) for _ in range(r.randint(1, 60))) for _ in range(60)]
    rows = spark.createDataFrame([Row(k=k, t=t) for k, t in enumerate(texts)]).select("k", chunking.sentence_chunks("t", 30, 45).alias("c")).collect()
    assert {x.k: x.c for x in rows} == {k: py_sentences(t, 30, 45) for k, t in enumerate(texts)}


# -- addresses and pages


def test_urls(spark):
    u = "HTTPS://Admission.Example.edu:443/a/b/?q=1#top"
    assert one(spark, urls.split_form("u"), u=u) == "https://admission.example.edu:443/a/b?q=1"
    assert one(spark, urls.crawl_form("u"), u=u) == "https://admission.example.edu:443/a/b/?q=1"
    assert one(spark, urls.site_form("u", "example.edu"), u="http://www.example.edu") == "http://example.edu/"
    assert one(spark, urls.site_form("u"), u="ftp://x/y") is None
    assert one(spark, urls.unwrapped("u"), u="[t](https://x.org/y)") == "https://x.org/y"
    assert one(spark, urls.trimmed_once("u"), u="https://x.org/a//") == "https://x.org/a/"
    assert one(spark, urls.program_label(urls.program_code("u")), u="https://x/UG-2026-1/y") == "Undergraduate"
    assert one(spark, urls.context_of("u"), u="https://x/?redirectFrom=a%20b") == "A B"
    assert one(spark, urls.file_name("u"), u="https://x/a/b.PDF?x=1") == "b.PDF"


@pytest.mark.parametrize("href", ["c", "../c", "./c", "/c/../d", "../../../e", "?q=1", "#f", "//other.org/x", "https://z.org/", "mailto:a@b.c", "", "c/./d/"])
def test_resolve(spark, href):
    from urllib.parse import urljoin

    base = "https://x.org/a/b/page.html?k=v"
    assert one(spark, urls.resolved("h", "b"), h=href, b=base) == urljoin(base, href)


def test_html(spark):
    page = '<title> A &amp; B </title><!-- <a href="/no">no</a> --><script>var t="</p>";</script><nav><a href="/x">X <b>y</b></a></nav><article><p>one<p>two &lt;3</article><a href="mailto:q@r.s">m</a>'
    assert one(spark, html.title("p"), p=page) == "A & B"
    assert one(spark, html.main_text("p"), p=page) == "one two <3"
    assert [tuple(x) for x in one(spark, html.page_links("p", F.lit("https://h.org/")), p=page)] == [("https://h.org/x", "X y")]


# -- classifiers


def test_rule_order_and_anchors(spark):
    target = lambda u, t="": one(spark, classify.target("u", "t", SITE)["decision"], u=u, t=t)
    assert target("https://admission.example.edu/faqs", "FAQs") == "REVIEW"  # the pattern's end isn't the address's end
    assert target("https://admission.example.edu/faqs/") == "KEEP"
    assert target("https://other.org/login") == "REVIEW"
    assert target("https://admission.example.edu/account/x") == "ACTION"
    assert one(spark, classify.file_target("u", "t")["decision"], u="https://admission.example.edu/x.pdf", t="") == "KEEP_FILE"  # the host holds a telling word
    assert one(spark, classify.page_type("u", "t", "x", SITE), u="https://admission.example.edu/", t="t", x="x") == "admission"


def test_usability(spark):
    df = spark.createDataFrame([("", "", ""), ("SKIP", "", ""), ("REVIEW", "", "x"), ("ODD", "", "x"), ("CORE", "operational", "x"), ("CORE", "core", ""), ("CORE", "core", "hostel"), ("CORE", "core", "fees")], "s string, r string, b string")
    assert [x.u for x in df.select(classify.usability(F.col("s"), F.col("r"), F.col("b")).alias("u")).collect()] == ["UNKNOWN_STATUS", "SKIP_STATUS", "REVIEW_UNDECIDED", "INVALID_STATUS:ODD", "ROLE_OPERATIONAL", "NO_BOOK_TARGET", "UNKNOWN_BOOK:hostel", "USABLE"]


@pytest.mark.parametrize(("d", "want"), [(None, "none"), (0.55, "strong"), (0.65, "good"), (0.78, "moderate"), (0.79, "low")])
def test_confidence(spark, d, want):
    assert spark.range(1).select(classify.confidence(F.lit(d).cast("double")).alias("x")).first().x == want


# -- questions


def test_question_traps(spark):
    assert one(spark, tables.category("q"), q="I'm asking") == "M"
    assert one(spark, tables.category("q"), q="category p please") is None
    assert one(spark, tables.aggregate("q"), q="aggregate is 100") == 10.0
    assert one(spark, tables.asks_merit("q"), q="send 12 by email") is True
    assert one(spark, tables.program("q"), q="send 12 by email") is None
    assert one(spark, tables.typed_aggregate("q"), q="in 3 lists with 45 or 72") == 72.0
    assert one(spark, tables.list_number("q"), q="Twelfth Merit List") == 12
    assert one(spark, tables.canonical_campus("q"), q="Main-Campus (LHR)") == "Main Campus (LHR)"


def test_records_resync(spark):
    r = random.Random(3)
    good = lambda k: ["Lahore", f"P{k}", "A1", "Morning", "ECAT", str(60 + k)]
    pages = []
    for p in range(30):
        cells, want = [], []
        for k in range(r.randint(0, 6)):
            cells += ["junk"] * r.randint(0, 3) + good(k)
            want.append(f"P{k}")
        pages.append((p, cells + ["tail"], want))
    got = tables.records(spark.createDataFrame([(p, c) for p, c, _ in pages], "page int, cells array<string>")).orderBy("page", "pos").collect()
    assert {p: [x.program for x in got if x.page == p] for p, _, _ in pages} == {p: w for p, _, w in pages}


# -- operators


def py_diversify(rows, cap, n):
    taken, later, seen = [], [], {}
    for x in rows:
        if len(taken) < n and seen.get(x[1], 0) < cap:
            seen[x[1]] = seen.get(x[1], 0) + 1
            taken.append(x)
        else:
            later.append(x)
    return (taken + later)[:n]


def test_diversified(spark):
    r = random.Random(6)
    lists = {q: sorted((round(r.random(), 3), r.choice("abc"), k) for k in range(r.randint(1, 25))) for q in range(40)}
    lists = {q: sorted(v, key=lambda x: (x[0], x[2])) for q, v in lists.items()}
    rows = [(q, k, s, d, 0) for q, v in lists.items() for d, s, k in v]
    got = vector.diversified(spark.createDataFrame(rows, "query_id int, vec_id int, source string, distance double, rank_no int"), "source").orderBy("query_id", "rank_no").collect()
    for q, v in lists.items():
        assert [x.vec_id for x in got if x.query_id == q] == [x[2] for x in py_diversify(v, 4, 8)]


def test_blocks_of_queries_change_nothing(spark):
    r = random.Random(2)
    v = spark.createDataFrame([(k, [r.random() for _ in range(4)]) for k in range(60)], "vec_id int, embedding array<double>")
    q = v.where("vec_id % 7 = 0").withColumnRenamed("vec_id", "query_id")
    a, b = (sorted(map(tuple, vector.nearest(v, q, 5, block=n).select("query_id", "vec_id", "rank_no").collect())) for n in (1024, 2))
    assert a == b and len(a) == 45


def test_conservation(spark):
    old = spark.range(100).select((F.col("id") % 20).alias("page"), "id", F.lit("old").alias("text"))
    new = spark.createDataFrame([(3, 1000, "new"), (50, 1001, "new")], "page long, id long, text string")
    out = merge.replace_by_key(old, new, ["page"])
    assert out.count() == 100 - 5 + 2 and out.where("page = 3").count() == 1
    kept, removed = merge.excluded(old, spark.createDataFrame([(1,), (77,)], "page long"), "page")
    assert kept.count() + removed.count() == 100 and removed.count() == 5


def test_gap_clusters(spark):
    df = spark.createDataFrame([("a", x) for x in (1.0, 2.0, 9.0, 10.0, 30.0)] + [("b", 5.0)], "k string, x double")
    got = {(r.k, r.x): r.cluster for r in layout.gap_clusters(df, ["k"], "x", F.lit(5.0)).collect()}
    assert got == {("a", 1.0): 0, ("a", 2.0): 0, ("a", 9.0): 1, ("a", 10.0): 1, ("a", 30.0): 2, ("b", 5.0): 0}


def test_patterns_are_looked_for_where_their_core_is(spark):
    assert [text.core(p) for p in (r"\bfee\b", r"ph\.?d", "step.*application", r"/UG-\d", "/news(?:/|$)", r"^https?://a\.edu/?$", "colou?r", "a|b", "(x)y", "ab{2}", r"\Qa\E", "É", "[ab]+c")] == ["fee", "ph", "application", "/ug-", "/news", "://a.edu", "colo", "", "", "", "", "", "c"]
    lists = {"fee": [r"\bfee\b", "fee structure"], "steps": ["step.*application"], "k": ["kiss"], "either": ["no|yes", "x{2}"], "end": ["/news(?:/|$)"]}
    texts = [None, "", "FEE", "coffee", "Coffee, Fee Structures", "coffee FEE", "STEP one\nApplication", "Step 1: Application", "Kiss", "KIſS", "Kiss", "İ fee", "YES", "axXb", "/newspaper", "/NEWS"]
    plain = F.array_compact(F.array(*(F.when(F.coalesce("t", F.lit("")).rlike("(?i)(?:" + "|".join(ps) + ")"), k) for k, ps in lists.items())))
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(text.pattern_signals("t", lists).alias("found"), plain.alias("want")).collect()
    assert [r.found for r in rows] == [r.want for r in rows] and sum(map(len, (r.found for r in rows))) == 9
