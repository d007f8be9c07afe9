import random
import re

from pyspark.sql import functions as F

from tarnweave.llm.pii import listed, personal_data
from tests.llm.conftest import SCHEMA, row

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(d))) % 10 == 0


def brute(text):
    out = []
    for no, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else 0, "card": 14 <= len(d) <= 19 and luhn(d), "phone": 10 <= len(d) <= 15}[kind]
            if ok:
                out.append((m.start(), no, f"{kind}:{m.start()}:{m.end()}"))
    return ",".join(x for *_, x in sorted(out))


def samples():
    r = random.Random(4)
    bits = ["a.b+c@d-e.fr", "x@y", "@", "a@b.c.d@e.f", "1.2.3.4", "999.1.2.3.4", "010.0.0.255", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (555) 010-9999", "+44 20 7946 0958.", "++1", "+1-", "378282246310005", "6011000990139424 12", "é😀", "\x01", "\x02", "12 - 34", "00000000000000", " ", "_z@q.r", "79927398713", "%", "12345678901234567890123"]
    out = ["".join(r.choice(bits) + r.choice(["", " ", ",", "\n"]) for _ in range(r.randint(1, 12))) for _ in range(400)]
    return [None, "", *bits, *out, "7" * 60000, "a" * 60000, "1." * 30000, "4 " * 30000, "a@b.c " * 600, "a@b.c " * 128, "1.2.3.4 " * 127, "1.2.3.4 " * 255, "+1" + "(" * 5000]


def test_base_against_brute_force(spark):
    rows = samples()
    docs = spark.createDataFrame([row(k, t) for k, t in enumerate(rows)], SCHEMA)
    found = personal_data(docs).selectExpr("doc_id", "filter(spans, s -> s.base) base", "spans")
    got = {r.doc_id: (r.base, r.every) for r in found.select("doc_id", listed(found.base).alias("base"), listed(found.spans).alias("every")).collect()}
    for k, t in enumerate(rows):
        assert got[k][0] == brute(t), repr(t)[:200]
        assert set(filter(None, got[k][0].split(","))) <= set(got[k][1].split(","))


def test_added_kinds_and_context(spark):
    rows = ["IBAN GB82 WEST 1234 5698 7654 32 please", "IBAN GB83 WEST 1234 5698 7654 32 please", "call me: 555-010-9999", "part 555-010-9999", "Visa card 4222222222222", "no 4222222222222"]
    docs = spark.createDataFrame([row(k, t) for k, t in enumerate(rows)], SCHEMA)
    got = {r.doc_id: r.s for r in personal_data(docs).select("doc_id", listed(F.col("spans")).alias("s")).collect()}
    assert got == {0: "iban:5:32", 1: "", 2: "phone:9:21", 3: "", 4: "card:10:23", 5: ""}


def test_context_behind(spark):
    rows = ["555-123-4567 (mobile)", "4222222222222 is my Visa", "4222222222222 was seen", "555-123-4567 " + "x " * 30 + "mobile", "555-123-4567 hotel"]
    docs = spark.createDataFrame([row(k, t) for k, t in enumerate(rows)], SCHEMA)
    got = {r.doc_id: r.s for r in personal_data(docs).select("doc_id", listed(F.col("spans")).alias("s")).collect()}
    assert got == {0: "phone:0:12", 1: "card:0:13", 2: "", 3: "", 4: ""}


def test_nothing(no_docs):
    assert personal_data(no_docs).count() == 0
