"""Words with their places, from contents written out by hand; files and pages that can't be read."""

import zlib

import pytest

from tarnweave.plans.fixtures import pdf, pdf_table
from tarnweave.sources.pdf import text_layer
from tarnweave.sources.pdf_words import glyph, page_words, pdf_words

WIDTHS = b"/FirstChar 32 /Widths [" + b" ".join([b"250"] + [b"500"] * 94) + b"]"


def document(content: bytes, more: bytes = b"", font: bytes = b"/Type /Font /Subtype /Type1 " + WIDTHS, resources: bytes = b"") -> bytes:
    return b"".join([
        b"%PDF-1.4\n1 0 obj\n<< /Type /Catalog /Pages 2 0 R >>\nendobj\n2 0 obj\n<< /Type /Pages /Kids [3 0 R] /Count 1 >>\nendobj\n",
        b"3 0 obj\n<< /Type /Page /Parent 2 0 R /MediaBox [0 0 600 800] /Contents 4 0 R /Resources << /Font << /F1 5 0 R >> " + resources + b" >> >>\nendobj\n",
        b"4 0 obj\n<< /Length %d >>\nstream\n" % len(content), content, b"\nendstream\nendobj\n5 0 obj\n<< " + font + b" >>\nendobj\n", more, b"trailer\n<< /Root 1 0 R >>\n%%EOF\n",
    ])


def words(*x, **kv):
    [(number, reason, found)] = page_words(document(*x, **kv))
    return reason, [(w.text, round(w.x, 3), round(w.y, 3), round(w.h, 3)) for w in found]


@pytest.mark.parametrize("content,want", [
    (b"BT /F1 10 Tf 100 700 Td (one two) Tj ET", [("one", 100, 100, 10), ("two", 117.5, 100, 10)]),
    (b"BT /F1 10 Tf 14 TL 100 700 Td (a) Tj T* (b) Tj 5 -20 Td (c) Tj (d) ' ET", [("a", 100, 100, 10), ("b", 100, 114, 10), ("c", 105, 134, 10), ("d", 105, 148, 10)]),
    (b"q 2 0 0 2 10 20 cm BT /F1 5 Tf 1 0 0 1 30 40 Tm (x) Tj ET Q BT 1 0 0 1 30 40 Tm /F1 5 Tf (y) Tj ET", [("x", 70, 700, 10), ("y", 30, 760, 5)]),
    (b"BT /F1 10 Tf 100 700 Td [(jo) -50 (in) -400 (ed)] TJ ET", [("join", 100, 100, 10), ("ed", 124.5, 100, 10)]),
    (b"BT /F1 10 Tf 3 Tc 100 700 Td (ab) Tj 0 Tc 50 Tz (cc) Tj ET", [("a", 100, 100, 10), ("b", 108, 100, 10), ("cc", 116, 100, 10)]),
    (b"BT /F1 10 Tf 5 Tw 100 700 Td (a b) Tj 4 Ts (u) Tj ET", [("a", 100, 100, 10), ("b", 112.5, 100, 10), ("u", 117.5, 96, 10)]),
    (b"BT /F1 10 Tf 100 700 TD (a) Tj 0 -12 TD (b) Tj T* (c) Tj ET", [("a", 100, 100, 10), ("b", 100, 112, 10), ("c", 100, 124, 10)]),
    (b"BT /F1 1 Tf 0 12 -12 0 100 700 Tm (r) Tj ET", [("r", 100, 100, 12)]),
])
def test_places(content, want):
    assert words(content) == ("ok", want)


def test_differences_and_composite_fonts():
    font = b"/Type /Font /Subtype /Type1 " + WIDTHS + b" /Encoding << /Differences [65 /eacute /uni20AC 70 /fi /strange] >>"
    assert words(b"BT /F1 10 Tf 0 0 Td (ABFGx) Tj ET", font=font)[1][0][0] == "é€fi�x"
    assert glyph("a") == "a" and glyph("hyphen") == "-"
    font = b"/Type /Font /Subtype /Type0 /DescendantFonts [6 0 R] /ToUnicode 7 0 R"
    table = b"1 begincodespacerange <0000> <FFFF> endcodespacerange 2 beginbfchar <0001> <0041> <0002> <65E5> endbfchar"
    more = b"6 0 obj\n<< /DW 600 /W [1 [700] 5 9 300] >>\nendobj\n7 0 obj\n<< /Length %d >>\nstream\n%s\nendstream\nendobj\n" % (len(table), table)
    assert words(b"BT /F1 10 Tf 0 800 Td <00010002> Tj <0001> Tj 40 0 Td <0001> Tj ET", more, font)[1] == [("A日A", 0, 0, 10), ("A", 40, 0, 10)]


def test_forms_and_images():
    inner = b"BT /F1 10 Tf 10 10 Td (in) Tj ET /X1 Do"
    form = b"8 0 obj\n<< /Type /XObject /Subtype /Form /Matrix [1 0 0 1 100 0] /Length %d >>\nstream\n%s\nendstream\nendobj\n" % (len(inner), inner)
    reason, found = words(b"BT /F1 10 Tf 0 0 Td (out) Tj ET BI /W 1 /H 1 ID \x00)( EI q 1 0 0 1 0 50 cm /X1 Do Q", form, resources=b"/XObject << /X1 8 0 R >>")
    # A form that draws itself is followed to a depth, and said to be partly read.
    assert reason == "partial" and found[:3] == [("out", 0, 800, 10), ("in", 110, 740, 10), ("in", 210, 740, 10)]


def test_stray_bytes_lose_nothing():
    assert words(b"BT /F1 10 Tf 0 0 Td (one, ) Tj ) (two) Tj ET") == ("partial", [("one,", 0, 800, 10), ("two", 22.5, 800, 10)])
    assert text_layer(document(b"BT /F1 10 Tf 0 0 Td (one, ) Tj ) (two) Tj ET")) == [("partial", "one, two")]
    assert text_layer(document(b"BT /F1 10 Tf 0 0 Td (a) Tj ET BI /W 1 ID \x00)(\xff EI BT (b) Tj ET")) == [("native", "ab")]
    assert text_layer(document(b"BT ET")) == [("empty", "")]


def test_failures_are_rows(spark):
    spoiled = pdf([["a page"], ["next"]], True).replace(zlib.compress(b"BT\n/F1 12 Tf\n72 720 Td\n(next) Tj 0 -14 Td\nET"), b"spoiled")
    files = spark.createDataFrame([("a", bytearray(pdf([["a page"]], True))), ("b", bytearray(b"text")), ("c", None), ("d", bytearray(spoiled)), ("e", bytearray(pdf([[]], False)))], "path string, content binary")
    got = {(r.path, r.page, r.reason if r.text is None else "ok", r.text) for r in pdf_words(files).collect()}
    assert {(p, n, t) for p, n, _, t in got if t} == {("a", 1, "a"), ("a", 1, "page"), ("d", 1, "a"), ("d", 1, "page")}
    reasons = {(p, n): r for p, n, r, t in got if t is None}
    assert set(reasons) == {("b", 0), ("c", 0), ("d", 2), ("e", 1)} and reasons["e", 1] == "empty" and reasons["d", 2].startswith("error") and "no PDF" in reasons["b", 0]
    assert pdf_words(files.limit(0)).count() == 0


def test_a_table(spark):
    rows = [["Name", "Of", "n"], ["x (y)", "two words", "3"], ["z", "w", "4"]]
    for packed in (True, False):
        [(_, reason, found)] = page_words(pdf_table(rows, packed))
        # Rows 0 and 2 are on the page, row 1 in a form after it.
        assert reason == "ok" and [w.text for w in found] == ["Name", "Of", "n", "z", "w", "4", "x", "(y)", "two", "words", "3"]
        assert [round(w.y) for w in found if w.text in ("Name", "x", "z")] == [40, 88, 64]
