"""Words of PDF pages with their places: what tables are made of (operators.layout.table_lines).

An interpreter of the graphics and text state: transformations (cm, q, Q), the text and line matrices, character, word and line spacing, rise and
horizontal scale, fonts' widths (simple ones and those of composite fonts), encodings with differences, forms (XObjects) with their own resources and matrices; inline images
are stepped over. Strings shown on one baseline are joined to words where the gap is less than a part of the font's size.

x and y are in points from the page's upper left corner, y that of the baseline; h is the font's height as it is shown. Files that can't be read, and pages
that can't, are rows with a reason; a page of which parts could not be understood has what could.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnweave.sources.pdf import MALFORMED, Document, Name, Tokens, unicode_map

Matrix = tuple[float, float, float, float, float, float]
UNIT: Matrix = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)
#: Gaps of less than this part of the font's size don't end a word; forms within forms are followed so deep.
JOIN, DEPTH = 0.2, 8
#: A simple font's width of a character that it doesn't say, in thousandths.
WIDTH = 500
#: Glyph names that aren't a single character.
GLYPHS = {
    "space": " ", "exclam": "!", "quotedbl": '"', "numbersign": "#", "dollar": "$", "percent": "%", "ampersand": "&", "quotesingle": "'", "parenleft": "(", "parenright": ")", "asterisk": "*", "plus": "+", "comma": ",", "hyphen": "-", "period": ".",
    "slash": "/", "zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9", "colon": ":", "semicolon": ";", "less": "<", "equal": "=", "greater": ">", "question": "?", "at": "@",
    "bracketleft": "[", "backslash": "\\", "bracketright": "]", "asciicircum": "^", "underscore": "_", "grave": "`", "braceleft": "{", "bar": "|", "braceright": "}", "asciitilde": "~", "bullet": "•", "endash": "–", "emdash": "—",
    "quoteleft": "‘", "quoteright": "’", "quotedblleft": "“", "quotedblright": "”", "ellipsis": "…", "fi": "fi", "fl": "fl", "nbspace": " ", "Euro": "€", "degree": "°", "germandbls": "ß",
    "adieresis": "ä", "odieresis": "ö", "udieresis": "ü", "eacute": "é", "egrave": "è", "agrave": "à", "ccedilla": "ç", "ntilde": "ñ", "aacute": "á", "iacute": "í", "oacute": "ó", "uacute": "ú",
}


def times(a: Matrix, b: Matrix) -> Matrix:
    """a, then b."""
    return (a[0] * b[0] + a[1] * b[2], a[0] * b[1] + a[1] * b[3], a[2] * b[0] + a[3] * b[2], a[2] * b[1] + a[3] * b[3], a[4] * b[0] + a[5] * b[2] + b[4], a[4] * b[1] + a[5] * b[3] + b[5])


def glyph(name: str) -> str:
    """The text of a glyph's name."""
    if len(name) == 1:
        return name
    m = re.fullmatch(r"(?:uni|u)([0-9A-F]{4,6})", name)
    return chr(int(m[1], 16)) if m else GLYPHS.get(name.partition(".")[0], "�")


@dataclass
class Font:
    """size: bytes of a code; text and widths (in thousandths) of codes."""

    size: int = 1
    text: dict[int, str] = field(default_factory=dict)
    widths: dict[int, float] = field(default_factory=dict)
    other: float = WIDTH

    def shown(self, data: bytes) -> Iterator[tuple[str, float, bool]]:
        """Per code: its text, its width in parts of the size, whether it is a space of one byte."""
        for k in range(0, len(data), self.size):
            code = int.from_bytes(data[k : k + self.size], "big")
            text = self.text.get(code) if self.text else None
            if text is None:
                text = bytes([code]).decode("cp1252", "replace") if self.size == 1 else "�"
            yield text, self.widths.get(code, self.other) / 1000, self.size == 1 and code == 32


def _number(x, other: float = 0.0) -> float:
    return float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else other


def font_of(document: Document, font: dict) -> Font:
    out, get = Font(), document.get
    if font.get("Subtype") == "Type0":
        out.size, out.other = 2, 1000
        below = get((get(font.get("DescendantFonts")) or [None])[0]) or {}
        out.other = _number(get(below.get("DW")), 1000)
        listed, k = [get(x) for x in get(below.get("W")) or []], 0
        while k + 1 < len(listed):
            if isinstance(listed[k + 1], list):
                out.widths |= {listed[k] + j: _number(get(w)) for j, w in enumerate(listed[k + 1])}
                k += 2
            elif k + 2 < len(listed):
                out.widths |= dict.fromkeys(range(listed[k], min(listed[k + 1], listed[k] + 65535) + 1), _number(listed[k + 2]))
                k += 3
            else:
                break
    else:
        first = int(_number(get(font.get("FirstChar"))))
        out.widths = {first + j: _number(get(w)) for j, w in enumerate(get(font.get("Widths")) or [])}
        out.other = _number(get((get(font.get("FontDescriptor")) or {}).get("MissingWidth")), 0) or WIDTH
        encoding = get(font.get("Encoding"))
        if isinstance(encoding, dict):
            code = 0
            for x in get(encoding.get("Differences")) or []:
                x = get(x)
                if isinstance(x, Name):
                    out.text[code] = glyph(x)
                    code += 1
                else:
                    code = int(_number(x))
    table = get(font.get("ToUnicode"))
    if isinstance(table, tuple):
        size, known = unicode_map(document.decoded(*table))
        out.text |= known
        out.size = size if font.get("Subtype") == "Type0" else 1
    return out


@dataclass
class State:
    """What q keeps and Q brings back."""

    matrix: Matrix = UNIT
    font: Font = field(default_factory=Font)
    size: float = 0.0
    letters: float = 0.0
    words: float = 0.0
    scale: float = 1.0
    leading: float = 0.0
    rise: float = 0.0


@dataclass
class Run:
    text: str
    x: float
    y: float
    h: float
    end: float


class Reader:
    """Runs of characters of a page; `partial` if something was stepped over that can't be understood."""

    def __init__(self, document: Document):
        self.document, self.runs, self.partial = document, [], False

    def read(self, content: bytes, resources: dict, state: State, depth: int = 0) -> None:
        get, kept, stack = self.document.get, [], []
        line = text = UNIT
        listed = get((get(resources) or {}).get("Font")) or {}
        fonts: dict[str, Font] = {}
        tokens = Tokens(content)
        for x in tokens:
            if type(x) is not str:
                stack.append(x)
                continue
            n = [float(v) for v in stack if isinstance(v, (int, float))]
            if x == "q":
                kept.append(replace(state))
            elif x == "Q" and kept:
                state = kept.pop()
            elif x == "cm" and len(n) > 5:
                state.matrix = times(tuple(n[-6:]), state.matrix)
            elif x == "BT":
                line = text = UNIT
            elif x == "Tf" and n:
                name = next((v for v in stack if isinstance(v, Name)), "")
                if name not in fonts:
                    fonts[name] = font_of(self.document, get(listed.get(name)) or {})
                state.font, state.size = fonts[name], n[-1]
            elif x == "Tm" and len(n) > 5:
                line = text = tuple(n[-6:])
            elif x in ("Td", "TD") and len(n) > 1:
                state.leading = -n[-1] if x == "TD" else state.leading
                line = text = times((1, 0, 0, 1, n[-2], n[-1]), line)
            elif x in ("T*", "'", '"'):
                if x == '"' and len(n) > 1:
                    state.words, state.letters = n[0], n[1]
                line = text = times((1, 0, 0, 1, 0, -state.leading), line)
            elif x in ("TL", "Tc", "Tw", "Ts", "Tz") and n:
                name = {"TL": "leading", "Tc": "letters", "Tw": "words", "Ts": "rise", "Tz": "scale"}[x]
                setattr(state, name, n[-1] / 100 if x == "Tz" else n[-1])
            elif x == "Do" and stack:
                self._form(get((get((get(resources) or {}).get("XObject")) or {}).get(stack[-1])), resources, state, depth)
            elif x == "ID":
                m = re.compile(rb"\sEI(?=\s|$)").search(content, tokens.at)
                tokens.at = m.end() if m else len(content)
            if x in ("Tj", "'", '"', "TJ") and stack:
                for p in stack[-1] if isinstance(stack[-1], list) else [stack[-1]]:
                    if isinstance(p, bytes):
                        text = self._show(p, state, text)
                    elif isinstance(p, (int, float)):
                        text = times((1, 0, 0, 1, -p / 1000 * state.size * state.scale, 0), text)
            stack = []
        self.partial |= bool(tokens.strays)

    def _form(self, found, resources: dict, state: State, depth: int) -> None:
        if not isinstance(found, tuple) or found[0].get("Subtype") != "Form":
            return
        if depth >= DEPTH:
            self.partial = True
            return
        head, raw = found
        matrix = [_number(self.document.get(v)) for v in self.document.get(head.get("Matrix")) or UNIT]
        inner = replace(state, matrix=times(tuple(matrix), state.matrix))
        self.read(self.document.decoded(head, raw), self.document.get(head.get("Resources")) or resources, inner, depth + 1)

    def _show(self, data: bytes, s: State, text: Matrix) -> Matrix:
        for c, width, blank in s.font.shown(data):
            at = times((s.size * s.scale, 0, 0, s.size, 0, s.rise), times(text, s.matrix))
            step = (width * s.size + s.letters + (s.words if blank else 0)) * s.scale
            text = times((1, 0, 0, 1, step, 0), text)
            after = times(text, s.matrix)
            self.runs.append(Run(c, at[4], at[5], (at[2] ** 2 + at[3] ** 2) ** 0.5, after[4] - s.letters * s.scale))
        return text


def joined(runs: list[Run]) -> list[Run]:
    """Words: neighbouring runs of one baseline without space between them."""
    out: list[Run] = []
    for r in runs:
        last = out[-1] if out else None
        if last and last.text and r.text.strip() and abs(r.y - last.y) < 0.1 * max(r.h, 1) and -JOIN * r.h <= r.x - last.end < JOIN * r.h:
            last.text, last.end, last.h = last.text + r.text, r.end, max(last.h, r.h)
        elif r.text.strip():
            out.append(replace(r))
        elif last:
            out.append(Run("", r.x, r.y, r.h, r.end))
    return [r for r in out if r.text]


def page_words(data: bytes) -> Iterator[tuple[int, str, list[Run]]]:
    """Per page: its number, a reason (`ok`, `partial`, `empty`, or why it can't be read), its words with y from the upper edge. A document that can't be read raises ValueError."""
    try:
        document = Document(data)
        pages = list(document.pages())
    except MALFORMED as e:
        raise ValueError(f"no readable PDF: {e}") from e
    for number, page in enumerate(pages, 1):
        reader = Reader(document)
        try:
            box = [_number(document.get(v)) for v in document.get(page.get("MediaBox")) or (0, 0, 612, 792)]
            reader.read(document.content(page), document.get(page.get("Resources")) or {}, State())
            reason = "partial" if reader.partial else "ok" if reader.runs else "empty"
        except MALFORMED as e:
            reason = f"{type(e).__name__}: {e}"[:200]
        yield number, reason, [replace(w, x=w.x - box[0], y=box[3] - w.y) for w in joined(reader.runs)]


def pdf_words(files: DataFrame, content: str = "content", key: str = "path") -> DataFrame:
    """Per word of PDF files: key, page (from 1), reason, text, x, y, h. A page without words, and a file that can't be read (page 0), have a row with a reason and nulls. A null file has none to be read either."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, data in enumerate(batch.column(1)):
                rows: list[tuple] = []
                try:
                    for page, reason, words in page_words(data.as_py() or b""):
                        rows += [(page, reason, w.text, w.x, w.y, w.h) for w in words] or [(page, reason, None, None, None, None)]
                except ValueError as e:
                    rows = [(0, str(e)[:200], None, None, None, None)]
                kinds = (pa.int32(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.float64())
                columns = [pa.array(c, t) for c, t in zip(zip(*rows), kinds)] if rows else [pa.array([], t) for t in kinds]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([k] * len(rows), pa.int64())), *columns], ["key", "page", "reason", "text", "x", "y", "h"])

    kind = files.schema[key].dataType.simpleString()
    rows = files.select(F.col(key).alias("key"), F.col(content).alias("content")).mapInArrow(run, f"key {kind}, page int, reason string, text string, x double, y double, h double")
    return rows.withColumnRenamed("key", key)
