"""Text expressions. White space is Unicode's unless a docstring says otherwise; null is treated as empty."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"(?U)\s"
QUERY_PREFIX = "Represent this sentence for searching relevant passages: "  # fixed value: the embedding model's instruction


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def once(x: Column, use: Callable[[Column], Column]) -> Column:
    """What `use` makes of x, x being computed once: as a lambda's variable, however often it is used."""
    return F.transform(F.array(x), use)[0]


#: Edges of a word of ASCII letters, digits and underscores, as \b of the SQL has them; Java's \b also knows other letters, or not, by its version.
BEGIN, END = "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"


def strip(x: Column | str) -> Column:
    """Without white space at the ends; null becomes empty."""
    return F.regexp_replace(F.coalesce(col(x), F.lit("")), rf"^{SPACE}+|(?U)\s+$", "")


def collapse(x: Column | str) -> Column:
    """Stripped, with every run of white space one space."""
    return F.btrim(F.regexp_replace(F.coalesce(col(x), F.lit("")), rf"{SPACE}+", " "), F.lit(" "))


def folded(x: Column | str) -> Column:
    """Collapsed and lower case."""
    return F.lower(collapse(x))


def compact(x: Column | str) -> Column:
    """Lower case letters and digits of ASCII alone."""
    return F.regexp_replace(F.lower(F.coalesce(col(x), F.lit(""))), "[^a-z0-9]+", "")


def program_key(x: Column | str) -> Column:
    """A program's name without brackets and punctuation, for comparison."""
    return collapse(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(col(x), F.lit(""))), r"\([^)]*\)", " "), "[^a-z0-9]+", " "))


def code(x: Column | str) -> Column:
    """A canonical code: stripped, lower case, spaces as underscores."""
    return F.replace(F.lower(strip(x)), F.lit(" "), F.lit("_"))


def status(x: Column | str) -> Column:
    return F.upper(strip(x))


def first_value(*xs: Column | str) -> Column:
    """The first value that isn't blank, stripped; else empty."""
    return F.coalesce(*(F.nullif(strip(x), F.lit("")) for x in xs), F.lit(""))


def safe_int(x: Column | str) -> Column:
    return F.coalesce(strip(x).try_cast("int"), F.lit(0))


def safe_float(x: Column | str) -> Column:
    return strip(x).try_cast("double")


def words(x: Column | str) -> Column:
    """The runs of characters that aren't white space."""
    return F.filter(F.split(F.coalesce(col(x), F.lit("")), rf"{SPACE}+"), lambda w: w != "")


def preview(x: Column | str, n: int, tail: str = "...") -> Column:
    """At most n characters, with `tail` if something was cut."""
    x = F.coalesce(col(x), F.lit(""))
    return F.when(F.length(x) > n, F.concat(F.left(x, F.lit(n)), F.lit(tail))).otherwise(x)


def embedding_input(title: Column | str, text: Column | str) -> Column:
    """Title, a blank line, text; the text alone without a title."""
    return F.when(strip(title) != "", F.concat(strip(title), F.lit("\n\n"), strip(text))).otherwise(strip(text))


def query_input(x: Column | str, prefix: str = QUERY_PREFIX) -> Column:
    return F.when(collapse(x) == "", "").otherwise(F.concat(F.lit(prefix), collapse(x)))


def clean_ocr(x: Column | str, pipes: bool = True) -> Column:
    """Lines of recognised text: control characters and runs of blanks go, pipes are tidied, blank lines go."""
    x = F.regexp_replace(F.coalesce(col(x), F.lit("")), r"[^\P{C}\n\t]", "")
    lines = F.transform(F.split(x, "\n"), lambda y: F.btrim(F.regexp_replace(y, "[ \t]+", " "), F.lit(" \t")))
    if pipes:
        lines = F.transform(lines, lambda y: F.btrim(F.regexp_replace(y, r"\|(?:\s*\|)+", "|"), F.lit(" |")))
    return F.array_join(F.filter(lines, lambda y: y != ""), "\n")


def audit_text(x: Column | str) -> Column:
    """Line feeds only, no more than one blank line together, stripped."""
    x = F.regexp_replace(F.coalesce(col(x), F.lit("")), "\r\n?", "\n")
    return F.btrim(F.regexp_replace(x, "\n{3,}", "\n\n"), F.lit(" \n\t"))


def count_of(x: Column | str, characters: str) -> Column:
    """How many characters of a class (as in a pattern's brackets) the text has."""
    return F.length(F.regexp_replace(F.coalesce(col(x), F.lit("")), f"[^{characters}]+", ""))


def quality(x: Column | str) -> Column:
    """Struct of flag and ratios (3 decimals): empty, likely_garbled, likely_non_english_or_garbled or ok."""
    x = F.coalesce(col(x), F.lit(""))
    n, letters, vowels = F.length(x), count_of(x, "A-Za-z"), count_of(x, "AEIOUaeiou")
    # A word with an odd sign, or with both a digit and a letter; whole words are stepped over, so the text is read about once.
    odd = r"(?U)(?<!\S)(?:(?=[^\s_~{}]*+[_~{}])|(?=[^\s\p{Nd}]*+\p{Nd})(?=[^\s\p{L}]*+\p{L}))\S++"
    n_words, n_odd = F.regexp_count(x, F.lit(r"(?U)\S++")), F.regexp_count(x, F.lit(odd))
    ascii_ratio = letters / F.greatest(n, F.lit(1))
    vowel_ratio = F.when(letters > 0, vowels / F.greatest(letters, F.lit(1))).otherwise(0.0)
    odd_ratio = F.when(n_words > 0, n_odd / F.greatest(n_words, F.lit(1))).otherwise(0.0)
    flag = (
        F.when(strip(x) == "", "empty")
        .when(((n_words >= 10) & (odd_ratio > 0.15)) | (vowel_ratio < 0.25), "likely_garbled")
        .when(ascii_ratio < 0.35, "likely_non_english_or_garbled")
        .otherwise("ok")
    )
    return F.struct(flag.alias("flag"), F.round(ascii_ratio, 3).alias("ascii_letter_ratio"), F.round(vowel_ratio, 3).alias("vowel_ratio"), F.round(odd_ratio, 3).alias("suspicious_word_ratio"))


SKIPPED_FLAGS = ("likely_garbled", "likely_non_english_or_garbled")


def skip_reason(flag: Column) -> Column:
    """Why a page of that quality isn't kept; null if it is (an empty page is kept and yields no chunk)."""
    return F.when(flag.isin(*SKIPPED_FLAGS), "low_quality_ocr_output")


def native_quality(x: Column | str, least: int = 30) -> Column:
    n = F.length(strip(x))
    return F.when(n == 0, "empty").when(n >= least, "usable").otherwise("too_short")


def ocr_need(chars: Column, failed: Column | None = None, least: int = 40) -> Column:
    """FAILED, TEXT_OK or NEEDS_OCR."""
    return F.when(F.lit(False) if failed is None else failed, "FAILED").when(chars >= least, "TEXT_OK").otherwise("NEEDS_OCR")


def text_issues(x: Column | str) -> Column:
    """Names of what looks wrong with a chunk's text."""
    x = F.coalesce(col(x), F.lit(""))
    dense = F.regexp_replace(x, rf"{SPACE}+", "")
    return F.array_compact(F.array(
        F.when(F.regexp_count(x, F.lit(r"(?U)\b\w+\b")) < 5, "very_short"),
        F.when(count_of(x, "\\ufffd") >= 2, "replacement_characters"),
        F.when(x.rlike(r"(?U)[^\w\s]{8,}"), "punctuation_noise"),
        F.when((F.length(dense) > 0) & (count_of(dense, r"\p{Nd}") > 0.65 * F.length(dense)), "high_digit_ratio"),
    ))


def suspicions(x: Column | str) -> Column:
    """Reasons to look at a page again."""
    x = strip(x)
    n = F.length(x)
    return F.when(n == 0, F.array(F.lit("empty_text"))).otherwise(F.array_compact(F.array(
        F.when(F.size(words(x)) < 10, "very_few_words"),
        F.when(count_of(x, r"{}\[\]~") > 0.03 * n, "symbol_noise"),
        F.when((n >= 30) & (count_of(x, "A-Za-z") < 0.2 * n), "low_letter_ratio"),
    )))


def course_codes(x: Column | str) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.coalesce(col(x), F.lit("")), F.lit(r"\b([A-Z]{2,5}\d{3,4})\b"), F.lit(1))))


#: Headings of course tables.
TABLE_HEADINGS = {
    "course_number": r"(?i)\b(?:Course\s*(?:No|Number)|Code)\b",
    "subject": r"(?i)\bSubject\b",
    "credit": r"(?i)\b(?:Cr\.?\s*Hrs?|Credit\s*Hours?|Credits?)\b",
    "elective": r"(?i)\bElective\s+Courses?\b",
    "course": r"(?i)\bCourses?\b",
    "separator": r"\|",
}


def table_indicators(x: Column | str) -> Column:
    return F.array_compact(F.array(*(F.when(F.coalesce(col(x), F.lit("")).rlike(p), k) for k, p in TABLE_HEADINGS.items())))


def page_profile(x: Column | str) -> Column:
    """What an audit looks at in a page's text: struct of chars, words, lines, codes, indicators, suspicions, head and tail."""
    x = F.coalesce(col(x), F.lit(""))
    lines = F.size(F.filter(F.split(x, "\n"), lambda y: F.btrim(y) != ""))
    ends = head_tail(x)
    return F.struct(F.length(x).alias("n_chars"), F.size(words(x)).alias("n_words"), lines.alias("n_lines"), course_codes(x).alias("codes"), table_indicators(x).alias("indicators"), suspicions(x).alias("suspicions"), ends["head"].alias("head"), ends["tail"].alias("tail"))


def flat_metadata(**fields: Column) -> list[Column]:
    """Metadata that any store takes: lists joined by ", ", strings stripped, numbers 0 and flags false where null; a field's kind is told by its name's ending (_list, _number, _flag, else text)."""
    out = []
    for name, x in fields.items():
        kind = name.rpartition("_")[2]
        plain = {"list": lambda x: F.array_join(F.coalesce(x, F.array().cast("array<string>")), ", "), "number": lambda x: F.coalesce(x.try_cast("int"), F.lit(0)), "flag": lambda x: F.coalesce(x.cast("boolean"), F.lit(False))}.get(kind, strip)
        out.append(plain(x).alias(name.removesuffix(f"_{kind}") if kind in ("list", "number", "flag") else name))
    return out


def listed(x: Column | str) -> Column:
    """A list from "a, b": empty without anything."""
    return F.filter(F.split(strip(x), r",\s*"), lambda y: y != "")


def garbled_url_lines(x: Column | str) -> Column:
    """Lines that look like broken addresses."""
    pattern = r"(?i)\bhttps?\b|\w+\s*\.\s*(?:edu|pk|com|org|gov)"
    return F.filter(F.split(F.coalesce(col(x), F.lit("")), "\n"), lambda y: y.rlike(pattern))


def head_tail(x: Column | str, n: int = 3) -> Column:
    """The first and the last n lines that aren't blank."""
    lines = F.filter(F.split(F.coalesce(col(x), F.lit("")), "\n"), lambda y: F.btrim(y) != "")
    return F.struct(F.slice(lines, 1, n).alias("head"), F.when(F.size(lines) > n, F.slice(lines, F.greatest(F.size(lines) - n + 1, F.lit(1)), F.lit(n))).otherwise(lines).alias("tail"))


def date_signals(x: Column | str, most: int = 50) -> Column:
    """Dates in the text: numeric, with month names, and years; by pattern, then place; each once whatever its case."""
    months = "january|february|march|april|may|june|july|august|september|october|november|december|jan|feb|mar|apr|jun|jul|aug|sep|sept|oct|nov|dec"
    patterns = (r"\b(\d{1,2}[/-]\d{1,2}[/-]\d{2,4})\b", rf"(?i)\b(\d{{1,2}}\s+(?:{months})\s+\d{{4}})\b", r"\b(20\d{2})\b")
    found = F.concat(*(F.regexp_extract_all(F.coalesce(col(x), F.lit("")), F.lit(p), F.lit(1)) for p in patterns))
    unique = F.filter(found, lambda d, k: F.array_position(F.transform(found, lambda y: F.lower(y)), F.lower(d)) == k + 1)
    return F.slice(unique, 1, most)


def signals(x: Column | str, words_of: dict[str, list[str]]) -> Column:
    """Sorted names of the lists of which any word is in the (lower case) text."""
    found = lambda x: F.array(*(F.when(contains_any(x, ws), k) for k, ws in words_of.items()))
    return F.array_sort(F.array_compact(once(F.coalesce(col(x), F.lit("")), found)))


def contains_any(x: Column, parts: list[str]) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | F.contains(x, F.lit(p))
    return out


def core(pattern: str) -> str:
    """A lower case text that all a pattern matches holds, whatever the case; empty where none is told."""
    if not pattern.isascii() or re.search(r"[{}]|\(\?[^:]|\\[pPQEkxu0-9]", pattern):
        return ""
    parts = re.sub(r"\(\?:[^()]*\)[?*+]?|\[[^\]]*\][?*+]?|\\?.[?*]|\\[A-Za-z]|(?<!\\)[\^$.+]", "\0", pattern)
    return "" if re.search(r"(?<!\\)[|()\[\]]", parts) else max((re.sub(r"\\(.)", r"\1", x) for x in parts.split("\0")), key=len).lower()


def found_any(x: Column, low: Column, patterns: list[str]) -> Column:
    """Whether any pattern is found, whatever the case. `low` is x in lower case: a pattern is only looked for in texts that hold its core, as looking for a fixed text is far quicker."""
    out = F.lit(False)
    for p in patterns:
        out = out | (F.contains(low, F.lit(core(p))) & x.rlike(f"(?i)(?:{p})"))
    return out


def pattern_signals(x: Column | str, patterns: dict[str, list[str]]) -> Column:
    """Names, in their order, of the lists of which any pattern is found, whatever the case."""
    found = lambda x, low: F.array_compact(F.array(*(F.when(found_any(x, low, ps), k) for k, ps in patterns.items())))
    return once(F.coalesce(col(x), F.lit("")), lambda x: once(F.lower(x), lambda low: found(x, low)))


def matched(x: Column | str, parts: list[str]) -> Column:
    """Those of the words that the (lower case) text holds."""
    x = F.coalesce(col(x), F.lit(""))
    return F.filter(F.array(*map(F.lit, parts)), lambda p: F.contains(x, p))


def snippet(x: Column | str, parts: list[str], before: int = 1000, after: int = 3000) -> Column:
    """The text around the words found, from `before` the first to `after` the last; empty without any."""
    x = F.coalesce(col(x), F.lit(""))
    places = F.filter(F.array(*(F.locate(p, F.lower(x)) for p in parts)), lambda k: k > 0)
    start = F.greatest(F.array_min(places) - before, F.lit(1))
    return F.when(F.size(places) > 0, F.substr(x, start, F.array_max(places) + after - start)).otherwise("")
