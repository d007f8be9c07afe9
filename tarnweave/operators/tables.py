"""Questions about a table of closing marks: entities, filters, comparisons."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnweave.functions import html
from tarnweave.functions import vocabulary as V
from tarnweave.functions.text import BEGIN, END, collapse, compact, contains_any, folded, program_key, safe_float
from tarnweave.operators import dedup


def category(q: Column | str) -> Column:
    """A category code in a question: longer codes in any case, single letters in capitals only; null without one."""
    q = collapse(q)
    long = F.regexp_extract(q, r"(?i)\b(AP1-M|AP2-M|A1-M|A2-M|AP1|AP2|A1|A2|NM|M)\b", 1)
    return F.coalesce(F.nullif(F.upper(long), F.lit("")), F.nullif(F.regexp_extract(q, r"\b([LNOPRST])\b", 1), F.lit("")))


def aggregate(q: Column | str) -> Column:
    """A student's aggregate in a question: two digits and decimals after or before telling words, else the first such number."""
    q = collapse(q)
    patterns = (
        r"(?i)(?:aggregate|merit)\s*(?:is|of|=|:)?\s*(\d{2}(?:\.\d+)?)", r"(?i)(\d{2}(?:\.\d+)?)\s*(?:aggregate|merit)",
        r"(?i)(?:got|have|scored|score|aggregate\s+is)\s*(?:=|:)?\s*(\d{2}(?:\.\d+)?)", r"(?i)(?:with)\s*(\d{2}(?:\.\d+)?)", rf"{BEGIN}(\d{{2}}(?:\.\d+)?){END}",
    )
    return F.coalesce(*(F.regexp_extract(q, p, 1).try_cast("double") for p in patterns))


def typed_aggregate(q: Column | str) -> Column:
    """Of the numbers up to 100, the first with decimals or of 50 and more."""
    numbers = F.regexp_extract_all(F.coalesce(F.col(q) if isinstance(q, str) else q, F.lit("")), F.lit(rf"{BEGIN}(\d{{1,3}}(?:\.\d+)?){END}"), F.lit(1))
    good = F.filter(numbers, lambda n: (n.cast("double") <= 100) & (F.contains(n, F.lit(".")) | (n.cast("double") >= 50)))
    return F.get(good, F.lit(0)).cast("double")


def _aliases(text: Column, table: dict[str, str], whole: int) -> Column:
    """The meaning of the longest alias in the text; aliases of up to `whole` characters as whole words only.

    One expression looks ahead at each place for the longest alias that begins there, so a long text is gone through once and generated code stays small.
    """
    order = sorted(table, key=len, reverse=True)
    found = F.regexp_extract_all(text, F.lit("(?=(" + "|".join(rf"\b\Q{a}\E\b" if len(a) <= whole else rf"\Q{a}\E" for a in order) + "))"), F.lit(1))
    # In a lambda over the aliases, what was found would be computed for each of them.
    longest = F.get(F.array_intersect(F.array(*(F.lit(a) for a in order)), found), F.lit(0))
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), longest)


def campus(q: Column | str) -> Column:
    return _aliases(folded(q), V.QUESTION_CAMPUS_ALIASES, 0)


def program(q: Column | str) -> Column:
    return _aliases(folded(q), V.QUESTION_PROGRAM_ALIASES, 3)


def typed_campus(q: Column | str) -> Column:
    return _aliases(folded(q), V.TABLE_CAMPUS_ALIASES, 99)


def typed_program(q: Column | str) -> Column:
    return _aliases(folded(q), V.TABLE_PROGRAM_ALIASES, 99)


def asks_merit(q: Column | str) -> Column:
    """Whether a question is about closing marks: a telling phrase, or a two-digit number with a campus or a program (as parts of words too)."""
    q = folded(q)
    named = contains_any(q, [*V.QUESTION_CAMPUS_ALIASES, *V.QUESTION_PROGRAM_ALIASES])
    return contains_any(q, V.MERIT_KEYWORDS) | (q.rlike(rf"{BEGIN}\d{{2}}(\.\d+)?{END}") & named)


def route(q: Column | str) -> Column:
    return F.when(collapse(q) == "", "none").when(asks_merit(q), "table").otherwise("search")


def canonical_campus(x: Column | str) -> Column:
    """The campus that a cell means: alias, alias without punctuation, name without punctuation; null if none."""
    table = V.TABLE_CAMPUS_ALIASES
    plain = {"".join(c for c in a if c.isalnum()): v for a, v in table.items()} | {"".join(c for c in v.lower() if c.isalnum()): v for v in table.values()}
    maps = [F.create_map(*(F.lit(y) for kv in t.items() for y in kv)) for t in (table, plain)]
    return F.coalesce(F.try_element_at(maps[0], folded(x)), F.try_element_at(maps[1], compact(x)))


def canonical_category(x: Column | str) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(y) for kv in V.TABLE_CATEGORY_ALIASES.items() for y in kv)), folded(x))


def list_number(title: Column | str) -> Column:
    """The number of a list in its title, in digits or as a word; null without one."""
    t = collapse(title)
    digits = (r"(?i)(\d+)\s*(?:st|nd|rd|th)?\s+merit\s*list", r"(?i)merit\s*list\s*(?:no\.?|number)?\s*[:\-]?\s*(\d+)")
    word = F.lower(F.regexp_extract(t, r"(?i)\b(" + "|".join(V.ORDINAL_WORDS) + r")\s+merit\s*list", 1))
    table = F.create_map(*(F.lit(x) for kv in V.ORDINAL_WORDS.items() for x in kv))
    return F.coalesce(*(F.regexp_extract(t, p, 1).try_cast("int") for p in digits), F.try_element_at(table, word))


def latest(lists: DataFrame, title: str, number: str, order: str) -> DataFrame:
    """The newest list: largest year in its title, then number, then the first."""
    year = F.coalesce(F.array_max(F.regexp_extract_all(F.col(title), F.lit(r"(20\d{2})"), F.lit(1))).cast("int"), F.lit(0))
    return lists.agg(F.max_by(F.struct(*lists.columns), F.struct(year, F.coalesce(number, F.lit(0)), -F.col(order))).alias("row")).select("row.*")


def discovered_lists(pages: DataFrame, source: str, base: str) -> DataFrame:
    """Documents under headings (h3 to h5) about merit lists, postgraduate ones left out: url, title, heading, list_number. An address found again counts where it is found last."""
    parts = pages.select(F.col(base).alias("base"), F.posexplode(F.split(html.without_boilerplate(source), r"(?i)(?=<h[1-6]\b)")).alias("part", "section"))
    head = collapse(html.tagless(F.regexp_extract("section", r"(?is)^<h[3-5]\b[^>]*>(.*?)</h[3-5]\s*>", 1)))
    low = F.lower(F.col("heading"))
    about = F.contains(low, F.lit("merit list")) | (F.contains(low, F.lit("minimum")) & (F.contains(low, F.lit("merit")) | F.contains(low, F.lit("aggregate"))))
    chosen = parts.withColumn("heading", head).where(about & ~contains_any(low, V.POSTGRADUATE_WORDS))
    links = chosen.select("base", "part", "heading", F.posexplode(html.page_links("section", "base")).alias("at", "l"))
    rows = links.select(F.col("l.url").alias("url"), F.col("l.name").alias("title"), "heading", "part", "at")
    last = rows.groupBy("url").agg(F.max_by(F.struct("title", "heading"), F.struct("part", "at")).alias("r")).select("url", "r.*")
    return last.withColumn("list_number", list_number(F.concat_ws(" ", "title", "heading")))


def unique_records(rows: DataFrame, order: str, name: str = "place") -> DataFrame:
    """The first record of each campus, program, category, session and admission type, whatever their case; with its place among them in that order."""
    keys = {f"key {k}": F.upper(k) if k == "category" else F.lower(k) for k in ("campus", "program", "category", "session", "admission_type")}
    kept, _ = dedup.first_wins(rows.withColumns(keys), list(keys), [order])
    return dedup.placed(kept, ["key campus", "key program", "category", "key session", "key admission_type"], name).drop(*keys)


def contains_either(a: Column, b: Column) -> Column:
    """Equal, or one within the other; nothing matches an empty one."""
    return (a != "") & (b != "") & (F.contains(a, b) | F.contains(b, a))


def asked(records: DataFrame, questions: DataFrame, broadcast_rows: int = 100_000) -> DataFrame:
    """Records that fit each question's program, campus and category (null: any).

    Names fit by containment, which is no equality to join by: so the distinct names that are asked for meet the distinct names of the records, of which
    there are few, and records and questions are joined by equality to what fits. A category that is asked for is an equality from the start.
    """
    own = [program_key("program").alias("key of program"), folded("campus").alias("key of campus"), folded("category").alias("key of category")]
    want = ["q_program", "q_campus", "q_category"]
    keyed = records.select(F.struct(*records.columns).alias("record"), *own)
    names = ["key of program", "key of campus", "key of category"]
    sets = keyed.select(*names).distinct()
    sets = F.broadcast(sets) if sets.count() <= broadcast_rows else sets
    wants = questions.select(*want).distinct()
    fits = (F.col("q_program").isNull() | contains_either(F.col("key of program"), program_key("q_program"))) & (F.col("q_campus").isNull() | contains_either(F.col("key of campus"), folded("q_campus")))
    given = wants.where("q_category is not null").join(sets, (folded("q_category") == F.col("key of category")) & fits)
    pairs = given.unionByName(wants.where("q_category is null").join(sets, fits))
    pairs = pairs.select(*(F.col(w).alias(f"asked {w}") for w in want), *(F.col(k).alias(f"fitting {k}") for k in names))
    of = questions.join(pairs, reduce(and_, (F.col(w).eqNullSafe(F.col(f"asked {w}")) for w in want)))
    return of.join(keyed, reduce(and_, (F.col(k) == F.col(f"fitting {k}") for k in names))).select(*questions.columns, "record.*")


def compared(rows: DataFrame, own: str = "q_aggregate", minimum: str = "closing_merit") -> DataFrame:
    """With difference (5 decimals), selected, and ABOVE or BELOW."""
    d = F.round(F.col(own) - F.col(minimum), 5)
    return rows.withColumn("difference", d).withColumn("selected", F.col(own) >= F.col(minimum)).withColumn("verdict", F.when(d >= 0, "ABOVE").otherwise("BELOW"))


def side(q: Column | str) -> Column:
    """The side of a limit that a question speaks of: < wherever it says below, > for "over 60"; null without either."""
    q = folded(q)
    return F.when(q.rlike(rf"{BEGIN}(?:below|under|less than){END}"), "<").when(q.rlike(rf"{BEGIN}(?:above|over|greater than)\s+\d"), ">")


def threshold(q: Column | str) -> Column:
    """Of "below 75" or "over 60": struct of side (<, >) and value; null without one."""
    q = folded(q)
    value = F.regexp_extract(q, rf"{BEGIN}(?:below|under|less than|above|over|greater than)\s+(\d{{1,3}}(?:\.\d+)?)", 1).try_cast("double")
    return F.when(value.isNotNull(), F.struct(F.when(q.rlike(rf"{BEGIN}(?:below|under|less than){END}"), "<").otherwise(">").alias("side"), value.alias("value")))


def command(q: Column | str) -> Column:
    """programs, threshold or lookup: what a typed question asks of the table."""
    t = folded(q)
    has = lambda x: F.contains(t, F.lit(x))
    return F.when(has("program") & (has("all") | has("show") | has("list")), "programs").when(threshold(q).isNotNull(), "threshold").otherwise("lookup")


def noise_cell(cell: Column | str) -> Column:
    """Whether a cell is heading or page furniture."""
    c = folded(cell)
    return (c == "") | c.isin(*V.HEADER_CELLS) | c.rlike(r"^(?:campus discipline|admission:|merit list no)") | F.contains(c, F.lit("university of engineering")) | (c.startswith("ug-") & F.contains(c, F.lit("page")))


def _record(cells: Column, i: Column) -> Column:
    at = lambda k: collapse(F.get(cells, i + k))
    sessions, kinds = (F.create_map(*(F.lit(y) for kv in t.items() for y in kv)) for t in (V.SESSIONS, V.ADMISSION_TYPES))
    session, kind, mark = F.try_element_at(sessions, F.lower(at(3))), F.try_element_at(kinds, F.lower(at(4))), safe_float(F.get(cells, i + 5))
    good = session.isNotNull() & kind.isNotNull() & at(2).rlike("(?i)^(?:A1-M|A2-M|AP1-M|AP2-M|A1|A2|AP1|AP2|NM|M|[A-Z]{1,2})$") & mark.between(0, 100) & (at(1) != "")
    return F.when(good, F.struct(F.coalesce(canonical_campus(F.get(cells, i)), at(0)).alias("campus"), at(1).alias("program"), F.upper(at(2)).alias("category"), session.alias("session"), kind.alias("admission_type"), mark.alias("closing_merit")))


def records(pages: DataFrame, page: str = "page", cells: str = "cells") -> DataFrame:
    """Rows of six cells from each page's cells in order: a valid row takes six, anything else is stepped over by one."""
    clean = pages.select(page, F.filter(cells, lambda c: ~noise_cell(c)).alias("cells"))
    n = F.greatest(F.size("cells") - 5, F.lit(0))
    rows = F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: _record(F.col("cells"), i))).otherwise(F.expr("cast(array() as array<struct<campus:string,program:string,category:string,session:string,admission_type:string,closing_merit:double>>)"))
    built = clean.select(page, rows.alias("rows"))
    state = "struct<nxt:int,out:array<int>>"
    zero = F.struct(F.lit(0).alias("nxt"), F.expr("cast(array() as array<int>)").alias("out")).cast(state)
    take = lambda a, i: F.when((i >= a["nxt"]) & F.get(F.col("rows"), i).isNotNull(), F.struct((i + 6).alias("nxt"), F.concat(a["out"], F.array(i)).alias("out")).cast(state)).otherwise(a)
    places = F.when(F.size("rows") > 0, F.aggregate(F.sequence(F.lit(0), F.size("rows") - 1), zero, take, lambda a: a["out"])).otherwise(F.expr("cast(array() as array<int>)"))
    return built.select(page, F.posexplode(F.transform(places, lambda i: F.get(F.col("rows"), i))).alias("pos", "r")).select(page, "pos", "r.*")
