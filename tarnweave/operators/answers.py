"""Typed questions that run over a table of closing marks, and answers in words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnweave.functions import vocabulary as V
from tarnweave.functions.classify import first_match
from tarnweave.functions.text import BEGIN, END, collapse, compact, contains_any, folded, safe_float
from tarnweave.operators import tables
from tarnweave.operators.durable import durable

#: Answers of up to so many bytes are broadcast to the questions.
BROADCAST_BYTES = 64 << 20

FIELDS = ("campus", "program", "category", "session", "admission_type")


def typed_category(q: Column | str) -> Column:
    return tables._aliases(folded(q), V.TABLE_CATEGORY_ALIASES, 99)


def typed_session(q: Column | str) -> Column:
    t = folded(q)
    return first_match([(t.rlike(f"{BEGIN}{s}{END}"), F.lit(V.SESSIONS[s])) for s in ("afternoon", "evening", "morning")], F.lit(None).cast("string"))


def typed_admission(q: Column | str) -> Column:
    t = folded(q)
    return F.when(t.rlike(f"{BEGIN}non[- ]?ecat{END}"), "Non-ECAT").when(t.rlike(f"{BEGIN}ecat{END}"), "ECAT")


def leftover(q: Column | str) -> Column:
    """What a question says beside its filters: perhaps a program's name."""
    filters, categories = (BEGIN + p.removeprefix(r"\b").removesuffix(r"\b") + END for p in (V.FILTER_WORDS, V.CATEGORY_WORDS))
    return collapse(F.regexp_replace(F.regexp_replace(folded(q), filters, " "), categories, " "))


def typed(questions: DataFrame, question: str = "question") -> DataFrame:
    """Questions with their filters (want_campus, want_program, want_category, want_session, want_admission_type), aggregate, threshold (side, value) and command: programs (of a named campus), threshold or lookup."""
    q = F.col(question)
    t, limit = folded(q), tables.threshold(q)
    asks = contains_any(t, ["program"]) & contains_any(t, ["all", "show", "list"])
    out = questions.select(
        "*", tables.typed_campus(q).alias("want_campus"), tables.typed_program(q).alias("want_program"), typed_category(q).alias("want_category"), typed_session(q).alias("want_session"),
        typed_admission(q).alias("want_admission_type"), tables.typed_aggregate(q).alias("aggregate"), limit["side"].alias("side"), limit["value"].alias("value"), leftover(q).alias("leftover"),
    )
    return out.withColumn("command", F.when(asks & F.col("want_campus").isNotNull(), "programs").when(F.col("value").isNotNull(), "threshold").otherwise("lookup"))


def named_program(questions: DataFrame, records: DataFrame) -> DataFrame:
    """Look-ups without a program take the one program that the rest of the question names: an alias or the name itself, else a name that contains it; none if there are several. Only distinct rests meet distinct names."""
    rests = questions.where("command = 'lookup' and want_program is null and leftover <> ''").select("leftover").distinct()
    known = F.create_map(*(F.lit(x) for kv in V.TABLE_PROGRAM_ALIASES.items() for x in kv))
    asked = rests.withColumn("asked", F.lower(F.coalesce(F.try_element_at(known, F.col("leftover")), F.col("leftover"))))
    names = records.select(F.col("program").alias("name")).distinct()
    whole = F.lower("name") == F.col("asked")
    part = F.contains(folded("name"), F.col("asked")) | F.contains(compact("name"), compact("asked"))
    met = asked.join(F.broadcast(names) if names.count() <= 100_000 else names, whole | part)
    found = met.groupBy("leftover").agg(F.collect_set(F.when(whole, F.col("name"))).alias("whole"), F.collect_set("name").alias("part"))
    chosen = F.when(F.size("whole") > 0, F.col("whole")).otherwise(F.col("part"))
    one = found.where(F.size(chosen) == 1).select(F.col("leftover").alias("rest"), chosen[0].alias("one_program"))
    free = (F.col("command") == "lookup") & F.col("want_program").isNull() & (F.col("leftover") == F.col("rest"))
    return questions.join(one, free, "left").withColumn("want_program", F.coalesce("want_program", "one_program")).drop("rest", "one_program")


def fitting(questions: DataFrame, records: DataFrame) -> DataFrame:
    """Each question with the records that its filters let through. A program fits if the record's name contains it, which distinct names decide; what follows are joins by the program, else by the campus."""
    names = records.select(F.col("program").alias("name")).distinct()
    wants = questions.where("want_program is not null").select("want_program").distinct()
    fits = (F.lower("name") == F.lower("want_program")) | F.contains(folded("name"), folded("want_program")) | F.contains(compact("name"), compact("want_program"))
    pairs = wants.join(F.broadcast(names) if names.count() <= 100_000 else names, fits).select(F.col("want_program").alias("asked program"), "name")
    rows = records.select(F.struct(*records.columns).alias("record"))
    given = lambda w, f: F.col(w).isNull() | (F.col(w) == F.col(f"record.{f}"))
    others = given("want_category", "category") & given("want_session", "session") & given("want_admission_type", "admission_type")
    by_program = questions.join(pairs, F.col("want_program") == F.col("asked program")).drop("asked program").join(rows, (F.col("name") == F.col("record.program")) & given("want_campus", "campus") & others).drop("name")
    by_campus = questions.where("want_program is null and want_campus is not null").join(rows, (F.col("want_campus") == F.col("record.campus")) & others)
    neither = questions.where("want_program is null and want_campus is null").join(rows, others)
    return by_program.unionByName(by_campus).unionByName(neither)


def run_questions(records: DataFrame, questions: DataFrame, key: str = "qid", question: str = "question") -> DataFrame:
    """What each typed question yields: key, command (programs, threshold, check, lookup), the record's fields and closing_merit (of programs: campus and program alone), and for check the aggregate, difference and verdict."""
    # What a question says is read once, as several joins need it.
    asked = durable(named_program(durable(typed(questions, question)), records))
    rows = fitting(asked.where("command <> 'programs'"), records)
    mark = F.col("record.closing_merit")
    rows = rows.where((F.col("command") != "threshold") | F.when(F.col("side") == "<", mark < F.col("value")).otherwise(mark > F.col("value")))
    checks = (F.col("command") == "lookup") & F.col("aggregate").isNotNull()
    listed = rows.select(
        key, F.when(checks, "check").otherwise(F.col("command")).alias("command"), *(F.col(f"record.{f}").alias(f) for f in FIELDS), mark.cast("double").alias("closing_merit"),
        F.when(checks, F.col("aggregate")).alias("aggregate"), F.when(checks, F.round(F.col("aggregate") - mark, 5)).cast("double").alias("difference"), F.when(checks, F.when(F.col("aggregate") >= mark, "ABOVE").otherwise("BELOW")).alias("verdict"),
    )
    programs = asked.where("command = 'programs'").join(records.select("campus", "program").distinct(), F.col("want_campus") == F.col("campus")).select(key, "command", "campus", "program")
    return listed.unionByName(programs, allowMissingColumns=True)


def _some(label: str, x: Column) -> Column:
    return F.when(F.coalesce(x, F.lit("")) != "", F.concat(F.lit(label), x))


def lookup_line(r: Column, minimum: Column) -> Column:
    """A record in one line."""
    head = F.format_string("**%s — %s**", F.coalesce(r["program"], F.lit("Unknown program")), F.coalesce(r["campus"], F.lit("Unknown campus")))
    return F.concat_ws("", head, _some(" | ", r["category"]), _some(" | ", r["session"]), _some(" | ", r["admission_type"]), F.when(minimum.isNotNull(), F.format_string(" → **%.5f**", minimum)))


def check_lines(r: Column, minimum: Column, own: Column) -> Column:
    """A record and how an aggregate compares, as a paragraph."""
    head = F.format_string("\n**%s — %s**", F.coalesce(r["program"], F.lit("Unknown program")), F.coalesce(r["campus"], F.lit("Unknown campus")))
    verdict = F.when(own >= minimum, "✅ **SELECTED / ABOVE CURRENT MERIT**").otherwise("❌ **BELOW CURRENT MERIT**")
    return F.concat_ws(
        "\n", head, _some("- Category: ", r["category"]), _some("- Session: ", r["session"]), _some("- Type: ", r["admission_type"]), F.format_string("- Current closing merit: **%.5f**", minimum),
        F.format_string("- Difference: **%+.5f**", F.round(own - minimum, 5)), F.concat(F.lit("- Status: "), verdict),
    )


def merit_answers(records: DataFrame | None, questions: DataFrame, order: str, key: str = "qid", source_url: str | None = None, site: str = "the") -> DataFrame:
    """Each question's answer: key, kind (merit_unavailable, merit_empty, merit_not_found, merit_invalid_records, merit_check, merit), n_records and answer. Questions have q_program, q_campus, q_category and q_aggregate; no records at all means that the list can't be had. An answer's records are put together in their order."""
    said = {k: F.lit(v.format(site=site)) for k, v in V.MERIT_MESSAGES.items()}
    if records is None:
        return questions.select(key, F.lit("merit_unavailable").alias("kind"), F.lit(0).cast("long").alias("n_records"), said["merit_unavailable"].alias("answer"))
    r, minimum, own = F.struct(*(F.col(f) for f in FIELDS)), safe_float(F.col("closing_merit").cast("string")), F.col("q_aggregate")
    # Questions that ask the same have the same answer, which is put together once for all of them. Questions of one key are answered together, as in SQL: records of each aggregate by themselves.
    records = durable(records)
    own_asks = questions.select(key, F.struct("q_program", "q_campus", "q_category", "q_aggregate").alias("ask"))
    alike = durable(own_asks.where(F.col(key).isNotNull()).groupBy(key).agg(F.array_sort(F.collect_list("ask")).alias("asks")))
    rows = tables.asked(records, alike.select("asks").distinct().select("asks", F.explode("asks").alias("ask")).select("asks", "ask.*")).withColumn("minimum", minimum)
    line = F.when(own.isNull(), lookup_line(r, F.col("minimum"))).when(F.col("minimum").isNotNull(), check_lines(r, F.col("minimum"), own))
    found = rows.withColumn("line", line).groupBy("asks", "q_aggregate").agg(F.count("*").alias("n_found"), F.count("line").alias("n_records"), F.array_sort(F.collect_list(F.when(F.col("line").isNotNull(), F.struct(order, "line")))).alias("lines"))
    link = F.lit(None).cast("string") if source_url is None else F.lit(f"\n[🔗 Open official {site} merit source]({source_url})")
    empty = F.lit(records.isEmpty())
    text = F.array_join(F.transform("lines", lambda x: x["line"]), "\n")
    whole = F.concat_ws("\n", F.when(own.isNotNull(), F.format_string("Your aggregate: **%.5f**", own)), text, link)
    found = durable(found.select(F.col("asks").alias("answered"), "n_found", "n_records", whole.alias("whole")))
    size = found.agg(F.coalesce(F.sum(F.octet_length("whole") + 32 * F.size("answered")), F.lit(0))).first()[0]
    each = alike.select(key, "asks", F.explode("asks").alias("ask")).unionByName(own_asks.where(F.col(key).isNull()).withColumn("asks", F.lit(None).cast(alike.schema["asks"].dataType)))
    out = each.join(F.broadcast(found) if size <= BROADCAST_BYTES else found, F.col("asks") == F.col("answered"), "left")
    out = out.withColumn("kind", F.when(empty, "merit_empty").when(F.coalesce("n_found", F.lit(0)) == 0, "merit_not_found").when(F.col("n_records") == 0, "merit_invalid_records").when(F.col("ask.q_aggregate").isNotNull(), "merit_check").otherwise("merit"))
    answer = F.when(F.col("kind").isin("merit", "merit_check"), F.col("whole"))
    for k in ("merit_empty", "merit_not_found", "merit_invalid_records"):
        answer = answer.when(F.col("kind") == k, said[k])
    return out.select(key, "kind", F.coalesce("n_records", F.lit(0)).cast("long").alias("n_records"), answer.alias("answer"))
