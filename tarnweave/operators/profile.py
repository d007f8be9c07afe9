"""Counts and profiles."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnweave.operators.durable import durable


def counts(df: DataFrame, *keys: str, name: str = "n_rows") -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias(name))


def most_common(df: DataFrame, key: str, n: int, name: str = "n_rows") -> DataFrame:
    """The n most frequent values; ties by value."""
    return counts(df, key, name=name).orderBy(F.desc(name), key).limit(n)


def text_lengths(df: DataFrame, text: str, *keys: str) -> DataFrame:
    n = F.length(text)
    return df.groupBy(*keys).agg(F.count("*").alias("n_rows"), F.round(F.avg(n), 2).alias("avg_chars"), F.min(n).cast("long").alias("min_chars"), F.max(n).cast("long").alias("max_chars"))


def field_profile(df: DataFrame) -> DataFrame:
    """For each column: rows, present, null and empty values, and its type. One pass: every column is counted in the same aggregate, and the one row is turned into one per column."""
    kinds = dict(df.dtypes)
    text = lambda c: F.col(c).cast("string")
    aggs = [F.struct(F.lit(c).alias("field"), F.lit(kinds[c]).alias("type"), F.count("*").alias("n_rows"), F.count(c).alias("n_present"), F.count_if(F.col(c).isNull()).alias("n_null"), F.count_if(F.trim(text(c)) == "").alias("n_empty")).alias(f"f{k}") for k, c in enumerate(df.columns)]
    return df.agg(*aggs).select(F.explode(F.array(*(f"f{k}" for k in range(len(df.columns))))).alias("f")).select("f.*")


def missing_fields(df: DataFrame, fields: list[str], variant: str = "null") -> DataFrame:
    """Rows with `missing`, the fields without a value: null, or (variant blank) null, empty or an empty list."""
    kinds = dict(df.dtypes)

    def lacks(f: str) -> Column:
        if f not in kinds:
            return F.lit(True)
        bad = F.col(f).isNull()
        if variant == "blank":
            bad = bad | (F.size(f) == 0 if kinds[f].startswith("array") else F.col(f).cast("string") == "")
        return bad

    return df.withColumn("missing", F.array_compact(F.array(*(F.when(lacks(f), f) for f in fields))))


def checks(df: DataFrame, **conditions: Column) -> DataFrame:
    """Each named condition over all rows (as an aggregate), and the status of all."""
    one = df.agg(*(F.coalesce(c, F.lit(True)).alias(k) for k, c in conditions.items()))
    status = F.when(F.forall(F.array(*conditions), lambda x: x), "PASS").otherwise("FAIL")
    return one.withColumn("status", status).select(F.explode(F.array(*(F.struct(F.lit(k).alias("check"), F.col(k).alias("passed"), F.col("status").alias("status")) for k in conditions))).alias("c")).select("c.*")


def graded_checks(df: DataFrame, critical: dict[str, Column], review: dict[str, Column]) -> DataFrame:
    """Each named condition over all rows, and the status of all: NEEDS_REPAIR if a critical one fails, NEEDS_REVIEW if another does, else PASS_WITH_HEURISTIC_REVIEW, as what is checked are signs and no proof."""
    names = [*critical, *review]
    one = df.agg(*(F.coalesce(c, F.lit(True)).alias(k) for k, c in (critical | review).items()))
    holds = lambda of: F.forall(F.array(*of), lambda x: x) if of else F.lit(True)
    status = F.when(~holds(critical), "NEEDS_REPAIR").when(~holds(review), "NEEDS_REVIEW").otherwise("PASS_WITH_HEURISTIC_REVIEW")
    rows = F.array(*(F.struct(F.lit(k).alias("check"), F.lit("critical" if k in critical else "review").alias("level"), F.col(k).alias("passed"), F.col("status").alias("status")) for k in names))
    return one.withColumn("status", status).select(F.explode(rows).alias("c")).select("c.*")


def json_structure(df: DataFrame, variant: str, levels: int = 8) -> DataFrame:
    """Paths of a variant column at any depth, with the kinds of value there and how often: path, kind, n_values. Elements of a list share a path."""
    level, out = df.select(F.lit("$").alias("path"), F.col(variant).alias("v")), None
    while True:
        for _ in range(levels):
            told = F.regexp_extract(F.schema_of_variant("v"), "^[A-Z]+", 0)
            kind = F.when(F.col("v").isNull() | F.is_variant_null("v"), "null").when(told == "OBJECT", "object").when(told == "ARRAY", "array").when(told == "STRING", "string").when(told == "BOOLEAN", "boolean").otherwise("number")
            part = level.select("path", kind.alias("kind"))
            out = part if out is None else out.unionByName(part)
            items = F.transform(F.try_variant_get("v", "$", "array<variant>"), lambda x: F.struct(F.lit("[]").alias("step"), x.alias("v")))
            fields = F.transform(F.map_entries(F.try_variant_get("v", "$", "map<string,variant>")), lambda e: F.struct(F.concat(F.lit("."), e["key"]).alias("step"), e["value"].alias("v")))
            level = level.select("path", F.explode(F.coalesce(items, fields)).alias("k")).select(F.concat("path", "k.step").alias("path"), "k.v")
        level = durable(level)
        if level.isEmpty():
            return out.groupBy("path", "kind").agg(F.count("*").alias("n_values"))


def upper_median(values: Column) -> Column:
    """The middle of sorted values; of an even number, the upper one."""
    return F.element_at(F.array_sort(values), (F.floor(F.size(values) / 2) + 1).cast("int"))


def ordered_text(df: DataFrame, keys: list[str], order: str, text: str, separator: str) -> DataFrame:
    """Texts of each key in order, joined. Meant for keys whose rows are bounded (the results of one question)."""
    return df.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda x: x[text]), separator).alias(text))


def rows_at(df: DataFrame, keys: list[str], order: list[str], places: dict[str, Column], name: str = "which") -> DataFrame:
    """Of each key the rows at certain places in the given order: `places` are names and places (from 0) as expressions of column n, the key's number of rows; null, or outside of them, gives none.

    Rows are ranged over partitions by key and order. A key's rows are counted in each partition, which says in which one a place lies; only there
    rows are numbered, so no task sees more of a key than its partition holds. Ties are broken by all other columns.
    """
    spread = durable(df.repartitionByRange(max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), *keys, *order, *(c for c in df.columns if c not in (*keys, *order))).withColumn("part", F.spark_partition_id()))
    sizes = spread.groupBy("part", *keys).agg(F.count("*").alias("size"))
    parts = Window.partitionBy(*keys)
    ahead = parts.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("n", F.sum("size").over(parts)).withColumn("before", F.coalesce(F.sum("size").over(ahead), F.lit(0)))
    wanted = sizes.select("part", *keys, "before", "size", F.explode(F.array(*(F.struct(F.lit(k).alias("which"), p.cast("long").alias("at")) for k, p in places.items()))).alias("w"))
    wanted = wanted.where("w.at >= before and w.at < before + size").select(F.col("part").alias("of part"), *(F.col(k).alias(f"of {k}") for k in keys), F.col("w.which").alias(name), (F.col("w.at") - F.col("before")).alias("at in part"))
    here = reduce(and_, (F.col(k).eqNullSafe(F.col(f"of {k}")) for k in keys), F.col("part") == F.col("of part"))
    held = spread.join(wanted.select("of part", *(f"of {k}" for k in keys)).distinct(), here, "left_semi")
    nth = F.row_number().over(Window.partitionBy("part", *keys).orderBy(*order, *(c for c in df.columns if c not in (*keys, *order)))) - 1
    return held.withColumn("nth", nth).join(wanted, here & (F.col("nth") == F.col("at in part"))).select(*df.columns, name)


def checksums(df: DataFrame, *keys: str | Column) -> DataFrame:
    """Per key: how many rows, and two sums over all columns in the order of their names, which don't depend on the rows' order; a doubled row changes the count and one of the sums."""
    names = sorted(df.columns)
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64(*names)).alias("mixed"), F.sum(F.pmod(F.xxhash64(*reversed(names)), F.lit(1 << 31))).alias("total"))


def stored_differences(stored: DataFrame, wanted: DataFrame, key: str, n_ranges: int = 4096) -> DataFrame:
    """Keys whose rows differ between two tables of equal columns: key, n_stored, n_wanted (0 without rows), state (missing, surplus, doubled, changed).

    Checksums of ranges of keys' hashes are compared first, at most `n_ranges` rows of either side; only rows of ranges that differ are summed by key. So tables that are equal
    cost two scans and no shuffle of rows, and a few differences cost little more. A null key is a key.
    """
    part = F.pmod(F.xxhash64(key), F.lit(n_ranges)).alias("range of keys")
    same = lambda a, b: reduce(and_, (F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in ("n", "mixed", "total")))

    def compared(x: DataFrame, y: DataFrame, on: str) -> DataFrame:
        return x.alias("x").join(y.alias("y"), F.col(f"x.{on}").eqNullSafe(F.col(f"y.{on}")), "full").where(~same("x", "y"))

    ranges = compared(checksums(stored, part), checksums(wanted, part), "range of keys")
    differ = durable(ranges.select(F.coalesce("x.range of keys", "y.range of keys").alias("differs")))
    inside = lambda df: df.join(F.broadcast(differ), F.pmod(F.xxhash64(key), F.lit(n_ranges)) == F.col("differs"), "left_semi")  # noqa: E731  at most n_ranges numbers
    held, asked = (F.coalesce(F.col(f"{t}.n"), F.lit(0)) for t in ("x", "y"))
    state = F.when(held == 0, "missing").when(asked == 0, "surplus").when(held > asked, "doubled").otherwise("changed")
    found = compared(checksums(inside(stored), key), checksums(inside(wanted), key), key)
    return found.select(F.when(F.col("x.n").isNotNull(), F.col(f"x.{key}")).otherwise(F.col(f"y.{key}")).alias(key), held.alias("n_stored"), asked.alias("n_wanted"), state.alias("state"))
