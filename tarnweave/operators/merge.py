"""Merging, repairing and comparing sets of rows by keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def lookup(left: DataFrame, right: DataFrame, key: str, keys: list[str], order: str, prefix: str = "found_") -> DataFrame:
    """Left rows with the first right row (by order) of which any of `keys` equals the left key; columns of the right carry a prefix, null where nothing is found."""
    entries = right.select(F.explode(F.array_distinct(F.array_compact(F.array(*(F.nullif(F.col(k), F.lit("")) for k in keys))))).alias("entry"), F.struct(*right.columns).alias("row"))
    index = entries.groupBy("entry").agg(F.min_by("row", F.col(f"row.{order}")).alias("row"))
    return left.join(index, left[key] == index["entry"], "left").select(*(left[c] for c in left.columns), *(F.col(f"row.{c}").alias(prefix + c) for c in right.columns))


def replace_by_key(existing: DataFrame, recovered: DataFrame, keys: list[str]) -> DataFrame:
    """Recovered rows take the place of all existing rows with their keys; `origin` says where a row is from."""
    kept = existing.join(recovered.select(*keys).distinct(), keys, "left_anti")
    return kept.withColumn("origin", F.lit("existing")).unionByName(recovered.withColumn("origin", F.lit("recovered")), allowMissingColumns=True)


def override(rows: DataFrame, overrides: DataFrame, keys: list[str], texts: str, text: str, index: str) -> DataFrame:
    """Rows of overridden keys make way for the override's texts, numbered from 0, where the key existed."""
    kept = rows.join(overrides.select(*keys), keys, "left_anti").select(*keys, index, text)
    present = overrides.join(rows.select(*keys).distinct(), keys, "left_semi")
    return kept.unionByName(present.select(*keys, F.posexplode(texts).alias(index, text)))


def decided(rows: DataFrame, decisions: DataFrame, key: str) -> DataFrame:
    """Rows with their decision; `unknown` marks those without one."""
    out = rows.join(decisions, key, "left")
    return out.withColumn("unknown", F.col("decision").isNull())


def excluded(rows: DataFrame, keys: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Rows whose key isn't listed, and those whose is."""
    return rows.join(keys, key, "left_anti"), rows.join(keys, key, "left_semi")


def backfill(rows: DataFrame, candidates: DataFrame, id_col: str, keys: list[str], fields: list[str], complete: Column, order: str) -> DataFrame:
    """Rows with `fields` from candidates that share a key, keys in order of priority: the first complete one, else the first. An OR of keys as one equi-join per key.

    Of a key's candidates only the best can be taken, so they become one before the join: what is joined, sorted and shuffled after it is a row for each row and key, however many candidates share a key.
    """
    rank = F.struct(F.when(complete, 0).when(~complete, 1).otherwise(2).alias("incomplete"), F.col(order).alias("place"))
    parts = []
    for p, k in enumerate(keys):
        known = candidates.where(f"{k} <> ''").groupBy(k).agg(F.min_by(F.struct(*fields), rank).alias("fields"), F.min(rank).alias("rank"))
        parts.append(rows.select(id_col, k).where(f"{k} <> ''").join(known, k).select(id_col, F.lit(p).alias("priority"), "rank", "fields"))
    all_of = parts[0]
    for p in parts[1:]:
        all_of = all_of.unionByName(p)
    best = all_of.groupBy(id_col).agg(F.min_by(F.struct("fields", "priority"), F.struct("rank.incomplete", "priority", "rank.place")).alias("best"))
    own = [c for c in rows.columns if c not in fields]
    return rows.join(best, id_col, "left").select(*own, *(F.coalesce(F.nullif(F.col(f).cast("string"), F.lit("")), F.col(f"best.fields.{f}").cast("string")).alias(f) if f in rows.columns else F.col(f"best.fields.{f}").alias(f) for f in fields), F.col("best.priority").alias("priority"))


def fill_missing(rows: DataFrame, key: str, fields: list[str], score: Column, order: str) -> DataFrame:
    """One row for each key: every field from the best row (score, then order) that has it. Rows of a key are combined before the shuffle, so a key may hold any share of them."""
    place = F.struct(-score, order)
    return rows.groupBy(key).agg(*(F.min_by(f, F.when(F.col(f) != "", place)).alias(f) for f in fields))


def metadata_score(url: Column, title: Column, sha: Column, urls: Column, file: Column) -> Column:
    """How much of a chunk's metadata there is: a valid digest and a file count double."""
    some = lambda x: F.coalesce(x, F.lit("")) != ""
    digest = F.when(F.coalesce(sha, F.lit("")).rlike("^[0-9a-fA-F]{64}$"), 2).when(some(sha), 1).otherwise(0)
    return some(url).cast("int") + some(title).cast("int") + digest + (F.coalesce(F.size(urls), F.lit(0)) > 0).cast("int") + 2 * some(file).cast("int")


def reconcile(before: DataFrame, after: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Keys with their state: missing, extra, changed or same."""
    a = before.select(*keys, F.col(value).alias("v_before"), F.lit(1).alias("in_before"))
    b = after.select(*keys, F.col(value).alias("v_after"), F.lit(1).alias("in_after"))
    state = F.when(F.col("in_after").isNull(), "missing").when(F.col("in_before").isNull(), "extra").when(F.col("v_before").eqNullSafe(F.col("v_after")), "same").otherwise("changed")
    return a.join(b, keys, "full").select(*keys, state.alias("state"))


def novel(new: DataFrame, known: DataFrame, key: str) -> DataFrame:
    return new.join(known.select(key).distinct(), key, "left_anti")


def unified(*parts: DataFrame) -> DataFrame:
    """All rows; columns that a part lacks are null."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out
