"""Exact deduplication. Which row wins is always said by an explicit order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnweave.functions.text import folded
from tarnweave.functions.vocabulary import GENERIC_TITLES
from tarnweave.operators.durable import durable


def first_wins(df: DataFrame, keys: list[str], order: list[str], blank_free: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows that are first of their keys by `order`; and the others, with `kept`, the winner's order columns as a struct.

    Keys are first aggregated to their least order, so copies are combined before the shuffle and no window holds a hot key's rows.
    With `blank_free`, rows whose column of that name is blank are all kept.
    """
    place = F.struct(*order)
    least = df.groupBy(*(F.col(k).alias(f"key {n}") for n, k in enumerate(keys))).agg(F.min(place).alias("kept"))
    on = [F.col(k).eqNullSafe(F.col(f"`key {n}`")) for n, k in enumerate(keys)]
    joined = df.join(least, on).select(*df.columns, "kept")
    free = F.lit(False) if blank_free is None else F.coalesce(F.col(blank_free), F.lit("")) == ""
    wins = free | (F.col("kept") == place)
    return joined.where(wins).drop("kept"), joined.where(~wins)


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, with their counts."""
    return df.groupBy(*keys).agg(F.count("*").alias("n_rows")).where("n_rows > 1")


def duplicate_total(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row: how many rows repeat a key."""
    return duplicate_keys(df, keys).agg(F.coalesce(F.sum(F.col("n_rows") - 1), F.lit(0)).alias("n_repeats"), F.count("*").alias("n_keys"))


def text_profile(df: DataFrame, text: Column, least: int = 2, preview: int = 500) -> DataFrame:
    """Texts that occur `least` times or more, with a preview. Groups are by hash; the text itself isn't shuffled."""
    rows = df.select(F.sha2(text, 256).alias("text_sha256"), F.left(text, F.lit(preview)).alias("text_preview"))
    return rows.groupBy("text_sha256").agg(F.count("*").alias("n_rows"), F.min("text_preview").alias("text_preview")).where(F.col("n_rows") >= least)


def canonical(df: DataFrame, group: str, title: str, order: str) -> DataFrame:
    """One row of each group: the first with a title that says something, else the first; and the group's size."""
    generic = folded(title).isin(*GENERIC_TITLES) | (folded(title) == "")
    best = F.min_by(F.struct(*df.columns), F.struct(generic.cast("int"), F.col(order)))
    return df.groupBy(group).agg(best.alias("best"), F.count("*").alias("group_size")).select("best.*", "group_size")


def aliases(df: DataFrame, chosen: DataFrame, group: str, order: str) -> DataFrame:
    """The rows of each group but the chosen one, with the chosen row's order column as `canonical`."""
    c = chosen.select(F.col(group), F.col(order).alias("canonical"))
    return df.join(c, group).where(F.col(order) != F.col("canonical"))


def grouped(df: DataFrame, keys: list[str], order: str, fields: list[str], name: str = "members") -> DataFrame:
    """Each key with its rows' fields as a list in order, and their number. For groups that are small by nature, such as the files of one digest."""
    members = F.transform(F.array_sort(F.collect_list(F.struct(order, *(f for f in fields if f != order)))), lambda m: F.struct(*(m[f].alias(f) for f in fields)))
    return df.groupBy(*keys).agg(members.alias(name), F.count("*").alias("n_members"))


def placed(df: DataFrame, order: list[Column | str], name: str = "place") -> DataFrame:
    """df with each row's place (from 0) in the given order. Rows are ranged over partitions, each counts on from those before it, and no task sees more than its own: what is counted is written first, so that both looks at it see the same partitions."""
    n = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    part = durable(df.repartitionByRange(n, *order).withColumn("part", F.spark_partition_id()))
    sizes = part.groupBy("part").agg(F.count("*").alias("size"))
    before = sizes.alias("a").join(sizes.alias("b"), F.col("b.part") < F.col("a.part"), "left").groupBy(F.col("a.part").alias("part")).agg(F.coalesce(F.sum("b.size"), F.lit(0)).alias("before"))
    nth = F.row_number().over(Window.partitionBy("part").orderBy(*order)) - 1
    return part.withColumn("nth", nth).join(F.broadcast(before), "part").select(*df.columns, (F.col("nth") + F.col("before")).alias(name))


def numbered(df: DataFrame, prefix: str, order: list[Column | str], name: str = "id") -> DataFrame:
    """Sequential ids in the given order, such as page_001."""
    return placed(df, order, "place of row").select(F.format_string(f"{prefix}_%03d", F.col("place of row") + 1).alias(name), *df.columns)
