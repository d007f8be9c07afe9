"""Tables from recognised words with their places on a page."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnweave.operators.durable import durable
from tarnweave.operators.profile import upper_median


def gap_clusters(df: DataFrame, keys: list[str], value: str, gap: Column, name: str = "cluster") -> DataFrame:
    """Numbers the groups of values that gaps larger than `gap` divide, for each key.

    Rows are ranged over partitions by key and value, so a key with many rows is spread; a partition numbers its own part of a key, and goes on from
    where the parts before it end, of which only their ends and numbers of gaps are compared. Null values come first and start no group.
    """
    n = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    part = durable(df.withColumn("gap of row", gap).repartitionByRange(n, *keys, value).withColumn("part", F.spark_partition_id()))
    w = Window.partitionBy("part", *keys).orderBy(value)
    opens = F.when(F.col(value) - F.lag(value).over(w) > F.col("gap of row"), 1).otherwise(0)
    own = part.withColumn("opens", opens)
    ends = own.groupBy("part", *keys).agg(F.sum("opens").alias("n_opens"), F.min(F.struct(F.col(value).isNotNull(), value, "gap of row")).alias("head"), F.max(value).alias("tail"))
    parts = Window.partitionBy(*keys).orderBy("part")
    first = F.when(F.col(f"head.{value}") - F.lag("tail").over(parts) > F.col("head.gap of row"), 1).otherwise(0)
    before = ends.withColumn("first", first).select("part", *keys, (F.sum("first").over(parts) + F.coalesce(F.sum("n_opens").over(parts.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).alias("before"))
    counted = own.withColumn("inside", F.sum("opens").over(w.rangeBetween(Window.unboundedPreceding, 0)))
    on = (counted["part"] == before["part"]) & reduce(and_, (counted[k].eqNullSafe(before[k]) for k in keys))
    return counted.join(before, on).select(*(counted[c] for c in df.columns), (F.col("inside") + F.col("before")).cast("int").alias(name))


def _columns(df: DataFrame, page: str, value: str, gap: Column, name: str) -> DataFrame:
    """The same for the words of a page, which are few."""
    w = Window.partitionBy(page).orderBy(value)
    new = F.when(F.col(value) - F.lag(value).over(w) > gap, 1).otherwise(0)
    return df.withColumn("new", new).withColumn(name, F.sum("new").over(w.rangeBetween(Window.unboundedPreceding, 0)).cast("int")).drop("new")


def table_lines(items: DataFrame, page: str = "page", tolerance: float = 1.3, least_tolerance: float = 8.0, gap: float = 0.08, least_gap: float = 40.0) -> DataFrame:
    """Lines of each page from its words (text, x, y, h): a word starts a row if it lies beyond the tolerance from the row's first word; columns are divided by gaps in x; cells are joined by pipes. Columns: page, line_no, line. A page's words are bounded, and no page needs another."""
    word = "struct<y:double,x:double,text:string>"
    per = items.groupBy(page).agg(F.array_sort(F.collect_list(F.struct(F.col("y").cast("double").alias("y"), F.col("x").cast("double").alias("x"), F.col("text").alias("text")))).alias("items"), (F.max("x") - F.min("x")).cast("double").alias("width"), upper_median(F.collect_list(F.col("h").cast("double"))).alias("median"))
    state = f"struct<anchor:double,row:int,out:array<struct<row:int,item:{word}>>>"
    zero = F.struct(F.lit(None).cast("double").alias("anchor"), F.lit(-1).alias("row"), F.expr(f"cast(array() as array<struct<row:int,item:{word}>>)").alias("out")).cast(state)

    def step(a: Column, w: Column) -> Column:
        new = a["anchor"].isNull() | (w["y"] - a["anchor"] > F.greatest(F.col("median") * tolerance, F.lit(least_tolerance)))
        row = a["row"] + new.cast("int")
        return F.struct(F.when(new, w["y"]).otherwise(a["anchor"]).alias("anchor"), row.alias("row"), F.concat(a["out"], F.array(F.struct(row.alias("row"), w.alias("item")))).alias("out")).cast(state)

    rows = per.select(page, "width", F.explode(F.aggregate("items", zero, step, lambda a: a["out"])).alias("r")).select(page, "width", F.col("r.row").alias("line_no"), "r.item.x", "r.item.text")
    cells = _columns(rows, page, "x", F.greatest(F.col("width") * gap, F.lit(least_gap)), "column")
    joined = cells.groupBy(page, "line_no", "column").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x", "text"))), lambda c: c["text"]), " ").alias("cell"))
    return joined.groupBy(page, "line_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("column", "cell"))), lambda c: c["cell"]), " | ").alias("line"))
