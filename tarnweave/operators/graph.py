"""Link graphs: breadth-first discovery, trees, a resumable frontier."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnweave.operators.dedup import placed
from tarnweave.operators.durable import durable


def breadth_first(edges: DataFrame, roots: DataFrame, most_depth: int | None = None, most_nodes: int | None = None) -> DataFrame:
    """Nodes reached from the roots (column node) over edges (src, dst, pos): node, depth, parent (the first to find it: smallest parent, then place).

    One join and one anti-join a level. The edges are computed once, as every level reads them; every level is written once, to the shared folder, so plans stay short and lost executors cost one level.
    `most_nodes` is the crawl budget: discovery stops after the level that reaches it.
    """
    edges = durable(edges.select("src", "dst", "pos"))
    level = durable(roots.select(F.col("node"), F.lit(0).alias("depth"), F.lit(None).cast(edges.schema["src"].dataType).alias("parent")).distinct())
    seen, n_nodes, depth = level, level.count(), 0
    while True:
        depth += 1
        if most_depth is not None and depth > most_depth or most_nodes is not None and n_nodes >= most_nodes:
            return seen
        found = edges.join(level.select(F.col("node").alias("src")), "src").groupBy(F.col("dst").alias("node")).agg(F.min_by("src", F.struct("src", "pos")).alias("parent"))
        level = durable(found.join(seen.select("node"), "node", "left_anti").select("node", F.lit(depth).alias("depth"), "parent"))
        n_new = level.count()
        if not n_new:
            return seen
        seen, n_nodes = seen.unionByName(level), n_nodes + n_new


def crawled(edges: DataFrame, roots: DataFrame, most_nodes: int, most_depth: int | None = None) -> DataFrame:
    """What a crawler that takes pages from a queue has seen when its budget of `most_nodes` pages is spent: node, depth, parent, place (from 0, in the order of discovery).

    A node is found by that page of the level before that comes first in the queue, and there by its first link (pos). Each level is put in this order
    over range partitions, numbered by counting, and cut where the budget ends, so that neither a task nor the driver sees a whole level.
    """
    edges = durable(edges.select("src", "dst", "pos"))
    kind = edges.schema["src"].dataType
    level = placed(roots.select("node").distinct(), ["node"]).where(F.col("place") < most_nodes)
    seen = level = durable(level.select("node", F.lit(0).alias("depth"), F.lit(None).cast(kind).alias("parent"), "place"))
    n, depth = level.count(), 0
    while n < most_nodes and (most_depth is None or depth < most_depth):
        depth += 1
        found = edges.join(level.select(F.col("node").alias("src"), F.col("place").alias("turn")), "src").groupBy(F.col("dst").alias("node")).agg(F.min(F.struct("turn", "pos", "src")).alias("first"))
        new = found.join(seen.select("node"), "node", "left_anti")
        order = placed(new.select("node", "first.turn", "first.pos", F.col("first.src").alias("parent")), ["turn", "pos", "node"])
        level = durable(order.where(F.col("place") < most_nodes - n).select("node", F.lit(depth).alias("depth"), "parent", (F.col("place") + n).alias("place")))
        n_new = level.count()
        if not n_new:
            break
        seen, n = seen.unionByName(level), n + n_new
    return seen


def children(nodes: DataFrame) -> DataFrame:
    """Each parent with its children, sorted."""
    return nodes.where("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.array_sort(F.collect_set("node")).alias("children"))


def frontier(inventory: DataFrame) -> DataFrame:
    """What a resumed crawl still has to check: anything not checked, errors included."""
    return inventory.where("status <> 'checked' or status is null")


def upserted(inventory: DataFrame, updates: DataFrame, key: str, version: str) -> DataFrame:
    """The newest row of each key. Rows of a key are combined before the shuffle."""
    both = inventory.unionByName(updates, allowMissingColumns=True)
    return both.groupBy(key).agg(F.max_by(F.struct(*both.columns), version).alias("row")).select("row.*")
