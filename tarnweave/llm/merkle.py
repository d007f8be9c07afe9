"""Merkle manifest of a dataset: an external-memory store of tree nodes, from which proofs are extracted by coordinate.

H is the lower-case hexadecimal SHA-256 of its inputs in a row, digests as hexadecimal text. A row's leaf is H of its fields,
each `-` if null, else its UTF-8 byte count, `:` and its value. Rows of equal `tree_col` are one tree: leaves ascend by
`id_col`, every two neighbours become their H, level by level, a last one alone becomes its own H, until one node is left, the subroot.
Subroots, by tree_col (null first, then bytewise), make one more tree in the same way, whose last node is the root.

Leaves are ranged over partitions by tree and id, numbered by counting and written as sorted runs; a tree may be spread over all
of them. Nodes have coordinates (tree, level, place). A block of 2**SPAN neighbours is read in order and gives the SPAN levels
above it (SPAN can be set), which are appended to a store partitioned by level; what it ends in is read back as the next blocks' input, so that a
billion leaves take three passes. For proofs the store is read downwards: a block's levels and the one path that leads from the
block to the root are merged by coordinate, which gives the paths of the block's nodes. No task holds more than two blocks.

A null tree_col is a tree of its own, null ids come first, rows of equal ids are ordered by their leaves (whole copies have equal leaves, so
their order doesn't show); each row has its own proof. An empty table gives an empty result, texts of any length are hashed
whole where they are read, columns that aren't fields are ignored and may have any name.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tarnweave.llm.shared import free, saved, scratch

#: Levels that one block adds; 2**SPAN neighbours are a block.
SPAN = 10
#: Rows of counts for each partition and tree that may be broadcast (some 50 MB); more of them are joined by a shuffle.
BROADCAST_ROWS = 1 << 20

_PATH = "array<struct<digest string, left boolean>>"


def leaf(fields: Sequence[Column]) -> Column:
    """H of the fields."""
    texts = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts)), 256)


def folded(digest: Column, path: Column) -> Column:
    """The root that a leaf and its path lead to."""
    return F.aggregate(path, digest, lambda h, s: F.sha2(F.when(s["digest"].isNull(), h).when(s["left"], F.concat(s["digest"], h)).otherwise(F.concat(h, s["digest"])), 256))


def height(n: Column) -> Column:
    """The levels above n leaves."""
    return F.when(n > 1, F.length(F.bin(n - 1))).otherwise(0)


def _heights(n: int) -> int:
    return (n - 1).bit_length() if n > 1 else 0


@dataclass
class Forest:
    """leaves (tree, place, digest, payload, total), a store of nodes (tree, place, digest, total, level), how many passes its highest tree took, and the levels of a pass."""

    leaves: DataFrame
    path: str
    passes: int
    span: int

    def nodes(self, low: int, high: int) -> DataFrame:
        """The nodes of levels low to high - 1; the store holds those above the leaves."""
        spark = self.leaves.sparkSession
        kind = self.leaves.schema["tree"].dataType.simpleString()
        return spark.read.schema(f"tree {kind}, place long, digest string, total long, level int").parquet(self.path).where((F.col("level") >= low) & (F.col("level") < high))

    def roots(self) -> DataFrame:
        """Per tree its last node, as tree, digest."""
        top = height(F.col("total"))
        single = self.leaves.where("total = 1").select("tree", "digest")
        return single.unionAll(self.nodes(1, 99).where(F.col("level") == top).select("tree", "digest")) if self.passes else single


def _parents(digests: list[str]) -> list[str]:
    last = [sha256(digests[-1].encode()).hexdigest()] if len(digests) % 2 else []
    return [sha256((a + b).encode()).hexdigest() for a, b in zip(digests[::2], digests[1::2])] + last


def _levels(table: pa.Table, base: int, span: int) -> pa.Table:
    """Of a block's nodes on level `base` (columns tree, place, digest, total): the levels above them within the block."""
    table = table.sort_by("place")
    tree, total, place = table.column("tree"), table.column("total")[0].as_py(), table.column("place")[0].as_py()
    digests, places, out, levels = table.column("digest").to_pylist(), [], [], []
    for level in range(base + 1, base + 1 + min(span, _heights(total) - base)):
        digests, place = _parents(digests), place >> 1
        out += digests
        places.append(np.arange(place, place + len(digests)))
        levels.append(np.full(len(digests), level, np.int32))
    n = len(out)
    return pa.table({"tree": tree.take(pa.array(np.zeros(n, np.int64))), "place": np.concatenate(places), "digest": out, "total": np.full(n, total), "level": np.concatenate(levels)})


def _above(base: int, span: int) -> Callable[[pa.Table], pa.Table]:
    return lambda table: _levels(table.select(["tree", "place", "digest", "total"]), base, span)


def _numbered(rows: DataFrame, order: str) -> DataFrame:
    """rows (tree, order, nth, digest, payload) with their places in their trees and the trees' totals; ranged over partitions, and counted in each."""
    by = ["tree", order, "digest", "nth"]
    ordered = rows.repartitionByRange(*by).sortWithinPartitions(*by)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, seen = object(), 0
        for batch in batches:
            if not batch.num_rows:
                continue
            tree = batch.column(0)
            code = pc.dictionary_encode(tree, null_encoding="encode").indices.to_numpy(zero_copy_only=False)
            heads = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
            at = np.arange(batch.num_rows) - np.repeat(heads, np.diff(np.append(heads, batch.num_rows)))
            if tree[0].as_py() == last:
                at[: heads[1] if heads.size > 1 else None] += seen
            last, seen = tree[-1].as_py(), int(at[-1]) + 1
            yield pa.RecordBatch.from_arrays([tree, pa.array(at), batch.column(1), batch.column(2)], ["tree", "at", "digest", "payload"])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    runs = saved(ordered.select("tree", "digest", "payload").mapInArrow(count, f"tree {kinds['tree']}, at long, digest string, payload {kinds['payload']}").withColumn("run", F.spark_partition_id()), "merkle-runs")
    # A row for each partition and tree: a tree has one a partition at most.
    sizes = runs.groupBy("run", "tree").agg((F.max("at") + 1).alias("n"))
    ahead = Window.partitionBy("tree").orderBy("run")
    before = saved(sizes.select(F.col("run").alias("of run"), F.col("tree").alias("of tree"), F.coalesce(F.sum("n").over(ahead.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.sum("n").over(Window.partitionBy("tree")).alias("total")), "merkle-sizes")
    few = F.broadcast(before) if before.count() <= BROADCAST_ROWS else before
    joined = runs.join(few, (F.col("run") == F.col("of run")) & F.col("tree").eqNullSafe(F.col("of tree")))
    return joined.select("tree", (F.col("at") + F.col("before")).alias("place"), "digest", "payload", "total")


def build(rows: DataFrame, order: str, span: int = SPAN) -> Forest:
    """From rows (tree, a column to order by, nth to tell ties apart, digest, payload) to their trees."""
    leaves = _numbered(rows, order)
    spark, path = rows.sparkSession, scratch(rows.sparkSession, "merkle-nodes")
    kind = leaves.schema["tree"].dataType.simpleString()
    most = leaves.agg(F.max("total")).first()[0] or 0
    passes = -(-_heights(most) // span)
    forest = Forest(leaves, path, passes, span)
    for k in range(passes):
        base = k * span
        below = (leaves if not k else forest.nodes(base, base + 1)).select("tree", "place", "digest", "total").where(height(F.col("total")) > base)
        blocks = below.groupBy("tree", F.shiftright("place", span).alias("block"))
        made = blocks.applyInArrow(_above(base, span), f"tree {kind}, place long, digest string, total long, level int")
        made.write.mode("append").partitionBy("level").option("compression", "lz4_raw").parquet(path)
    return forest


def _paths(nodes: pa.Table, above: pa.Table, base: int, span: int) -> pa.Table:
    """Of a block's nodes from level `base` up: for each on that level the path to the root, of which `above` has the part that begins at the block's end."""
    own = nodes.filter(pc.equal(nodes.column("level"), base)).sort_by("place")
    n, up = own.num_rows, min(span, _heights(own.column("total")[0].as_py()) - base)
    place = own.column("place").to_numpy()
    digests, lefts = [], []
    for k in range(up):
        level = own if not k else nodes.filter(pc.equal(nodes.column("level"), base + k)).sort_by("place")
        at, first = place >> k, level.column("place")[0].as_py()
        other = (at ^ 1) - first
        there = other < level.num_rows
        digests.append(level.column("digest").combine_chunks().take(pa.array(np.where(there, other, 0), pa.int64(), mask=~there)))
        lefts.append((at & 1).astype(bool))
    rest = above.column("path").combine_chunks()
    rest = rest.flatten()
    # Path entries level by level, then dealt to their leaves; the rest of the path is the same for all.
    flat = pa.concat_arrays([*digests, rest.field("digest").cast(pa.string())]) if up else rest.field("digest").cast(pa.string())
    side = np.concatenate([*lefts, rest.field("left").to_numpy(zero_copy_only=False).astype(bool)])
    m = len(rest)
    order = np.empty((n, up + m), np.int64)
    order[:, :up] = np.arange(up) * n + np.arange(n)[:, None]
    order[:, up:] = up * n + np.arange(m)
    entries = pa.StructArray.from_arrays([flat.take(pa.array(order.ravel())), pa.array(side[order.ravel()], pa.bool_())], ["digest", "left"])
    paths = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * (up + m)), entries)
    subroot = above.column("subroot").take(pa.array(np.zeros(n, np.int64)))
    return pa.table([*(own.column(c) for c in ("tree", "place", "digest", "payload")), subroot, paths], names=["tree", "place", "digest", "payload", "subroot", "path"])


def _merged(base: int, span: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    return lambda nodes, above: _paths(nodes, above, base, span)


def paths(forest: Forest, above: DataFrame) -> DataFrame:
    """Per leaf: tree, place, digest, payload, subroot, path. `above` has for each tree (tree, total) its subroot and the path from there to the root."""
    kinds = {f.name: f.dataType.simpleString() for f in forest.leaves.schema}
    schema = f"tree {kinds['tree']}, place long, digest string, payload {kinds['payload']}, subroot string, path {_PATH}"
    last = F.greatest(F.lit(0), F.call_function("div", height(F.col("total")) - 1, F.lit(forest.span)).cast("int"))
    entering = above.select("tree", last.alias("entry"), F.lit(0).cast("long").alias("block"), "subroot", "path")
    below = None
    for k in range(max(0, forest.passes - 1), -1, -1):
        base = k * forest.span
        known = entering.where(F.col("entry") == k).drop("entry")
        if below is not None:
            known = known.unionAll(below.select("tree", F.col("place").alias("block"), "subroot", "path"))
        nodes = forest.nodes(max(1, base), base + forest.span).where(height(F.col("total")) > F.col("level")).select("tree", "place", "digest", F.lit(None).cast(kinds["payload"]).alias("payload"), "total", "level") if forest.passes else None
        if not k:
            leaves = forest.leaves.select("tree", "place", "digest", "payload", "total", F.lit(0).alias("level"))
            nodes = leaves if nodes is None else leaves.unionAll(nodes)
        block = F.call_function("shiftright", F.col("place"), F.lit(base + forest.span) - F.col("level"))
        merged = nodes.withColumn("block", block).groupBy("tree", "block").cogroup(known.select(F.col("tree").alias("of tree"), F.col("block").alias("of block"), "subroot", "path").groupBy("of tree", "of block"))
        below = merged.applyInArrow(_merged(base, forest.span), schema)
        if k:
            below = saved(below, "merkle-paths")
    return below


def manifest(docs: DataFrame, fields: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"), tree_col: str = "lang", id_col: str = "doc_id", also: Column | None = None, span: int = SPAN) -> DataFrame:
    """Per row: id_col, leaf, also (null, if not given), subroot, root, path (sibling digests from the leaf to the root and whether they stand left; null: none).

    `also` is a string column of docs to be carried along, such as the leaf of a changed row.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    carried = F.struct(F.col(id_col).alias("id"), (F.lit(None).cast("string") if also is None else also).alias("also"))
    # Written first: texts are read and hashed once, and what tells ties apart stays as it is.
    rows = saved(docs.select(F.col(tree_col).alias("tree"), F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("nth"), leaf([F.col(f) for f in fields]).alias("digest"), carried.alias("payload")), "merkle-leaves")
    forest = build(rows, "id", span)
    free(rows)
    subroots = saved(forest.roots().join(forest.leaves.where("place = 0").select(F.col("tree").alias("of"), F.col("total").alias("size")), F.col("tree").eqNullSafe(F.col("of"))).select("tree", "size", "digest"), "merkle-subroots")
    tops = build(subroots.select(F.lit(0).alias("tree"), F.col("tree").alias("of"), F.lit(0).alias("nth"), "digest", F.struct(F.col("tree").alias("of"), "size").alias("payload")), "of", span)
    root = tops.roots().first()
    top = F.lit(root.digest if root else None).cast(StringType())
    start = tops.leaves.where("place = 0").select("tree", "total", top.alias("subroot"), F.array().cast(_PATH).alias("path"))
    above = saved(paths(tops, start).select(F.col("payload.of").alias("tree"), F.col("payload.size").alias("total"), F.col("digest").alias("subroot"), "path"), "merkle-tops")
    found = paths(forest, above)
    return found.select(F.col("payload.id").cast(kind).alias(id_col), F.col("digest").alias("leaf"), F.col("payload.also").alias("also"), "subroot", top.alias("root"), "path")
