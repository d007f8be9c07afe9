"""A stored vector index: lists of vectors around centres, read and rewritten list by list.

Each vector lies in the list of its nearest centre, with its distance from it (reach). A list of many rows is several parts, by a hash
of the id. A second kind of part says for each id in which list it lies, so that a change of a vector finds and rewrites the old place and
the new one and no other. A search opens the lists nearest to the queries; then those lists of which reach and distance leave open, by the
triangle inequality, that they hold something nearer: what it finds is what comparing all pairs finds.
"""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tarnweave.operators.durable import durable
from tarnweave.operators.vector import QUERIES, _squared, blocked, bounds, compared, ranked, trained_centroids
from tarnweave.sources.versions import Manifest, Store

#: Rows of parts' numbers, or of queries, that may be broadcast.
BROADCAST_ROWS = 1 << 16


class VectorIndex:
    """Of rows (id_col, vector, more). Null ids and null vectors aren't stored; of rows with one id in one write the one with the greatest vector is."""

    def __init__(self, spark: SparkSession, path: str, id_col: str = "vec_id", vector: str = "embedding", part_rows: int = 1 << 17, id_parts: int = 64):
        self.store, self.id_col, self.vector, self.part_rows, self.id_parts = Store(spark, path), id_col, vector, part_rows, id_parts
        self.spark = spark

    def _centres(self, manifest: Manifest) -> np.ndarray:
        rows = self.store.read("centres", None, manifest).orderBy("list_no").collect()
        return np.array([r.centre for r in rows], np.float64)

    def _listed(self, vectors: DataFrame, centres: np.ndarray) -> DataFrame:
        @F.pandas_udf("struct<list_no:int,reach:double>")
        def listed(x: pd.Series) -> pd.DataFrame:
            d = np.sqrt(_squared(np.stack(x.to_numpy()).astype(np.float64), centres))
            return pd.DataFrame({"list_no": d.argmin(1).astype(np.int32), "reach": d.min(1)})

        known = vectors.where(F.col(self.id_col).isNotNull() & F.col(self.vector).isNotNull())
        unique = known.groupBy(self.id_col).agg(F.max_by(F.struct(*vectors.columns), self.vector).alias("row")).select("row.*")
        return unique.withColumn("listed", listed(self.vector)).select("*", "listed.*").drop("listed")

    def _id_part(self) -> Column:
        return F.pmod(F.xxhash64(self.id_col), F.lit(self.id_parts))

    def _numbers(self, rows: DataFrame) -> dict[str, list]:
        """Per part: rows, least and greatest reach."""
        return {f"list/{r.part}": [r.n, r.low, r.high] for r in rows.groupBy("part").agg(F.count("*").alias("n"), F.min("reach").alias("low"), F.max("reach").alias("high")).collect()}

    def build(self, vectors: DataFrame, n_lists: int = 64, sample: int = 20_000) -> Manifest:
        """A version that holds these vectors alone. Centres come from a bounded sample; they decide how fast searches are and not what they find."""
        base = self.store.manifest()
        centres = trained_centroids(vectors, n_lists, self.id_col, self.vector, sample)
        rows = durable(self._listed(vectors, centres))
        # A row a list, of which there are n_lists.
        many = F.broadcast(rows.groupBy("list_no").agg(F.ceil(F.count("*") / self.part_rows).cast("int").alias("n_parts")))
        rows = rows.join(many, "list_no").withColumn("part", F.concat_ws("_", "list_no", F.pmod(F.xxhash64(self.id_col), F.col("n_parts")))).drop("n_parts")
        middle = self.spark.createDataFrame([(k, c.tolist()) for k, c in enumerate(centres)], "list_no int, centre array<double>")
        ids = rows.select(self.id_col, "part")
        parts = self.store.written(rows, "list", F.col("part")) | self.store.written(ids, "id", self._id_part()) | self.store.written(middle, "centres", F.lit(0))
        return self.store.committed(base, dict.fromkeys(base.parts) | parts, {"list": rows.schema, "id": ids.schema, "centres": middle.schema}, self._numbers(rows))

    def upsert(self, vectors: DataFrame, deleted: DataFrame | None = None) -> Manifest:
        """A version in which these vectors replace those of their ids or are added, and ids in `deleted` are gone. Only parts that lose or gain a row are rewritten."""
        base = self.store.manifest()
        fields = StructType.fromJson(json.loads(base.schemas["list"])).names
        n_parts: dict[int, int] = {}
        for name in base.numbers:
            list_no = int(name.removeprefix("list/").partition("_")[0])
            n_parts[list_no] = n_parts.get(list_no, 0) + 1
        known = F.create_map(*(F.lit(x) for kv in n_parts.items() for x in kv)) if n_parts else F.create_map().cast("map<int,int>")
        # An id that is both given and deleted is gone.
        rows = self._listed(vectors if deleted is None else vectors.join(deleted.select(self.id_col).distinct(), self.id_col, "left_anti"), self._centres(base))
        rows = durable(rows.withColumn("part", F.concat_ws("_", "list_no", F.pmod(F.xxhash64(self.id_col), F.coalesce(F.try_element_at(known, "list_no"), F.lit(1))))))
        ids = rows.select(self.id_col)
        ids = durable(ids if deleted is None else ids.unionByName(deleted.select(self.id_col)).where(F.col(self.id_col).isNotNull()).distinct())
        id_names = [f"id/{r[0]}" for r in ids.select(self._id_part()).distinct().collect()]
        places = self.store.read("id", id_names, base)
        old = durable(places.join(ids, self.id_col))
        names = sorted({f"list/{r.part}" for r in old.select("part").distinct().unionAll(rows.select("part").distinct()).distinct().collect()})
        kept = self.store.read("list", names, base).join(ids, self.id_col, "left_anti")
        whole = durable(kept.select(*fields).unionByName(rows.select(*fields)))
        parts = self.store.written(whole, "list", F.col("part")) | self.store.written(places.join(ids, self.id_col, "left_anti").unionByName(rows.select(self.id_col, "part")), "id", self._id_part())
        return self.store.committed(base, dict.fromkeys([*names, *id_names]) | parts, None, self._numbers(whole))

    def rows(self, version: int | None = None) -> DataFrame:
        return self.store.read("list", None, self.store.manifest(version)).drop("list_no", "reach", "part")

    def nearest(self, queries: DataFrame, k: int, n_probe: int = 2, skip_self: bool = True, version: int | None = None) -> tuple[DataFrame, int]:
        """For each query (query_id and the vector column) its k nearest rows, as vector.nearest gives them (distance, rank_no), and how many parts were opened."""
        manifest = self.store.manifest(version)
        centres = self._centres(manifest)

        @F.pandas_udf("array<double>")
        def far(x: pd.Series) -> pd.Series:
            return pd.Series(list(np.sqrt(_squared(np.stack(x.to_numpy()).astype(np.float64), centres))))

        queries = queries.where(F.col(self.vector).isNotNull()).select("query_id", F.col(self.vector).alias("query_vector"))
        # Narrow rows for each query and list; vectors come to what is left of them.
        lists = queries.select("query_id", F.posexplode(far("query_vector")).alias("list_no", "far"))
        probes = durable(lists.withColumn("turn", F.row_number().over(Window.partitionBy("query_id").orderBy("far", "list_no"))))
        parts = self.spark.createDataFrame([(int(n[5:].partition("_")[0]), n[5:], low, high) for n, (_, low, high) in manifest.numbers.items()], "list_no int, part string, low double, high double")
        parts = F.broadcast(parts) if len(manifest.numbers) <= BROADCAST_ROWS else parts
        n_blocks = max(1, -(-probes.where("turn = 1").count() // QUERIES))

        def scored(wanted: DataFrame) -> tuple[DataFrame, int]:
            wanted = durable(wanted)
            names = [f"list/{r.part}" for r in wanted.select("part").distinct().collect()]
            asked = blocked(wanted.join(queries, "query_id"), n_blocks).select("query_id", "query_vector", "part", "block", *(c for c in ("far", "bound") if "bound" in wanted.columns))
            rows = self.store.read("list", names, manifest).select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_blocks - 1).cast("long"))).alias("block"))
            met = compared(rows, asked, ["part", "block"], max(1, len(names)) * n_blocks, k, self.id_col, self.vector, skip_self, None, ("list_no",))
            return ranked(met, k, self.id_col), len(names)

        first, n_first = scored(probes.where(F.col("turn") <= n_probe).join(parts, "list_no"))
        first = durable(first)
        rest = probes.where(F.col("turn") > n_probe).join(bounds(first, k), "query_id", "left").join(parts, "list_no")
        nearer = F.greatest(F.col("far") - F.col("high"), F.col("low") - F.col("far"))
        second, n_second = scored(rest.where(F.col("bound").isNull() | (nearer <= F.col("bound") + 1e-6)))
        out = ranked(first.unionByName(second), k, self.id_col)
        return out, n_first + n_second
