"""A versioned store in a folder: a log of numbered manifests, of which each is written once, and data that manifests name.

A manifest lists the store's parts and the folder of each. A writer puts its data aside, then its manifest under the next number, if no other writer has
done so: of two one wins, and the other merges its parts over the winner's, or fails if both changed the same. Readers see the manifest with the highest number, so they
see a version or the one before, whatever step a writer was killed at. Older versions stay as backups until `vacuumed`; going back is a new
version that names an old one's data. Parts that a change doesn't touch keep their files.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

PART = "part of store"


class Conflict(Exception):
    """Another writer has changed the same parts."""


@dataclass
class Manifest:
    """parts: name to folder, below the store's; schemas: of each kind of part (its name before the slash), as JSON; numbers: what a writer keeps for a part; based_on: the version it was made from."""

    version: int = 0
    parts: dict[str, str] = field(default_factory=dict)
    schemas: dict[str, str] = field(default_factory=dict)
    numbers: dict[str, list] = field(default_factory=dict)
    changed: list[str] = field(default_factory=list)


class Store:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._fs = self._at("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _names(self, folder: str) -> list[str]:
        at = self._at(folder)
        return sorted(x.getPath().getName() for x in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def versions(self) -> list[int]:
        return [int(n.removesuffix(".json")) for n in self._names("log") if n.endswith(".json") and n[0] != "."]

    def manifest(self, version: int | None = None) -> Manifest:
        """The manifest of a version, the newest if none is given; an empty one of version 0 before the first."""
        known = self.versions()
        version = max(known, default=0) if version is None else version
        if not version and not known:
            return Manifest()
        if version not in known:
            raise ValueError(f"{self.path} has no version {version}")
        file = self._fs.open(self._at(f"log/{version:020d}.json"))
        try:
            return Manifest(**json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(file, "UTF-8")))
        finally:
            file.close()

    def put(self, manifest: Manifest) -> bool:
        """Puts a manifest under its number, whole, if there is none yet; whether it did."""
        name = f"{manifest.version:020d}.json"
        aside, target = self._at(f"log/.{uuid.uuid4().hex}"), self._at(f"log/{name}")
        out = self._fs.create(aside, False)
        out.write(bytearray(json.dumps(manifest.__dict__).encode()))
        out.close()
        try:
            if self._fs.getUri().getScheme() == "file":
                # A rename replaces files there; a link doesn't.
                of = lambda p: self._jvm.java.nio.file.Path.of(self._jvm.java.net.URI("file://" + p.toUri().getPath()))
                self._jvm.java.nio.file.Files.createLink(of(target), of(aside))
                return True
            return self._fs.rename(aside, target)
        except Exception as e:
            if "FileAlreadyExists" in str(e):
                return False
            raise
        finally:
            self._fs.delete(aside, False)

    def written(self, rows: DataFrame, kind: str, part: Column) -> dict[str, str]:
        """Writes rows aside, a folder for each value of `part`; the parts' names and folders."""
        folder = f"data/{uuid.uuid4().hex}"
        rows.withColumn(PART, part.cast("string")).repartition(PART).write.partitionBy(PART).parquet(f"{self.path}/{folder}")
        return {f"{kind}/{n.partition('=')[2]}": f"{folder}/{n}" for n in self._names(folder) if "=" in n}

    def committed(self, base: Manifest, parts: dict[str, str | None], schemas: dict[str, StructType] | None = None, numbers: dict[str, list] | None = None) -> Manifest:
        """The version after `base`, or after those that other writers put there meanwhile, with these parts instead of those of their names (None: without them)."""
        while True:
            new = Manifest(base.version + 1, {k: v for k, v in (base.parts | parts).items() if v}, base.schemas | {k: v.json() for k, v in (schemas or {}).items()}, base.numbers | (numbers or {}), sorted(parts))
            new.numbers = {k: v for k, v in new.numbers.items() if k in new.parts}
            if self.put(new):
                return new
            base = self.manifest(base.version + 1)
            if set(base.changed) & set(parts):
                raise Conflict(f"{self.path}: version {base.version} changed {sorted(set(base.changed) & set(parts))[:5]} as well")

    def read(self, kind: str, names: list[str] | None = None, manifest: Manifest | None = None) -> DataFrame:
        """The rows of the parts of a kind, or of those named only; files of others aren't opened."""
        manifest = manifest or self.manifest()
        wanted = [k for k in manifest.parts if k.startswith(f"{kind}/")] if names is None else [k for k in names if k in manifest.parts]
        schema = StructType.fromJson(json.loads(manifest.schemas[kind]))
        folders = [f"{self.path}/{manifest.parts[k]}" for k in wanted]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def rolled_back(self, version: int) -> Manifest:
        """A new version with an old one's content."""
        now, then = self.manifest(), self.manifest(version)
        new = Manifest(now.version + 1, then.parts, then.schemas, then.numbers, sorted({*now.parts, *then.parts}))
        if not self.put(new):
            raise Conflict(f"{self.path}: another version was put first")
        return new

    def vacuumed(self, keep: int = 2) -> int:
        """Deletes manifests but the newest `keep`, then data that none of those names; how many folders went. Data of a write that isn't committed yet goes as well, so no writer may be at work."""
        known = self.versions()
        for v in known[:-keep]:
            self._fs.delete(self._at(f"log/{v:020d}.json"), False)
        used = {f for v in known[-keep:] for f in self.manifest(v).parts.values()}
        gone = 0
        for folder in self._names("data"):
            for name in self._names(f"data/{folder}"):
                if f"data/{folder}/{name}" not in used:
                    gone += self._fs.delete(self._at(f"data/{folder}/{name}"), True) and "=" in name
        return gone


class KeyedTable:
    """Rows with unique keys in buckets by the key's hash. Changes rewrite the buckets of their keys only. A null key is a key."""

    def __init__(self, spark: SparkSession, path: str, key: str, n_buckets: int = 64):
        self.store, self.key, self.n_buckets = Store(spark, path), key, n_buckets

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.n_buckets))

    def created(self, rows: DataFrame) -> Manifest:
        """The first version, or one that replaces all rows."""
        base = self.store.manifest()
        parts = self.store.written(rows, "rows", self._bucket())
        return self.store.committed(base, dict.fromkeys(base.parts) | parts, {"rows": rows.schema})

    def merged(self, changes: DataFrame, deleted: DataFrame | None = None, order: str | None = None) -> Manifest:
        """A version in which `changes` replace the rows of their keys or are added, and keys in `deleted` are gone. Of changes with one key the last by `order` counts; without it they must be unique."""
        base = self.store.manifest()
        names = StructType.fromJson(json.loads(base.schemas["rows"])).names
        if order is not None:
            changes = changes.groupBy(self.key).agg(F.max_by(F.struct(*changes.columns), order).alias("row")).select("row.*")
        elif not changes.groupBy(self.key).count().where("count > 1").isEmpty():
            raise ValueError("several changes of one key")
        keys = changes.select(self.key) if deleted is None else changes.select(self.key).unionByName(deleted.select(self.key))
        # As many numbers as there are buckets at most.
        touched = [r[0] for r in keys.select(self._bucket()).distinct().collect()]
        own = [f"rows/{b}" for b in touched]
        old = self.store.read("rows", own, base)
        gone = keys.select(F.col(self.key).alias("changed key"))
        kept = old.join(gone, old[self.key].eqNullSafe(gone["changed key"]), "left_anti")
        parts = self.store.written(kept.select(*names).unionByName(changes.select(*names)), "rows", self._bucket())
        return self.store.committed(base, dict.fromkeys(own) | parts)

    def rows(self, version: int | None = None) -> DataFrame:
        return self.store.read("rows", None, self.store.manifest(version))
