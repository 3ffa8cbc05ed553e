"""A table in versions: files by key bucket, of which a change rewrites only those it touches, and a manifest that says which files are the table.

Rows are dealt to buckets by a hash of ``group``, so all rows of a group (the chunks of a paper) lie in one. A change writes the new files of its buckets
into a folder of its own and then puts the next manifest in place by a rename that fails if another writer was faster; until then readers see the version
before, whole, and after it the new one. A writer that dies between the steps leaves files that no manifest names, which ``vacuum``
removes. Readers are pinned to the manifest they read.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKET = "bucket_of_key"


class Conflict(RuntimeError):
    """Another writer made the next version first."""


class Versions:
    def __init__(self, spark: SparkSession, path: str, group: str, key: str, buckets: int = 64):
        """``group`` names the column that buckets are by, ``key`` the one that tells its rows apart; both as the table was made with."""
        self.spark, self.path, self.group, self.key, self.buckets = spark, path.rstrip("/"), group, key, buckets
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._fs = self._hadoop.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    # manifests

    def _names(self) -> list[int]:
        where = self._hadoop.Path(f"{self.path}/manifests")
        if not self._fs.exists(where):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(where)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json"))

    def version(self) -> int:
        """The newest version; 0 before the first."""
        return max(self._names(), default=0)

    def manifest(self, version: int | None = None) -> dict:
        """schema, and the folder of each bucket that has rows."""
        version = self.version() if version is None else version
        if not version:
            return {"schema": None, "files": {}, "buckets": self.buckets}
        text = self.spark.read.text(f"{self.path}/manifests/{version:010d}.json", wholetext=True).first()[0]
        return json.loads(text)

    def _commit(self, version: int, manifest: dict) -> None:
        side = self._hadoop.Path(f"{self.path}/manifests/.{uuid.uuid4().hex}")
        out = self._fs.create(side, False)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        at = self._hadoop.Path(f"{self.path}/manifests/{version:010d}.json")
        if self._fs.exists(at) or not self._fs.rename(side, at):
            self._fs.delete(side, False)
            raise Conflict(f"version {version} of {self.path} exists")

    # rows

    def bucket(self):
        return F.pmod(F.xxhash64(F.col(self.group).cast("string")), F.lit(self.buckets)).cast("int")

    def read(self, version: int | None = None, only: list[int] | None = None) -> DataFrame | None:
        """The rows of a version, the newest if not said; None before the first. ``only`` reads these buckets."""
        manifest = self.manifest(version)
        if manifest["schema"] is None:
            return None
        from pyspark.sql.types import StructType

        schema = StructType.fromJson(manifest["schema"])
        paths = [f"{self.path}/{p}" for b, p in sorted(manifest["files"].items(), key=lambda x: int(x[0])) if only is None or int(b) in only]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _write(self, rows: DataFrame, touched: list[int], before: int, manifest: dict) -> int:
        """Files for the touched buckets, then the manifest that names them beside the untouched ones."""
        folder = f"data/{before + 1:010d}-{uuid.uuid4().hex}"
        rows.withColumn(BUCKET, self.bucket()).repartition(BUCKET).write.partitionBy(BUCKET).parquet(f"{self.path}/{folder}")
        made = {s.getPath().getName().split("=")[1] for s in self._fs.listStatus(self._hadoop.Path(f"{self.path}/{folder}")) if s.isDirectory()}
        files = {b: p for b, p in manifest["files"].items() if int(b) not in touched} | {b: f"{folder}/{BUCKET}={b}" for b in made}
        self._commit(before + 1, {"schema": rows.schema.jsonValue(), "files": files, "buckets": self.buckets})
        return before + 1

    def _touched(self, *changes: DataFrame | None) -> list[int]:
        """The buckets of groups that change; as many as there are buckets at most."""
        found: set[int] = set()
        for change in changes:
            if change is not None:
                found |= {r[0] for r in change.select(self.bucket()).distinct().collect()}
        return sorted(found)

    def apply(self, upserts: DataFrame | None = None, deletes: DataFrame | None = None, replace: bool = False) -> int:
        """A new version in which ``upserts`` stand in place of rows with their group and key, and groups of ``deletes`` are gone; its number.

        With ``replace``, groups that ``upserts`` have keep none of their old rows. Of upserts that repeat a group and key one stays, the greatest
        row. Only buckets of changed groups are read and written. Nothing to change makes no version.
        """
        before = self.version()
        manifest = self.manifest(before)
        if manifest["schema"] is not None and manifest["buckets"] != self.buckets:
            raise ValueError(f"{self.path} has {manifest['buckets']} buckets")
        touched = self._touched(upserts, deletes)
        if not touched:
            return before
        keys = [self.group, self.key]
        rows = self.read(before, touched)
        if rows is not None and deletes is not None:
            rows = rows.join(deletes.select(self.group).distinct(), self.group, "left_anti")
        if upserts is not None:
            rest = [c for c in upserts.columns if c not in keys]
            fresh = upserts.groupBy(*keys).agg(F.max(F.struct(*rest)).alias("r")).select(*keys, *[F.col(f"r.{c}").alias(c) for c in rest]).select(*upserts.columns) if rest else upserts.distinct()
            if rows is not None:
                on = [self.group] if replace else keys
                rows = rows.join(fresh.select(*on).distinct(), on, "left_anti").unionByName(fresh)
            else:
                rows = fresh
        return before if rows is None else self._write(rows, touched, before, manifest)

    def retain(self, present: DataFrame) -> int:
        """A new version without the groups that ``present`` lacks: orphans go."""
        rows = self.read()
        if rows is None:
            return 0
        return self.apply(deletes=rows.select(self.group).distinct().join(present.select(self.group), self.group, "left_anti"))

    def vacuum(self, keep: int = 2) -> list[str]:
        """Remove all but the newest ``keep`` versions and every folder that none of these names; what was removed. Not while a writer is at work."""
        versions = self._names()
        for old in versions[:-keep] if keep else versions:
            self._fs.delete(self._hadoop.Path(f"{self.path}/manifests/{old:010d}.json"), False)
        named = {p.split("/")[1] for v in self._names() for p in self.manifest(v)["files"].values()}
        where, gone = self._hadoop.Path(f"{self.path}/data"), []
        for s in self._fs.listStatus(where) if self._fs.exists(where) else []:
            if s.getPath().getName() not in named:
                self._fs.delete(s.getPath(), True)
                gone.append(s.getPath().getName())
        return sorted(gone)
