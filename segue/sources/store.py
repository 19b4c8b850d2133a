"""A keyed table in hash buckets: an update rewrites only the buckets it touches, a manifest says which files count."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

c = F.col
BUCKETS = 64


class BucketStore:
    """Rows of a key live in bucket hash(key) mod ``buckets`` of the folder ``root``.

    ``manifest/<version>`` lists the data folder of every bucket.  An update writes new
    folders for the buckets of its keys, then the next manifest; the manifest
    appears by a rename that fails if another writer was first, so a crash in between
    leaves the old state and some unlisted folders, which :meth:`vacuum` removes.  The file
    system must rename atomically.
    """

    def __init__(self, spark: SparkSession, root: str, schema: str, key: str = "key", buckets: int = BUCKETS):
        self.spark, self.root, self.schema, self.key, self.default = spark, root.rstrip("/"), schema, key, buckets
        self.hadoop = spark._jvm.org.apache.hadoop.fs
        self.fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.hadoop.Path(f"{self.root}/{name}" if name else self.root)

    def _names(self, folder: str) -> list[str]:
        path = self._path(folder)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(path)) if self.fs.exists(path) else []

    def versions(self) -> list[int]:
        return [int(n) for n in self._names("manifest") if n.isdigit()]

    def exists(self) -> bool:
        return bool(self.versions())

    def manifest(self, version: int | None = None) -> dict:
        """Number of buckets and the folder of each that has rows; the newest version by default."""
        known = self.versions()
        if not known:
            return {"version": -1, "buckets": self.default, "folders": {}}
        version = known[-1] if version is None else version
        text = self.spark.read.text(str(self._path(f"manifest/{version:020d}")), wholetext=True).first()[0]
        return {"version": version, **json.loads(text)}

    def bucket(self, buckets: int) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(buckets)).cast("int")

    def _rows(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.root}/{f}" for f in folders])

    def read(self, version: int | None = None, buckets: list[int] | None = None) -> DataFrame:
        """The rows of a version, or of some of its buckets only."""
        folders = self.manifest(version)["folders"]
        return self._rows(sorted(f for b, f in folders.items() if buckets is None or int(b) in set(buckets)))

    def _write(self, rows: DataFrame, buckets: int) -> dict[str, str]:
        """Rows as one folder per bucket: bucket -> folder."""
        name = f"data/{uuid.uuid4().hex}"
        numbered = rows.withColumn("bucket", self.bucket(buckets))
        numbered.repartition("bucket").write.partitionBy("bucket").parquet(f"{self.root}/{name}")
        return {n.split("=")[1]: f"{name}/{n}" for n in self._names(name) if n.startswith("bucket=")}

    def _commit(self, version: int, buckets: int, folders: dict[str, str]) -> None:
        self.fs.mkdirs(self._path("manifest"))
        draft, final = self._path(f"draft-{uuid.uuid4().hex}"), self._path(f"manifest/{version:020d}")
        out = self.fs.create(draft, False)
        out.write(bytearray(json.dumps({"buckets": buckets, "folders": folders}).encode()))
        out.close()
        if self.fs.exists(final) or not self.fs.rename(draft, final):
            raise RuntimeError(f"version {version} of {self.root} was written by someone else")

    def update(self, rows: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame]) -> list[int]:
        """Replace the touched buckets by ``merge(old rows of these buckets, rows)``; returns their numbers.

        At most one number per bucket reaches the driver.
        """
        now = self.manifest()
        held = rows.persist()
        try:
            touched = sorted(r[0] for r in held.select(self.bucket(now["buckets"])).distinct().collect())
            if not touched:
                return []
            old = [now["folders"][str(b)] for b in touched if str(b) in now["folders"]]
            new = self._write(merge(self._rows(old), held), now["buckets"])
        finally:
            held.unpersist()
        kept = {b: f for b, f in now["folders"].items() if int(b) not in touched}
        self._commit(now["version"] + 1, now["buckets"], {**kept, **new})
        return touched

    def replace(self, rows: DataFrame) -> None:
        """These rows instead of all that the store holds."""
        now = self.manifest()
        self._commit(now["version"] + 1, now["buckets"], self._write(rows, now["buckets"]))

    def rebucket(self, buckets: int) -> None:
        """The same rows in another number of buckets, one folder each."""
        now = self.manifest()
        self._commit(now["version"] + 1, buckets, self._write(self.read(), buckets))

    def vacuum(self, keep: int = 1) -> int:
        """Delete manifests before the last ``keep`` and data that no remaining one lists; returns the folders deleted."""
        known = self.versions()
        listed = {f for v in known[-keep:] for f in self.manifest(v)["folders"].values()}
        for version in known[:-keep]:
            self.fs.delete(self._path(f"manifest/{version:020d}"), False)
        gone = 0
        for name in self._names("data"):
            for part in [n for n in self._names(f"data/{name}") if n.startswith("bucket=")]:
                if f"data/{name}/{part}" not in listed:
                    self.fs.delete(self._path(f"data/{name}/{part}"), True)
                    gone += 1
            if not any(f.startswith(f"data/{name}/") for f in listed):
                self.fs.delete(self._path(f"data/{name}"), True)
        for name in self._names(""):
            if name.startswith("draft-"):
                self.fs.delete(self._path(name), False)
        return gone
