"""Documents in versioned Parquet folders behind a pointer file.

    <root>/<name>/versions/<version>/   one complete state of the documents
    <root>/<name>/CURRENT               JSON: version, and the last batch of each stream that it holds
    <root>/<name>/terms/<version>/      statistics of its terms, where they have been asked for
    <root>/<name>/specification.json    mapping and settings as last deployed

A change writes a new version and then swaps the pointer, so readers see the old state or the new one. All file
operations go through Hadoop's file system, so any store that Spark reads will do.
"""

from __future__ import annotations

import json
import uuid
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Files:
    """The few file operations that pointers need, on Hadoop's file system."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, p: str) -> Any:
        return self._jvm.org.apache.hadoop.fs.Path(p)

    def exists(self, p: str) -> bool:
        return self._fs.exists(self._path(p))

    def read(self, p: str) -> str:
        stream = self._fs.open(self._path(p))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, p: str, text: str) -> None:
        """To a new file, then renamed over the old one."""
        new = f"{p}.{uuid.uuid4().hex}"
        stream = self._fs.create(self._path(new), True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        if not self._fs.rename(self._path(new), self._path(p)):
            self._fs.delete(self._path(p), False)
            if not self._fs.rename(self._path(new), self._path(p)):
                raise OSError(f"{p} can't be replaced")

    def make(self, p: str) -> None:
        self._fs.mkdirs(self._path(p))

    def delete(self, p: str) -> None:
        self._fs.delete(self._path(p), True)

    def names(self, p: str) -> list[str]:
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(p))) if self.exists(p) else []


class Store:
    """The documents of one index."""

    def __init__(self, spark: SparkSession, root: str, name: str, schema: T.StructType | None = None, partition_by: tuple[str, ...] = ()):
        self.spark, self.name, self.schema, self.partition_by = spark, name, schema, partition_by
        self.files = Files(spark, root)
        self.path = f"{self.files.root}/{name}"

    @property
    def pointer(self) -> dict:
        at = f"{self.path}/CURRENT"
        return json.loads(self.files.read(at)) if self.files.exists(at) else {}

    def exists(self) -> bool:
        return bool(self.pointer)

    def versions(self) -> list[str]:
        return self.files.names(f"{self.path}/versions")

    def read(self, version: str | None = None) -> DataFrame:
        version = version or self.pointer.get("version")
        if version is None:
            return self.spark.createDataFrame([], self.schema or T.StructType([T.StructField("_id", T.StringType())]))
        return self.spark.read.parquet(f"{self.path}/versions/{version}")

    def terms_folder(self, version: str | None = None) -> str:
        """Where the statistics of a version's terms are."""
        return f"{self.path}/terms/{version or self.pointer.get('version')}"

    def write(self, df: DataFrame, suffix: str | None = None, batch: tuple[str, int] | None = None, keep: int = 1) -> str:
        """A new version that holds `df`, made current; older ones but the last `keep` go."""
        old = self.pointer
        number = int(old.get("number", 0)) + 1
        version = f"{number:08d}-{suffix or uuid.uuid4().hex[:8]}"
        writer = df.write.partitionBy(*self.partition_by) if self.partition_by else df.write
        writer.parquet(f"{self.path}/versions/{version}")
        streams = dict(old.get("streams", {}))
        if batch is not None:
            streams[batch[0]] = batch[1]
        self.files.write(f"{self.path}/CURRENT", json.dumps({"version": version, "number": number, "streams": streams}))
        for gone in self.versions()[: -1 - keep]:
            self.files.delete(f"{self.path}/versions/{gone}")
            self.files.delete(self.terms_folder(gone))
        return version

    def merge(self, ops: DataFrame, fields: list[str] | None = None, batch: tuple[str, int] | None = None) -> None:
        """Apply `ops`: `_op` (index, update or delete), `_id` and document columns, one row for each id.

        A keyed merge: one full outer join on `_id`. An update changes the listed fields (all of ops' if none is listed)
        of documents that are there; others stay as they are. batch: a stream's name and the batch's number; one that is
        in the store already changes nothing.
        """
        if batch is not None and batch[1] <= self.pointer.get("streams", {}).get(batch[0], -1):
            return
        old = self.read()
        columns = [c for c in ops.columns if c not in ("_op", "_id")]
        for c in columns:
            if c not in old.columns:
                old = old.withColumn(c, F.lit(None).cast(ops.schema[c].dataType))
        new = ops.select("_id", F.col("_op").alias("__op"), *[F.col(f"`{c}`").alias(f"__new_{c}") for c in columns])
        both = old.withColumn("__old", F.lit(True)).join(new, "_id", "full_outer")
        op, there = F.coalesce("__op", F.lit("keep")), F.coalesce("__old", F.lit(False))
        kept = both.filter((op != "delete") & (there | (op == "index")))

        def value(c: str) -> Any:
            own = F.col(f"`{c}`")
            if c not in columns:
                return F.when(op != "index", own).alias(c)
            changed = F.col(f"`__new_{c}`")
            if fields is not None and c not in fields:
                return F.when(op == "index", changed).otherwise(own).alias(c)
            return F.when(op == "keep", own).otherwise(changed).alias(c)

        self.write(kept.select("_id", *[value(c) for c in old.columns if c != "_id"]), batch=batch)

    def delete_ids(self, ids: DataFrame) -> int:
        """Remove documents by `_id`; how many there were."""
        old = self.read()
        before = old.count()
        self.write(old.join(ids.select(F.col("_id").cast("string").alias("_id")).distinct(), "_id", "left_anti"))
        return before - self.read().count()

    def drop(self) -> None:
        self.files.delete(self.path)

    # -- specification ----------------------------------------------------------------------------------------

    def specification(self) -> dict | None:
        at = f"{self.path}/specification.json"
        return json.loads(self.files.read(at)) if self.files.exists(at) else None

    def lock_specification(self, spec: dict) -> None:
        self.files.write(f"{self.path}/specification.json", json.dumps(spec, sort_keys=True))

    def specification_changed(self, spec: dict) -> bool:
        return json.dumps(self.specification(), sort_keys=True) != json.dumps(json.loads(json.dumps(spec)), sort_keys=True)
