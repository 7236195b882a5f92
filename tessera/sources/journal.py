"""The journal of imports: Parquet folders that can be replayed and cleaned."""

from __future__ import annotations

import uuid
from datetime import datetime, timedelta, timezone
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.store import Files

SCHEMA = "index_name string, action string, references array<string>, created_at timestamp_ntz"


def now() -> datetime:
    return datetime.now(timezone.utc).replace(tzinfo=None)


class Journal:
    """Entries (index_name, action, references, created_at); about `group` references share an entry.

    Each addition is a folder of its own, so that cleaning touches none that is written meanwhile: it writes what is kept of
    the folders that it found, then removes them. A crash in between leaves entries twice, which changes no replay.
    """

    def __init__(self, spark: SparkSession, root: str, group: int = 1000):
        self.spark, self.files, self.group = spark, Files(spark, root), group
        self.path = f"{self.files.root}/journal"

    def create(self) -> None:
        self.files.make(self.path)

    def segment(self) -> str:
        return f"{self.path}/{uuid.uuid4().hex}"

    def add(self, index: Any, ops: DataFrame, at: datetime | None = None) -> None:
        lanes = max(1, -(-ops.count() // self.group))
        rows = ops.select(F.when(F.col("_op") == "delete", "delete").otherwise("index").alias("action"), "_id", F.pmod(F.xxhash64("_id"), F.lit(lanes)).alias("lane"))
        entries = rows.groupBy("action", "lane").agg(F.array_sort(F.collect_set("_id")).alias("references"))
        entries.select(F.lit(index.name).alias("index_name"), "action", "references", F.lit(at or now()).cast("timestamp_ntz").alias("created_at")).write.parquet(self.segment())

    def read(self, segments: list[str] | None = None) -> DataFrame:
        self.create()
        paths = [self.path] if segments is None else [f"{self.path}/{s}" for s in segments]
        return self.spark.read.schema(SCHEMA).option("recursiveFileLookup", "true").parquet(*paths)

    def entries(self, since: datetime | None = None, indexes: list | None = None) -> DataFrame:
        df = self.read()
        if since is not None:  # a second earlier, as clocks differ
            df = df.filter(F.col("created_at") > F.lit(since - timedelta(seconds=1)).cast("timestamp_ntz"))
        if indexes:
            df = df.filter(F.col("index_name").isin([getattr(i, "name", i) for i in indexes]))
        return df

    def references(self, since: datetime, indexes: list | None = None) -> DataFrame:
        """index_name, reference: everything that changed, once each."""
        return self.entries(since, indexes).select("index_name", F.explode("references").alias("reference")).distinct()

    def apply(self, since: datetime, indexes: list) -> int:
        """Import again what was journalled since; how many references there were."""
        changed = self.references(since, indexes).persist()
        done = 0
        try:
            for index in indexes:
                ids = changed.filter(F.col("index_name") == index.name).select(F.col("reference").alias("_id"))
                n = ids.count()
                if n:
                    done += n
                    replay(index, ids)
        finally:
            changed.unpersist()
        return done

    def clean(self, until: datetime | None = None, indexes: list | None = None) -> int:
        """Remove entries up to a time, of some indexes (all of either if not given); how many went."""
        self.create()
        found = [n for n in self.files.names(self.path) if not n.startswith(("_", "."))]
        if not found:
            return 0
        df = self.read(found)
        old = F.lit(True)
        if until is not None:
            old = old & (F.col("created_at") <= F.lit(until).cast("timestamp_ntz"))
        if indexes:
            old = old & F.col("index_name").isin([getattr(i, "name", i) for i in indexes])
        gone, all_ = df.agg(F.count_if(old), F.count("*")).first()
        if gone:
            if gone < all_:
                df.filter(~old).write.parquet(self.segment())
            for segment in found:
                self.files.delete(f"{self.path}/{segment}")
        return gone


def replay(index: Any, ids: DataFrame) -> None:
    """Import documents by id without journalling; ids that the source lacks are deleted. Nothing is collected."""
    from tessera.sources.importer import Ids, Importer

    importer = Importer(index)
    index.create()
    index.store.merge(importer.operations(*importer.rows(Ids(ids))))
