"""Synchronisation: ids that only one side has, and documents that are out of date, by one full outer join."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def comparable(c: Column, kind: T.DataType) -> Column:
    """Times count in milliseconds; everything else as text."""
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.date_trunc("MILLISECOND", c.cast("timestamp")).cast("string")
    return c.cast("string")


class Syncer:
    """field: what tells that a document is out of date (`updated_at`); not compared if its value is composed."""

    def __init__(self, index: Any, field: str = "updated_at"):
        self.index = index
        declared = next((f for f in index.mapping.fields if f.name == field), None)
        self.field = field if declared is not None and declared.value is None and field in index.source_rows().columns else None

    def compare(self) -> DataFrame:
        """_id, state: missing (only the source has it), extra (only the index), outdated, or same."""
        rows, docs = self.index.source_rows(), self.index.documents()
        if self.index.delete_if is not None:
            rows = rows.filter(~F.coalesce(self.index.delete_if(rows), F.lit(False)))
        mark = lambda df: comparable(F.col(f"`{self.field}`"), df.schema[self.field].dataType) if self.field and self.field in df.columns else F.lit(None).cast("string")
        a = rows.select(F.col(f"`{self.index.source_id}`").cast("string").alias("_id"), mark(rows).alias("__a"), F.lit(True).alias("__in_a"))
        b = docs.select("_id", mark(docs).alias("__b"), F.lit(True).alias("__in_b"))
        both = a.join(b, "_id", "full_outer")
        state = F.when(F.col("__in_b").isNull(), "missing").when(F.col("__in_a").isNull(), "extra")
        if self.field:
            state = state.when(~F.col("__a").eqNullSafe(F.col("__b")), "outdated")
        return both.select("_id", state.otherwise("same").alias("state"))

    def differing(self) -> DataFrame:
        """What has to be imported again; nothing if the source is empty, which is more likely a fault than the truth."""
        found = self.compare().filter("state <> 'same'")
        return found.filter(F.lit(False)) if self.index.source_rows().isEmpty() else found

    def missing_ids(self) -> list[str]:
        return [r[0] for r in self.differing().filter("state in ('missing', 'extra')").select("_id").toLocalIterator()]

    def outdated_ids(self) -> list[str]:
        return [r[0] for r in self.differing().filter("state = 'outdated'").select("_id").toLocalIterator()]

    def perform(self) -> dict:
        """Import what differs; counts by state, and their sum."""
        from tessera.sources.journal import replay

        found = self.differing().persist()
        try:
            counts = {r.state: r["count"] for r in found.groupBy("state").count().collect()}
            if counts:
                replay(self.index, found.select("_id"))
        finally:
            found.unpersist()
        return {**{k: counts.get(k, 0) for k in ("missing", "extra", "outdated")}, "count": sum(counts.values())}
