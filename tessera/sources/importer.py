"""Imports: rows become operations, operations are merged into the stored documents."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.events import event
from tessera.operators.joins import descendants
from tessera.sources.tokens import column_of


class ImportFailed(RuntimeError):
    """Documents that couldn't be imported: {operation: {error: [first ids]}}; `Importer.failed` holds them all."""

    def __init__(self, errors: dict):
        super().__init__(f"import failed: {errors}")
        self.errors = errors


@dataclass(frozen=True)
class Ids:
    """Ids of documents to import, as a DataFrame with `_id`: nothing of it is collected."""

    frame: DataFrame


class Importer:
    """update_fields: change only these fields of documents that are there (others are imported whole unless
    update_failover is off). validate: {message: Column that is true for bad documents}. raw_import: rewrites rows first.
    batch_size, bulk_size, refresh, pipeline, parallel are accepted: Spark's partitions do what they are for.
    """

    SHOWN = 1000
    HINTS = ("batch_size", "bulk_size", "refresh", "pipeline", "parallel", "suffix", "direct_import", "consistency")

    def __init__(self, index: Any, *, update_fields: list[str] | None = None, update_failover: bool = True, journal: Any = None, validate: dict[str, Callable[[], Column]] | None = None, strict: bool = False, raw_import: Callable | None = None, batch: Any = None, **hints: Any):
        if unknown := set(hints) - set(self.HINTS):
            raise TypeError(f"unknown options: {sorted(unknown)}")
        self.index, self.update_fields, self.failover, self.journal = index, update_fields, update_failover, journal
        self.validate, self.strict, self.raw_import, self.batch = validate or {}, strict, raw_import, batch
        self.errors: dict = {}  # the first SHOWN ids of each operation and message
        self.error_counts: dict = {}  # how many there are
        self.failed: DataFrame | None = None  # all of them: operation, error, _id

    # -- rows to operations -----------------------------------------------------------------------------------

    def rows(self, given: Any) -> tuple[DataFrame, DataFrame | None]:
        """Source rows, and ids that were asked for but aren't in the source (as `_id`)."""
        if given is None:
            return self.index.source_rows(), None
        if isinstance(given, DataFrame):
            return given, None
        if isinstance(given, Ids):
            ids = given.frame.select(F.col("_id").cast("string").alias("_id")).distinct()
        else:
            given, spark = list(given), self.index.spark
            if given and isinstance(given[0], dict):
                return spark.createDataFrame(given), None
            ids = spark.createDataFrame([(str(i),) for i in given], "_id string").distinct()
        source, key = self.index.source_rows(), self.index.source_id
        named = source.withColumn("__id", F.col(f"`{key}`").cast("string"))
        found = named.join(ids, named["__id"] == ids["_id"], "left_semi").drop("__id")
        return found, ids.join(found.select(F.col(f"`{key}`").cast("string").alias("_id")), "_id", "left_anti")

    def operations(self, rows: DataFrame, gone: DataFrame | None = None) -> DataFrame:
        """`_op`, `_id` and document columns: one row for each id; a deletion wins over an import of the same id."""
        if self.raw_import:
            rows = self.raw_import(rows)
        delete_if = self.index.delete_if
        if delete_if is not None:
            rows = rows.withColumn("__gone", F.coalesce(delete_if(rows), F.lit(False)))
        docs = self.index.compose(rows.filter("not __gone").drop("__gone") if delete_if is not None else rows)
        blank = F.col("_id").isNull() | (F.trim("_id") == "")
        docs = docs.withColumn("_id", F.when(blank, F.uuid()).otherwise(F.col("_id"))) if self.update_fields is None else docs.filter(~blank)
        ops = self.index.with_tokens(docs).withColumn("_op", F.lit("index" if self.update_fields is None else "update"))
        deleted = []
        if delete_if is not None:
            key = self.index.mapping.id
            ids = rows.filter("__gone").select((F.col(f"`{key}`") if isinstance(key, str) else F.col(f"`{self.index.source_id}`")).cast("string").alias("_id"))
            deleted.append(ids)
        if gone is not None:
            deleted.append(gone.select("_id"))
        for d in deleted:
            ops = ops.unionByName(d.filter("_id is not null").withColumn("_op", F.lit("delete")), allowMissingColumns=True)
        # of several rows with one id a deletion counts, else the largest by a hash of its content, so that a rerun gives the same
        others = [c for c in ops.columns if c not in ("_op", "_id")]
        content = F.xxhash64(F.to_json(F.struct(*[F.col(f"`{c}`") for c in others]))) if others else F.lit(0).cast("long")
        rank = F.struct((F.col("_op") == "delete").cast("int").alias("d"), content.alias("h"))
        return ops.groupBy("_id").agg(F.max_by(F.struct("_op", *[F.col(f"`{c}`") for c in others]), rank).alias("d")).select("_id", "d.*")

    def checked(self, ops: DataFrame) -> DataFrame:
        """Operations without the documents that fail validation; those are reported by message."""
        if not self.validate:
            return ops
        reason = F.lit(None).cast("string")
        for message, test in self.validate.items():
            reason = F.when(F.coalesce(test(), F.lit(False)) & (F.col("_op") != "delete"), message).otherwise(reason)
        marked = ops.withColumn("__error", reason)
        self.failed = marked.filter("__error is not null").select(F.col("_op").alias("operation"), F.col("__error").alias("error"), "_id")
        by = ["operation", "error"]
        for r in self.failed.groupBy(by).count().collect():  # one row for each message
            self.error_counts.setdefault(r.operation, {})[r.error] = r["count"]
        if self.error_counts:
            place = F.row_number().over(Window.partitionBy(by).orderBy("_id"))
            for r in self.failed.withColumn("n", place).filter(F.col("n") <= self.SHOWN).orderBy("n").collect():
                self.errors.setdefault(r.operation, {}).setdefault(r.error, []).append(r["_id"])
        return marked.filter("__error is null").drop("__error")

    def with_descendants(self, ops: DataFrame) -> DataFrame:
        """Documents below an imported one that has moved are written again, so that they follow their root."""
        at = self.index.join_field
        field = next((f for f in self.index.mapping.fields if f.name == at), None)
        if field is None or not self.index.exists():
            return ops
        old = self.index.documents()
        if at not in old.columns or old.isEmpty():
            return ops
        moved = old.select("_id", F.col(at).alias("__was")).join(ops.filter("_op <> 'delete'").select("_id", F.col(at).alias("__is")), "_id").filter("not (__was <=> __is)").select("_id")
        below = descendants(old, moved, "_id", F.col(f"{at}.parent"), self.depth(field.relations())).filter("level > 0").select(F.col("id").alias("_id"))
        again = old.join(below, "_id", "left_semi").join(ops.select("_id"), "_id", "left_anti").withColumn("_op", F.lit("index"))
        return ops.unionByName(again, allowMissingColumns=True)

    def written_fields(self) -> list[str] | None:
        """The fields of an update, and the tokens of the text fields among them."""
        if self.update_fields is None:
            return None
        paths = [p for p in self.index.analyzers if self.index.aliases.get(p, p).split(".")[0] in self.update_fields]
        return [*self.update_fields, *map(column_of, paths)]

    def failing_over(self, ops: DataFrame) -> DataFrame:
        """Updates of documents that aren't there yet import them whole."""
        there = self.index.store.read().select("_id", F.lit(True).alias("__there"))
        whole = (F.col("_op") == "update") & F.col("__there").isNull()
        return ops.join(there, "_id", "left").withColumn("_op", F.when(whole, "index").otherwise(F.col("_op"))).drop("__there")

    @staticmethod
    def depth(relations: dict[str, list[str]]) -> int:
        def below(name: str, seen: tuple = ()) -> int:
            return 0 if name in seen else 1 + max((below(c, (*seen, name)) for c in relations.get(name, [])), default=0)

        return max((below(n) for n in relations), default=1)

    # -- run --------------------------------------------------------------------------------------------------

    def run(self, given: Any = None) -> bool:
        if given is not None and not isinstance(given, (DataFrame, Ids)) and not list(given):
            return True
        with event("import_objects", index=self.index.name) as payload:
            self._run(given)
            payload["errors"], payload["error_counts"] = self.errors, self.error_counts
        if self.errors and self.strict:
            raise ImportFailed(self.errors)
        return not self.errors

    def _run(self, given: Any) -> None:
        self.index.create()
        rows, gone = self.rows(given)
        ops = self.checked(self.operations(rows, gone)).persist()
        try:
            store = self.index.store
            if self.update_fields is not None and self.failover:
                ops_ = self.failing_over(ops)
            else:
                ops_ = self.with_descendants(ops) if self.index.join_field else ops
            store.merge(ops_, self.written_fields(), self.batch)
            if given is None:
                self.index.analyse()
            journal = self.index.journal if self.journal is None else self.journal  # False turns it off
            if journal:
                journal.add(self.index, ops)
        finally:
            ops.unpersist()
