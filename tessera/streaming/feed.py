"""Change feeds as streams: files of changes in, merged documents out."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Mapping
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

SCHEMA = "index_name string, id string, fields array<string>, at timestamp"


def append(spark: SparkSession, path: str, index: str, ids: list | DataFrame, fields: list[str] | None = None) -> None:
    """Write changes of documents; fields: what has changed of them (None: all). ids: a list, or a DataFrame with `_id`."""
    if isinstance(ids, DataFrame):
        rows = ids.select(F.col("_id").cast("string").alias("id"))
    else:
        rows = spark.createDataFrame([(str(i),) for i in ids], "id string")
    named = rows.select(F.lit(index).alias("index_name"), "id", (F.lit(None) if fields is None else F.array(*[F.lit(f) for f in fields])).cast("array<string>").alias("fields"))
    named.withColumn("at", F.current_timestamp()).write.mode("append").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(SCHEMA).parquet(path)


def operations(index: Any, changes: DataFrame) -> tuple[DataFrame, list[str]]:
    """Operations for the changes (id, fields) of one index, one for each id, and the fields that updates write.

    An id is imported whole if one of its changes has no list of fields, else the fields of the lists are updated (all that
    are listed in these changes; they come from the source, so more of them than were asked for does no harm).
    """
    from tessera.sources.importer import Ids, Importer

    known = set(index.field_names)
    by_id = changes.groupBy(F.col("id").alias("_id")).agg(F.bool_or(F.col("fields").isNull()).alias("whole"))
    listed = changes.filter("fields is not null").select(F.explode("fields").alias("f")).distinct()
    fields = sorted(known.intersection(r.f for r in listed.filter(F.col("f").isin(sorted(known))).collect()))  # no more than the mapping has
    whole = Importer(index)
    if not fields:
        return whole.operations(*whole.rows(Ids(by_id.filter("whole").select("_id")))), fields
    part = Importer(index, update_fields=fields)
    own = whole.operations(*whole.rows(Ids(by_id.filter("whole").select("_id"))))
    some = part.failing_over(part.operations(*part.rows(Ids(by_id.filter("not whole").select("_id")))))
    return own.unionByName(some, allowMissingColumns=True), part.written_fields()


def merge_batch(indexes: Mapping[str, Any], stream: str) -> Callable[[DataFrame, int], None]:
    """A batch's changes into each index; a batch of this stream that comes again after a failure changes nothing."""

    def run(batch: DataFrame, number: int) -> None:
        held = batch.persist()
        try:
            names = [r[0] for r in held.select("index_name").distinct().collect()]  # one row for each index
            for name in names:
                index = indexes.get(name)
                if index is not None:
                    index.create()
                    ops, fields = operations(index, held.filter(F.col("index_name") == name))
                    index.store.merge(ops, fields or None, batch=(stream, number))
        finally:
            held.unpersist()

    return run


def stream_name(checkpoint: str) -> str:
    """A stream is told from others by its checkpoint, where its batches are counted."""
    return hashlib.sha256(checkpoint.rstrip("/").encode()).hexdigest()[:16]


def consume(spark: SparkSession, path: str, indexes: Mapping[str, Any], checkpoint: str, once: bool = False) -> StreamingQuery:
    """Import changes as they come; once: all that is there, then stop."""
    writer = read(spark, path).writeStream.foreachBatch(merge_batch(indexes, stream_name(checkpoint))).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def chunk_of(at: Any, latency: int) -> Any:
    """Start of the chunk that a change at `at` (seconds) belongs to: the next multiple of `latency`."""
    return (F.floor(at / latency) + 1).cast("long") * latency


def delayed_chunks(changes: DataFrame, at: str, id_column: str, index_column: str | None = None, latency: int = 10, margin: int = 2, fields: str | None = None) -> DataFrame:
    """Changes by chunk of `latency` seconds: chunk (when it closes), run_at, distinct ids, and the fields to update.

    Works on tables and on streams (there with a watermark of `margin` seconds). A change without a list of fields
    stands for all fields, and wins over lists.
    """
    stream = changes.isStreaming
    if stream:
        changes = changes.withWatermark(at, f"{margin} seconds")
    start = chunk_of(F.unix_timestamp(F.col(at).cast("timestamp")), latency)
    by = [F.window(F.col(at), f"{latency} seconds")] if stream else [start.alias("chunk")]
    by += [F.col(index_column)] if index_column else []
    ids = F.array_sort(F.collect_set(F.col(id_column).cast("string"))).alias("ids")  # one chunk's, of one index
    more = []
    if fields:
        more = [F.max(F.col(fields).isNull()).alias("__all"), F.array_sort(F.array_distinct(F.flatten(F.collect_set(fields)))).alias("__fields")]
    out = changes.groupBy(*by).agg(ids, *more)
    if stream:
        out = out.withColumn("chunk", F.unix_timestamp(F.col("window.end").cast("timestamp"))).drop("window")
    if fields:
        out = out.withColumn("fields", F.when(~F.col("__all"), F.col("__fields"))).drop("__all", "__fields")
    return out.withColumn("run_at", F.col("chunk") + margin)


def held_back(changes: DataFrame, latency: float = 10, margin: float = 2) -> DataFrame:
    """A stream of changes (index_name, id, fields), each document's once per chunk of `latency` seconds.

    A document's first change waits for the end of the current chunk and `margin` seconds more; changes until then join it: lists
    of fields are united, and a change without a list stands for all fields. State is kept by document and ends with the chunk.
    """

    def gather(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            whole, fields, _ = state.get
            state.remove()
            yield pd.DataFrame({"index_name": [key[0]], "id": [key[1]], "fields": [None if whole else list(fields)]})
            return
        now = state.getCurrentProcessingTimeMs()
        whole, fields, due = state.get if state.exists else (False, [], int(((now / 1000) // latency + 1) * latency * 1000 + margin * 1000))
        fields = set(fields)
        for part in parts:
            for own in part["fields"]:
                whole = whole or own is None
                fields.update(own if own is not None else ())
        state.update((bool(whole), sorted(fields), due))
        state.setTimeoutDuration(max(1, due - now))

    by = changes.groupBy("index_name", "id")
    return by.applyInPandasWithState(gather, "index_name string, id string, fields array<string>", "whole boolean, fields array<string>, due long", "append", GroupStateTimeout.ProcessingTimeTimeout)


def delayed(spark: SparkSession, path: str, indexes: Mapping[str, Any], checkpoint: str, latency: float = 10, margin: float = 2, every: str = "1 second") -> StreamingQuery:
    """As `consume`, but a document's changes within a chunk of `latency` seconds are imported together, `margin` later."""
    writer = held_back(read(spark, path), latency, margin).writeStream.foreachBatch(merge_batch(indexes, stream_name(checkpoint))).option("checkpointLocation", checkpoint)
    return writer.outputMode("append").trigger(processingTime=every).start()


def deduplicated(changes: DataFrame, at: str, keys: list[str], late: str = "10 minutes") -> DataFrame:
    """A stream without repeated changes; state is kept for `late`."""
    return changes.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)
