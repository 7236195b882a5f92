"""Vectors in blocks: what both searches share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def finite(vectors: DataFrame, id_column: str, column: str) -> DataFrame:
    """id, v (array of double) of rows whose vector is there, finite throughout, and of the most frequent length.

    (Of lengths equally frequent the largest counts.) Rows without an id take no part.
    """
    v = F.col(column).cast("array<double>")
    ok = F.col(id_column).isNotNull() & v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    good = vectors.filter(ok).select(F.col(id_column).cast("long").alias("id"), v.alias("v"))
    sizes = good.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).limit(1).collect()
    return good.filter(F.size("v") == (sizes[0].n if sizes else 0))


def matrix(column: pa.Array) -> np.ndarray:
    """A list column without nulls as a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def top(found: DataFrame, k: int, kind: str) -> DataFrame:
    """The k best of each query from blocks' own: query_id, rank, vec_id, score; ties to the smaller id."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int"), "vec_id", F.col("score").cast(kind))


def packed(rows: DataFrame, size: int, key: str | None = None, kind: str = "<f8") -> DataFrame:
    """Blocks of at most `size` rows of (id, v[, key]): (key, ids, body); packed where the rows are, without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

        def block(k: int) -> pa.RecordBatch:
            parts = held.pop(k)
            ids, body = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            n = range(0, len(ids), size)
            return pa.record_batch(
                [pa.array([k] * len(n), pa.int64()), pa.array([ids[i : i + size].astype("<i8").tobytes() for i in n], pa.binary()), pa.array([body[i : i + size].astype(kind).tobytes() for i in n], pa.binary())],
                ["key", "ids", "body"],
            )

        for b in batches:
            if not b.num_rows:
                continue
            ids, v = b.column(0).to_numpy(), matrix(b.column(1))
            keys = b.column(2).to_numpy() if key else np.zeros(len(ids), int)
            for k in np.unique(keys).tolist():
                held.setdefault(k, []).append((ids[keys == k], v[keys == k]))
                if sum(len(p[0]) for p in held[k]) >= size:
                    yield block(k)
        for k in list(held):
            yield block(k)

    return rows.select("id", "v", *([key] if key else [])).mapInArrow(run, "key long, ids binary, body binary")


def unpacked(ids: bytes, body: bytes, kind: str = "<f8") -> tuple[np.ndarray, np.ndarray]:
    i = np.frombuffer(ids, "<i8")
    return i, np.frombuffer(body, kind).reshape(len(i), -1)
