"""Harmonic packing of token ids into sequences of fixed capacity.

A piece of length n belongs to class k = floor(capacity / n): k of them fit, and a bin of class k takes exactly k
pieces. A document is first cut into full sequences (class 1); what remains stays whole if it nearly fills its
class's slot of floor(capacity / k) tokens (`slack`), else the largest slot that it fills is cut off and the rest is
treated alike. So almost every bin is filled to within `slack`, whatever the lengths are.

Workers number the pieces of each class on their own; only counts by (worker, class) meet, to turn those numbers
into bins. Each class leaves at most one bin open. The pieces in those bins (fewer than `capacity` tokens a class,
whatever the input's size) are packed together by best fit.

Nulls and edge cases: a null text counts as empty; each document has at least its end id; a null doc_id is packed
like any other; repeated rows are packed each; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import bisect
import zlib
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.byte_bpe import byte_bpe
from tessera.llm.common import save

STRETCH = 256
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, worker int, class int, number long"


def cut_lengths(n: int, capacity: int, slack: float) -> list[int]:
    """Lengths of the pieces of a document of n tokens."""
    out = [capacity] * (n // capacity)
    n %= capacity
    while n:
        slot = capacity // (capacity // n)
        if slot - n <= slack * slot:
            out.append(n)
            break
        slot = capacity // (capacity // n + 1)
        out.append(slot)
        n -= slot
    return out


def best_fit(lengths: list[int], capacity: int) -> list[tuple[int, int]]:
    """(bin, offset) of each piece; longest first, each into the fullest bin that still has room."""
    place, room, filled = [(0, 0)] * len(lengths), [], []
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        at = bisect.bisect_left(room, (lengths[i], -1))
        if at < len(room):
            left, b = room.pop(at)
        else:
            left, b = capacity, len(filled)
            filled.append(0)
        place[i] = (b, filled[b])
        filled[b] += lengths[i]
        bisect.insort(room, (left - lengths[i], b))
    return place


def cut_documents(docs: DataFrame, tokenizer: str, end_id: int, capacity: int, slack: float) -> DataFrame:
    """A row for each piece, numbered within its worker and class. No shuffle."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, end, worker = byte_bpe(tokenizer), end_id.to_bytes(4, "little"), TaskContext.get().partitionId()
        seen: dict[int, int] = defaultdict(int)
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                rows = []
                for doc, text in zip(b.column(0).slice(at, 1024).to_pylist(), b.column(1).slice(at, 1024).to_pylist(), strict=True):
                    raw = bpe.encode(text) + end
                    total, start = len(raw) // 4, 0
                    for n in cut_lengths(total, capacity, slack):
                        k = capacity // n
                        rows.append((doc, start, n, zlib.crc32(raw[4 * start : 4 * (start + n)]), total, worker, k, seen[k]))
                        seen[k] += 1
                        start += n
                kinds = [pa.int64()] * 5 + [pa.int32()] * 2 + [pa.int64()]
                yield pa.record_batch(
                    [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)],
                    [c.split()[0] for c in PIECES.split(", ")],
                )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(cut, PIECES)


def pack(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = 2048, slack: float = 1 / 64) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, class of each piece of `docs`."""
    spark = docs.sparkSession
    pieces = save(cut_documents(docs, tokenizer, end_id, capacity, slack), "pieces")
    counts = save(pieces.groupBy("worker", "class").agg((F.max("number") + 1).alias("n")), "piece-counts")
    totals = {r["class"]: r.n for r in counts.groupBy("class").agg(F.sum("n").alias("n")).collect()}  # at most 2 * sqrt(capacity) rows
    base, at = {}, 0
    for k in sorted(totals):
        base[k] = at
        at += totals[k] // k
    if not totals:
        return pieces.select(*PIECES.split(" long, ")[:1], "start", "length", "ids_crc32", "doc_tokens", F.col("number").alias("sequence_id"), F.col("number").alias("offset"), "class")
    classes = spark.createDataFrame([(k, base[k], totals[k] // k * k) for k in totals], "class int, base long, whole long")
    before = Window.partitionBy("class").orderBy("worker").rowsBetween(Window.unboundedPreceding, -1)
    shift = counts.withColumn("shift", F.coalesce(F.sum("n").over(before), F.lit(0))).join(F.broadcast(classes), "class")
    # keyed by stretches of numbers, so that no worker's frequent class lands in one task
    stretches = shift.withColumn("stretch", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / STRETCH)))).drop("n")
    ranked = pieces.withColumn("stretch", F.floor(F.col("number") / STRETCH)).join(stretches, ["worker", "class", "stretch"]).withColumn("rank", F.col("shift") + F.col("number"))
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]

    closed = ranked.filter(F.col("rank") < F.col("whole")).withColumn("sequence_id", F.col("base") + F.floor(F.col("rank") / F.col("class")).cast("long"))
    full = closed.filter("class = 1").select(*columns, "sequence_id", F.lit(0).cast("long").alias("offset"), "class")
    earlier = Window.partitionBy("sequence_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    shared = closed.filter("class > 1").withColumn("offset", F.coalesce(F.sum("length").over(earlier), F.lit(0)).cast("long"))

    left = ranked.filter(F.col("rank") >= F.col("whole"))
    rest = left.select("class", "rank", "length").orderBy("class", "rank").collect()  # under `capacity` tokens a class
    placed = [(r["class"], r["rank"], at + b, o) for r, (b, o) in zip(rest, best_fit([r.length for r in rest], capacity), strict=True)]
    where = spark.createDataFrame(placed, "class int, rank long, sequence_id long, offset long")
    last = left.join(F.broadcast(where), ["class", "rank"])
    return full.unionByName(shared.select(*columns, "sequence_id", "offset", "class")).unionByName(last.select(*columns, "sequence_id", "offset", "class"))
