"""Token-ID output: documents as id arrays, each compressed alone with a zstandard dictionary that all share.

Layout of an output folder:

* `dictionary`: one row with the dictionary's bytes and its hash (BLAKE2b, 128 bits);
* `shards`: one row for each shard, its file in `content`, in ascending document order over (part, shard).

Rows of Parquet hold the shard files, so any store that Spark writes to will do and Spark's committer makes the
output whole when a task is tried again. A shard file is, little-endian throughout:

    magic 8 bytes | id width u16 | documents u32 | tokens before it in its part u64 | dictionary hash 16 bytes
    | doc_id i64 each | null flag u8 each | tokens u64 each | offset u64 each, and the end | frames

The offsets let a reader decompress one short document without touching the rest of the shard.

Nulls and edge cases: a null text counts as empty (its record holds the end id alone); null doc_ids come first;
equal doc_ids are ordered by a hash of the text, then the text; an empty table gives an empty output; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.byte_bpe import byte_bpe
from tessera.llm.common import bounded_sample

MAGIC = b"TSRSHRD1"
HEAD = struct.Struct("<8sHIQ16s")
SHARDS = "part int, shard int, first_doc long, last_doc long, n_docs int, n_tokens long, tokens_before long, content binary"
TOKENS = "doc_id long, start long, n_tokens long, ids_crc32 long"
#: Row groups of a few MB, looked at after every 16 shards: a reader holds one of them at a time.
SMALL_GROUPS = {"compression": "none", "parquet.block.size": str(4 << 20), "parquet.page.size.row.check.min": "4", "parquet.block.size.row.check.min": "16", "parquet.enable.dictionary": "false"}


def _narrow(raw: bytes, width: int) -> bytes:
    return raw if width == 4 else np.frombuffer(raw, "<u4").astype("<u2").tobytes()


def _dictionary(blob: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(blob) if blob else None


def dictionary_hash(blob: bytes) -> bytes:
    return hashlib.blake2b(blob, digest_size=16).digest()


def train_dictionary(docs: DataFrame, tokenizer: str, end_id: int, width: int, sample: int = 1000, size: int = 65536) -> bytes:
    """A dictionary of at most `size` bytes from about `sample` documents' arrays (at most twice as many are read).

    Fewer documents than zstandard can learn from give a raw-content dictionary, none at all an empty one.
    """

    def arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(tokenizer)
        for b in batches:
            rows = [_narrow(bpe.encode(t) + end_id.to_bytes(4, "little"), width) for t in b.column(0).to_pylist()]
            yield pa.record_batch([pa.array(rows, pa.binary())], ["ids"])

    rows = bounded_sample(docs.select("doc_id", F.col("text").cast("string").alias("text")), "doc_id", sample).select("text")
    got = [bytes(r.ids) for r in rows.mapInArrow(arrays, "ids binary").collect()]
    try:
        return zstandard.train_dictionary(size, got, level=3).as_bytes()
    except zstandard.ZstdError:
        return b"".join(got)[:size]


def build_shard(rows: list[tuple], before: int, width: int, dict_hash: bytes) -> bytes:
    """rows: (doc_id or None, tokens, frame) in order."""
    offsets = np.cumsum([0] + [len(r[2]) for r in rows], dtype="<u8")
    return b"".join(
        (
            HEAD.pack(MAGIC, width, len(rows), before, dict_hash),
            np.array([r[0] or 0 for r in rows], "<i8").tobytes(),
            np.array([r[0] is None for r in rows], "u1").tobytes(),
            np.array([r[1] for r in rows], "<u8").tobytes(),
            offsets.tobytes(),
            *(r[2] for r in rows),
        )
    )


class Shard:
    """Reads a shard file; `ids(i)` decompresses document i alone."""

    def __init__(self, content: bytes, dictionary: bytes):
        magic, self.width, self.n, self.before, self.hash = HEAD.unpack_from(content)
        if magic != MAGIC or self.hash != dictionary_hash(dictionary):
            raise ValueError("not a shard, or one of another dictionary")
        at, n = HEAD.size, self.n
        self.doc_ids = np.frombuffer(content, "<i8", n, at)
        self.nulls = np.frombuffer(content, "u1", n, at + 8 * n)
        self.tokens = np.frombuffer(content, "<u8", n, at + 9 * n)
        self.offsets = np.frombuffer(content, "<u8", n + 1, at + 17 * n)
        self.base, self.content = at + 17 * n + 8 * (n + 1), content
        shared = _dictionary(dictionary)
        self.press = zstandard.ZstdDecompressor(**({"dict_data": shared} if shared else {}))

    def ids(self, i: int) -> np.ndarray:
        a, b = self.base + int(self.offsets[i]), self.base + int(self.offsets[i + 1])
        return np.frombuffer(self.press.decompress(self.content[a:b]), "<u4" if self.width == 4 else "<u2")


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int, vocabulary: int, part_bytes: int = 64 << 20, shard_bytes: int = 128 << 10, dictionary_sample: int = 1000) -> None:
    """Write `docs` to `path` in ascending doc_id order.

    Rows are dealt to ranges of (doc_id, hash of the text), of about `part_bytes` of text or less, so that a doc_id that
    many rows share is dealt to several; each range is sorted, encoded once, and cut into shards of about `shard_bytes`.
    """
    spark = docs.sparkSession
    width = 2 if max(vocabulary, end_id + 1) <= 1 << 16 else 4
    blob = train_dictionary(docs, tokenizer, end_id, width, dictionary_sample)
    digest = dictionary_hash(blob)
    spark.createDataFrame([(bytearray(blob), digest.hex())], "content binary, hash string").coalesce(1).write.parquet(f"{path}/dictionary")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    total = rows.agg(F.sum(F.octet_length("text")).alias("b")).first().b or 0
    parts = max(1, -(-total // part_bytes), min(4 * spark.sparkContext.defaultParallelism, total // (8 << 20)))

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, end, part = byte_bpe(tokenizer), end_id.to_bytes(4, "little"), TaskContext.get().partitionId()
        shared = _dictionary(blob)
        if shared:
            shared.precompute_compress(level=3)
        press = zstandard.ZstdCompressor(level=3, **({"dict_data": shared} if shared else {})).compress
        held: list[tuple] = []
        size = before = number = 0

        def flush() -> pa.RecordBatch:
            tokens = sum(r[1] for r in held)
            ids = [r[0] for r in held if r[0] is not None]
            values = [[part], [number], [ids[0] if ids else None], [ids[-1] if ids else None], [len(held)], [tokens], [before], [build_shard(held, before, width, digest)]]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
            return pa.record_batch([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], [c.split()[0] for c in SHARDS.split(", ")])

        for b in batches:
            for doc, text in zip(b.column(0), b.column(1), strict=True):
                raw = bpe.encode(text.as_py()) + end
                held.append((doc.as_py(), len(raw) // 4, press(_narrow(raw, width))))
                size += len(held[-1][2])
                if size >= shard_bytes:
                    yield flush()
                    before, number, held, size = before + sum(r[1] for r in held), number + 1, [], 0
        if held:
            yield flush()

    by = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), F.col("text")]
    dealt = rows.repartitionByRange(int(parts), *by[:2]).sortWithinPartitions(*by)
    dealt.mapInArrow(shards, SHARDS).write.options(**SMALL_GROUPS).parquet(f"{path}/shards")


def _read_dictionary(spark: SparkSession, path: str) -> bytes:
    row = spark.read.schema("content binary, hash string").parquet(f"{path}/dictionary").first()
    blob = bytes(row.content)
    if dictionary_hash(blob).hex() != row.hash:
        raise ValueError("the dictionary doesn't match its hash")
    return blob


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """Per document, from the files: doc_id, ids of all documents before it, its count of ids, their checksum."""
    blob = _read_dictionary(spark, path)
    files = spark.read.schema(SHARDS).parquet(f"{path}/shards")
    totals = files.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each part
    starts = totals.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("part_start"))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                shard = Shard(content.as_py(), blob)
                crc, n = [], []
                for i in range(shard.n):
                    ids = shard.ids(i)
                    n.append(len(ids))
                    crc.append(zlib.crc32(ids.astype("<u4").tobytes()))
                first = start + shard.before + np.cumsum([0, *n], dtype=np.int64)[:-1]
                yield pa.record_batch(
                    [pa.array(shard.doc_ids.astype(np.int64), mask=shard.nulls.astype(bool)), pa.array(first, pa.int64()), pa.array(n, pa.int64()), pa.array(crc, pa.int64())],
                    ["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    placed = files.select("part", "content").join(F.broadcast(starts), "part")
    return placed.select("part_start", "content").mapInArrow(decode, TOKENS)


def read_document(spark: SparkSession, path: str, doc_id: int) -> list[int] | None:
    """Ids of one document: only shards whose range holds it are read, only its frame is decompressed."""
    blob = _read_dictionary(spark, path)
    files = spark.read.schema(SHARDS).parquet(f"{path}/shards").filter((F.col("first_doc") <= doc_id) & (F.col("last_doc") >= doc_id))
    for r in files.select("content").toLocalIterator():
        shard = Shard(bytes(r.content), blob)
        found = np.flatnonzero((shard.doc_ids == doc_id) & (shard.nulls == 0))
        if len(found):
            return shard.ids(int(found[0])).tolist()
    return None
