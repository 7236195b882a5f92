"""Queries of the training-data operators: each applies one operator to its whole table.

Digest columns are derived here; the operators keep their general interfaces.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import kmtree, licenses, near_dup, packing, quality, spm, tokenout, toxicity, url_filter, vafile, vectors
from tessera.llm.common import save, scratch

BYTE_BPE = "byte_bpe_50k.json"
PIECE_BPE = "piece_bpe_32k.model"
BYTE_BPE_SIZE = 50257


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def graded(labels: DataFrame) -> DataFrame:
    """doc_id, grade: 0 for poor text, 1 for good text that is toxic, 2 for good text that isn't."""
    grade = F.when(F.col("quality") == 0, 0.0).when((F.col("quality") == 1) & (F.col("toxic") == 1), 1.0).when(F.col("quality") == 1, 2.0)
    return labels.select("doc_id", grade.alias("grade"))


def crc_thirds(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 3."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3


def may_learn(labels: DataFrame) -> DataFrame:
    """doc_id, toxic of the rows that may be learned from."""
    return labels.filter(crc_thirds(F.col("doc_id")) != 1).select("doc_id", "toxic")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected grade, tail probability and decision of every document; held_out: never learned from."""
    docs = table(spark, sf_dir, "documents")
    ratings = graded(table(spark, sf_dir, "labels").filter(crc_thirds(F.col("doc_id")) != 1))
    scored = quality.classify(docs, quality.fit(docs, ratings))
    return scored.withColumn("held_out", F.coalesce(crc_thirds(F.col("doc_id")) == 1, F.lit(False)))


def op2_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path(BYTE_BPE), end_id=1, capacity=2048)


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spm.round_trip(table(spark, sf_dir, "documents"), tokenizer_path(PIECE_BPE))


def op5_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, class_id, keep, copy of every document."""
    return near_dup.classes(table(spark, sf_dir, "documents"))


def op6_vafile(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = save(vafile.whole_numbers(vectors.finite(table(spark, sf_dir, "embeddings"), "vec_id", "embedding"), 256.0), "va-rows")
    return vafile.search(whole, whole.filter("id % 50 = 0"), k=5)


def op7_kmtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = vectors.finite(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return kmtree.search(good, good.filter("id % 50 = 0"), k=5)


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, may_learn(table(spark, sf_dir, "labels")))
    scored = toxicity.score(docs, model)
    held_out = F.coalesce(crc_thirds(F.col("doc_id")) == 1, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"), "n_spans", "spans")


def op10_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "tokens")
    tokenout.write_tokens(table(spark, sf_dir, "documents"), path, tokenizer_path(BYTE_BPE), end_id=2, vocabulary=BYTE_BPE_SIZE)
    return tokenout.read_tokens(spark, path)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality": op1_quality,
        "op2_urls": op2_urls,
        "op3_packing": op3_packing,
        "op4_sentencepiece": op4_sentencepiece,
        "op5_near_dup": op5_near_dup,
        "op6_vafile": op6_vafile,
        "op7_kmtree": op7_kmtree,
        "op8_licenses": op8_licenses,
        "op9_toxicity": op9_toxicity,
        "op10_tokens": op10_tokens,
    }


#: Inner products of floor(256 x) in DuckDB; ties to the smaller id.
OP6_SQL = """
WITH good AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM good q JOIN good c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM scored
)
SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, score FROM ranked WHERE r <= 5
"""


def oracle_sql() -> dict[str, str]:
    return {"op6_vafile": OP6_SQL}
