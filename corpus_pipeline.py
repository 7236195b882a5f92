"""A corpus pipeline of four stages; each works on all that the stage before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import packing, quality, toxicity
from tessera.llm.common import save
from tessera.llm.queries import BYTE_BPE, graded, may_learn, table, tokenizer_path


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ordinal quality classifier: documents that don't reach the middle grade by even odds go."""
    return quality.keep_good(docs, quality.fit(docs, graded(table(spark, sf_dir, "labels"))))


def keep_clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Toxicity: documents whose score gets to 0.7 go."""
    return toxicity.keep_clean(docs, toxicity.fit(docs, may_learn(table(spark, sf_dir, "labels"))))


def keep_distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Near-duplicates: one document of each group stays, the one with the least id."""
    from tessera.llm import near_dup

    return near_dup.keep_one(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Harmonic packing into sequences of 2048 tokens."""
    return packing.pack(docs, tokenizer_path(BYTE_BPE), end_id=1, capacity=2048)


STAGES = [("quality", keep_good), ("toxicity", keep_clean), ("near_dedup", keep_distinct), ("packing", pack)]

#: The stages train models and follow links, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = save(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
