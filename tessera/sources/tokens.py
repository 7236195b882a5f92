"""Stored analysis: text is tokenised once, when documents are written; queries read the tokens.

Beside a document's columns stand its tokens, in a hidden column for each text field. Statistics of all terms (in how many
documents each occurs, and each field's documents and tokens) lie in a table sorted by field and term, so that a
query's terms are looked up in a few row groups.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.scoring import TextStats
from tessera.plans.compiler import Compiler, Schema

PREFIX = "__tokens_"


def column_of(path: str) -> str:
    return PREFIX + path.replace(".", "__")


def with_tokens(df: DataFrame, paths: list[str], schema: Schema) -> DataFrame:
    """`df` with the tokens of these fields; documents that lack a field have null."""
    plain = Compiler(schema)
    held = [p for p in paths if plain.schema.kind(p) is not None]
    return df.withColumns({column_of(p): plain.tokens(p).cast("array<string>") for p in held}) if held else df


class Terms:
    """The statistics, in a folder: `terms` (field, term, n) and `fields` (field, docs, tokens), which is written last."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def build(self, df: DataFrame, paths: list[str]) -> None:
        paths = [p for p in paths if column_of(p) in df.columns]
        by_field = [df.select(F.lit(p).alias("field"), F.col(column_of(p)).alias("t")).filter("t is not null") for p in paths]
        all_ = by_field[0] if by_field else self.spark.createDataFrame([], "field string, t array<string>")
        for more in by_field[1:]:
            all_ = all_.unionByName(more)
        terms = all_.select("field", F.explode(F.array_distinct("t")).alias("term")).groupBy("field", "term").agg(F.count("*").alias("n"))
        terms.repartitionByRange("field", "term").sortWithinPartitions("field", "term").write.mode("overwrite").option("parquet.block.size", str(16 << 20)).parquet(f"{self.folder}/terms")
        all_.groupBy("field").agg(F.count("*").alias("docs"), F.sum(F.size("t")).alias("tokens")).coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/fields")

    def counts(self, wanted: Mapping[str, set[str]]) -> tuple[dict, dict]:
        """Of fields: (docs, tokens); of (field, term): documents. Only the wanted terms are read."""
        fields = {r.field: (r.docs, r.tokens) for r in self.spark.read.schema("field string, docs long, tokens long").parquet(f"{self.folder}/fields").collect()}
        test = F.lit(False)
        for path, terms in wanted.items():
            test = test | ((F.col("field") == path) & F.col("term").isin(sorted(terms)))
        found = self.spark.read.schema("field string, term string, n long").parquet(f"{self.folder}/terms").filter(test).collect()
        return fields, {(r.field, r.term): r.n for r in found}


def stored_stats(all_terms: list[Terms], wanted: Mapping[str, set[str]]) -> dict[str, TextStats]:
    """Statistics of the wanted terms over several indexes."""
    parts = [t.counts(wanted) for t in all_terms]
    out = {}
    for path, terms in wanted.items():
        docs, tokens = (sum(fields.get(path, (0, 0))[i] or 0 for fields, _ in parts) for i in (0, 1))
        out[path] = TextStats(docs, tokens / docs if docs else 1.0, {t: sum(n.get((path, t), 0) for _, n in parts) for t in sorted(terms)})
    return out
