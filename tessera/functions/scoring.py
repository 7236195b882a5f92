"""Relevance: statistics of the query's terms in one aggregation, and the score as a column expression."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Saturation and length normalisation of BM25.
K1, B = 1.2, 0.75


@dataclass(frozen=True)
class TextStats:
    """Documents that have the field, their mean token count, and documents by term."""

    docs: int
    mean: float
    with_term: dict[str, int]

    def idf(self, term: str) -> float:
        n = self.with_term.get(term, 0)
        return math.log(1 + (self.docs - n + 0.5) / (n + 0.5))


def collect_stats(df: DataFrame, tokens: dict[str, Column], terms: dict[str, set[str]]) -> dict[str, TextStats]:
    """Statistics of each field's terms over the whole index: one job, whatever the number of terms."""
    wanted = {f: sorted(ts) for f, ts in terms.items() if f in tokens}
    if not wanted:
        return {}
    held = df.select(*[tokens[f].alias(f"t{i}") for i, f in enumerate(wanted)])
    parts = []
    for i, ts in enumerate(wanted.values()):
        t = F.col(f"t{i}")
        parts += [F.count(t).alias(f"n{i}"), F.avg(F.size(t)).alias(f"l{i}")]
        parts += [F.count_if(F.array_contains(t, x)).alias(f"d{i}_{j}") for j, x in enumerate(ts)]
    row = held.agg(*parts).first()
    return {f: TextStats(row[f"n{i}"], row[f"l{i}"] or 1.0, {x: row[f"d{i}_{j}"] for j, x in enumerate(ts)}) for i, (f, ts) in enumerate(wanted.items())}


def bm25(tokens: Column, term: str, stats: TextStats) -> Column:
    """One term's part of the score; 0 for documents without it."""
    tf = F.size(F.filter(tokens, lambda t: t == term)).cast("double")
    norm = K1 * (1 - B + B * F.size(tokens) / F.lit(stats.mean))
    return F.when(tf > 0, F.lit(stats.idf(term)) * tf * (1.0) / (tf + norm)).otherwise(0.0)
