"""Exact nearest neighbours of one query vector, as part of a search."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.sorting import tie_breaks
from tessera.plans.compiler import Compiler


def dot(c: Column, v: list[float]) -> Column:
    """Inner product with a constant vector, as a sum that code generation unrolls."""
    return reduce(lambda a, b: a + b, [c[i].cast("double") * F.lit(float(x)) for i, x in enumerate(v)])


def similarity(c: Column, v: list[float], kind: str) -> Column:
    """Scores as search engines define them: all positive, larger is nearer."""
    if kind == "l2_norm":
        return 1 / (1 + reduce(lambda a, b: a + b, [F.pow(c[i].cast("double") - F.lit(float(x)), 2) for i, x in enumerate(v)]))
    if kind == "dot_product":
        return (1 + dot(c, v)) / 2
    size = F.sqrt(F.aggregate(c, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))) * float(sum(float(x) ** 2 for x in v) ** 0.5)
    return (1 + dot(c, v) / F.when(size > 0, size)) / 2


def neighbours(df: DataFrame, knn: Mapping, compiler: Compiler) -> DataFrame:
    """The k nearest documents of each index, with `_near`; filters come before the choice."""
    v = [float(x) for x in knn["query_vector"]]
    c = compiler.col(knn["field"])
    if "filter" in knn:
        df = df.filter(compiler.compile(knn["filter"]).test)
    near = df.filter(c.isNotNull() & (F.size(c) == len(v))).withColumn("_near", similarity(c, v, knn.get("similarity", "cosine")))
    if knn.get("min_similarity") is not None:
        near = near.filter(F.col("_near") >= float(knn["min_similarity"]))
    k = int(knn.get("k", 10))
    boost = float(knn.get("boost", 1))
    w = Window.partitionBy("_index").orderBy(F.desc("_near"), *[t.order() for t in tie_breaks(near, compiler.schema.id_column)[1:]])
    # a window with a rank filter keeps k rows of each partition before it shuffles
    return near.withColumn("__k", F.row_number().over(w)).filter(F.col("__k") <= k).withColumn("_near", F.col("_near") * boost).drop("__k")
