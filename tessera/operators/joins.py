"""Joins that searches and imports need: parents and children, descendants, lookups, source rows of hits."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Mapping
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def related_ids(index: Any, kind: str, body: Mapping) -> DataFrame:
    """`id`s to compare with: of parents that match (has_parent), or of documents with enough children that match."""
    from tessera.plans.request import Request

    at = index.join_field
    df = Request(index).filter(body.get("query", {"match_all": {}})).matching() if kind != "parent_id" else index.documents().withColumn("_id", F.col(f"`{index.id_column}`").cast("string"))
    if kind == "has_parent":
        name = body.get("parent_type", body.get("type"))
        return df.filter(F.col(f"{at}.name") == name).select(F.col("_id").alias("id"))
    if kind == "parent_id":
        return df.select(F.col("_id").alias("id"))
    own = df.filter(F.col(f"{at}.name") == body["type"]).groupBy(F.col(f"{at}.parent").alias("id")).agg(F.count("*").alias("n"))
    low, high = int(body.get("min_children", 1)), body.get("max_children")
    own = own.filter(F.col("n") >= max(low, 1))
    return (own.filter(F.col("n") <= int(high)) if high is not None else own).select("id")


def descendants(documents: DataFrame, ids: DataFrame, id_column: str, parent: Column, depth: int) -> DataFrame:
    """`id`, `level`: all documents below `ids` (level 0) by their parent; as many joins as relations are deep."""
    links = documents.select(F.col(f"`{id_column}`").cast("string").alias("id"), parent.cast("string").alias("parent")).filter("parent is not null")
    level = ids.select(F.col(ids.columns[0]).cast("string").alias("id")).distinct().withColumn("level", F.lit(0))
    out = level
    for n in range(1, depth + 1):
        level = links.join(level.select(F.col("id").alias("parent")), "parent").select("id", F.lit(n).alias("level"))
        out = out.unionByName(level)
    return out.groupBy("id").agg(F.min("level").alias("level"))


def lookup_one(df: DataFrame, other: DataFrame, on: str, key: str, columns: Mapping[str, str]) -> DataFrame:
    """Columns of the matching row of `other` (its key is unique); null where there is none."""
    side = other.select(F.col(key).alias("__key"), *[F.col(c).alias(n) for n, c in columns.items()])
    return df.join(side, df[on] == F.col("__key"), "left").drop("__key")


def lookup_many(df: DataFrame, other: DataFrame, on: str, key: str, name: str, element: Column, order: Column | None = None) -> DataFrame:
    """An array of what all matching rows give; empty where there is none."""
    item = F.struct(order.alias("o"), element.alias("e")) if order is not None else F.struct(element.alias("e"))
    listed = other.groupBy(F.col(key).alias("__key")).agg(F.transform(F.array_sort(F.collect_list(item)), lambda s: s["e"]).alias(name))
    empty = F.array().cast(listed.schema[name].dataType)
    joined = df.join(listed, df[on] == F.col("__key"), "left").drop("__key")
    return joined.withColumn(name, F.coalesce(name, empty))


def load_frame(hits: DataFrame, source: DataFrame, id_column: str, scope: Any = None) -> DataFrame:
    """Hits with their source row in `object` (null where the scope leaves none), in the hits' order by `position`."""
    side = scope(source) if scope else source
    side = side.select(F.col(f"`{id_column}`").cast("string").alias("__id"), F.struct(*[F.col(f"`{c}`") for c in side.columns]).alias("object"))
    return hits.join(side, F.col("_id") == F.col("__id"), "left").drop("__id")


def load_objects(hits: Iterable, indexes: Mapping[str, Any], options: Mapping) -> list:
    """Source rows of a page of hits, one query for each index, in the hits' order; None for rows that are gone."""
    hits = list(hits)
    wanted = defaultdict(list)
    for h in hits:
        wanted[h.data["_index"]].append(h.id_text)
    only = {str(getattr(i, "name", i)) for i in ([options["only"]] if isinstance(options.get("only"), str) else options.get("only") or [])}
    skip = {str(getattr(i, "name", i)) for i in ([options["except"]] if isinstance(options.get("except"), str) else options.get("except") or [])}
    rows: dict[tuple[str, str], Any] = {}
    for name, ids in wanted.items():
        index = indexes.get(name)
        if index is None or (only and name not in only) or name in skip:
            rows |= {(name, h.id_text): h for h in hits if h.data["_index"] == name}
            continue
        own = (options.get(name) or {}).get("scope") or options.get("scope")
        source = index.source_rows()
        source = own(source) if own else source
        key = F.col(f"`{index.source_id}`").cast("string")
        rows |= {(name, str(r[index.source_id])): r for r in source.filter(key.isin(ids)).collect()}
    return [rows.get((h.data["_index"], h.id_text)) for h in hits]
