"""Execution of a request: one lazy plan for its hits, one for each of its aggregations.

    scan of the indexes -> query and filters, score -> vector neighbours -> min_score -> terminate_after
      |- aggregations                      (suggestions look at the whole index)
      `- post_filter -> total -> rescore -> sort, search_after -> collapse -> offset, limit -> fetch
"""

from __future__ import annotations

import time
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field
from functools import cached_property, reduce
from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.scoring import TextStats, collect_stats
from tessera.operators.aggs import Aggregator, kind_of
from tessera.operators.fetch import add_explanation, add_highlight, source_columns
from tessera.operators.knn import neighbours
from tessera.operators.joins import related_ids
from tessera.operators.sorting import Key, collapse, search_after, sort_keys, tie_breaks
from tessera.operators.suggest import suggest_tree, term_suggestions
from tessera.events import event
from tessera.plans.clauses import Clauses
from tessera.sources.tokens import PREFIX, column_of, stored_stats
from tessera.plans.compiler import Compiler, Part, Schema, joined_queries

PAGE = 10


class IndexMissing(LookupError):
    """An index that isn't there."""


@dataclass(eq=False)
class Hit:
    """One found document: source fields as attributes, metadata with an underscore."""

    data: dict = field(repr=False)
    id_field: str = "id"
    declared: frozenset = frozenset()
    index: Any = field(default=None, repr=False)

    @property
    def id(self) -> Any:
        return self.data.get(self.id_field, self.data.get("id", self.data["_id"])) if self.id_field else self.data["_id"]

    @property
    def id_text(self) -> str:
        return str(self.data["_id"])

    @property
    def attributes(self) -> dict:
        return {"id": self.id, **{k: v for k, v in self.data.items() if not k.startswith("_")}, "_score": self.data.get("_score"), "_explanation": self.data.get("_explanation")}

    def __getattr__(self, name: str) -> Any:
        data = self.__dict__.get("data", {})
        if name in data:
            return data[name]
        if name.endswith(("_highlights", "_highlight")):
            found = (data.get("_highlight") or {}).get(name.rsplit("_highlight", 1)[0]) or []
            return found if name.endswith("s") else next(iter(found), data.get(name.removesuffix("_highlight")))
        if name in self.__dict__.get("declared", ()):
            return None
        raise AttributeError(name)

    def __eq__(self, other: object) -> bool:
        if isinstance(other, Hit):
            return self.data["_index"] == other.data["_index"] and self.id_text == other.id_text
        return hasattr(other, "id") and str(other.id) == self.id_text

    def __hash__(self) -> int:
        return hash((self.data["_index"], self.id_text))


class Search:
    def __init__(self, clauses: Clauses, known: Mapping[str, Any]):
        self.clauses, self.known = clauses, known
        self.took = 0.0

    def value(self, name: str) -> Any:
        return self.clauses.value(name)

    # -- scan -------------------------------------------------------------------------------------------------

    @cached_property
    def indexes(self) -> list:
        out = []
        for name in self.clauses.get("indices").listed():
            index = self.known.get(name)
            if index is not None and index.exists():
                out.append(index)
            elif self.value("ignore_unavailable") is False:
                raise IndexMissing(f"no such index: {name}")
        return out

    @cached_property
    def spark(self) -> SparkSession:
        return self.indexes[0].spark if self.indexes else SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()

    @cached_property
    def scanned(self) -> DataFrame:
        """All documents of all indexes; columns that one lacks are null."""
        parts = [i.documents().withColumns({"_index": F.lit(i.name), "_id": F.col(f"`{i.id_column}`").cast("string")}) for i in self.indexes]
        if not parts:
            return self.spark.createDataFrame([], "_id string, _index string")
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)

    @cached_property
    def id_column(self) -> str:
        ids = {i.id_column for i in self.indexes}
        return ids.pop() if len(ids) == 1 else "_id"

    @cached_property
    def schema(self) -> Schema:
        merged: dict[str, dict] = {k: {} for k in ("analyzers", "search_analyzers", "aliases")}
        for i in self.indexes:
            for k in merged:
                merged[k] |= getattr(i, k)
        settings: dict = {}
        for i in self.indexes:
            for kind, entries in (i.settings.get("analysis") or {}).items():
                settings.setdefault(kind, {}).update(entries)
        nested = frozenset(p for i in self.indexes for p in i.nested)
        names = set(self.scanned.columns)
        stored = {p: column_of(p) for p in merged["analyzers"] if column_of(p) in names}
        return Schema(self.scanned.schema, self.id_column, **merged, nested=nested, settings=settings, stored=stored)

    # -- match ------------------------------------------------------------------------------------------------

    @cached_property
    def rendered(self) -> Any:
        return (self.clauses.render_query() or {}).get("query")

    @cached_property
    def needs_score(self) -> bool:
        order = self.value("order") or ()
        return not order or any("_score" in (o if isinstance(o, Mapping) else [o]) for o in order) or bool(self.value("track_scores") or self.value("min_score") is not None or self.value("rescore"))

    @cached_property
    def stats(self) -> Mapping[str, TextStats]:
        """Statistics of the terms that are scored: one job, and none if nothing is."""
        if not self.needs_score and not self.value("explain"):
            return {}
        plain, terms = Compiler(self.schema), {}
        for q in [self.rendered, *[r["query"]["rescore_query"] for w in self.value("rescore") or () for r in [w] if "query" in r]]:
            if q:
                plain.wanted_terms(q, terms)
        wanted = {f: ts for f, ts in terms.items() if f in self.schema.analyzers}
        held = [i.stored_terms() for i in self.indexes]
        if wanted and all(held):
            return stored_stats(held, wanted)
        return collect_stats(self.scanned, {f: plain.tokens(f) for f in terms}, terms)

    @cached_property
    def flagged(self) -> tuple[DataFrame, dict[int, str]]:
        """The scan with a column for each parent/child query, and those columns' names."""
        df, flags = self.scanned, {}
        queries = joined_queries([self.rendered, (self.clauses.get("post_filter").body() or {}).get("post_filter")])
        for n, (kind, body) in enumerate(queries):
            index = next((i for i in self.indexes if i.join_field), None)
            if index is None:
                raise ValueError("no index here has a join field")
            ids = related_ids(index, kind, body).select(F.col("id").alias(f"__r{n}")).distinct()
            at = index.join_field
            key = F.col(f"{at}.parent") if kind in ("has_parent", "parent_id") else F.col("_id")
            if kind == "parent_id":
                ids = ids.sparkSession.createDataFrame([(str(body["id"]),)], f"__r{n} string")
            df = df.join(ids, key == F.col(f"__r{n}"), "left")
            flags[id(body)] = f"__r{n}"
        return df, flags

    @cached_property
    def compiler(self) -> Compiler:
        return Compiler(self.schema, self.stats, flags=self.flagged[1])

    @cached_property
    def matched(self) -> DataFrame:
        """Documents that the query and the filters match, with their score."""
        df = self.flagged[0]
        knn = self.value("knn")
        part = self.compiler.compile(self.rendered) if self.rendered else Part(F.lit(True), F.lit(1.0), True)
        score = part.score if self.rendered else F.lit(1.0)
        scoring = self.needs_score or knn
        shown = score.cast("double") if scoring else F.lit(None).cast("double")
        if knn:
            # a document found both ways has the sum of both scores
            own = df.filter(part.certain()) if self.rendered else df.filter(F.lit(False))
            text = own.withColumn("_score", shown)
            near = neighbours(df, knn, self.compiler).select("_index", "_id", F.col("_near"))
            both = df.join(text.select("_index", "_id", F.col("_score").alias("__s")), ["_index", "_id"], "left").join(near, ["_index", "_id"], "left") if self.rendered else df.join(near, ["_index", "_id"]).withColumn("__s", F.lit(None).cast("double"))
            df = both.filter("__s is not null or _near is not null").withColumn("_score", F.coalesce("__s", F.lit(0.0)) + F.coalesce("_near", F.lit(0.0))).drop("__s", "_near")
        else:
            df = df.filter(part.test).withColumn("_score", shown)
        boosts = self.value("indices_boost")
        if boosts and scoring:
            by = F.lit(1.0)
            for name, factor in reversed(boosts):
                by = F.when(F.col("_index") == name, float(factor)).otherwise(by)
            df = df.withColumn("_score", F.col("_score") * by)
        if self.value("min_score") is not None:
            df = df.filter(F.col("_score") >= self.value("min_score"))
        stop = self.value("terminate_after")
        if stop:
            w = Window.partitionBy("_index").orderBy(*[k.order() for k in tie_breaks(df, self.id_column)[1:]])
            df = df.withColumn("__n", F.row_number().over(w)).filter(F.col("__n") <= stop).drop("__n")
        return df

    def hits(self) -> DataFrame:
        after = (self.clauses.get("post_filter").body() or {}).get("post_filter")
        return self.matched.filter(self.compiler.compile(after).test) if after else self.matched

    def total(self) -> int:
        return self.hits().count()

    # -- order and page ---------------------------------------------------------------------------------------

    def keys(self, df: DataFrame) -> list[Key]:
        order = self.value("order")
        return sort_keys(order or ("_score",), self.compiler) + tie_breaks(df, self.id_column)

    def rescored(self, df: DataFrame) -> DataFrame:
        """The best `window_size` hits get a second score; the others keep theirs, and their place behind."""
        for stage in self.value("rescore") or ():
            spec = stage["query"]
            size = int(stage.get("window_size", PAGE))
            top = df.orderBy(*[k.order() for k in self.keys(df)]).limit(size).select("_index", "_id", F.lit(1).alias("__top"))
            second = self.compiler.compile(spec["rescore_query"])
            a, b = float(spec.get("query_weight", 1)), float(spec.get("rescore_query_weight", 1))
            old, new = F.col("_score") * a, second.score * b
            how = {"total": old + new, "multiply": old * new, "avg": (old + new) / 2, "max": F.greatest(old, new), "min": F.least(old, new)}[spec.get("score_mode", "total")]
            df = df.join(F.broadcast(top), ["_index", "_id"], "left")  # `window_size` rows
            changed = F.when(F.col("__top").isNotNull(), F.when(second.certain(), how).otherwise(old)).otherwise(F.col("_score"))
            rank = F.coalesce("__top", F.lit(0))
            df = df.withColumn("_score", changed).withColumn("__rank", (F.coalesce("__rank", F.lit(0)) if "__rank" in df.columns else F.lit(0)) + rank).drop("__top")
        return df

    def ordered(self) -> tuple[DataFrame, list[Key]]:
        df = self.rescored(self.hits())
        keys = self.keys(df)
        if self.value("rescore") and not self.value("order"):
            keys = [Key(F.col("__rank"), True), *keys]
        if self.value("search_after"):
            df = search_after(df, keys, self.value("search_after"))
        if self.value("collapse"):
            df = collapse(df, self.compiler.col(self.value("collapse")["field"]), keys)
        return df, keys

    def page(self, everything: bool = False) -> DataFrame:
        df, keys = self.ordered()
        df = df.orderBy(*[k.order() for k in keys])
        if not everything:
            if self.value("offset"):
                df = df.offset(self.value("offset"))
            size = self.value("limit")
            df = df.limit(PAGE if size is None else size)
        return self.fetched(df, keys)

    def fetched(self, df: DataFrame, keys: list[Key] | None = None) -> DataFrame:
        if self.value("highlight"):
            df = add_highlight(df, self.value("highlight"), self.rendered, self.compiler)
        if self.value("explain"):
            df = add_explanation(df, self.rendered, self.compiler)
        for name, spec in (self.value("script_fields") or {}).items():
            df = df.withColumn(name, self.compiler.script(spec["script"]))
        source, stored = self.clauses.get("source"), self.clauses.get("stored_fields")
        docvalues = self.value("docvalue_fields") or ()
        own = T.StructType([f for f in self.scanned.schema.fields if f.name not in ("_id", "_index") and not f.name.startswith(PREFIX)])
        includes = list(source.value) + [f for f in stored.value]
        columns = source_columns(own, includes, list(source.excludes)) if source.on and stored.on else []
        extra = [c for c in ("_highlight", "_explanation", *(self.value("script_fields") or {})) if c in df.columns]
        if docvalues:
            arrays = [(c if self.compiler.is_array(f) else F.array(c)).alias(f) for f in docvalues for c in [self.compiler.col(f)]]
            df = df.withColumn("_fields", F.struct(*arrays))
            extra.append("_fields")
        if self.value("version"):
            df = df.withColumn("_version", F.lit(1).cast("long") if "_version" not in df.columns else F.col("_version"))
            extra.append("_version")
        return df.select("_index", "_id", "_score", *columns, *[F.col(f"`{c}`") for c in extra if c not in ("_score",)])

    def hit(self, row: Any) -> Hit:
        return self.hit_of(row.asDict(True))

    def hit_of(self, data: dict) -> Hit:
        index = self.known.get(data["_index"])
        return Hit(data, getattr(index, "id_column", "id"), frozenset(getattr(index, "field_names", ())), index)

    def collect(self) -> list[Hit]:
        began = time.monotonic()
        with event("search_query", request=self.clauses.render()):
            out = [self.hit(r) for r in self.page().collect()] if self.indexes else []
        self.took = time.monotonic() - began
        return out

    def batches(self, size: int) -> Iterator[list[Hit]]:
        """All hits in order (by score where none is given), read partition by partition; the driver holds one batch."""
        df, keys = self.ordered()
        df = df.orderBy(*[k.order() for k in keys])
        if self.value("limit") is not None:
            df = df.limit(self.value("limit"))
        batch: list[Hit] = []
        for row in self.fetched(df).toLocalIterator(prefetchPartitions=True):
            batch.append(self.hit(row))
            if len(batch) == size:
                yield batch
                batch = []
        if batch:
            yield batch

    # -- beside the hits --------------------------------------------------------------------------------------

    def aggregator(self, df: DataFrame | None = None) -> Aggregator:
        return Aggregator(self.matched if df is None else df, self.compiler, self.scanned.withColumn("_score", F.lit(1.0)), self.id_column)

    def aggregations(self) -> dict:
        """All aggregations as a tree; the matching documents are kept in memory and on disk between them."""
        defs = self.value("aggs") or {}
        if not defs or not self.indexes:
            return {}
        several = sum(kind_of(s)[0] not in ("avg", "sum", "min", "max", "value_count", "stats", "cardinality") for s in defs.values()) > 1
        held = self.matched.persist() if several else self.matched
        try:
            return self.aggregator(held).tree(defs)
        finally:
            if several:
                held.unpersist()

    def aggregation_frame(self, name: str, path: str | None = None) -> DataFrame:
        return self.aggregator().flat(name, self.value("aggs")[name], path)

    def suggestions(self) -> dict:
        return suggest_tree(self.scanned, self.compiler, self.value("suggest") or {}) if self.indexes else {}

    def suggestion_frame(self, name: str) -> DataFrame:
        spec = self.value("suggest")[name]
        return term_suggestions(self.scanned, self.compiler, spec.get("text", (self.value("suggest") or {}).get("text")), spec["term"])

    def profile(self) -> dict:
        """The page's physical plan, and what its phases took in milliseconds."""
        run = self.page()._jdf.queryExecution()
        mode = self.spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
        plan, phases = run.explainString(mode), run.tracker().phases()
        took = {n: phases.apply(n).durationMs() for n in ("analysis", "optimization", "planning") if phases.contains(n)}
        return {"plan": plan, "phases": took, "took": round(self.took * 1000)}

    def response(self, hits: list[Hit]) -> dict:
        total = self.total() if self.indexes else 0
        best = max((h.data["_score"] for h in hits if h.data["_score"] is not None), default=None) if not self.value("order") or self.value("track_scores") else None
        stop = self.value("terminate_after")
        profile = {"profile": self.profile()} if self.value("profile") and self.indexes else {}
        return profile | {
            "took": round(self.took * 1000), "timed_out": False, "terminated_early": bool(stop and total >= stop) if stop else None,
            "hits": {"total": {"value": total, "relation": "eq"}, "max_score": best, "hits": [h.data for h in hits]},
            "aggregations": self.aggregations(), "suggest": self.suggestions(),
        }


class MultiSearch:
    """Several requests as one: those that haven't run are run side by side, each on the columns and row groups it needs (a
    shared copy of the documents would have to hold all that any of them reads)."""

    def __init__(self, requests: list):
        self.requests = list(requests)

    def add_query(self, request: Any) -> None:
        self.requests.append(request)

    def perform(self, threads: int = 4) -> None:
        from concurrent.futures import ThreadPoolExecutor

        todo = [r for r in self.requests if not r.performed]
        with ThreadPoolExecutor(min(threads, len(todo) or 1)) as pool:
            list(pool.map(lambda r: r.hits(), todo))

    def responses(self) -> list:
        self.perform()
        return self.requests

