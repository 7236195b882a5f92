"""Aggregations: every definition becomes one flat DataFrame; trees are put together from the flat rows.

Buckets inside buckets are one aggregation over all keys on the way: a tree takes one job for each definition, whatever the
number of buckets. Metrics of the same level share an aggregation.
"""

from __future__ import annotations

import math
import re
from collections.abc import Mapping
from dataclasses import dataclass, field, replace
from datetime import datetime
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.plans.clauses import as_list
from tessera.plans.compiler import Compiler, every
from tessera.operators.sorting import sort_keys, tie_breaks

METRICS = {"avg", "sum", "min", "max", "value_count", "stats", "extended_stats", "cardinality", "percentiles", "percentile_ranks", "median_absolute_deviation", "weighted_avg", "geo_bounds", "geo_centroid"}
BUCKETS = {"terms", "histogram", "date_histogram", "range", "date_range", "filter", "filters", "missing", "global", "nested", "reverse_nested", "composite", "top_hits", "sampler", "significant_terms", "geotile_grid"}
PIPELINES = {"derivative", "cumulative_sum", "moving_fn", "moving_avg", "serial_diff", "bucket_sort", "bucket_script", "bucket_selector", "avg_bucket", "sum_bucket", "max_bucket", "min_bucket", "stats_bucket"}
SHIFTS = {"global", "nested", "reverse_nested", "sampler"}
NAMED = {"filters", "filter", "range", "date_range", "missing"}
PERCENTS = [1, 5, 25, 50, 75, 95, 99]
#: Calendar units of date histograms.
CALENDAR = {"minute": "MINUTE", "1m": "MINUTE", "hour": "HOUR", "1h": "HOUR", "day": "DAY", "1d": "DAY", "week": "WEEK", "1w": "WEEK", "month": "MONTH", "1M": "MONTH", "quarter": "QUARTER", "1q": "QUARTER", "year": "YEAR", "1y": "YEAR"}
SECONDS = {"ms": 0.001, "s": 1, "m": 60, "h": 3600, "d": 86400}


def subs(spec: Mapping) -> dict:
    return dict(spec.get("aggs") or spec.get("aggregations") or {})


def kind_of(spec: Mapping) -> tuple[str, dict]:
    for k, v in spec.items():
        if k in METRICS | BUCKETS | PIPELINES:
            return k, v or {}
    raise ValueError(f"unknown aggregation: {sorted(spec)}")


def metric_columns(name: str, kind: str, body: Mapping, c: Compiler) -> dict[str, Column]:
    """Columns of a metric: `name` itself, or `name.part`."""
    if kind in ("geo_bounds", "geo_centroid"):
        p = c.col(body["field"])
        if kind == "geo_centroid":
            return {f"{name}.lat": F.avg(p["lat"]), f"{name}.lon": F.avg(p["lon"]), f"{name}.count": F.count(p["lat"])}
        return {f"{name}.top": F.max(p["lat"]), f"{name}.left": F.min(p["lon"]), f"{name}.bottom": F.min(p["lat"]), f"{name}.right": F.max(p["lon"])}
    if kind == "weighted_avg":
        v, w = c.col(body["value"]["field"]), c.col(body["weight"]["field"])
        return {name: F.sum(v * w) / F.sum(F.when(v.isNotNull(), w))}
    v = c.script(body["script"]) if "script" in body else c.col(body["field"])
    if "missing" in body:
        v = F.coalesce(v, c.value(body["field"], body["missing"]))
    if "field" in body and c.is_array(body["field"]):
        number = lambda how: F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double"))
        many = {"min": lambda: F.min(F.array_min(v)), "max": lambda: F.max(F.array_max(v)), "sum": lambda: F.sum(number(v)), "value_count": lambda: F.sum(F.size(v)), "avg": lambda: F.sum(number(v)) / F.sum(F.size(v)), "cardinality": lambda: F.size(F.array_distinct(F.flatten(F.collect_set(v))))}
        if kind not in many:
            raise ValueError(f"{kind} of an array needs a nested aggregation")
        return {name: many[kind]()}
    plain = {"avg": F.avg, "sum": F.sum, "min": F.min, "max": F.max, "value_count": F.count}
    if kind in plain:
        return {name: plain[kind](v)}
    if kind == "cardinality":
        return {name: F.approx_count_distinct(v, float(body["rsd"])) if "rsd" in body else F.count_distinct(v)}
    if kind in ("stats", "extended_stats"):
        out = {f"{name}.count": F.count(v), f"{name}.min": F.min(v), f"{name}.max": F.max(v), f"{name}.avg": F.avg(v), f"{name}.sum": F.sum(v)}
        if kind == "extended_stats":
            out |= {f"{name}.sum_of_squares": F.sum(v * v), f"{name}.variance": F.var_pop(v), f"{name}.std_deviation": F.stddev_pop(v)}
        return out
    if kind == "percentiles":
        percents = [float(p) for p in body.get("percents", PERCENTS)]
        wanted = F.array(*[F.lit(p / 100) for p in percents])
        # one buffer for all; exact ones hold the group's distinct values, a sketch is bounded by its accuracy
        sketch = body.get("tdigest") or body.get("hdr")
        found = F.percentile_approx(v, wanted, int(sketch.get("compression", 100)) * 100) if sketch else F.percentile(v, wanted)
        return {f"{name}.{p:g}": found[i] for i, p in enumerate(percents)}
    if kind == "percentile_ranks":
        return {f"{name}.{x:g}": 100.0 * F.count_if(v <= x) / F.count(v) for x in map(float, body["values"])}
    # median absolute deviation: the group's median is there already (see Aggregator.aggregated)
    return {name: F.percentile(F.abs(v - F.col(f"`__median_{name}`")), 0.5)}


@dataclass(frozen=True)
class Level:
    """Rows that an aggregation looks at, and the columns that hold the keys of the buckets around it.

    shown: the names under which a flat result gives those columns.
    """

    df: DataFrame
    compiler: Compiler
    parents: list[str] = field(default_factory=list)
    shown: dict[str, str] = field(default_factory=dict)


class Aggregator:
    """Aggregations of one request over its matching documents."""

    def __init__(self, df: DataFrame, compiler: Compiler, everything: DataFrame, id_column: str):
        self.df, self.compiler, self.everything, self.id_column = df, compiler, everything, id_column

    # -- flat results -----------------------------------------------------------------------------------------

    def metrics(self, defs: Mapping[str, Mapping]) -> DataFrame:
        """All metrics of a level in one row."""
        return self.aggregated(self.df, [], defs, self.compiler).drop("doc_count")

    def key(self, kind: str, body: Mapping, at: Level) -> tuple[DataFrame, dict[str, Column]]:
        """The rows that a bucket aggregation looks at, and its key columns (one row may be in several buckets)."""
        df, c = at.df, at.compiler
        if kind == "geotile_grid":
            p, n = c.col(body["field"]), float(2 ** int(body.get("precision", 7)))
            lat = F.radians(F.least(F.greatest(p["lat"], F.lit(-85.05112878)), F.lit(85.05112878)))
            cell = lambda part: F.least(F.greatest(F.floor(part * n), F.lit(0.0)), F.lit(n - 1)).cast("long").cast("string")
            return df.filter(p["lat"].isNotNull()), {"key": F.concat_ws("/", F.lit(str(int(body.get("precision", 7)))), cell((p["lon"] + 180) / 360), cell((1 - F.log(F.tan(lat) + 1 / F.cos(lat)) / math.pi) / 2))}
        if kind in ("terms", "significant_terms"):
            v = c.script(body["script"]) if "script" in body else c.col(body["field"])
            if "field" in body and (c.is_array(body["field"]) or body["field"] in c.schema.analyzers):
                many = c.tokens(body["field"]) if body["field"] in c.schema.analyzers else v
                df = df.withColumn("__k", F.explode(F.array_distinct(many)))
                v = F.col("__k")
            if "missing" in body:
                v = F.coalesce(v, F.lit(body["missing"]))
            keep = v.isNotNull()
            for how in ("include", "exclude"):
                if how in body:
                    test = v.cast("string").rlike(f"^(?:{body[how]})$") if isinstance(body[how], str) else v.isin(as_list(body[how]))
                    keep = keep & (test if how == "include" else ~test)
            return df.filter(keep), {"key": v}
        if kind == "histogram":
            v = F.coalesce(c.col(body["field"]), F.lit(body["missing"])) if "missing" in body else c.col(body["field"])
            step, shift = float(body["interval"]), float(body.get("offset", 0))
            return df.filter(v.isNotNull()), {"key": F.floor((v - shift) / step) * step + shift}
        if kind == "date_histogram":
            v = c.col(body["field"])
            every_ = body.get("calendar_interval") or body.get("fixed_interval") or body.get("interval")
            if every_ in CALENDAR:
                return df.filter(v.isNotNull()), {"key": F.date_trunc(CALENDAR[every_], v)}
            m = re.fullmatch(r"(\d+)(ms|s|m|h|d)", every_)
            if not m:
                raise ValueError(f"unknown interval: {every_}")
            step = int(m[1]) * SECONDS[m[2]]
            return df.filter(v.isNotNull()), {"key": F.timestamp_seconds(F.floor(F.unix_micros(v.cast("timestamp")) / 1e6 / step) * step)}
        if kind in ("range", "date_range"):
            v = c.col(body["field"])
            found = []
            for r in body["ranges"]:
                test = every([v.isNotNull(), *([v >= c.value(body["field"], r["from"])] if "from" in r else []), *([v < c.value(body["field"], r["to"])] if "to" in r else [])])
                text = r.get("key") or f"{r.get('from', '*')}-{r.get('to', '*')}"
                found.append(F.when(test, F.lit(text)))
            return df.withColumn("__k", F.explode(F.array_compact(F.array(*found)))), {"key": F.col("__k")}
        if kind in ("filter", "filters", "missing"):
            named = {"_": body} if kind == "filter" else {"_": {"missing": body}} if kind == "missing" else body["filters"]
            if not isinstance(named, Mapping):
                named = {str(i): q for i, q in enumerate(named)}
            tests = {n: c.compile(q).certain() for n, q in named.items()}
            found = [F.when(t, F.lit(n)) for n, t in tests.items()]
            if body.get("other_bucket_key") and kind == "filters":
                found.append(F.when(~reduce_or(list(tests.values())), F.lit(body["other_bucket_key"])))
            return df.withColumn("__k", F.explode(F.array_compact(F.array(*found)))), {"key": F.col("__k")}
        if kind == "composite":
            columns = {}
            for source in body["sources"]:
                name, spec = next(iter(source.items()))
                inner, rest = kind_of(spec)
                df, own = self.key(inner, rest, replace(at, df=df))
                columns[name] = own["key"]
            return df, columns
        raise ValueError(f"{kind} has no key")

    def flat(self, name: str, spec: Mapping, path: str | None = None) -> DataFrame:
        """One aggregation as a DataFrame: key columns, doc_count, and the metrics below it (as `metric` or `metric.part`).

        Buckets inside it become further key columns (`key`, then the inner aggregations' names). path: which of them, by
        names with `>` between; "" for none. Without a path the only one on each level is followed. Outer buckets without any
        inner one are there with a null inner key and 0 documents.
        """
        kind, body = kind_of(spec)
        if kind in METRICS:
            return self.metrics({name: spec})
        way = None if path is None else [p for p in path.split(">") if p]
        out, shown = self.flat_level(Level(self.df, self.compiler), name, spec, way)
        return out.select(*[F.col(f"`{c}`").alias(shown.get(c, c)) for c in out.columns])

    def flat_level(self, at: Level, name: str, spec: Mapping, path: list[str] | None) -> tuple[DataFrame, dict[str, str]]:
        kind, body = kind_of(spec)
        inside = subs(spec)
        if kind == "top_hits":
            return self.top_hits(body, at), at.shown
        if kind in SHIFTS:
            inner = self.shifted(kind, body, at)
            if (below := self.chosen(inside, path)) is not None:
                return self.flat_level(inner, below, inside[below], path[1:] if path else path)
            return self.aggregated(inner.df, inner.parents, inside, inner.compiler), at.shown
        out, inner = self.level(at, name, spec)
        if (below := self.chosen(inside, path)) is None:
            return out, inner.shown
        kept = out.select(*inner.parents)
        inner = replace(inner, df=inner.df.join(F.broadcast(kept), inner.parents, "left_semi"))
        deeper, shown = self.flat_level(inner, below, inside[below], path[1:] if path else path)
        whole = kept.join(deeper, inner.parents, "left")
        return (whole.withColumn("doc_count", F.coalesce("doc_count", F.lit(0))) if "doc_count" in deeper.columns else whole), shown

    @staticmethod
    def chosen(inside: Mapping, path: list[str] | None) -> str | None:
        """The inner bucket aggregation to go on with."""
        names = [n for n, s in inside.items() if kind_of(s)[0] in BUCKETS]
        if path is not None:
            if path and path[0] not in names:
                raise ValueError(f"no inner aggregation {path[0]!r} among {names}")
            return path[0] if path else None
        if len(names) > 1:
            raise ValueError(f"several inner aggregations, choose one by path: {names}")
        return names[0] if names else None

    def shifted(self, kind: str, body: Mapping, at: Level) -> Level:
        """The rows that a nested, reverse_nested or global aggregation looks at."""
        if kind == "global":
            return Level(self.everything, self.compiler)
        if kind == "nested":
            rows = at.df.select("*", F.explode(at.compiler.col(body["path"])).alias("__e"))
            return Level(rows, Compiler(self.compiler.schema, self.compiler.stats, F.col("__e"), body["path"], self.compiler.flags), at.parents, at.shown)
        if kind == "sampler":  # the best documents of each parent, by score and then by id
            order = [F.col("_score").desc_nulls_last(), *[k.order() for k in tie_breaks(at.df, self.id_column)]]
            place = F.row_number().over(Window.partitionBy(*(at.parents or [F.lit(1)])).orderBy(*order))
            return Level(at.df.withColumn("__n", place).filter(F.col("__n") <= int(body.get("shard_size", 100))).drop("__n"), at.compiler, at.parents, at.shown)
        plain = Compiler(self.compiler.schema, self.compiler.stats, flags=self.compiler.flags)
        return Level(at.df.dropDuplicates(["_index", "_id", *at.parents]), plain, at.parents, at.shown)

    @staticmethod
    def aggregated(df: DataFrame, by: list[str], inside: Mapping, compiler: Compiler) -> DataFrame:
        """doc_count and all metrics of `inside` for each group; medians that deviations start from are found before."""
        metrics = {n: kind_of(s) for n, s in inside.items() if kind_of(s)[0] in METRICS}
        middle = {n: compiler.col(body["field"]) for n, (kind, body) in metrics.items() if kind == "median_absolute_deviation"}
        if middle:
            medians = F.broadcast(df.groupBy(*by).agg(*[F.percentile(v, 0.5).alias(f"__median_{n}") for n, v in middle.items()]))
            df = df.join(medians, by) if by else df.join(medians)
        columns = {k: v for n, (kind, body) in metrics.items() for k, v in metric_columns(n, kind, body, compiler).items()}
        return df.groupBy(*by).agg(F.count("*").alias("doc_count"), *[v.alias(k) for k, v in columns.items()])

    def level(self, at: Level, name: str, spec: Mapping) -> tuple[DataFrame, Level]:
        """The buckets of one aggregation within each of its parents, by one aggregation over all keys on the way, and the rows
        marked with their keys, for what is inside. Keys have columns of their own (see Level.parents)."""
        kind, body = kind_of(spec)
        inside = subs(spec)
        pipes = {n: s for n, s in inside.items() if kind_of(s)[0] in PIPELINES}
        df, keys = self.key(kind, body, at)
        shown = {f"__k{len(at.parents)}_{i}": k if not at.parents else name if k == "key" else f"{name}.{k}" for i, k in enumerate(keys)}
        own = list(shown)
        df = df.withColumns(dict(zip(own, keys.values(), strict=True)))
        out = self.aggregated(df, [*at.parents, *own], inside, at.compiler)
        if kind in NAMED:
            out = self.all_named(kind, body, out, own[0], at)
        if kind in ("histogram", "date_histogram"):
            out = self.filled(kind, body, out, own[0], at.parents)
        if kind == "significant_terms":
            out = self.significant(body, out, own[0], df, at)
        if "min_doc_count" in body and kind != "significant_terms":
            out = out.filter(F.col("doc_count") >= int(body["min_doc_count"]))
        if pipes:
            out = self.piped(pipes, out, own[0], at.parents)
        if kind == "composite":
            out = self.composite(body, out, own, list(keys))
        if kind == "terms":
            order, size = self.term_order(body.get("order"), own[0]), int(body.get("size", 10))
            if at.parents:
                place = F.row_number().over(Window.partitionBy(*at.parents).orderBy(*order))
                out = out.withColumn("__place", place).filter(F.col("__place") <= size).drop("__place")
            else:
                out = out.orderBy(*order).limit(size)
        return out, Level(df.drop("__k"), at.compiler, [*at.parents, *own], at.shown | shown)

    def significant(self, body: Mapping, out: DataFrame, key: str, df: DataFrame, at: Level) -> DataFrame:
        """Terms that are more frequent here than in all documents: doc_count, bg_count and score, the largest first.

        With the shares here and there, score = (here - there) * here / there.
        """
        rows, keys = self.key("terms", body, Level(self.everything, at.compiler))
        behind = rows.groupBy(keys["key"].alias(key)).agg(F.count("*").alias("bg_count"))
        total = self.everything.agg(F.count("*").alias("__all"))
        own = at.df.groupBy(*at.parents).agg(F.count("*").alias("__own"))
        both = out.join(behind, key).join(F.broadcast(total))
        both = both.join(own, at.parents) if at.parents else both.join(F.broadcast(own))
        here, there = F.col("doc_count") / F.col("__own"), F.col("bg_count") / F.col("__all")
        scored = both.withColumn("score", (here - there) * here / there).drop("__all", "__own").filter((F.col("score") > 0) & (F.col("doc_count") >= int(body.get("min_doc_count", 3))))
        place = F.row_number().over(Window.partitionBy(*(at.parents or [F.lit(1)])).orderBy(F.desc("score"), key))
        return scored.withColumn("__place", place).filter(F.col("__place") <= int(body.get("size", 10))).orderBy(*at.parents, "__place").drop("__place")

    @staticmethod
    def term_order(order: Any, key: str) -> list[Column]:
        out = []
        for item in as_list(order) or [{"_count": "desc"}]:
            for name, way in item.items():
                c = F.col("doc_count") if name == "_count" else F.col(key) if name in ("_key", "_term") else F.col(f"`{name}`")
                out.append(c.desc_nulls_last() if str(way).lower() == "desc" else c.asc_nulls_last())
        return [*out, F.col(key).asc()]

    def all_named(self, kind: str, body: Mapping, out: DataFrame, key: str, at: Level) -> DataFrame:
        """Named buckets are there even if they are empty, within each of the parents."""
        if kind in ("filter", "missing"):
            named = ["_"]
        elif kind == "filters":
            named = [*body["filters"]] if isinstance(body["filters"], Mapping) else [str(i) for i in range(len(body["filters"]))]
            named += [body["other_bucket_key"]] if body.get("other_bucket_key") else []
        else:
            named = [r.get("key") or f"{r.get('from', '*')}-{r.get('to', '*')}" for r in body["ranges"]]
        around = at.df.select(*at.parents).distinct() if at.parents else out.sparkSession.range(1).select()
        every_ = around.select(*at.parents, F.explode(F.array(*[F.lit(n) for n in named])).alias(key))
        full = every_.join(out, [*at.parents, key], "left")
        return full.withColumn("doc_count", F.coalesce("doc_count", F.lit(0)))

    def filled(self, kind: str, body: Mapping, out: DataFrame, key: str, parents: list[str]) -> DataFrame:
        """Buckets between a parent's first and last that no document falls into, with 0 documents."""
        if int(body.get("min_doc_count", 0)) > 0:
            return out
        ends = out.groupBy(*parents).agg(F.min(key).alias("__a"), F.max(key).alias("__b")).filter("__a is not null")
        if kind == "histogram":
            step = float(body["interval"])
            bounds = body.get("extended_bounds", {})
            low = F.least("__a", F.lit(bounds["min"]).cast("double")) if "min" in bounds else F.col("__a")
            high = F.greatest("__b", F.lit(bounds["max"]).cast("double")) if "max" in bounds else F.col("__b")
            n = F.round((high - low) / step).cast("long")
            grid = ends.select(*parents, F.explode(F.sequence(F.lit(0).cast("long"), n)).alias("__i"), low.alias("__a")).select(*parents, (F.col("__a") + F.col("__i") * step).alias(key))
        else:
            every_ = body.get("calendar_interval") or body.get("fixed_interval") or body.get("interval")
            m = re.fullmatch(r"(\d+)(ms|s|m|h|d)", every_) if every_ not in CALENDAR else None
            step = f"interval {int(float(m[1]) * SECONDS[m[2]])} seconds" if m else {"QUARTER": "interval 3 months"}.get(CALENDAR[every_], f"interval 1 {CALENDAR[every_].lower()}")
            grid = ends.select(*parents, F.explode(F.expr(f"sequence(__a, __b, {step})")).alias(key))
        return grid.join(out, [*parents, key], "left").withColumn("doc_count", F.coalesce("doc_count", F.lit(0)))

    def composite(self, body: Mapping, out: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
        ways = [str(kind_of(next(iter(s.values())))[1].get("order", "asc")).lower() == "desc" for s in body["sources"]]
        if "after" in body:
            after = [body["after"][n] for n in names]
            tests = []
            for i, (k, down) in enumerate(zip(keys, ways, strict=True)):
                here = F.col(k) < F.lit(after[i]) if down else F.col(k) > F.lit(after[i])
                tests.append(every([F.col(j) == F.lit(v) for j, v in zip(keys[:i], after[:i], strict=True)] + [here]))
            out = out.filter(reduce_or(tests))
        return out.orderBy(*[F.desc(k) if d else F.asc(k) for k, d in zip(keys, ways, strict=True)]).limit(int(body.get("size", 10)))

    def piped(self, pipes: Mapping, out: DataFrame, key: str, parents: list[str]) -> DataFrame:
        """Pipeline aggregations over the buckets of a parent in the order of their key. A parent's buckets are few."""
        w = Window.partitionBy(*parents).orderBy(key) if parents else Window.orderBy(key)
        path = lambda p: F.col("doc_count") if p == "_count" else F.col(key) if p == "_key" else F.col(f"`{p}`")
        for name, spec in pipes.items():
            kind, body = kind_of(spec)
            if kind == "cumulative_sum":
                out = out.withColumn(name, F.sum(path(body["buckets_path"])).over(w.rowsBetween(Window.unboundedPreceding, 0)))
            elif kind == "derivative":
                v = path(body["buckets_path"])
                out = out.withColumn(name, v - F.lag(v).over(w))
            elif kind == "serial_diff":
                v = path(body["buckets_path"])
                out = out.withColumn(name, v - F.lag(v, int(body.get("lag", 1))).over(w))
            elif kind in ("moving_fn", "moving_avg"):
                size, shift = int(body.get("window", 5)), int(body.get("shift", 0))
                how = next((f for n, f in (("max", F.max), ("min", F.min), ("sum", F.sum), ("stdDev", F.stddev_pop)) if n in str(body.get("script", ""))), F.avg)
                out = out.withColumn(name, how(path(body["buckets_path"])).over(w.rowsBetween(-size + shift, -1 + shift)))
            elif kind in ("bucket_script", "bucket_selector"):
                script = body["script"]["source"] if isinstance(body["script"], Mapping) else body["script"]
                for var, p in body["buckets_path"].items():
                    at = "doc_count" if p == "_count" else p
                    script = re.sub(rf"\b(?:params\.)?{re.escape(var)}\b", lambda _, at=at: f"`{at}`", script)
                out = out.filter(F.expr(script)) if kind == "bucket_selector" else out.withColumn(name, F.expr(script))
            elif kind == "bucket_sort":
                orders = [(next(iter(s.items())) if isinstance(s, Mapping) else (s, "asc")) for s in as_list(body.get("sort"))]
                by = [path(p).desc() if str(o.get("order") if isinstance(o, Mapping) else o) == "desc" else path(p).asc() for p, o in orders]
                a = int(body.get("from", 0))
                place = F.row_number().over((Window.partitionBy(*parents) if parents else Window.partitionBy()).orderBy(*by, F.col(key)))
                out = out.withColumn("__place", place).filter(F.col("__place").between(a + 1, a + int(body["size"])) if "size" in body else F.col("__place") > a).drop("__place")
                out = out if parents else out.orderBy(*by, F.col(key))
        return out

    def top_hits(self, body: Mapping, at: Level) -> DataFrame:
        """The best documents, of each bucket: key columns, hit_rank, and the document's columns."""
        df, order = at.df, as_list(body.get("sort"))
        plain = [c for c in df.columns if not c.startswith("__") and c != "hit_rank"]
        keys = sort_keys(tuple(order), at.compiler) or ([k for k in sort_keys(("_score",), at.compiler)] if "_score" in df.columns else [])
        w = Window.partitionBy(*(at.parents or [F.lit(1)])).orderBy(*[k.order() for k in keys + tie_breaks(df, self.id_column)])
        a = int(body.get("from", 0))
        ranked = df.withColumn("hit_rank", F.row_number().over(w)).filter(F.col("hit_rank").between(a + 1, a + int(body.get("size", 3))))
        wanted = body.get("_source", {}).get("includes") if isinstance(body.get("_source"), Mapping) else body.get("_source") if isinstance(body.get("_source"), list) else None
        columns = [c for c in plain if wanted is None or c in wanted or c in ("_id", "_index")]
        return ranked.select(*at.parents, "hit_rank", *columns)

    # -- trees ------------------------------------------------------------------------------------------------

    def tree(self, defs: Mapping[str, Mapping]) -> dict:
        """All definitions as the nested result that a search response holds: a job for each definition, not for each bucket."""
        return self.trees(defs, Level(self.df, self.compiler), [()])[()]

    def trees(self, defs: Mapping[str, Mapping], at: Level, wanted: list[tuple]) -> dict[tuple, dict]:
        """Results of the definitions within each wanted parent, by the parent's keys."""
        out: dict[tuple, dict] = {k: {} for k in wanted}
        metrics = {n: s for n, s in defs.items() if kind_of(s)[0] in METRICS}
        if metrics:
            for r in self.aggregated(at.df, at.parents, metrics, at.compiler).collect():
                if (k := tuple(r[p] for p in at.parents)) in out:
                    out[k] |= metric_tree(metrics, r.asDict())
        for name, spec in defs.items():
            if name not in metrics and kind_of(spec)[0] not in PIPELINES:
                found, none = self.branch(name, spec, at)
                for k in wanted:
                    out[k][name] = found.get(k, none)
        for name, spec in defs.items():
            kind, body = kind_of(spec)
            if kind.endswith("_bucket"):
                first, path = body["buckets_path"].split(">")
                fold = {"avg_bucket": lambda v: sum(v) / len(v), "sum_bucket": sum, "max_bucket": max, "min_bucket": min}
                for own in out.values():
                    values = [v for v in (dig(b, path) for b in own[first]["buckets"]) if v is not None]
                    if kind == "stats_bucket":
                        own[name] = {"count": len(values), "min": min(values, default=None), "max": max(values, default=None), "avg": sum(values) / len(values) if values else None, "sum": sum(values)}
                    else:
                        own[name] = {"value": fold[kind](values) if values else None}
        return out

    def branch(self, name: str, spec: Mapping, at: Level) -> tuple[dict[tuple, dict], dict]:
        """One definition's results by the parents' keys, and what parents without any have."""
        kind, body = kind_of(spec)
        inside = subs(spec)
        if kind == "top_hits":
            hits: dict[tuple, list] = {}
            for r in self.top_hits(body, at).orderBy("hit_rank").collect():
                hits.setdefault(tuple(r[p] for p in at.parents), []).append({k: v for k, v in r.asDict(True).items() if k != "hit_rank" and k not in at.parents})
            return {k: {"hits": {"hits": v}} for k, v in hits.items()}, {"hits": {"hits": []}}
        if kind in SHIFTS:
            inner = self.shifted(kind, body, at)
            counts = {tuple(r[p] for p in inner.parents): r["doc_count"] for r in inner.df.groupBy(*inner.parents).agg(F.count("*").alias("doc_count")).collect()}
            below = self.trees(inside, inner, list(counts))
            return {k: {"doc_count": n, **below[k]} for k, n in counts.items()}, {"doc_count": 0}
        frame, inner = self.level(at, name, spec)
        rows = frame.collect()  # buckets, which the result holds all
        metrics = {n: s for n, s in inside.items() if kind_of(s)[0] in METRICS | PIPELINES}
        deeper = {n: s for n, s in inside.items() if kind_of(s)[0] in BUCKETS}
        own = inner.parents[len(at.parents) :]
        keys = [tuple(r[p] for p in inner.parents) for r in rows]
        below: dict[tuple, dict] = {}
        if deeper:
            spark, schema = inner.df.sparkSession, frame.select(*inner.parents).schema
            kept = inner.df.join(F.broadcast(spark.createDataFrame(keys, schema)), inner.parents, "left_semi") if keys else inner.df
            below = self.trees(deeper, replace(inner, df=kept), keys)
        buckets: dict[tuple, list[dict]] = {}
        for r, k in zip(rows, keys, strict=True):
            given = k[len(at.parents) :]
            plain = given[0] if [inner.shown[c].rpartition(".")[2] for c in own] == ["key"] or len(own) == 1 and kind != "composite" else {inner.shown[c].removeprefix(f"{name}.") if at.parents else inner.shown[c]: v for c, v in zip(own, given, strict=True)}
            extra = {c: r[c] for c in ("score", "bg_count") if kind == "significant_terms"}
            b = {"key": plain, "doc_count": r["doc_count"], **extra, **metric_tree(metrics, r.asDict(True)), **below.get(k, {})}
            if isinstance(plain, datetime):
                b["key_as_string"] = plain.isoformat()
            buckets.setdefault(k[: len(at.parents)], []).append(b)

        def result(found: list[dict]) -> dict:
            if kind in ("filter", "missing"):
                return {k: v for k, v in found[0].items() if k != "key"} if found else {"doc_count": 0}
            if kind == "filters" and isinstance(body["filters"], Mapping):
                return {"buckets": {b["key"]: {k: v for k, v in b.items() if k != "key"} for b in found}}
            if kind in ("histogram", "date_histogram"):
                found = sorted(found, key=lambda b: b["key"])
            out: dict = {"buckets": found}
            if kind == "composite" and found:
                out["after_key"] = found[-1]["key"]
            return out

        return {k: result(v) for k, v in buckets.items()}, result([])


def dig(bucket: Mapping, path: str) -> Any:
    if path == "_count":
        return bucket["doc_count"]
    name, _, part = path.partition(".")
    return bucket[name].get(part or "value")


def reduce_or(tests: list[Column]) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out


def metric_tree(defs: Mapping[str, Mapping], row: Mapping) -> dict:
    out: dict = {}
    for name, spec in defs.items():
        kind, _ = kind_of(spec)
        if name in row:
            out[name] = {"value": row[name]}
            continue
        parts = {k[len(name) + 1 :]: v for k, v in row.items() if k.startswith(name + ".")}
        if parts:
            out[name] = {"values": parts} if kind.startswith("percentile") else parts
    return out
