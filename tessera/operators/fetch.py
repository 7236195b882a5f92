"""The fetch phase: which columns come back, highlighted fragments, scripted fields, explanations."""

from __future__ import annotations

import fnmatch
import re
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.scoring import bm25
from tessera.plans.clauses import as_list
from tessera.plans.compiler import Compiler

META = ("_index", "_id", "_score")


def leaf_paths(schema: T.StructType, at: str = "") -> list[str]:
    out = []
    for f in schema.fields:
        path = f"{at}{f.name}"
        out += leaf_paths(f.dataType, path + ".") if isinstance(f.dataType, T.StructType) else [path]
    return out


def chosen(path: str, includes: list[str], excludes: list[str]) -> bool:
    hit = lambda p: fnmatch.fnmatchcase(path, p) or path.startswith(p + ".")
    return (not includes or any(map(hit, includes))) and not any(map(hit, excludes))


def source_columns(schema: T.StructType, includes: list[str], excludes: list[str]) -> list[Column]:
    """Top-level columns, with structs cut down to the chosen leaves; the scan reads no other."""
    kept = {p for p in leaf_paths(schema) if chosen(p, includes, excludes)}

    def build(struct: T.StructType, c: Column | None, at: str) -> list[Column]:
        out = []
        for f in struct.fields:
            path, own = at + f.name, F.col(f"`{f.name}`") if c is None else c[f.name]
            if isinstance(f.dataType, T.StructType):
                parts = build(f.dataType, own, path + ".")
                if parts:
                    out.append(F.when(own.isNotNull(), F.struct(*parts)).alias(f.name))
            elif path in kept:
                out.append(own.alias(f.name))
        return out

    return build(schema, None, "")


def highlight_column(c: Column, terms: list[str], spec: Mapping) -> Column:
    """Fragments of a text that hold a term, best first come first; the whole text marked if number_of_fragments is 0."""
    pre, post = as_list(spec.get("pre_tags", "<em>"))[0], as_list(spec.get("post_tags", "</em>"))[0]
    if not terms:
        return F.array().cast("array<string>")
    pattern = r"(?iu)(?<![\p{L}\p{N}])(" + "|".join(re.escape(t) for t in sorted(terms, key=len, reverse=True)) + r")(?![\p{L}\p{N}])"
    mark = lambda x: F.regexp_replace(x, pattern, re.sub(r"([\\$])", r"\\\1", pre) + "$1" + re.sub(r"([\\$])", r"\\\1", post))
    if int(spec.get("number_of_fragments", 5)) == 0:
        return F.when(c.rlike(pattern), F.array(mark(c))).otherwise(F.array().cast("array<string>"))
    size = int(spec.get("fragment_size", 100))
    pieces = F.regexp_extract_all(c, F.lit(r"(?s)(\S(?:.{0,%d}(?=\s|$)|.{1,%d}))" % (size - 1, size - 1)), 1)
    found = F.filter(pieces, lambda p: p.rlike(pattern))
    return F.slice(F.transform(found, mark), 1, int(spec.get("number_of_fragments", 5)))


def query_terms(q, compiler: Compiler) -> dict[str, list[str]]:
    """Terms by text field, wherever they stand in the query."""
    into: dict[str, set[str]] = {}

    def walk(x) -> None:
        compiler.wanted_terms(x, into)
        if isinstance(x, Mapping):
            for k, v in x.items():
                if k in ("filter", "nested", "bool", "must", "should"):
                    walk(v)
        elif isinstance(x, (list, tuple)):
            for i in x:
                walk(i)

    if q:
        walk(q)
    return {k: sorted(v) for k, v in into.items()}


def add_highlight(df: DataFrame, spec: Mapping, q, compiler: Compiler) -> DataFrame:
    terms = query_terms(q, compiler)
    shared = {k: v for k, v in spec.items() if k != "fields"}
    fields = spec.get("fields", {})
    fields = fields if isinstance(fields, Mapping) else {k: v for f in fields for k, v in f.items()}
    columns = []
    for path, own in fields.items():
        for name in fnmatch.filter(list(compiler.schema.analyzers) or [path], path) or [path]:
            columns.append(highlight_column(compiler.col(name), terms.get(name, []), {**shared, **(own or {})}).alias(name))
    return df.withColumn("_highlight", F.struct(*columns)) if columns else df


def add_explanation(df: DataFrame, q, compiler: Compiler) -> DataFrame:
    """A map from `field:term` to that term's part of the score."""
    entries = []
    for path, terms in query_terms(q, compiler).items():
        stats = compiler.stats.get(path)
        for t in terms if stats else []:
            entries += [F.lit(f"{path}:{t}"), bm25(compiler.tokens(path), t, stats)]
    return df.withColumn("_explanation", F.create_map(*entries) if entries else F.lit(None).cast("map<string,double>"))
