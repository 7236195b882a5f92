"""Field trees: the mapping of an index, and the composition of documents from source rows as one projection."""

from __future__ import annotations

import fnmatch
import inspect
import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Spark types of mapping types.
TYPES: dict[str, T.DataType] = {
    "text": T.StringType(), "keyword": T.StringType(), "integer": T.IntegerType(), "long": T.LongType(), "short": T.ShortType(), "byte": T.ByteType(),
    "float": T.FloatType(), "double": T.DoubleType(), "half_float": T.FloatType(), "scaled_float": T.DoubleType(), "boolean": T.BooleanType(),
    "date": T.TimestampType(), "binary": T.StringType(), "dense_vector": T.ArrayType(T.FloatType()), "ip": T.StringType(),
    "geo_point": T.StructType([T.StructField("lat", T.DoubleType()), T.StructField("lon", T.DoubleType())]),
    "join": T.StructType([T.StructField("name", T.StringType()), T.StructField("parent", T.StringType())]),
}


class BadJoin(ValueError):
    """A relation's name that the join field doesn't know."""


def is_blank(c: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.StringType):
        return c.isNull() | (F.trim(c) == "")
    if isinstance(kind, T.ArrayType):
        return c.isNull() | (F.size(c) == 0)
    if isinstance(kind, T.BooleanType):
        return c.isNull() | ~c
    return c.isNull()


@dataclass
class Field:
    """A declared field. `value`: a source column's name, or a callable (row[, parents..., crutches]) -> Column."""

    name: str
    type: str | None = None
    value: str | Callable | None = None
    children: list[Field] = field(default_factory=list)
    fields: list[Field] = field(default_factory=list)  # multi-fields: other analyses of the same value
    many: bool = False  # an array of values
    ignore_blank: bool | None = None
    join: Mapping[str, Any] | None = None  # {'type': column, 'id': column} of a join field
    options: dict = field(default_factory=dict)

    @property
    def kind(self) -> str:
        return self.type or ("object" if self.children else "text")

    @property
    def drops_blank(self) -> bool:
        return self.kind == "geo_point" if self.ignore_blank is None else self.ignore_blank

    def mapping(self) -> dict:
        out: dict = {"type": self.kind, **self.options}
        if self.children:
            out["properties"] = {c.name: c.mapping() for c in self.children}
            if self.type is None:
                out.pop("type")
                out = {"type": "object", **out}
        if self.fields:
            out["fields"] = {f.name: f.mapping() for f in self.fields}
        return out

    def relations(self) -> dict[str, list[str]]:
        return {k: [v] if isinstance(v, str) else list(v) for k, v in (self.options.get("relations") or {}).items()}

    def spark_type(self) -> T.DataType:
        if self.children and self.kind in ("object", "nested"):
            struct = T.StructType([T.StructField(c.name, c.spark_type()) for c in self.children])
            return T.ArrayType(struct) if self.many or self.kind == "nested" else struct
        base = TYPES.get(self.kind, T.StringType())
        return T.ArrayType(base) if self.many else base

    def raw(self, row: Row, parents: tuple) -> Column:
        """The value before children and types."""
        if self.join is not None:
            return self.join_value(row)
        if callable(self.value):
            return call(self.value, row, parents)
        return row[self.value or self.name]

    def join_value(self, row: Row) -> Column:
        name, parent = row[self.join["type"]], row[self.join["id"]] if self.join.get("id") else F.lit(None)
        known = [*self.relations(), *(c for cs in self.relations().values() for c in cs)]
        checked = F.when(name.isNull() | name.isin(known), name).otherwise(F.raise_error(F.concat(F.lit(f"{self.name}: unknown relation "), name)))
        return F.when(name.isNotNull(), F.struct(checked.cast("string").alias("name"), parent.cast("string").alias("parent")))

    def column(self, row: Row, parents: tuple = ()) -> Column:
        value = self.raw(row, parents)
        kind = row.type_of(self)
        if self.children and self.kind in ("object", "nested"):
            def build(v: Column, t: T.DataType | None) -> Column:
                inner = Row(v, t, row.crutches)
                parts = [c.column(inner, (inner, *parents_of(row, parents))).alias(c.name) for c in self.children]
                return F.when(v.isNotNull(), F.struct(*parts))

            if isinstance(kind, T.ArrayType):
                value = F.transform(value, lambda v: build(v, kind.elementType))
            else:
                value = build(value, kind)
        elif self.kind in TYPES and not callable(self.value) and self.join is None:
            target = TYPES[self.kind]
            if self.kind == "geo_point":
                value = F.when(value.isNotNull() & value["lat"].isNotNull(), F.struct(value["lat"].cast("double").alias("lat"), value["lon"].cast("double").alias("lon")))
            elif isinstance(kind, T.ArrayType) and not isinstance(target, T.ArrayType):
                value = value.cast(T.ArrayType(target))
            elif self.kind != "date" or not isinstance(kind, (T.TimestampNTZType, T.TimestampType)):
                value = value.cast(target)
        if self.drops_blank and self.kind != "geo_point":
            value = F.when(~is_blank(value, kind or T.StringType()), value)
        return value


def parents_of(row: Row, parents: tuple) -> tuple:
    return parents or (row,)


def call(f: Callable, row: Row, parents: tuple) -> Column:
    """A value's callable with as many arguments as it takes: the row, its parents (innermost first), the crutches."""
    kinds = [p.kind for p in inspect.signature(f).parameters.values()]
    given = [row, *parents[1:], row.crutches]
    if any(k is inspect.Parameter.VAR_POSITIONAL for k in kinds):
        return f(*given)
    n = len(kinds)
    if n == 0:
        return f()
    if n == 2 and row.crutches is not None and len(parents) <= 1:
        return f(row, row.crutches)
    return f(*given[:n])


class Row:
    """A source row, or an element of one, whose columns are attributes or items."""

    def __init__(self, at: Column | None, kind: T.DataType | None, crutches: Any = None):
        self._at, self._kind, self.crutches = at, kind, crutches

    def __getitem__(self, name: str) -> Column:
        if isinstance(self._kind, T.StructType) and name not in self._kind.names:
            return F.lit(None)
        return F.col(f"`{name}`") if self._at is None else self._at[name]

    def __getattr__(self, name: str) -> Column:
        if name.startswith("_"):
            raise AttributeError(name)
        return self[name]

    @property
    def self_(self) -> Column | None:
        return self._at

    def type_of(self, f: Field) -> T.DataType | None:
        name = f.name if f.value is None or callable(f.value) else f.value
        if callable(f.value) or not isinstance(self._kind, T.StructType) or name not in self._kind.names:
            return T.ArrayType(T.StructType()) if f.many or f.kind == "nested" else None
        return self._kind[name].dataType


@dataclass
class Crutch:
    """A lookup that documents are composed with: `source()` gives rows, joined on `key` to the document's `on`.

    `one` (column -> name) takes the columns of the one matching row, `many` (name -> Column) an array of all.
    """

    source: Callable[[], DataFrame]
    on: str
    key: str
    one: Mapping[str, str] = field(default_factory=dict)
    many: Mapping[str, Column] = field(default_factory=dict)


@dataclass
class Mapping_:
    """The root of a field tree."""

    fields: list[Field] = field(default_factory=list)
    id: str | Callable = "id"
    value: Callable[[DataFrame], DataFrame] | None = None  # rewrites source rows first
    templates: list[tuple[str, dict]] = field(default_factory=list)
    crutches: dict[str, Crutch] = field(default_factory=dict)
    options: dict = field(default_factory=dict)

    def template(self, pattern: str | re.Pattern, kind: str | None = None, match_type: str | None = None, **options: Any) -> None:
        """A dynamic template by glob, regular expression or dotted path."""
        rule: dict = {"match_mapping_type": match_type or "*"}
        if isinstance(pattern, re.Pattern):
            rule["path_match" if r"\." in pattern.pattern else "match"] = pattern.pattern
            rule["match_pattern"] = "regex"
        else:
            rule["path_match" if "." in pattern else "match"] = pattern
        rule["mapping"] = {"type": kind or "text", **options}
        self.templates.append((f"template_{len(self.templates) + 1}", rule))

    def dynamic_type(self, path: str) -> str | None:
        """Mapping type that the first fitting template gives to an undeclared field."""
        for _, rule in self.templates:
            pattern, subject = (rule["path_match"], path) if "path_match" in rule else (rule["match"], path.rsplit(".", 1)[-1])
            if re.search(pattern, subject) if rule.get("match_pattern") == "regex" else fnmatch.fnmatchcase(subject, pattern):
                return rule["mapping"]["type"]
        return None

    def to_dict(self) -> dict:
        out: dict = {**self.options}
        if self.fields:
            out["properties"] = {f.name: f.mapping() for f in self.fields}
        if self.templates:
            out["dynamic_templates"] = [{n: r} for n, r in self.templates]
        return {"mappings": out} if out else {}

    def join_field(self) -> Field | None:
        return next((f for f in self.fields if f.kind == "join"), None)

    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(f.name, f.spark_type()) for f in self.fields])

    def compose(self, rows: DataFrame, only: list[str] | None = None) -> DataFrame:
        """Documents: `_id` and the declared fields (all source columns if none is declared), in one projection.

        Crutches are left joins on their keys; their columns aren't part of documents.
        """
        from tessera.operators.joins import lookup_many, lookup_one

        if self.value:
            rows = self.value(rows)
        for name, c in self.crutches.items():
            if c.one:
                rows = lookup_one(rows, c.source(), c.on, c.key, {f"__{name}_{n}": col for col, n in c.one.items()})
            for n, element in c.many.items():
                rows = lookup_many(rows, c.source(), c.on, c.key, f"__{name}_{n}", element)
        held = type("Crutches", (), {f"{name}_{n}": F.col(f"__{name}_{n}") for name, c in self.crutches.items() for n in [*c.one.values(), *c.many]})() if self.crutches else None
        row = Row(None, rows.schema, held)
        key = self.id(row) if callable(self.id) else row[self.id]
        if not self.fields:
            return rows.withColumn("_id", key.cast("string"))
        wanted = [f for f in self.fields if only is None or f.name in only]
        return rows.select(key.cast("string").alias("_id"), *[f.column(row).alias(f.name) for f in wanted])


Mapping_.__name__ = "IndexMapping"
IndexMapping = Mapping_
