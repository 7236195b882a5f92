"""Orders, keyset pagination, collapsing."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import geo
from tessera.plans.compiler import Compiler


@dataclass
class Key:
    value: Column
    down: bool = False
    nulls_first: bool = False

    def order(self) -> Column:
        if self.down:
            return self.value.desc_nulls_first() if self.nulls_first else self.value.desc_nulls_last()
        return self.value.asc_nulls_first() if self.nulls_first else self.value.asc_nulls_last()

    def after(self, v: Any) -> Column:
        """Rows that come after a row with value v."""
        c = self.value
        if v is None:
            return c.isNotNull() if self.nulls_first else F.lit(False)
        ahead = (c < F.lit(v)) if self.down else (c > F.lit(v))
        return F.coalesce(ahead, F.lit(False)) if self.nulls_first else c.isNull() | F.coalesce(ahead, F.lit(False))

    def same(self, v: Any) -> Column:
        return self.value.isNull() if v is None else F.coalesce(self.value == F.lit(v), F.lit(False))


def sort_keys(order: tuple, compiler: Compiler) -> list[Key]:
    keys = []
    for item in order or ():
        name, spec = next(iter(item.items())) if isinstance(item, Mapping) else (item, {})
        spec = spec if isinstance(spec, Mapping) else {"order": str(spec)}
        down = str(spec.get("order", "desc" if name == "_score" else "asc")).lower() == "desc"
        if name == "_geo_distance":
            path, p = next((k, v) for k, v in spec.items() if k not in ("order", "unit", "mode", "distance_type"))
            lat, lon = geo.point(p)
            keys.append(Key(geo.distance(compiler.col(path), lat, lon), down))
            continue
        if name == "_script":
            keys.append(Key(compiler.script(spec["script"]).cast("double" if spec.get("type") == "number" else "string"), down))
            continue
        c = compiler.col(name)
        if compiler.is_array(name):
            mode = spec.get("mode", "max" if down else "min")
            fold = lambda how: F.aggregate(c, F.lit(0.0), lambda a, x: a + x.cast("double")) / (F.size(c) if how == "avg" else F.lit(1))
            c = {"min": F.array_min, "max": F.array_max}[mode](c) if mode in ("min", "max") else fold(mode)
        missing = spec.get("missing", "_last")
        if missing not in ("_first", "_last"):
            c = F.coalesce(c, compiler.value(name, missing))
        keys.append(Key(c, down, missing == "_first"))
    return keys


def tie_breaks(df: DataFrame, id_column: str) -> list[Key]:
    """Index, then id: as a number where all ids are numbers."""
    own = [Key(F.col(f"`{id_column}`"))] if id_column in df.columns and isinstance(df.schema[id_column].dataType, T.NumericType) else [Key(F.col("_id"))]
    return [Key(F.col("_index")), *own]


def search_after(df: DataFrame, keys: list[Key], values: tuple) -> DataFrame:
    """Rows behind the position that the values mark; fewer values than keys mark a group of rows."""
    tests = []
    for i, v in enumerate(values[: len(keys)]):
        tests.append(reduce(lambda a, b: a & b, [k.same(x) for k, x in zip(keys[:i], values[:i], strict=True)] + [keys[i].after(v)]))
    return df.filter(reduce(lambda a, b: a | b, tests)) if tests else df


def collapse(df: DataFrame, field: Column, keys: list[Key]) -> DataFrame:
    """The first row of each value; rows without a value are one group."""
    w = Window.partitionBy(field).orderBy(*[k.order() for k in keys])
    return df.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")
