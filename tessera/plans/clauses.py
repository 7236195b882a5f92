"""Clauses of a request: immutable values with three operations.

`put(x)` is what a request method does with its argument, `join(other)` what merging two requests does, and `body()`
the clause's part of the rendered request (None if it says nothing).
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass, field, replace
from typing import Any, ClassVar

OCCURS = ("must", "should", "must_not")


def blank(x: Any) -> bool:
    return x is None or x is False or (isinstance(x, str) and not x.strip()) or (isinstance(x, (Mapping, list, tuple, set)) and not x)


def as_list(x: Any) -> list:
    if x is None:
        return []
    return list(x) if isinstance(x, (list, tuple, set)) else [x]


def names(x: Any) -> tuple[str, ...]:
    return tuple(dict.fromkeys(str(i) for i in as_list(x) if not blank(i)))


def union(a: Iterable, b: Iterable) -> tuple:
    out = list(a)
    out += [x for x in b if x not in out]
    return tuple(out)


@dataclass(frozen=True)
class Bool:
    """Queries by how they have to occur."""

    must: tuple = ()
    should: tuple = ()
    must_not: tuple = ()
    minimum_should_match: Any = None

    @staticmethod
    def of(x: Any) -> Bool:
        """A hash with any of a bool's keys is a bool (its other keys are dropped); anything else has to match."""
        if isinstance(x, Bool):
            return x
        if isinstance(x, Mapping) and any(k in x for k in (*OCCURS, "minimum_should_match")):
            return Bool(*(Bool.clean(x.get(k)) for k in OCCURS), x.get("minimum_should_match"))
        return Bool(must=Bool.clean(x))

    @staticmethod
    def clean(x: Any) -> tuple:
        return tuple(q for q in (i() if isinstance(i, Callable) else i for i in as_list(x)) if not blank(q))

    def add(self, other: Bool) -> Bool:
        """Lists grow; the newcomer's minimum_should_match counts, even if it has none."""
        return Bool(self.must + other.must, self.should + other.should, self.must_not + other.must_not, other.minimum_should_match)

    def query(self) -> Any:
        """The shortest equal query: a lone `must` is itself, lists of one are their element."""
        if len(self.must) == 1 and not self.should and not self.must_not:
            return self.must[0]
        parts = {k: v[0] if len(v) == 1 else list(v) for k in OCCURS if (v := getattr(self, k))}
        if self.should and not blank(self.minimum_should_match):
            parts["minimum_should_match"] = self.minimum_should_match
        return {"bool": parts} if parts else None


@dataclass(frozen=True)
class Clause:
    value: Any = None
    name: ClassVar[str] = ""

    def norm(self, x: Any) -> Any:
        return x

    def put(self, x: Any) -> Clause:
        return replace(self, value=self.norm(x))

    def keep(self, x: Any) -> Clause:
        """As `put`, but nothing new leaves the old."""
        x = self.norm(x)
        return self if x is None else replace(self, value=x)

    def join(self, other: Clause) -> Clause:
        return self.keep(other.value)

    def body(self) -> dict | None:
        return None if blank(self.value) else {self.name: self.value}


@dataclass(frozen=True)
class QueryClause(Clause):
    value: Bool = field(default_factory=Bool)
    name: ClassVar[str] = "query"

    def norm(self, x: Any) -> Bool:
        return Bool.of(x)

    def occur(self, how: str, x: Any) -> QueryClause:
        return replace(self, value=self.value.add(Bool(**{how: Bool.clean(x)})))

    def least(self, n: Any) -> QueryClause:
        return replace(self, value=self.value.add(Bool(minimum_should_match=n)))

    def combine(self, how: str, x: Any) -> QueryClause:
        """Both sides become one query each under `how`; a side that says nothing is dropped."""
        sides = [s for s in (self.value, Bool.of(x)) if s.query() is not None]
        if len(sides) == 2:
            return replace(self, value=Bool(**{how: tuple(s.query() for s in sides)}))
        return replace(self, value=sides[0]) if sides else self

    def negate(self, x: Any) -> QueryClause:
        q = Bool.of(x).query()
        return self if q is None else self.occur("must_not", q)

    def put(self, x: Any) -> QueryClause:
        return replace(self, value=self.value.add(Bool.of(x)))

    def join(self, other: Clause) -> Clause:
        return self.combine("must", other.value)

    def body(self) -> dict | None:
        q = self.value.query()
        return None if blank(q) else {self.name: q}


@dataclass(frozen=True)
class PostFilterClause(QueryClause):
    name: ClassVar[str] = "post_filter"


@dataclass(frozen=True)
class FilterClause(QueryClause):
    name: ClassVar[str] = "filter"

    def body(self) -> dict | None:
        v = self.value
        if v.must and not v.should and not v.must_not:
            return {"filter": v.must[0] if len(v.must) == 1 else list(v.must)}
        return super().body()


def _clause(family: type[Clause], label: str) -> type[Clause]:
    return type(f"{family.__name__}_{label}", (family,), {"name": label})


class Flag(Clause):
    """Set replaces; merging takes either."""

    def norm(self, x: Any) -> bool:
        return bool(x)

    def join(self, other: Clause) -> Clause:
        return replace(self, value=bool(self.value or other.value))


class TriState(Clause):
    """True, False or nothing; False is rendered."""

    def norm(self, x: Any) -> bool | None:
        return None if x is None else bool(x)

    def body(self) -> dict | None:
        return None if self.value is None else {self.name: self.value}


class Whole(Clause):
    def norm(self, x: Any) -> int | None:
        return None if blank(x) and x != 0 else int(x)

    def body(self) -> dict | None:
        return None if self.value is None else {self.name: self.value}


class Real(Clause):
    def norm(self, x: Any) -> float | None:
        return None if blank(x) and x != 0 else float(x)

    def body(self) -> dict | None:
        return None if self.value is None else {self.name: self.value}


class Text(Clause):
    def norm(self, x: Any) -> str | None:
        return None if blank(x) else str(x)


class Names(Clause):
    """A set of names that grows."""

    def put(self, x: Any) -> Clause:
        return replace(self, value=union(self.value or (), names(x)))

    join = lambda self, other: self.put(other.value)

    def body(self) -> dict | None:
        return {self.name: list(self.value)} if self.value else None


class Hash(Clause):
    """A hash whose keys are merged."""

    def put(self, x: Any) -> Clause:
        return replace(self, value={**(self.value or {}), **{str(k): v for k, v in (x or {}).items()}})

    join = lambda self, other: self.put(other.value)


class OneHash(Hash):
    """A hash that a new one replaces; merging two requests merges its keys."""

    def put(self, x: Any) -> Clause:
        return replace(self, value=dict(x) if x else None)

    join = lambda self, other: Hash.put(self, other.value)


class Unrendered(Hash):
    def body(self) -> dict | None:
        return None


class Order(Clause):
    """A list of names, or hashes of one name each, that grows; duplicates stay."""

    name: ClassVar[str] = "sort"

    def norm(self, x: Any) -> tuple:
        out: list = []
        for item in as_list(x):
            if isinstance(item, Mapping):
                out += [{str(k): v} for k, v in item.items()]
            elif not blank(item):
                out.append(str(item))
        return tuple(out)

    def put(self, x: Any) -> Clause:
        return replace(self, value=(self.value or ()) + self.norm(x))

    def again(self, x: Any) -> Clause:
        return replace(self, value=self.norm(x))

    join = lambda self, other: self.put(other.value)

    def body(self) -> dict | None:
        return {self.name: list(self.value)} if self.value else None


class Ordered(Clause):
    """A hash in order; a key that is set again moves to the end."""

    name: ClassVar[str] = "indices_boost"

    def put(self, x: Any) -> Clause:
        new = {str(k): float(v) for k, v in (x or {}).items()}
        return replace(self, value=tuple(kv for kv in (self.value or ()) if kv[0] not in new) + tuple(new.items()))

    join = lambda self, other: self.put(dict(other.value or ()))

    def body(self) -> dict | None:
        return {self.name: [{k: v} for k, v in self.value]} if self.value else None


class Stages(Clause):
    """A list of hashes that grows by what it doesn't hold yet."""

    name: ClassVar[str] = "rescore"

    def put(self, x: Any) -> Clause:
        return replace(self, value=union(self.value or (), [i for i in as_list(x) if not blank(i)]))

    join = lambda self, other: self.put(list(other.value or ()))

    def body(self) -> dict | None:
        return {self.name: list(self.value)} if self.value else None


class After(Clause):
    name: ClassVar[str] = "search_after"

    def norm(self, x: Any) -> tuple | None:
        return tuple(as_list(x)) or None

    def body(self) -> dict | None:
        return {self.name: list(self.value)} if self.value else None


@dataclass(frozen=True)
class Fields(Clause):
    """Included and excluded names, both growing, and a switch that leaves them alone."""

    value: tuple = ()
    excludes: tuple = ()
    on: bool = True
    name: ClassVar[str] = "_source"

    def put(self, x: Any) -> Clause:
        if isinstance(x, bool):
            return replace(self, on=x)
        if isinstance(x, Mapping):
            return replace(self, value=union(self.value, names(x.get("includes"))), excludes=union(self.excludes, names(x.get("excludes"))), on=True)
        return replace(self, value=union(self.value, names(x)), on=True)

    def join(self, other: Clause) -> Clause:
        return replace(self, value=union(self.value, other.value), excludes=union(self.excludes, other.excludes), on=other.on)

    def body(self) -> dict | None:
        if not self.on:
            return {self.name: self.off()}
        if self.excludes:
            return {self.name: {k: list(v) for k, v in (("includes", self.value), ("excludes", self.excludes)) if v}}
        return {self.name: list(self.value)} if self.value else None

    def off(self) -> Any:
        return False


@dataclass(frozen=True)
class StoredFields(Fields):
    name: ClassVar[str] = "stored_fields"

    def off(self) -> Any:
        return "_none_"


@dataclass(frozen=True)
class Indices(Clause):
    """Indexes by name (sorted when rendered) or as objects."""

    value: tuple = ()
    name: ClassVar[str] = "index"

    def put(self, x: Any) -> Clause:
        return replace(self, value=union(self.value, [i for i in as_list(x) if not blank(i)]))

    join = lambda self, other: self.put(list(other.value))

    def listed(self) -> list[str]:
        return sorted({i if isinstance(i, str) else i.name for i in self.value})

    def body(self) -> dict | None:
        return {self.name: self.listed()} if self.value else None

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Indices) and self.listed() == other.listed()

    __hash__ = None  # type: ignore[assignment]


#: Clause of each request method.
CLAUSES: dict[str, type[Clause]] = {
    "query": QueryClause,
    "filter": FilterClause,
    "post_filter": PostFilterClause,
    **{n: _clause(Flag, n) for n in ("explain", "version", "profile", "track_scores", "track_total_hits", "none")},
    **{n: _clause(TriState, n) for n in ("request_cache", "ignore_unavailable", "allow_partial_search_results")},
    "limit": _clause(Whole, "size"),
    "offset": _clause(Whole, "from"),
    "terminate_after": _clause(Whole, "terminate_after"),
    "min_score": _clause(Real, "min_score"),
    **{n: _clause(Text, n) for n in ("search_type", "preference", "timeout")},
    "docvalue_fields": _clause(Names, "docvalue_fields"),
    **{n: _clause(Hash, n) for n in ("aggs", "suggest", "highlight", "script_fields")},
    **{n: _clause(OneHash, n) for n in ("collapse", "knn")},
    "order": Order,
    "indices": Indices,
    "indices_boost": Ordered,
    "rescore": Stages,
    "source": Fields,
    "stored_fields": StoredFields,
    "search_after": After,
    "load": _clause(Unrendered, "load"),
}

#: Clauses that travel beside the body.
BESIDE = ("indices", "search_type", "request_cache", "allow_partial_search_results", "ignore_unavailable")


class Clauses:
    """All clauses of a request; a method returns a changed copy."""

    def __init__(self, held: dict[str, Clause] | None = None):
        self.held = held or {}

    def get(self, name: str) -> Clause:
        return self.held.get(name) or CLAUSES[name]()

    def value(self, name: str) -> Any:
        return self.get(name).value

    def change(self, name: str, how: Callable[[Clause], Clause]) -> Clauses:
        return Clauses({**self.held, name: how(self.get(name))})

    def merge(self, other: Clauses) -> Clauses:
        out = self
        for name, clause in other.held.items():
            out = out.change(name, lambda c, clause=clause: c.join(clause))
        return out

    @staticmethod
    def known(wanted: Iterable[str]) -> list[str]:
        wanted = [str(n) for n in wanted]
        if not wanted:
            raise ValueError("no clause was named")
        if unknown := [n for n in wanted if n not in CLAUSES]:
            raise NameError(f"unknown clause: {', '.join(unknown)}")
        return wanted

    def only(self, *wanted: str) -> Clauses:
        keep = self.known(wanted)
        return Clauses({k: v for k, v in self.held.items() if k in keep})

    def without(self, *wanted: str) -> Clauses:
        drop = self.known(wanted)
        return Clauses({k: v for k, v in self.held.items() if k not in drop})

    def __eq__(self, other: object) -> bool:
        if not isinstance(other, Clauses):
            return NotImplemented
        return all(self.get(n) == other.get(n) for n in {*self.held, *other.held})

    __hash__ = None  # type: ignore[assignment]

    def render(self) -> dict:
        beside: dict = {}
        for n in BESIDE:
            beside |= self.get(n).body() or {}
        body: dict = {}
        for n, c in self.held.items():
            if n not in (*BESIDE, "query", "filter", "none"):
                body |= c.body() or {}
        return {**beside, "body": {**body, **(self.render_query() or {})}}

    def render_query(self) -> dict | None:
        """Query and filters in one: filters go into the query's own bool, if it is one."""
        if self.value("none"):
            return {"query": {"match_none": {}}}
        query, kept = (self.get("query").body() or {}).get("query"), self.get("filter").body()
        if not kept:
            return None if query is None else {"query": query}
        if query is None:
            return {"query": {"bool": kept}}
        inner = query.get("bool") if isinstance(query, Mapping) else None
        if inner is None:
            return {"query": {"bool": {"must": query, **kept}}}
        both = as_list(inner["filter"]) + as_list(kept["filter"]) if "filter" in inner else kept["filter"]
        return {"query": {"bool": {**inner, "filter": both}}}
