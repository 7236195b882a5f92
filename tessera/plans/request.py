"""Requests: immutable, chainable descriptions of a search, and their terminal actions."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from contextlib import contextmanager
from contextvars import ContextVar
from typing import TYPE_CHECKING, Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.plans.clauses import CLAUSES, Bool, Clauses

if TYPE_CHECKING:
    from tessera.operators.search import Hit, Search

_scopes: ContextVar[tuple] = ContextVar("scopes", default=())

#: Clauses that decide which documents match.
WHERE = ("query", "filter", "post_filter", "knn", "none", "min_score", "terminate_after", "ignore_unavailable", "indices", "search_type", "preference", "timeout")
PAGE = 10
BATCH = 1000
_MISSING = object()


class DocumentNotFound(LookupError):
    """Ids that no document has."""


class QueryProxy:
    """What `query()`, `filter()` and `post_filter()` give without an argument."""

    def __init__(self, request: Request, name: str):
        self._request, self._name = request, name

    def _value(self, x: Any) -> Any:
        if x is None or x is _MISSING:
            raise ValueError("a query, a request or a callable is needed")
        return x

    def must(self, x: Any = _MISSING) -> Request:
        return self._request._change(self._name, lambda c: c.occur("must", self._value(x)))

    def should(self, x: Any = _MISSING) -> Request:
        return self._request._change(self._name, lambda c: c.occur("should", self._value(x)))

    def must_not(self, x: Any = _MISSING) -> Request:
        return self._request._change(self._name, lambda c: c.occur("must_not", self._value(x)))

    def _side(self, x: Any) -> Any:
        x = self._value(x)
        return x.clauses.value(self._name) if isinstance(x, Request) else x

    def and_(self, x: Any = _MISSING) -> Request:
        return self._request._change(self._name, lambda c: c.combine("must", self._side(x)))

    def or_(self, x: Any = _MISSING) -> Request:
        return self._request._change(self._name, lambda c: c.combine("should", self._side(x)))

    def not_(self, x: Any = _MISSING) -> Request:
        return self._request._change(self._name, lambda c: c.negate(self._side(x)))

    def minimum_should_match(self, n: Any) -> Request:
        return self._request._change(self._name, lambda c: c.least(n))


class Request:
    """A search over one or more indexes. Every modifier returns a changed copy; nothing runs until asked for."""

    def __init__(self, *indexes: Any, clauses: Clauses | None = None, indexes_by_name: Mapping[str, Any] | None = None):
        self._known = dict(indexes_by_name or {}) | {i.name: i for i in indexes if not isinstance(i, str)}
        self.clauses = clauses or Clauses().change("indices", lambda c: c.put(list(indexes)))
        self._search: Search | None = None
        self._page: list[Hit] | None = None

    # -- chaining ---------------------------------------------------------------------------------------------

    def _with(self, clauses: Clauses, more: Mapping | None = None) -> Request:
        return type(self)(clauses=clauses, indexes_by_name={**self._known, **(more or {})})

    def _change(self, name: str, how: Callable) -> Request:
        return self._with(self.clauses.change(name, how))

    def _query(self, name: str, x: Any) -> Any:
        return QueryProxy(self, name) if x is _MISSING or x is None else self._change(name, lambda c: c.occur("must", x) if not isinstance(x, Bool) else c.put(x))

    def query(self, x: Any = _MISSING) -> Any:
        return self._query("query", x)

    def filter(self, x: Any = _MISSING) -> Any:
        return self._query("filter", x)

    def post_filter(self, x: Any = _MISSING) -> Any:
        return self._query("post_filter", x)

    def order(self, *values: Any, **fields: Any) -> Request:
        return self._change("order", lambda c: c.put([*values, *([fields] if fields else [])]))

    def reorder(self, *values: Any, **fields: Any) -> Request:
        return self._change("order", lambda c: c.again([*values, *([fields] if fields else [])]))

    def docvalue_fields(self, *values: str) -> Request:
        return self._change("docvalue_fields", lambda c: c.put(list(values)))

    def indices(self, *values: Any) -> Request:
        out = self._change("indices", lambda c: c.put(list(values)))
        out._known |= {i.name: i for i in values if not isinstance(i, str)}
        return out

    def search_after(self, *values: Any) -> Request:
        flat = values[0] if len(values) == 1 and isinstance(values[0], (list, tuple)) else values
        return self._change("search_after", lambda c: c.put(list(flat) if values != (None,) else None))

    def source(self, *values: Any, **lists: Any) -> Request:
        return self._fields("source", values, lists)

    def stored_fields(self, *values: Any) -> Request:
        return self._fields("stored_fields", values, {})

    def _fields(self, name: str, values: tuple, lists: dict) -> Request:
        x = lists or (values[0] if len(values) == 1 and isinstance(values[0], (bool, Mapping)) else [v for x in values for v in (x if isinstance(x, (list, tuple)) else [x])])
        return self._change(name, lambda c: c.put(x))

    def load(self, **options: Any) -> Request:
        return self._change("load", lambda c: c.put(options))

    def aggs(self, defs: Any = _MISSING, **named: Any) -> Any:
        """With definitions (or the names of an index's own): adds them. Without: the results."""
        if defs is _MISSING and not named:
            return self.search.aggregations()
        names = [defs] if isinstance(defs, str) else list(defs) if isinstance(defs, (list, tuple)) else None
        given = self._named_aggs(names) if names else {} if defs is _MISSING else defs
        return self._change("aggs", lambda c: c.put({**given, **named}))

    aggregations = aggs

    def _named_aggs(self, names: list[str]) -> dict:
        known = {k: v for i in self._known.values() for k, v in i.agg_definitions.items()}
        return {n: known[n] for n in names}

    def suggest(self, defs: Any = _MISSING) -> Any:
        return self.search.suggestions() if defs is _MISSING else self._change("suggest", lambda c: c.put(defs))

    def merge(self, other: Request) -> Request:
        return self._with(self.clauses.merge(other.clauses), other._known)

    def _both(self, how: str, other: Request) -> Request:
        out = self
        for name in ("query", "filter", "post_filter"):
            out = getattr(QueryProxy(out, name), how)(other)
        return out

    def and_(self, other: Request) -> Request:
        return self._both("and_", other)

    def or_(self, other: Request) -> Request:
        return self._both("or_", other)

    def not_(self, other: Request) -> Request:
        return self._both("not_", other)

    __and__, __or__, __sub__ = and_, or_, not_

    def only(self, *names: str) -> Request:
        return self._with(self.clauses.only(*names, "indices") if Clauses.known(names) else self.clauses)

    def except_(self, *names: str) -> Request:
        return self._with(self.clauses.without(*names))

    def __getattr__(self, name: str) -> Any:
        """Named scopes of the indexes."""
        if not name.startswith("_"):
            for index in self._known.values():
                if name in index.scopes:
                    return lambda *a, **k: self.scoping(lambda: index.scopes[name](self, *a, **k))
        raise AttributeError(name)

    def scoping(self, block: Callable[[], Any]) -> Any:
        """Run `block` with this request as what indexes start from."""
        with self.as_scope():
            return block()

    @contextmanager
    def as_scope(self) -> Iterator[Request]:
        token = _scopes.set((*_scopes.get(), self))
        try:
            yield self
        finally:
            _scopes.reset(token)

    @staticmethod
    def current_scope() -> Request | None:
        held = _scopes.get()
        return held[-1] if held else None

    def render(self) -> dict:
        return self.clauses.render()

    def __eq__(self, other: object) -> bool:
        if isinstance(other, Request):
            return self.clauses == other.clauses
        return self.to_list() == other if isinstance(other, list) else NotImplemented

    __hash__ = None  # type: ignore[assignment]

    def __repr__(self) -> str:
        return f"<Request {self.render()}>"

    # -- running ----------------------------------------------------------------------------------------------

    @property
    def search(self) -> Search:
        from tessera.operators.search import Search

        if self._search is None:
            self._search = Search(self.clauses, self._known)
        return self._search

    @property
    def performed(self) -> bool:
        return self._page is not None

    def respond(self, rows: list[dict]) -> Request:
        """This request with given hits, as if it had run: for tests of code that searches."""
        out = self._with(self.clauses)
        out._page = [out.search.hit_of({"_index": next(iter(self._known), ""), "_id": str(r.get("id", n)), "_score": 1.0, **r}) for n, r in enumerate(rows)]
        return out

    def frame(self) -> DataFrame:
        """The page of hits as a DataFrame, in order: _index, _id, _score and the source's columns."""
        return self.search.page()

    def matching(self) -> DataFrame:
        """All hits, without order, limit and offset."""
        return self.search.hits()

    def hits(self) -> list[Hit]:
        if self._page is None:
            self._page = self.search.collect()
        return self._page

    to_list = wrappers = hits

    def __iter__(self) -> Iterator[Hit]:
        return iter(self.hits())

    def __len__(self) -> int:
        return len(self.hits())

    def __getitem__(self, i: Any) -> Any:
        return self.hits()[i]

    @property
    def total(self) -> int:
        return self.search.total()

    def response(self) -> dict:
        """Hits and metadata as a search response has them."""
        return self.search.response(self.hits())

    def count(self) -> int:
        return self.only(*WHERE).search.total()

    def exists(self) -> bool:
        return not self.only(*WHERE).search.hits().isEmpty()

    def first(self, n: Any = _MISSING) -> Any:
        """The first hit, or the first n; a page that holds enough is used again."""
        want = 1 if n is _MISSING else int(n)
        size = self.clauses.value("limit")
        if self.performed and (len(self._page) >= want or len(self._page) < (PAGE if size is None else size)):
            page = self._page[:want]
        else:
            page = self.except_("aggs", "suggest").limit(want).hits()
        return page if n is not _MISSING else page[0] if page else None

    def find(self, *ids: Any) -> Any:
        """Documents by id within this request's scope; all have to be there."""
        if len(ids) == 1 and callable(ids[0]):
            return next((h for h in self if ids[0](h)), None)
        many = len(ids) != 1 or isinstance(ids[0], (list, tuple))
        wanted = [str(i) for x in ids for i in (x if isinstance(x, (list, tuple)) else [x])]
        found = self.except_("limit", "offset", "search_after", "order", "aggs", "suggest").filter({"ids": {"values": wanted}}).limit(len(wanted)).hits()
        by_id = {h.id_text: h for h in found}
        if missing := [i for i in wanted if i not in by_id]:
            raise DocumentNotFound(f"no documents with ids: {', '.join(missing)}")
        out = [by_id[i] for i in dict.fromkeys(wanted)]
        return out if many else out[0]

    def pluck(self, *fields: str) -> list:
        """Values of top-level fields (or _id, _index); everything that matches unless there is a limit."""
        names = [str(f) for f in fields]
        df = self.except_("source", "aggs", "suggest", "highlight").search.page(everything=self.clauses.value("limit") is None)
        held = [F.col(f"`{n}`").alias(f"c{i}") if n in df.columns else F.lit(None).alias(f"c{i}") for i, n in enumerate(names)]
        rows = df.select(*held).toLocalIterator(prefetchPartitions=True)
        return [r[0] for r in rows] if len(names) == 1 else [list(r) for r in rows]

    def scroll_batches(self, batch_size: int = BATCH) -> Iterator[list[Hit]]:
        """All hits in order, in batches; a limit cuts the last one."""
        return self.search.batches(batch_size)

    def scroll_hits(self, batch_size: int = BATCH) -> Iterator[Hit]:
        return (h for batch in self.scroll_batches(batch_size) for h in batch)

    scroll_wrappers = scroll_hits

    def scroll_objects(self, batch_size: int = BATCH) -> Iterator[Any]:
        from tessera.operators.joins import load_objects

        return (o for batch in self.source(False).scroll_batches(batch_size) for o in load_objects(batch, self._known, self.clauses.value("load") or {}))

    scroll_records = scroll_documents = scroll_objects

    def objects(self) -> list:
        """Source rows of the page's hits, in their order; None where there is none."""
        from tessera.operators.joins import load_objects

        return load_objects(self.hits(), self._known, self.clauses.value("load") or {})

    records = documents = objects

    def object_hash(self) -> dict:
        return dict(zip(self.hits(), self.objects(), strict=True))

    def aggs_frame(self, name: str, path: str | None = None) -> DataFrame:
        """One aggregation as a flat DataFrame; path: which inner buckets to go on to (`a>b`, "" for none)."""
        return self.search.aggregation_frame(name, path)

    def suggest_frame(self, name: str) -> DataFrame:
        return self.search.suggestion_frame(name)

    def delete_all(self, **_options: Any) -> dict:
        """Remove all matching documents from the indexes; options of timing have no effect here."""
        out = 0
        for index in self.search.indexes:
            one = type(self)(index, clauses=self.only(*WHERE).clauses.without("indices").change("indices", lambda c, index=index: c.put([index])), indexes_by_name={index.name: index})
            out += index.delete_matching(one.matching())
        return {"deleted": out}

    # -- pages ------------------------------------------------------------------------------------------------

    def page(self, n: Any = 1, size: int | None = None) -> Request:
        per = size or self.clauses.value("limit") or PAGE
        return self.limit(per).offset(per * (max(int(n or 1), 1) - 1))

    def per(self, n: int) -> Request:
        """Another page size; the number of the page stays."""
        old, skipped = self.clauses.value("limit") or PAGE, self.clauses.value("offset") or 0
        return self.limit(n).offset(n * (skipped // max(old, 1)))

    @property
    def current_page(self) -> int:
        return (self.clauses.value("offset") or 0) // max(self.clauses.value("limit") or PAGE, 1) + 1

    @property
    def total_pages(self) -> int:
        return -(-self.total // max(self.clauses.value("limit") or PAGE, 1))


def _setter(name: str) -> Callable:
    def method(self: Request, *x: Any, **named: Any) -> Request:
        value = named if named else x[0] if x else True
        return self._change(name, lambda c: c.put(value))

    method.__name__ = name
    method.__doc__ = f"Set or extend the clause `{name}`."
    return method


for _name in CLAUSES:
    if _name not in vars(Request) and _name != "allow_partial_search_results":
        setattr(Request, _name, _setter(_name))
del _name
