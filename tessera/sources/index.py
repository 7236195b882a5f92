"""Indexes: a name, a mapping, a source of rows, and stored documents."""

from __future__ import annotations

import copy
from collections.abc import Callable, Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.plans.compiler import Compiler, Schema
from tessera.plans.request import Request
from tessera.sources.fields import Field, IndexMapping
from tessera.sources.store import Store
from tessera.sources.tokens import PREFIX, Terms, column_of, with_tokens


class Config:
    """Settings that all indexes share."""

    prefix: str | None = None
    root: str | None = None  # where documents are stored
    index: dict = {}  # settings that each index starts from
    request_strategy = "atomic"
    massacre_allowed = False


class Index:
    """An index over a fixed DataFrame (`frame`), or one whose documents are composed from `source` and stored.

    text: analyzers of text fields by path (for indexes without a declared mapping). scopes: named functions
    (request, ...) -> request. journal: where imports are journalled unless they say otherwise.
    """

    def __init__(
        self, name: str, *, mapping: IndexMapping | None = None, source: Callable[[], DataFrame] | None = None, source_id: str = "id", frame: DataFrame | Callable[[], DataFrame] | None = None,
        id_column: str = "_id", text: Mapping[str, str] | None = None, nested: tuple[str, ...] = (), aliases: Mapping[str, str] | None = None, join_field: str | None = None,
        settings: Mapping | None = None, scopes: Mapping[str, Callable] | None = None, aggs: Mapping[str, Mapping] | None = None, delete_if: Callable | None = None, journal: Any = None,
        suffix: str | None = None, prefix: str | None = None, root: str | None = None,
    ):
        prefix = Config.prefix if prefix is None else prefix
        self.base = name
        self.name = "_".join(p for p in (prefix, name, suffix) if p)
        self.mapping, self._source, self.source_id, self._frame = mapping or IndexMapping(), source, source_id, frame
        self.id_column = id_column if frame is not None else "_id"
        self.settings = {**Config.index, **(settings or {})}
        self.scopes, self.agg_definitions = dict(scopes or {}), dict(aggs or {})
        self.delete_if, self.journal, self.root = delete_if, journal, root or Config.root
        self.analyzers, self.search_analyzers, self.aliases = dict(text or {}), {}, dict(aliases or {})
        self._nested = set(nested)
        self._walk(self.mapping.fields)
        own = self.mapping.join_field()
        self.join_field = join_field or (own.name if own else None)
        self._store: Store | None = None
        self._terms: Terms | None = None

    def _walk(self, fields: list[Field], at: str = "") -> None:
        for f in fields:
            path = at + f.name
            if f.kind == "text":
                self.analyzers.setdefault(path, f.options.get("analyzer", "standard"))
                if "search_analyzer" in f.options:
                    self.search_analyzers[path] = f.options["search_analyzer"]
            if f.kind == "nested":
                self._nested.add(path)
            for m in f.fields:
                self.aliases[f"{path}.{m.name}"] = path
                if m.kind == "text":
                    self.analyzers[f"{path}.{m.name}"] = m.options.get("analyzer", "standard")
            self._walk(f.children, path + ".")

    @property
    def nested(self) -> frozenset[str]:
        return frozenset(self._nested)

    @property
    def field_names(self) -> list[str]:
        return [f.name for f in self.mapping.fields]

    def __repr__(self) -> str:
        return f"<Index {self.name}>"

    # -- documents --------------------------------------------------------------------------------------------

    @property
    def spark(self) -> SparkSession:
        return SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()

    @property
    def store(self) -> Store:
        if self._store is None:
            if not self.root:
                raise ValueError(f"{self.name}: no folder to store documents in")
            self._store = Store(self.spark, self.root, self.name, self.document_schema())
        return self._store

    def document_schema(self) -> T.StructType:
        fields = [T.StructField("_id", T.StringType()), *self.mapping.schema().fields]
        plain = Compiler(Schema(T.StructType(fields), aliases=self.aliases))
        held = [p for p in self.analyzers if plain.schema.kind(p) is not None]
        return T.StructType(fields + [T.StructField(column_of(p), T.ArrayType(T.StringType())) for p in held])

    # -- stored analysis --------------------------------------------------------------------------------------

    def with_tokens(self, df: DataFrame) -> DataFrame:
        """`df` with the tokens of its text fields in hidden columns."""
        schema = Schema(df.schema, self.id_column, self.analyzers, self.search_analyzers, self.aliases, settings=self.settings.get("analysis"))
        return with_tokens(df, list(self.analyzers), schema)

    def stored_terms(self) -> Terms | None:
        """Statistics of the current documents' terms, if they have been stored."""
        if self._frame is not None:
            return self._terms
        if not self.root or not self.store.exists():
            return None
        folder = self.store.terms_folder()
        return Terms(self.spark, folder) if self.store.files.exists(f"{folder}/fields/_SUCCESS") else None

    def analyse(self) -> None:
        """Store the statistics of the current documents' terms; without them a scored query counts its terms itself."""
        if self.analyzers and self.stored_terms() is None:
            Terms(self.spark, self.store.terms_folder()).build(self.documents(), list(self.analyzers))

    def analysed(self, folder: str, files: int | None = None) -> Index:
        """This index over a copy of its documents, stored in `folder` with their tokens and the terms' statistics.

        files: how many to deal the documents to, if a file's share in reading is over four times as large; they are shuffled only then.
        """
        docs = self.documents()
        if files is not None:
            read = [r["count"] for r in docs.groupBy(F.spark_partition_id()).count().collect()]  # no column is read for it
            if sum(read) and max(read) * files > 4 * sum(read):
                docs = docs.repartition(files, self.id_column, *[p for p in self.analyzers if p in docs.columns])  # by keys: rows dealt in turn are sorted first
        self.with_tokens(docs).write.option("compression", "zstd").parquet(f"{folder}/documents")
        out = copy.copy(self)
        out._frame = lambda: self.spark.read.parquet(f"{folder}/documents")
        out._terms = Terms(self.spark, folder)
        out._terms.build(out._frame(), list(self.analyzers))
        return out

    def exists(self) -> bool:
        return self._frame is not None or (bool(self.root) and self.store.exists())

    def documents(self) -> DataFrame:
        if self._frame is not None:
            return self._frame() if callable(self._frame) else self._frame
        return self.store.read()

    def source_rows(self) -> DataFrame:
        if self._source is None:
            return self.documents()
        return self._source()

    def compose(self, rows: DataFrame, fields: list[str] | None = None) -> DataFrame:
        return self.mapping.compose(rows, fields)

    def delete_matching(self, found: DataFrame) -> int:
        return self.store.delete_ids(found.select("_id"))

    # -- requests ---------------------------------------------------------------------------------------------

    def all(self) -> Request:
        scope = Request.current_scope()
        if scope is not None and self.name in scope._known:
            return scope
        return Request(self)

    def __getattr__(self, name: str) -> Any:
        if name.startswith("_"):
            raise AttributeError(name)
        if name in self.__dict__.get("scopes", {}):
            return lambda *a, **k: self.scopes[name](self.all(), *a, **k)
        if hasattr(Request, name):
            return getattr(self.all(), name)
        raise AttributeError(name)

    def search_string(self, query: str, **options: Any) -> Request:
        return self.all().query({"query_string": {"query": query, **options}})

    # -- lifecycle --------------------------------------------------------------------------------------------

    def specification(self) -> dict:
        return {"settings": {k: v for k, v in self.settings.items() if k != "analysis"} | ({"analysis": _plain(self.settings["analysis"])} if "analysis" in self.settings else {}), **self.mapping.to_dict()}

    def create(self, suffix: str | None = None) -> bool:
        """An empty index; False if it is there."""
        if self.exists():
            return False
        self.store.write(self.spark.createDataFrame([], self.document_schema()), suffix)
        self.store.lock_specification(self.specification())
        return True

    def delete(self) -> bool:
        there = self.exists()
        if there:
            self.store.drop()
        return there

    def purge(self) -> bool:
        self.delete()
        return self.create()

    def versions(self) -> list[str]:
        return self.store.versions()

    def changed(self) -> bool:
        """Whether mapping or settings differ from those last deployed."""
        return self.store.specification_changed(self.specification())

    def update_mapping(self) -> None:
        """Deploy the mapping: new fields are there, null, in documents that lack them."""
        old = self.store.read()
        more = {f.name: F.lit(None).cast(f.dataType) for f in self.document_schema().fields if f.name not in old.columns}
        if more:
            self.store.write(old.withColumns(more))
        self.store.lock_specification(self.specification())

    def reindex_to(self, other: Index) -> None:
        plain = self.documents()
        other.store.write(other.with_tokens(plain.drop(*[c for c in plain.columns if c.startswith(PREFIX)])))
        other.analyse()

    def clear_cache(self) -> None:
        self.documents().unpersist()

    def reset(self, suffix: str | None = None, journal: Any = None, started: Any = None) -> bool:
        """Rebuild beside what is in use, then switch; changes journalled meanwhile are applied after."""
        from datetime import datetime, timezone

        from tessera.sources.importer import Importer

        began = started or datetime.now(timezone.utc).replace(tzinfo=None)
        documents = Importer(self).operations(self.source_rows()).filter("_op = 'index'").drop("_op")
        self.store.write(documents, suffix)
        self.store.lock_specification(self.specification())
        if journal is not None:
            journal.apply(began, [self])
        self.analyse()
        return True

    def import_(self, rows: Any = None, **options: Any) -> bool:
        from tessera.sources.importer import Importer

        return Importer(self, **options).run(rows)

    def import_strict(self, rows: Any = None, **options: Any) -> bool:
        """As `import_`, but raises if a document couldn't be imported."""
        from tessera.sources.importer import Importer

        return Importer(self, strict=True, **options).run(rows)

    def import_references(self, *fields: str) -> DataFrame:
        """Distinct ids of the source's rows, and the fields asked for: what a partial import would look at."""
        return self.source_rows().select(F.col(f"`{self.source_id}`"), *[F.col(f"`{f}`") for f in fields]).distinct()

    def sync(self) -> dict:
        from tessera.sources.syncer import Syncer

        return Syncer(self).perform()


def _plain(x: Any) -> Any:
    if isinstance(x, Mapping):
        return {k: _plain(v) for k, v in x.items()}
    if isinstance(x, (list, tuple)):
        return [_plain(v) for v in x]
    return x if isinstance(x, (str, int, float, bool, type(None))) else getattr(x, "__name__", type(x).__name__)
