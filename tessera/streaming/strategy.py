"""Strategies: when changes of source rows reach the indexes."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.sources.importer import Ids

_stack: ContextVar[tuple] = ContextVar("strategies", default=())


class UndefinedStrategy(RuntimeError):
    """An update outside any strategy."""


class Base:
    """Refuses updates, so that none is lost unnoticed. ids: a list, or a DataFrame with `_id`, which stays one."""

    def update(self, index: Any, ids: Any, **options: Any) -> None:
        raise UndefinedStrategy(f"{index.name}: choose a strategy before changing rows")

    def leave(self) -> None:
        pass


class Bypass(Base):
    def update(self, index: Any, ids: Any, **options: Any) -> None:
        pass


class Urgent(Base):
    """Each change at once."""

    def update(self, index: Any, ids: Any, **options: Any) -> None:
        index.import_strict(Ids(ids) if isinstance(ids, DataFrame) else list(ids), **options)


class Atomic(Base):
    """Distinct ids of each index, imported together at the end."""

    def __init__(self) -> None:
        self.held: dict[Any, dict[str, None]] = {}
        self.frames: dict[Any, list[DataFrame]] = {}

    def update(self, index: Any, ids: Any, **options: Any) -> None:
        if isinstance(ids, DataFrame):
            self.frames.setdefault(index, []).append(ids.select(F.col("_id").cast("string").alias("_id")))
        else:
            self.held.setdefault(index, {}).update(dict.fromkeys(map(str, ids)))

    def leave(self) -> None:
        for index in {**self.held, **self.frames}:
            index.import_strict(self.gathered(index))

    def gathered(self, index: Any) -> Any:
        ids = list(self.held.get(index, ()))
        frames = self.frames.get(index, [])
        if not frames:
            return ids
        listed = [index.spark.createDataFrame([(i,) for i in ids], "_id string")] if ids else []
        return Ids(reduce(DataFrame.unionByName, frames + listed).distinct())


class Queued(Base):
    """Changes go to a folder as a feed; `feed.consume` or `feed.delayed` imports them elsewhere (see `streaming.feed`).

    fields: what changes of an index concern if they don't say it (`update_fields`).
    """

    def __init__(self, path: str, fields: dict[Any, list[str]] | None = None):
        self.path, self.fields = path, fields or {}
        self.held: dict[tuple, dict[str, None]] = {}
        self.frames: list[tuple] = []

    def update(self, index: Any, ids: Any, update_fields: list[str] | None = None, **options: Any) -> None:
        own = update_fields if update_fields is not None else self.fields.get(index)
        own = None if own is None else tuple(own)
        if isinstance(ids, DataFrame):
            self.frames.append((index, own, ids))
        else:
            self.held.setdefault((index, own), {}).update(dict.fromkeys(map(str, ids)))

    def leave(self) -> None:
        from tessera.streaming.feed import append

        for index, fields, ids in [*((i, f, list(ids)) for (i, f), ids in self.held.items()), *self.frames]:
            append(index.spark, self.path, index.name, ids, None if fields is None else list(fields))


NAMED: dict[str, Callable[..., Base]] = {"base": Base, "bypass": Bypass, "urgent": Urgent, "atomic": Atomic, "atomic_no_refresh": Atomic, "queued": Queued, "active_job": Queued, "sidekiq": Queued, "lazy_sidekiq": Queued, "delayed_sidekiq": Queued}


def current() -> Base:
    held = _stack.get()
    return held[-1] if held else Base()


@contextmanager
def strategy(name: str | Base, *args: Any, **options: Any) -> Iterator[Base]:
    """Changes within the block follow this strategy; blocks nest."""
    own = name if isinstance(name, Base) else NAMED[name](*args, **options)
    token = _stack.set((*_stack.get(), own))
    try:
        yield own
    finally:
        _stack.reset(token)
    own.leave()


class Observer:
    """What a kind of source row changes: `to_ids(changes)` maps changed rows to the index's ids, as a DataFrame.

    Back references are joins, so a change of one parent reaches all its documents without a loop.
    """

    def __init__(self, index: Any, to_ids: Callable[[Any], Any] | None = None, only_if: Callable[[Any], Any] | None = None):
        self.index, self.only_if = index, only_if
        self.to_ids = to_ids or (lambda changes: changes.select(F.col("id")))

    def changed(self, changes: Any) -> None:
        rows = changes.filter(self.only_if(changes)) if self.only_if else changes
        ids = self.to_ids(rows)
        current().update(self.index, ids.select(F.col(ids.columns[0]).cast("string").alias("_id")).distinct())


def batch_name() -> str:
    return uuid.uuid4().hex
