"""Operations over many indexes: what deployments and scheduled jobs call."""

from __future__ import annotations

from datetime import datetime
from typing import Any

from tessera.sources.index import Config
from tessera.sources.journal import Journal


def _chosen(indexes: list, only: list[str] | None = None, except_: list[str] | None = None) -> list:
    names = lambda xs: {getattr(x, "name", x) for x in xs or []}
    return [i for i in indexes if (not only or i.name in names(only)) and i.name not in names(except_)]


def reset(indexes: list, journal: Journal | None = None, **choice: Any) -> list[str]:
    """Rebuild all."""
    return [i.name for i in _chosen(indexes, **choice) if i.reset(journal=journal)]


def upgrade(indexes: list, journal: Journal | None = None, **choice: Any) -> list[str]:
    """Rebuild those whose mapping or settings changed."""
    return [i.name for i in _chosen(indexes, **choice) if (not i.exists() or i.changed()) and i.reset(journal=journal)]


def update(indexes: list, **choice: Any) -> list[str]:
    """Import all rows into indexes that are there."""
    return [i.name for i in _chosen(indexes, **choice) if i.exists() and i.import_()]


def sync(indexes: list, **choice: Any) -> dict[str, dict]:
    return {i.name: i.sync() for i in _chosen(indexes, **choice)}


def deploy(indexes: list, journal: Journal | None = None, **choice: Any) -> dict:
    """Rebuild what changed, synchronise the rest."""
    done = upgrade(indexes, journal, **choice)
    return {"upgraded": done, "synced": sync([i for i in _chosen(indexes, **choice) if i.name not in done])}


def reindex(source: Any, target: Any) -> None:
    source.reindex_to(target)


def update_mapping(index: Any) -> None:
    index.update_mapping()


def create_missing(indexes: list) -> list[str]:
    return [i.name for i in indexes if i.create()]


def journal_apply(journal: Journal, since: datetime, indexes: list, **choice: Any) -> int:
    return journal.apply(since, _chosen(indexes, **choice))


def journal_clean(journal: Journal, until: datetime | None = None, indexes: list | None = None) -> int:
    return journal.clean(until, indexes)


def massacre(indexes: list) -> list[str]:
    """Drop all indexes; only where the configuration allows it."""
    if not Config.massacre_allowed:
        raise PermissionError("set Config.massacre_allowed first")
    return [i.name for i in indexes if i.delete()]
