"""Notifications: callables that hear of searches and imports."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from time import monotonic
from typing import Any

_listeners: list[Callable[[str, dict, float], None]] = []


def subscribe(listener: Callable[[str, dict, float], None]) -> Callable[[], None]:
    """listener(name, payload, seconds) is called after each event; the result ends the subscription."""
    _listeners.append(listener)
    return lambda: _listeners.remove(listener)


@contextmanager
def event(name: str, **payload: Any) -> Iterator[dict]:
    began = monotonic()
    try:
        yield payload
    finally:
        for listener in list(_listeners):
            listener(name, payload, monotonic() - began)
