"""What a Python worker keeps between tasks. Workers outlive tasks and stages, so what one operator has learned would lie beside what the next one needs; a worker keeps one operator's memory at a time."""

from __future__ import annotations

from collections.abc import Callable

_HELD: dict[str, Callable[[], None]] = {}


def keeps(name: str, forget: Callable[[], None]) -> None:
    """`forget` drops what the operator `name` keeps in this process."""
    _HELD[name] = forget


def works_for(name: str) -> None:
    """Called by tasks of `name` before their work: what other operators keep goes."""
    for other, forget in _HELD.items():
        if other != name:
            forget()
