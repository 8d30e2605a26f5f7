"""Plug-ins by name: extractors, segmenters, models and classifiers."""

from __future__ import annotations

from collections.abc import Callable

_known: dict[tuple[str, str], Callable] = {}


def plugin(kind: str, name: str) -> Callable[[Callable], Callable]:
    """Registers a factory under its kind and name."""

    def register(f: Callable) -> Callable:
        if (kind, name) in _known:
            raise ValueError(f"{kind} {name} is taken")
        _known[kind, name] = f
        return f

    return register


def build(kind: str, name: str, *args, **options):
    if (kind, name) not in _known:
        raise KeyError(f"no {kind} named {name}; there are {sorted(n for k, n in _known if k == kind)}")
    return _known[kind, name](*args, **options)


def names(kind: str) -> list[str]:
    return sorted(n for k, n in _known if k == kind)
