"""All registered queries."""

from __future__ import annotations

from importlib import import_module

from .registry import ORACLES, QUERIES

MODULES = ["merging", "catalog", "calendar", "news", "loose", "streams"]


def all_queries():
    for m in MODULES:
        import_module(f"{__name__}.{m}")
    return dict(QUERIES)


def all_oracles():
    all_queries()
    return dict(ORACLES)
