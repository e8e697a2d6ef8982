"""Loads every module that registers queries."""

from __future__ import annotations

from importlib import import_module

from .registry import CATALOG, Query

MODULES = (
    "queries_read",
    "queries_aggregate",
    "queries_text",
    "queries_state",
    "queries_pages",
    "queries_quality",
    "queries_stream",
)


def load_catalog() -> dict[str, Query]:
    for name in MODULES:
        import_module(f"{__package__}.{name}")
    return CATALOG
