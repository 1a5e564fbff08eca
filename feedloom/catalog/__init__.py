"""All registered queries and their checks."""

from __future__ import annotations

import importlib

from feedloom.catalog.base import CHECKS, QUERIES

_MODULES = ("reports", "report_views", "compare", "usage", "evaluate", "text", "extract", "scoring", "sources")


def _load() -> None:
    for name in _MODULES:
        importlib.import_module(f"feedloom.catalog.{name}")


def queries():
    _load()
    return dict(QUERIES)


def checks():
    _load()
    return dict(CHECKS)
