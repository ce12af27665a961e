"""Operators for building training data, with their registered queries.

Nothing outside this package imports it. ``load_all`` gives name -> (query,
DuckDB SQL or None); a query takes a session and the folder of the tables.
"""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}

MODULES = ("pii", "quality", "packing", "near", "lm", "exact", "language", "pieces", "rules", "edits", "infill", "secrets", "phrases")


def query(name: str, sql: str | None = None):
    """Register a query and its oracle."""

    def add(fn):
        QUERIES[name] = (fn, sql)
        return fn

    return add


def load_all() -> dict:
    """Import every operator and return what they registered."""
    for module in MODULES:
        import_module(f"{__name__}.{module}")
    return QUERIES
