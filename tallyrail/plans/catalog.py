"""Registered queries: name -> (builder, DuckDB SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    """Register a builder ``(spark, sf_dir) -> DataFrame`` with the SQL that checks it."""

    def add(fn: Callable) -> Callable:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return add
