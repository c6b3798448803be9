"""Where queries are kept with the SQL they equal."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable:
    """Registers a query (spark, root) -> DataFrame under its name, with SQL where SQL can say it."""

    def put(fn: Callable) -> Callable:
        key = name or fn.__name__
        QUERIES[key] = fn
        if sql is not None:
            ORACLE[key] = sql
        return fn

    return put
