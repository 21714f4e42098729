"""Registered queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from corpuscle.plans import views

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Registers a query under its name, with its SQL."""

    def keep(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = views.sql(sql)
        return f

    return keep
