"""Registry of queries and of the SQL that gives the same result."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession

from .views import VIEW_SQL

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def with_views(views: Sequence[str], body: str, recursive: bool = False) -> str:
    """SQL text with the named views as common table expressions in front of ``body``.

    ``body`` may go on with expressions of its own: it then starts with a comma.
    """
    needed: list[str] = []

    def add(name: str) -> None:
        if name in needed:
            return
        for dep in VIEW_SQL[name][0]:
            add(dep)
        needed.append(name)

    for v in views:
        add(v)
    ctes = ",\n".join(f"{v} AS ({VIEW_SQL[v][1]})" for v in needed)
    head = "WITH RECURSIVE " if recursive else "WITH "
    return f"{head}{ctes}\n{body.strip()}"


def query(name: str, views: Sequence[str] = (), sql: str | None = None, recursive: bool = False):
    """Register a query; ``sql`` is its oracle over the named views."""

    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = with_views(views, sql, recursive) if views else sql.strip()
        return fn

    return add
