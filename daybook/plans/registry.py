"""The table of named queries and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from daybook.plans.workspace import Workspace

QUERIES: dict[str, Callable[[Workspace], DataFrame]] = {}
TWINS: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    """Register a query under a name, with the SQL that must give the same rows."""

    def register(build: Callable[[Workspace], DataFrame]) -> Callable[[Workspace], DataFrame]:
        QUERIES[name] = build
        if sql:
            TWINS[name] = sql
        return build

    return register
