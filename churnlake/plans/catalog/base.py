"""Registry of runnable queries and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Runner = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Runner] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Runner], Runner]:
    """Register a query under ``name``, with the SQL its result must equal, if it has one."""

    def add(run: Runner) -> Runner:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return add


def r6(expr: str) -> str:
    """Oracle twin of :func:`churnlake.functions.scalars.r6`."""
    return f"(ROUND({expr}, 6) + CAST(0 AS DOUBLE))"


def listed(names: list[str], pattern: str = "{0}") -> str:
    return ", ".join(pattern.format(n) for n in names)
