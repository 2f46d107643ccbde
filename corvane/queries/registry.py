"""Named queries with their SQL twins."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corvane.queries.views import VIEW_SQL, Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(tables) -> DataFrame`` under ``name``; ``sql`` may use the view names freely."""

    def wrap(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = with_views(sql)
        return fn

    return wrap


def with_views(sql: str) -> str:
    """Prefix the statement with the view definitions it mentions."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name, body in VIEW_SQL.items():
            if name not in needed and re.search(rf"\b{name}\b", text):
                visit(body)
                if name not in needed:
                    needed.append(name)

    visit(sql)
    body = sql.strip()
    own = re.match(r"WITH\s+(RECURSIVE\s+)?", body)
    ctes = [f"{n} AS MATERIALIZED ({VIEW_SQL[n].strip()})" for n in needed]
    if own:
        ctes.append(body[own.end():])
        return "WITH RECURSIVE " + ",\n".join(ctes)
    return ("WITH RECURSIVE " + ",\n".join(ctes) + "\n" if ctes else "") + body
