"""Named queries over the given tables, each with an optional SQL twin for checking."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .inputs import SQL_VIEWS, Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, uses: str = ""):
    """Register ``fn(tables) -> DataFrame`` under ``name``; ``uses`` lists derived views the SQL needs."""

    def keep(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = with_views(sql, uses.split())
        return fn

    return keep


def with_views(sql: str, uses: list[str]) -> str:
    order: list[str] = []

    def visit(view: str) -> None:
        if view in order:
            return
        needs, _ = SQL_VIEWS[view]
        for n in needs.split():
            visit(n)
        order.append(view)

    for u in uses:
        visit(u)
    sql = sql.strip()
    recursive = sql.upper().startswith("RECURSIVE")
    if recursive:
        sql = sql[len("RECURSIVE"):].strip()
    heads = [f"{v} AS ({SQL_VIEWS[v][1]})" for v in order]
    if sql.upper().startswith("WITH "):
        sql = sql[5:]
        body = ",\n".join(heads + [sql])
        return f"WITH {'RECURSIVE ' if recursive else ''}{body}"
    if not heads:
        return sql
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(heads) + "\n" + sql
