"""Registry of named queries and their SQL twins.

A twin is written against the table names below; every derived table it names
is put in front of it as a common table expression.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
TWINS: dict[str, str] = {}
TABLES: dict[str, str] = {}


def table(name: str, sql: str) -> None:
    TABLES[name] = sql.strip()


def _needs(sql: str) -> list[str]:
    return [t for t in TABLES if re.search(rf"\b{t}\b", sql)]


def with_tables(body: str) -> str:
    order: list[str] = []

    def visit(sql: str, own: str | None = None) -> None:
        for t in _needs(sql):
            if t != own and t not in order:
                visit(TABLES[t], t)
                if t not in order:
                    order.append(t)

    visit(body)
    body = body.strip()
    if not order:
        return body
    heads = ",\n".join(f"{t} AS (\n{TABLES[t]}\n)" for t in order)
    if body[:5].upper() == "WITH ":
        return f"WITH {heads},\n{body[5:]}"
    return f"WITH {heads}\n{body}"


def query(name: str, sql: str | None = None):
    def keep(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql:
            TWINS[name] = sql
        return fn

    return keep
