"""Registered queries and their SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
VIEWS: dict[str, str] = {}


def view(name: str, sql: str) -> None:
    """A named subquery other SQL may use; it may use the ones defined before it."""
    VIEWS[name] = sql


def with_views(select: str) -> str:
    """Prefix ``select`` with the views it mentions, directly or through another view."""
    needed: set[str] = set()
    todo = [select]
    while todo:
        text = todo.pop()
        for name in VIEWS:
            if name not in needed and re.search(rf"\b{name}\b", text):
                needed.add(name)
                todo.append(VIEWS[name])
    if not needed:
        return select
    parts = [f"{n} AS ({VIEWS[n]})" for n in VIEWS if n in needed]
    return "WITH " + ",\n".join(parts) + "\n" + select


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = with_views(sql)
        return fn

    return register
