"""Query registry: a decorator that records the callable and its SQL, and expands the shared input views."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.catalog.views import VIEW_SQL

CALLS: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _uses(text: str) -> list[str]:
    return [v for v in VIEW_SQL if re.search(rf"\b(?:FROM|JOIN)\s+{v}\b", text, re.I)]


def expand(body: str) -> str:
    """Prepends the shared views the statement names (and the views those name) as common table expressions."""
    need: list[str] = []

    def visit(text: str) -> None:
        for v in _uses(text):
            if v not in need:
                visit(VIEW_SQL[v])
                if v not in need:
                    need.append(v)

    visit(body)
    body = body.strip()
    ctes = ",\n".join(f"{v} AS ({VIEW_SQL[v].strip()})" for v in need)
    m = re.match(r"WITH\s+(RECURSIVE\s+)?", body, re.I)
    rec = "RECURSIVE " if m and m.group(1) else ""
    if not ctes:
        return body
    if m:
        return f"WITH {rec}{ctes},\n{body[m.end():]}"
    return f"WITH {ctes}\n{body}"


def query(name: str, sql: str | None = None):
    def add(fn: Callable[[SparkSession, str], DataFrame]):
        if name in CALLS:
            raise ValueError(f"duplicate query {name}")
        CALLS[name] = fn
        if sql is not None:
            SQL[name] = expand(sql)
        return fn

    return add
