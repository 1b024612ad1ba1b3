"""Registration of checks: a Spark query and, where SQL can say it, its SQL twin."""

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
# The statements without their building blocks.
BODIES: dict[str, str] = {}
# Named building blocks of the SQL statements, in definition order.
VIEWS: dict[str, str] = {}


def view(name: str, body: str) -> None:
    VIEWS[name] = body.strip()


def with_views(body: str, changed: dict[str, str] | None = None) -> str:
    """A statement preceded by the building blocks it uses, directly or not; `changed` ones are its own."""
    views = VIEWS | (changed or {})
    need: set[str] = set()

    def visit(text: str) -> None:
        for name in set(re.findall(r"\bb_\w+", text)) & set(views) - need:
            need.add(name)
            visit(views[name])

    visit(body)
    if not need:
        return body.strip()
    parts = [f"{n} AS ({views[n]})" for n in views if n in need]
    return "WITH " + ",\n".join(parts) + "\n" + body.strip()


def check(name: str, sql: str | None = None, tables: str = "Tables", changed: dict[str, str] | None = None):
    """Register fn(t) -> DataFrame, where t gives access to the tables (a class of `bindings`)."""
    def add(fn):
        from . import bindings
        QUERIES[name] = lambda spark, sf_dir: fn(getattr(bindings, tables)(spark, sf_dir))
        if sql is not None:
            BODIES[name] = sql.strip()
            SQL[name] = with_views(sql, changed)
        return fn
    return add
