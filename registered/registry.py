"""Name to (query, SQL twin)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .views import TWINS, Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
COVERS: dict[str, tuple[str, ...]] = {}
#: Views that a twin reads more than once and that cost too much to work out each time.
ONCE = {"labelled", "labelled_totals"}


def with_views(body: str, *views: str) -> str:
    """The body behind the common table expressions it needs, each with its own needs first."""
    order: list[str] = []

    def add(name: str) -> None:
        needs, _ = TWINS[name]
        for need in needs:
            add(need)
        if name not in order:
            order.append(name)

    for view in views:
        add(view)
    if not order:
        return body
    head = ",\n".join(f"{name} AS {'MATERIALIZED ' * (name in ONCE)}({TWINS[name][1].strip()})" for name in order)
    return f"WITH {head}\n{body.strip()}"


def query(name: str, covers: str, sql: str | None = None, views: tuple[str, ...] = ()):
    """Register a query ``Tables -> DataFrame`` under a name, with its SQL twin if it has one."""

    def wrap(build: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"registered twice: {name}")
        QUERIES[name] = lambda spark, sf_dir: build(Tables(spark, sf_dir))
        QUERIES[name].__name__ = name
        COVERS[name] = tuple(covers.split())
        if sql is not None:
            ORACLES[name] = with_views(sql, *views)
        return build

    return wrap
