"""Registry of named queries, each with SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodestack.sources.inventory import VIEWS_SQL, Inventory

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, views: bool = True):
    """Register a function of an Inventory as a query; the views are put before the SQL."""

    def register(build: Callable[[Inventory], DataFrame]):
        QUERIES[name] = lambda spark, folder: build(Inventory(spark, folder))
        if sql:
            body = sql.strip()
            ORACLES[name] = f"WITH {VIEWS_SQL}{', ' + body[5:] if body.upper().startswith('WITH ') else body}" if views else body
        return build

    return register
