"""The registered queries of the engine and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gleaner.plans import connectors, engine, etl, exports, increments, ranking, records

FAMILIES = (ranking, etl, records, connectors, exports, engine, increments)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for family in FAMILIES for name, f in family.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for family in FAMILIES for name, sql in family.SQL.items()}
