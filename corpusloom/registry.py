"""All queries of the library proper, by name, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corpusloom.plans import queries as catalogue


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(catalogue.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(catalogue.SQL)
