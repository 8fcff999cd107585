"""Named queries with their SQL, and the archive tables as the queries see them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.delivery import latest_delivery
from ..session import table


class Book:
    """Queries by name, each with the SQL that gives the same rows where SQL can."""

    def __init__(self):
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None):
        def keep(f):
            self.queries[name] = f
            if sql:
                self.sql[name] = sql
            return f

        return keep


#: The latest delivery of each table as common table expressions; a query names those it needs.
_LATEST = "{0}_l AS (SELECT * FROM {0} QUALIFY row_number() OVER (PARTITION BY id ORDER BY loaded_at DESC) = 1)"


def with_latest(*names: str) -> str:
    return "WITH " + ", ".join(_LATEST.format(n) for n in names) + "\n"


def latest(spark: SparkSession, base: str, name: str, *columns: str, where: str | None = None) -> DataFrame:
    """The given columns of a table, one row per id, as last delivered.

    where is a condition on columns that are the same in all deliveries of a record (its id, dates
    and references); it is applied at the scan, so rows it excludes are never shuffled. Conditions
    on anything else belong after the call, since a later delivery may change what they read.
    """
    rows = table(spark, base, name)
    return latest_delivery(rows.where(where) if where else rows, ["id"], list(columns))


def top(df: DataFrame, n: int, *order: Column) -> DataFrame:
    """The first n rows in a total order (a unique column comes last in it)."""
    return df.orderBy(*order).limit(n)


def down(c: str) -> Column:
    """Descending with nulls first, as the relational store sorts."""
    return F.col(c).desc_nulls_first()
