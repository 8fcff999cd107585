"""Upserts as set operations: which delivery of a key gives which column."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .delivery import latest_delivery


def upsert(df: DataFrame, key: str, keep: list[str], update: list[str], order: str = "loaded_at") -> DataFrame:
    """One row per key: the columns `keep` from its first delivery, `update` from its last.

    Keys of 0 and below are no records. One aggregation with a map-side part; rows of one key and
    order that differ are resolved by the greatest values.
    """
    first = F.min(F.struct(F.col(order), *[F.col(c) for c in keep])).alias("_first")
    last = F.max(F.struct(F.col(order), *[F.col(c) for c in update])).alias("_last")
    rows = df.where(F.col(key) > 0).groupBy(key).agg(first, last)
    return rows.select(key, *[F.col("_first")[c].alias(c) for c in keep], *[F.col("_last")[c].alias(c) for c in update])


def insert_new(df: DataFrame, key: str, columns: list[str], order: str = "loaded_at") -> DataFrame:
    """One row per key as first delivered; later ones are conflicts and do nothing."""
    return upsert(df, key, columns, [], order) if columns else df.where(F.col(key) > 0).select(key).distinct()


def merge_named(df: DataFrame, name: str, greatest: list[str], first_known: list[str]) -> DataFrame:
    """One row per name (any case): the greatest of some columns, of the others the smallest known value."""
    return df.where(F.col(name).isNotNull()).groupBy(F.lower(name).alias(name)).agg(*[F.max(c).alias(c) for c in greatest], *[F.min(c).alias(c) for c in first_known])


def pending(todo: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """What of todo is not done yet: an anti join on the keys."""
    return todo.join(done.select(*keys).distinct(), keys, "left_anti")


def with_namespace(parts: dict[str, DataFrame], column: str = "community") -> DataFrame:
    """Tables of several communities in one, each row with its community, so that their ids do not collide."""
    out = None
    for name, df in parts.items():
        one = df.withColumn(column, F.lit(name))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


__all__ = ["insert_new", "latest_delivery", "merge_named", "pending", "upsert", "with_namespace"]
