"""Measures over arrays: vectors, retrieved sets and rankings, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    """a scaled to length 1; null for a zero vector."""
    return F.when(norm(a) > 0, F.transform(a, lambda x: x.cast("double") / norm(a)))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; 1 where one is missing or they differ in dimension, so that nothing is filtered out unseen."""
    return F.when(a.isNull() | b.isNull() | (F.size(a) != F.size(b)), F.lit(1.0)).otherwise(dot(a, b) / (norm(a) * norm(b)))


def coverage(required: Column, queried: Column) -> Column:
    """Share of the required items that were queried; 1 where none is required."""
    return F.when(F.size(F.array_distinct(required)) == 0, 1.0).otherwise(F.size(F.array_intersect(required, queried)) / F.size(F.array_distinct(required)))


def f1(found: Column, truth: Column) -> Column:
    """Set F1; 1 where both are empty, 0 where one is or nothing is shared."""
    n, m, k = F.size(F.array_distinct(found)), F.size(F.array_distinct(truth)), F.size(F.array_intersect(found, truth))
    return F.when((n == 0) & (m == 0), 1.0).when((n == 0) | (m == 0) | (k == 0), 0.0).otherwise(2.0 * k / (n + m))


def recall_at(found: Column, truth: Column, k: int) -> Column:
    """Share of the truth among the first k found; 1 where the truth is empty."""
    return F.when(F.size(truth) == 0, 1.0).otherwise(F.size(F.array_intersect(F.slice(found, 1, k), truth)) / F.size(F.array_distinct(truth)))


def ndcg_at(found: Column, truth: Column, k: int) -> Column:
    """Normalised discounted gain at k with relevance 1 / (place in truth) for the first k of the truth, capped at 1; 1 where the truth is empty."""
    head = F.slice(truth, 1, k)
    gain = lambda x, i: F.when(F.array_contains(head, x), F.lit(1.0) / F.array_position(head, x) / F.log2(i + 2)).otherwise(0.0)
    got = F.aggregate(F.transform(F.slice(found, 1, k), gain), F.lit(0.0), lambda s, x: s + x)
    best = F.aggregate(F.transform(head, lambda x, i: F.lit(1.0) / (i + 1) / F.log2(i + 2)), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(truth) == 0, 1.0).otherwise(F.least(got / best, F.lit(1.0)))


def service_kind(service: Column) -> Column:
    """The kind of source a service id names."""
    s = F.lower(service)
    return (
        F.when(s.rlike("sql|activity|user"), "sql")
        .when(s.rlike("graph|knowledge|neo4j"), "graph")
        .when(s.rlike("document|content|elastic"), "document")
        .otherwise(s)
    )
