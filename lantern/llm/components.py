"""Consolidating pairwise matches into groups (problem 4).

Method: seed-tree pruning. In every round each vertex proposes to its neighbourhood the smallest
vertex it sees; vertices that nobody needs as a minimum drop out and hang themselves under the
smallest proposal in a propagation forest, while the minima seen by one vertex are linked with each
other. Only minima stay, so the graph shrinks by a factor in each round. A vertex left alone is a
seed; seeds then flow down the forest, last round first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut


def _minima(edges: DataFrame) -> DataFrame:
    """(v, m): m is the smallest vertex of the closed neighbourhood of some u that holds v.

    The minimum of a vertex is aggregated in the map tasks first; the join that hands it to the
    neighbours is on the same key, where a hub's rows are split by the skew-join rule.
    """
    low = edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    passed = edges.join(low, "u").select(F.col("v"), "m")
    return passed.unionByName(low.select(F.col("u").alias("v"), "m")).distinct()


def connected_components(pairs: DataFrame, left: str, right: str, max_rounds: int = 100) -> DataFrame:
    """(vertex, group_id): every vertex that occurs in a pair of two different ids, with the smallest id of its component.

    Pairs with a null end or equal ends are ignored, direction and repetition do not matter; an
    empty table gives no rows. Any number of vertices may hang on one. Ids must be of one integer
    type. Each round writes its proposals, its minima and its remaining edges to the shared
    checkpoint folder, and each step down the forest its labels, so a lost executor costs at most
    the tasks of the current step.
    """
    parts = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kind = dict(pairs.dtypes)[left]
    ends = pairs.select(F.col(left).cast("long").alias("u"), F.col(right).cast("long").alias("v")).where("u <> v")
    edges = ends.unionByName(ends.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct()
    edges = cut(edges)
    forest: list[DataFrame] = []
    seeds: list[DataFrame] = []
    while not edges.isEmpty():
        if len(forest) == max_rounds:
            raise RuntimeError(f"the graph has not shrunk to its seeds in {max_rounds} rounds")
        reach = cut(_minima(edges))
        own = reach.groupBy("v").agg(F.min("m").alias("low"), F.max("m").alias("high"), F.max(F.when(F.col("m") == F.col("v"), 1).otherwise(0)).alias("kept"))
        own = cut(own)
        forest.append(own.where("kept = 0").select(F.col("v").alias("child"), F.col("low").alias("parent")))
        # The minima that meet in one vertex belong together: each is linked with the smallest.
        stars = reach.join(own.where("low < high").select("v", "low"), "v").where("m > low").select(F.col("m").alias("u"), F.col("low").alias("v"))
        edges = cut(stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
        # A kept vertex without links to others is the smallest of its component.
        seeds.append(own.where("kept = 1").select("v").join(edges.select(F.col("u").alias("v")).distinct(), "v", "left_anti"))
    labels = None
    for tree, found in zip(reversed(forest), reversed(seeds)):
        roots = found.select(F.col("v").alias("vertex"), F.col("v").alias("group_id"))
        labels = roots if labels is None else labels.unionByName(roots)
        below = tree.join(labels.withColumnRenamed("vertex", "parent"), "parent").select(F.col("child").alias("vertex"), "group_id")
        # A union has the partitions of both sides; those of a small step would add up.
        labels = cut(labels.unionByName(below).coalesce(parts))
    if labels is None:
        labels = ends.select(F.col("u").alias("vertex"), F.col("v").alias("group_id"))
    return labels.select(F.col("vertex").cast(kind), F.col("group_id").cast(kind))
