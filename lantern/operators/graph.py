"""Property graph over edge tables: patterns, paths, centrality and communities.

An edge table has src and dst (and whatever else); a pattern is a chain of equi-joins that Catalyst
orders and that broadcast or shuffle by size. Within one pattern no edge is used twice.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut


def both_ways(edges: DataFrame) -> DataFrame:
    """edges with each edge in both directions; edge names the stored one (least, greatest)."""
    e = edges.select("src", "dst", *[c for c in edges.columns if c not in ("src", "dst")])
    back = e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *[c for c in e.columns if c not in ("src", "dst")])
    return e.unionByName(back)


def attached(edges: DataFrame, sources: DataFrame, targets: DataFrame) -> DataFrame:
    """Distinct edges whose both ends exist; sources and targets have one column each."""
    s, t = sources.toDF("src").distinct(), targets.toDF("dst").distinct()
    return edges.where("src is not null and dst is not null").join(s, "src", "left_semi").join(t, "dst", "left_semi").select(*edges.columns).distinct()


def within_hops(edges: DataFrame, start, hops: int, directed: bool = True) -> DataFrame:
    """(id): distinct ends of trails of 1 to `hops` edges from start.

    A trail may meet a vertex again but not an edge; each step carries the edges behind it as far as
    the next one needs them, and paths that end alike with the same edges are one.
    """
    e = edges.select("src", "dst").distinct()
    step = (e if directed else both_ways(e)).distinct().select(F.col("src").alias("a"), F.col("dst").alias("b"), F.struct(F.least("src", "dst").alias("lo"), F.greatest("src", "dst").alias("hi"), F.when(F.lit(directed), F.col("src")).alias("from")).alias("edge"))
    at = step.where(F.col("a") == F.lit(start)).select(F.col("b").alias("id"), F.array("edge").alias("trail"))
    out = at.select("id")
    for n in range(2, hops + 1):
        at = at.join(step, F.col("id") == F.col("a")).where(~F.array_contains("trail", F.col("edge")))
        # Behind the last step no edge is asked for, so its ends are one row each where they arise.
        at = at.select(F.col("b").alias("id"), F.array_sort(F.concat("trail", F.array("edge"))).alias("trail")).distinct() if n < hops else at.select(F.col("b").alias("id")).distinct()
        out = out.unionByName(at.select("id"))
    return out.distinct()


def chain_roots(edges: DataFrame, longest: int) -> DataFrame:
    """(root, paths): vertices without an outgoing edge and the number of trails of 1 to `longest` (at most 3) edges that end there."""
    if longest > 3:
        raise ValueError("trails of at most three edges are counted")
    e = edges.select("src", "dst").distinct()
    roots = e.select(F.col("dst").alias("root")).distinct().join(e.select(F.col("src").alias("root")), "root", "left_anti")
    # Walked backwards from the roots, paths that stand at one vertex are counted, not listed. In
    # three steps to a root an edge can only come twice if it is a loop and comes twice in a row.
    at = roots.select("root", F.col("root").alias("v"), F.lit(False).alias("looped"), F.lit(1).cast("long").alias("n"))
    out = None
    for _ in range(longest):
        step = at.join(e, F.col("v") == F.col("dst")).where(~(F.col("looped") & (F.col("src") == F.col("dst"))))
        at = step.groupBy("root", F.col("src").alias("v"), (F.col("src") == F.col("dst")).alias("looped")).agg(F.sum("n").alias("n"))
        out = at if out is None else out.unionByName(at)
    return out.groupBy("root").agg(F.sum("n").alias("paths"))


def shortest_path(edges: DataFrame, start, end, most: int | None = None) -> int | None:
    """Edges on a shortest undirected path from start to end; None if there is none, or with `most` none within that.

    A breadth-first search from both ends until they meet or a frontier is empty; each round reads
    one frontier and cuts its lineage.
    """
    if start == end:
        return 0
    e = cut(both_ways(edges.select("src", "dst")).distinct())
    sides = []
    for v in (start, end):
        first = e.where(F.col("src") == F.lit(v)).select(F.col("src").alias("v")).distinct()
        sides.append([first, first])
    for length in count(1) if most is None else range(1, most + 1):
        side = sides[length % 2]
        near = e.join(side[1], e.src == F.col("v"), "left_semi").select(F.col("dst").alias("v")).distinct().join(side[0], "v", "left_anti")
        side[1] = cut(near)
        side[0] = cut(side[0].unionByName(side[1]))
        if side[1].isEmpty():
            return None
        if not side[1].join(sides[1 - length % 2][0], "v", "left_semi").isEmpty():
            return length
    return None


def pagerank(edges: DataFrame, rounds: int = 20, damping: float = 0.85) -> DataFrame:
    """(v, score) after a fixed number of rounds from 1 - damping; a vertex passes its score on in equal parts.

    Contributions are added up per target in the map tasks. Vertices without an outgoing edge pass
    nothing on.
    """
    e = edges.select("src", "dst").distinct()
    out = e.groupBy("src").agg(F.count("*").alias("deg"))
    e = cut(e.join(out, "src"))
    vertices = cut(e.select(F.col("src").alias("v")).unionByName(e.select(F.col("dst").alias("v"))).distinct())
    score = vertices.withColumn("score", F.lit(1 - damping))
    for n in range(rounds):
        given = e.join(score, e.src == F.col("v")).groupBy(F.col("dst").alias("v")).agg(F.sum(F.col("score") / F.col("deg")).alias("s"))
        score = vertices.join(given, "v", "left").select("v", (F.lit(1 - damping) + damping * F.coalesce("s", F.lit(0.0))).alias("score"))
        if n % 4 == 3:
            score = cut(score)
    return score


def modularity(edges: DataFrame, weight: str, label: DataFrame) -> DataFrame:
    """(modularity): how much of the weight lies within communities, less what chance would put there; label has v and community."""
    e = both_ways(edges.select("src", "dst", F.col(weight).cast("double").alias("w"))).join(label.select(F.col("v").alias("src"), F.col("community").alias("c")), "src").join(label.select(F.col("v").alias("dst"), F.col("community").alias("d")), "dst")
    own = e.groupBy("c").agg(F.sum("w").alias("k"), F.sum(F.when(F.col("c") == F.col("d"), F.col("w")).otherwise(0.0)).alias("inside"))
    total = F.sum("k")
    return own.agg((F.sum("inside") / total - F.sum(F.col("k") * F.col("k")) / (total * total)).alias("modularity"))


def communities(edges: DataFrame, weight: str, rounds: int = 12) -> DataFrame:
    """(v, community): modularity optimised by moving vertices between communities, made deterministic.

    In each round half of the vertices, alternating by a hash so that neighbours do not swap places,
    take the community among their neighbours' and their own that adds most to the modularity, the
    smallest among equals. It ends when two rounds change nothing. A community is named by one of its
    first members. A local optimum, like that of the graph server the reference uses.
    """
    e = cut(both_ways(edges.select("src", "dst", F.col(weight).cast("double").alias("w"))))
    whole = e.agg(F.sum("w").alias("w")).first()["w"]
    own = cut(e.groupBy(F.col("src").alias("v")).agg(F.sum("w").alias("k")))
    label = own.select("v", "k", F.col("v").alias("label"))
    quiet = 0
    for n in range(rounds):
        sums = label.groupBy("label").agg(F.sum("k").alias("total"))
        votes = e.join(label.select(F.col("v").alias("dst"), "label"), "dst").groupBy(F.col("src").alias("v"), "label").agg(F.sum("w").alias("s"))
        # To stay is a choice as well, also without a neighbour there.
        votes = votes.unionByName(label.select("v", "label", F.lit(0.0).alias("s"))).groupBy("v", "label").agg(F.sum("s").alias("s"))
        votes = votes.join(sums, "label").join(label.select("v", "k", F.col("label").alias("was")), "v")
        gain = F.col("s") - F.col("k") * (F.col("total") - F.when(F.col("label") == F.col("was"), F.col("k")).otherwise(0.0)) / F.lit(whole)
        best = votes.groupBy("v", "k", "was").agg(F.min(F.struct((-F.round(gain, 6)).alias("g"), "label")).alias("x"))
        turn = F.pmod(F.xxhash64("v"), F.lit(2)) == n % 2
        label = cut(best.select("v", "k", "was", F.when(turn, F.col("x.label")).otherwise(F.col("was")).alias("label")))
        quiet = 0 if not label.where("label <> was").isEmpty() else quiet + 1
        label = label.select("v", "k", "label")
        if quiet == 2:
            break
    return label.select("v", F.col("label").alias("community"))
