"""Which services a question is sent to, for many questions at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.sets import cosine

#: Services of one catalog; it is broadcast to the questions.
MOST_SERVICES = 10_000


def prefilter(questions: DataFrame, services: DataFrame, k: int = 10, least: float = 0.0) -> DataFrame:
    """(query_id, service_id, similarity, rank_no): the k nearest services of each question, at least `least` near.

    The catalog is small and becomes one array that every question is held against where it is
    read; a catalog of more than MOST_SERVICES is refused. A vector that is missing or of another
    dimension counts as similar, so it excludes nothing.
    """
    rows = services.select("service_id", "vector").limit(MOST_SERVICES + 1).collect()
    if len(rows) > MOST_SERVICES:
        raise ValueError(f"a catalog holds at most {MOST_SERVICES} services")
    catalog = questions.sparkSession.createDataFrame([([(r.service_id, [float(x) for x in r.vector] if r.vector is not None else None) for r in rows],)], "catalog array<struct<id:string,v:array<double>>>")
    # The whole catalog stands beside each question, so its best services are found in place.
    near = F.transform("catalog", lambda s: F.struct((-F.round(cosine(F.col("vector"), s["v"]), 4)).alias("far"), s["id"].alias("service_id")))
    best = F.slice(F.filter(F.array_sort(near), lambda x: -x["far"] >= least), 1, k)
    found = questions.join(F.broadcast(catalog)).select("query_id", F.posexplode(best).alias("p", "x"))
    return found.select("query_id", "x.service_id", (-F.col("x.far")).alias("similarity"), (F.col("p") + 1).alias("rank_no"))


def uniform_weights(services: DataFrame) -> DataFrame:
    """services with the same weight for each, adding up to 1."""
    n = services.count()
    return services.withColumn("weight", F.lit(1.0 / n if n else 0.0))
