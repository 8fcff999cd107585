"""Evaluation of a result log: coverage, accuracy, latency, translation and refusal rates.

A log row is one question answered by one system: question_id, query_class_label, required_services,
queried_service_ids, system_name, af_metric, retrieval_ms, conflict_count, is_cannot_answer and
answer (see sources.logs.LOG).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.sets import coverage, f1, ndcg_at, recall_at, service_kind
from ..functions.text import long_numbers

# The question classes in report order, and those that need several services.
CLASSES = ["1", "2", "3", "4a", "4b", "4c", "5"]
MULTI = ["4a", "4b", "4c", "5"]
SERVICES = ["sql", "graph", "document"]


def canonical_rows(df: DataFrame, by_name: bool = False, skip_nulls: bool = True, limit: int = 200) -> DataFrame:
    """(row): each row as col=value|col=value, as ground truths are compared.

    Columns in their order or by name; nulls left out or as an empty value. Of more than limit rows
    the first in the order of their text are kept.
    """
    columns = sorted(df.columns) if by_name else df.columns
    cells = [F.concat(F.lit(f"{c}="), F.col(c).cast("string") if skip_nulls else F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in columns]
    return df.select(F.concat_ws("|", *cells).alias("row")).orderBy("row").limit(limit)


def queried_kinds() -> Column:
    return F.array_distinct(F.transform("queried_service_ids", service_kind))


def with_coverage(log: DataFrame) -> DataFrame:
    """log with sc, the source coverage of each row (M1)."""
    return log.withColumn("sc", coverage(F.col("required_services"), queried_kinds()))


def by_class(log: DataFrame, measure: str, places: int = 4) -> DataFrame:
    """(system_name, query_class, n, mean): means per class and, as 'aggregate', over all rows of a system."""
    rows = log.where(F.col(measure).isNotNull())
    sets = rows.rollup("system_name", "query_class_label").agg(F.count("*").alias("n"), F.bround(F.avg(measure), places).alias("mean"), F.grouping_id().alias("g"))
    return sets.where("g < 3").select("system_name", F.when(F.col("g") == 1, "aggregate").otherwise(F.col("query_class_label")).alias("query_class"), "n", "mean")


def accuracy(metric: Column, found: Column, truth: Column, k: int = 10) -> Column:
    """The answer measure that a question asks for: f1, ndcg10 or recall10."""
    return F.when(metric == "ndcg10", ndcg_at(found, truth, k)).when(metric == "recall10", recall_at(found, truth, k)).otherwise(f1(found, truth))


def with_accuracy(log: DataFrame, truths: DataFrame, k: int = 10) -> DataFrame:
    """log with af, the answer measure of each row against truths (question_id, truth: ids as text, best first), null where a question has none.

    What an answer cites are its numbers of at least four digits; ids are compared with ids. A
    question has one truth, a bounded list, so the truths are broadcast by their measured size.
    """
    rows = log.join(truths.select("question_id", "truth"), "question_id", "left")
    return rows.withColumn("af", F.when(F.col("truth").isNotNull(), accuracy(F.col("af_metric"), long_numbers(F.coalesce("answer", F.lit(""))), F.col("truth"), k))).drop("truth")


def latency(log: DataFrame) -> DataFrame:
    """(system_name, n, mean, p50, p95, p99): exact interpolated percentiles to one place."""
    p = lambda q: F.bround(F.percentile("retrieval_ms", q), 1)
    return log.where("retrieval_ms is not null").groupBy("system_name").agg(F.count("*").alias("n"), F.bround(F.avg("retrieval_ms"), 1).alias("mean"), p(0.5).alias("p50"), p(0.95).alias("p95"), p(0.99).alias("p99"))


def translation_rate(log: DataFrame) -> DataFrame:
    """(system_name, service, n, rate): of the rows that require a service, the share in which it was queried (M8)."""
    rows = log.select("system_name", queried_kinds().alias("got"), F.explode("required_services").alias("service"))
    return rows.groupBy("system_name", "service").agg(F.count("*").alias("n"), F.bround(F.avg(F.array_contains("got", F.col("service")).cast("double")), 4).alias("rate"))


def conflict_rate(log: DataFrame) -> DataFrame:
    """(system_name, n, rate): share of rows over several services with a conflict; 0 where a system has none (M9)."""
    multi = F.col("query_class_label").isin(*MULTI)
    hit = F.when(multi, (F.col("conflict_count") > 0).cast("double"))
    return log.groupBy("system_name").agg(F.count(F.when(multi, 1)).alias("n"), F.coalesce(F.bround(F.avg(hit), 4), F.lit(0.0)).alias("rate"))
