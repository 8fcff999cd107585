"""Evaluation and routing queries over a result log derived from the events table and over embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..federation.relevance import prefilter, uniform_weights
from ..federation.validation import cypher_verdict, sql_verdict
from ..functions.sets import f1, ndcg_at, norm, recall_at, unit
from ..functions.text import long_numbers
from ..operators import evaluate as E
from ..session import table
from ..streaming.heartbeats import expired
from .book import Book

BOOK = Book()
SYSTEMS = ["full", "b1_sql_only", "b2_doc_only", "b3_calling", "b4_fixed"]
SERVICE_IDS = ["stats-sql-activity", "stats-graph-knowledge", "stats-document-content"]
REQUIRED = {"1": ["sql"], "2": ["graph"], "3": ["document"], "4a": ["sql", "graph"], "4b": ["sql", "document"], "4c": ["graph", "document"], "5": ["sql", "graph", "document"]}


def log(spark: SparkSession, base: str) -> DataFrame:
    """A result log with the columns of a benchmark run, one row per event."""
    e = table(spark, base, "events")
    label = F.array(*map(F.lit, E.CLASSES))[(F.col("event_id") % 120 % 7).cast("int")]
    required = F.create_map(*[x for k, v in REQUIRED.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    queried = F.filter(F.array(*map(F.lit, SERVICE_IDS)), lambda x, i: (F.col("event_id") + F.col("user_id") + i) % 3 != 0)
    n = F.col("event_id") % 12
    return e.select(
        (F.col("event_id") % 120).alias("question_id"),
        F.array(*map(F.lit, SYSTEMS))[(F.col("event_id") % 5).cast("int")].alias("system_name"),
        label.alias("query_class_label"),
        required[label].alias("required_services"),
        queried.alias("queried_service_ids"),
        F.array(F.lit("f1"), F.lit("ndcg10"), F.lit("recall10"))[(F.col("event_id") % 3).cast("int")].alias("af_metric"),
        (F.col("value") * 1).alias("retrieval_ms"),
        (F.col("event_id") % 4).alias("conflict_count"),
        (F.col("event_id") % 11 == 0).alias("is_cannot_answer"),
        F.transform(F.sequence(F.lit(1), n + 1), lambda i: F.col("user_id") + i * 2).alias("found"),
        F.transform(F.sequence(F.lit(1), F.col("event_id") % 16 + 1), lambda i: F.col("user_id") + i * 3 + F.col("event_id") % 2).alias("truth"),
        F.concat(F.lit("See "), F.col("event_id") + 1000, F.lit(" and item_"), F.col("user_id"), F.lit(", not "), F.col("event_id") % 1000, F.lit(".")).alias("answer"),
        "event_id",
    )


def _arr(xs: list[str]) -> str:
    return "[" + ", ".join(f"'{x}'" for x in xs) + "]"


_LOG = f"""WITH base AS (SELECT *, {_arr(E.CLASSES)}[(event_id % 120 % 7)::INT + 1] AS query_class_label FROM events),
log AS (SELECT event_id % 120 AS question_id, {_arr(SYSTEMS)}[(event_id % 5)::INT + 1] AS system_name, query_class_label,
  CASE query_class_label {' '.join(f"WHEN '{k}' THEN {_arr(v)}" for k, v in REQUIRED.items())} END AS required,
  list_filter({_arr(E.SERVICES)}, lambda x, i: (event_id + user_id + i - 1) % 3 <> 0) AS got,
  ['f1', 'ndcg10', 'recall10'][(event_id % 3)::INT + 1] AS af_metric, value AS retrieval_ms, event_id % 4 AS conflict_count,
  list_transform(generate_series(1, event_id % 12 + 1), lambda i: user_id + i * 2) AS found,
  list_transform(generate_series(1, event_id % 16 + 1), lambda i: user_id + i * 3 + event_id % 2) AS truth, event_id, user_id FROM base),
measured AS (SELECT *, len(list_intersect(required, got))::DOUBLE / len(required) AS sc,
  CASE WHEN len(list_intersect(found, truth)) = 0 THEN 0.0 ELSE 2.0 * len(list_intersect(found, truth)) / (len(found) + len(truth)) END AS f1,
  len(list_intersect(found[1:10], truth))::DOUBLE / len(truth) AS recall10,
  least(1.0, list_sum(list_transform(found[1:10], lambda x, i: CASE WHEN list_contains(truth[1:10], x) THEN 1.0 / list_position(truth[1:10], x) / log2(i + 1) ELSE 0.0 END)) / list_sum(list_transform(truth[1:10], lambda x, i: 1.0 / i / log2(i + 1)))) AS ndcg10 FROM log)
"""


@BOOK.add("eval_coverage", _LOG + "SELECT system_name, sc AS sc, count(*) AS n FROM (SELECT system_name, round(sc, 4) AS sc FROM measured) GROUP BY ALL")
def eval_coverage(spark: SparkSession, base: str) -> DataFrame:
    """Source coverage (M1)."""
    return E.with_coverage(log(spark, base)).groupBy("system_name", F.round("sc", 4).alias("sc")).agg(F.count("*").alias("n"))


def _measure(spark: SparkSession, base: str, name: str, value) -> DataFrame:
    return log(spark, base).select("event_id", F.round(value, 4).alias(name))


@BOOK.add("eval_f1", _LOG + "SELECT event_id, round(f1, 4) AS f1 FROM measured")
def eval_f1(spark: SparkSession, base: str) -> DataFrame:
    """Set F1 (M2)."""
    return _measure(spark, base, "f1", f1(F.col("found"), F.col("truth")))


@BOOK.add("eval_ndcg", _LOG + "SELECT event_id, round(ndcg10, 4) AS ndcg10 FROM measured")
def eval_ndcg(spark: SparkSession, base: str) -> DataFrame:
    """NDCG@10 (M3)."""
    return _measure(spark, base, "ndcg10", ndcg_at(F.col("found"), F.col("truth"), 10))


@BOOK.add("eval_recall", _LOG + "SELECT event_id, round(recall10, 4) AS recall10 FROM measured")
def eval_recall(spark: SparkSession, base: str) -> DataFrame:
    """Recall@10 (M4)."""
    return _measure(spark, base, "recall10", recall_at(F.col("found"), F.col("truth"), 10))


@BOOK.add("eval_percentiles", _LOG + "SELECT query_class_label, round(quantile_cont(retrieval_ms, 0.5), 4) AS p50, round(quantile_cont(retrieval_ms, 0.95), 4) AS p95 FROM log GROUP BY ALL")
def eval_percentiles(spark: SparkSession, base: str) -> DataFrame:
    """Exact percentiles (M5)."""
    return log(spark, base).groupBy("query_class_label").agg(F.round(F.percentile("retrieval_ms", 0.5), 4).alias("p50"), F.round(F.percentile("retrieval_ms", 0.95), 4).alias("p95"))


@BOOK.add("eval_coverage_by_class", _LOG + "SELECT system_name, query_class_label AS query_class, count(*) AS n, round_even(avg(sc), 4) AS mean FROM measured GROUP BY ALL UNION ALL SELECT system_name, 'aggregate', count(*), round_even(avg(sc), 4) FROM measured GROUP BY system_name")
def eval_coverage_by_class(spark: SparkSession, base: str) -> DataFrame:
    """Coverage per system and class with the total (M6)."""
    return E.by_class(E.with_coverage(log(spark, base)), "sc")


@BOOK.add("eval_latency", _LOG + "SELECT system_name, count(*) AS n, round(avg(retrieval_ms), 1) AS mean, round(quantile_cont(retrieval_ms, 0.5), 1) AS p50, round(quantile_cont(retrieval_ms, 0.95), 1) AS p95, round(quantile_cont(retrieval_ms, 0.99), 1) AS p99 FROM log GROUP BY system_name")
def eval_latency(spark: SparkSession, base: str) -> DataFrame:
    """Latency statistics (M7)."""
    return E.latency(log(spark, base))


@BOOK.add("eval_translation_rate", _LOG + "SELECT system_name, service, count(*) AS n, round(avg(CASE WHEN list_contains(got, service) THEN 1.0 ELSE 0.0 END), 4) AS rate FROM (SELECT system_name, got, unnest(required) AS service FROM log) GROUP BY ALL")
def eval_translation_rate(spark: SparkSession, base: str) -> DataFrame:
    """Required services that were queried (M8)."""
    return E.translation_rate(log(spark, base))


@BOOK.add("eval_conflict_rate", _LOG + "SELECT system_name, count(*) AS n, round(avg(CASE WHEN conflict_count > 0 THEN 1.0 ELSE 0.0 END), 4) AS rate FROM log WHERE query_class_label IN ('4a', '4b', '4c', '5') GROUP BY system_name")
def eval_conflict_rate(spark: SparkSession, base: str) -> DataFrame:
    """Answers over several services with a conflict (M9)."""
    return E.conflict_rate(log(spark, base))


@BOOK.add("eval_answer_ids", "SELECT event_id, CASE WHEN event_id + 1000 >= 1000 THEN (event_id + 1000)::VARCHAR END AS ids FROM events")
def eval_answer_ids(spark: SparkSession, base: str) -> DataFrame:
    """Ids cited in an answer: numbers of four digits that stand alone."""
    return log(spark, base).select("event_id", F.array_join(long_numbers(F.col("answer")), ",").alias("ids"))


@BOOK.add("eval_accuracy", _LOG + "SELECT system_name, query_class_label AS query_class, count(*) AS n, round_even(avg(CASE af_metric WHEN 'ndcg10' THEN ndcg10 WHEN 'recall10' THEN recall10 ELSE f1 END), 4) AS mean FROM measured GROUP BY ALL UNION ALL SELECT system_name, 'aggregate', count(*), round_even(avg(CASE af_metric WHEN 'ndcg10' THEN ndcg10 WHEN 'recall10' THEN recall10 ELSE f1 END), 4) FROM measured GROUP BY system_name")
def eval_accuracy(spark: SparkSession, base: str) -> DataFrame:
    """The measure each question asks for, per system and class."""
    rows = log(spark, base).withColumn("af", E.accuracy(F.col("af_metric"), F.col("found"), F.col("truth")))
    return E.by_class(rows, "af")


def services(spark: SparkSession, base: str) -> DataFrame:
    """A catalog of ten services, each described by the unit centroid of the vectors with its label."""
    e = table(spark, base, "embeddings").where("label is not null").select("label", F.posexplode("embedding"))
    means = e.groupBy("label", "pos").agg(F.avg(F.col("col").cast("double")).alias("x")).groupBy("label").agg(F.array_sort(F.collect_list(F.struct("pos", "x"))).alias("v"))
    return means.select(F.concat(F.lit("service_"), F.col("label")).alias("service_id"), unit(F.transform("v", lambda c: c["x"])).alias("vector"))


_SERVICES = """WITH dims AS (SELECT label, pos, avg(x) AS x FROM (SELECT label, unnest(generate_series(1, len(embedding))) AS pos, unnest(embedding)::DOUBLE AS x FROM embeddings WHERE label IS NOT NULL) GROUP BY ALL),
means AS (SELECT label, list(x ORDER BY pos) AS v FROM dims GROUP BY label),
services AS (SELECT 'service_' || label AS service_id, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS vector FROM means)
"""


@BOOK.add("route_prefilter", _SERVICES + """SELECT vec_id AS query_id, service_id, round(s, 4) AS similarity, row_number() OVER (PARTITION BY vec_id ORDER BY round(s, 4) DESC, service_id)::INT AS rank_no
FROM (SELECT vec_id, service_id, list_dot_product(embedding::DOUBLE[], vector) / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS s FROM embeddings, services) WHERE round(s, 4) >= 0.0 QUALIFY rank_no <= 3""")
def route_prefilter(spark: SparkSession, base: str) -> DataFrame:
    """Services nearest to each question's vector (C7, O8), for all questions in one job."""
    qs = table(spark, base, "embeddings").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return prefilter(qs, services(spark, base), 3)


@BOOK.add("route_unit_norm", "SELECT vec_id, round(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 4) AS length, abs(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) - 1) <= 0.01 AS is_unit FROM embeddings")
def route_unit_norm(spark: SparkSession, base: str) -> DataFrame:
    """Vectors of unit length within one per cent."""
    v = F.col("embedding")
    return table(spark, base, "embeddings").select("vec_id", F.round(norm(v), 4).alias("length"), (F.abs(norm(v) * norm(v) - 1) <= 0.01).alias("is_unit"))


@BOOK.add("route_uniform_weights", "SELECT 'service_' || label AS service_id, round(1.0 / count(*) OVER (), 4) AS weight FROM (SELECT DISTINCT label FROM embeddings WHERE label IS NOT NULL)")
def route_uniform_weights(spark: SparkSession, base: str) -> DataFrame:
    """Equal weights of all active services at the first discovery."""
    return uniform_weights(services(spark, base).select("service_id")).withColumn("weight", F.round("weight", 4))


# Translations of all kinds, good and bad.
TRANSLATED = [
    (1, "SELECT id FROM users"), (2, "with x as (select 1) select * from x"), (3, "SELEKT id FORM users"), (4, "-- CANNOT_ANSWER"), (5, ""), (6, "DELETE FROM users"),
    (7, "MATCH (u:User) RETURN u.id"), (8, "MATCH (u:User)"), (9, "// CANNOT_ANSWER"), (10, "CALL db.labels() YIELD label RETURN label"), (11, "OPTIONAL MATCH (t:Tag) RETURN t"),
    (12, "// note\nMATCH (q) RETURN q"), (13, "-- TRANSLATION_ERROR"), (14, "  select 1"), (15, "UNWIND [1] AS x RETURN x"),
]
_TRANSLATED = "WITH t AS (SELECT * FROM (VALUES " + ", ".join("({}, E'{}')".format(i, q.replace("\n", "\\n")) for i, q in TRANSLATED) + ") AS v(n, query))\n"


@BOOK.add("route_sql_validator", _TRANSLATED + "SELECT n, regexp_matches(upper(trim(query)), '^(SELECT|WITH)([^A-Z0-9_]|$)') AND NOT contains(upper(query), 'CANNOT_ANSWER') AS valid FROM t")
def route_sql_validator(spark: SparkSession, base: str) -> DataFrame:
    """Relational translations that may run (L3)."""
    return spark.createDataFrame(TRANSLATED, "n int, query string").select("n", sql_verdict(F.col("query")).alias("valid"))


@BOOK.add(
    "route_cypher_validator",
    _TRANSLATED + """SELECT n, bare <> '' AND NOT contains(upper(query), 'CANNOT_ANSWER') AND NOT regexp_matches(bare, '^(SELECT|INSERT|UPDATE|DELETE|DROP|WITH X|CREATE TABLE)([^A-Z0-9_]|$)') AND regexp_matches(bare, '(^|[^A-Z0-9_])RETURN([^A-Z0-9_]|$)') AS valid
FROM (SELECT *, trim(upper(array_to_string(list_filter(string_split(query, E'\\n'), lambda l: NOT starts_with(trim(l), '//')), E'\\n'))) AS bare FROM t)""",
)
def route_cypher_validator(spark: SparkSession, base: str) -> DataFrame:
    """Graph translations that may run (L4)."""
    return spark.createDataFrame(TRANSLATED, "n int, query string").select("n", cypher_verdict(F.col("query")).alias("valid"))


@BOOK.add("route_heartbeats", "SELECT user_id, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_seen FROM events GROUP BY user_id HAVING max(ts) < (SELECT max(ts) - INTERVAL 6 HOUR FROM events)")
def route_heartbeats(spark: SparkSession, base: str) -> DataFrame:
    """Services not heard of for longer than the timeout."""
    beats = table(spark, base, "events").select(F.col("user_id"), F.col("ts"))
    return expired(beats, "user_id", "ts", "6 hours").select("user_id", F.date_format("last_seen", "yyyy-MM-dd HH:mm:ss").alias("last_seen"))


@BOOK.add("route_strategies", _LOG + ", kinds AS (SELECT system_name, unnest(got) AS service FROM log), counts AS (SELECT system_name, service, count(*) AS n FROM kinds GROUP BY ALL) SELECT *, row_number() OVER (PARTITION BY system_name ORDER BY n DESC, service)::INT AS rank_no FROM counts")
def route_strategies(spark: SparkSession, base: str) -> DataFrame:
    """How often each system queried each kind of service."""
    rows = log(spark, base).select("system_name", F.explode(E.queried_kinds()).alias("service")).groupBy("system_name", "service").agg(F.count("*").alias("n"))
    return rows.withColumn("rank_no", F.row_number().over(Window.partitionBy("system_name").orderBy(F.desc("n"), "service")))


QUERIES, SQL = BOOK.queries, BOOK.sql
