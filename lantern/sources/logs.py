"""Result logs, fixtures and metric files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.upsert import pending

#: One row of a benchmark log.
LOG = (
    "question_id string, query_class_label string, required_services array<string>, natural_query string, gt_sql_view string, gt_cypher string, gt_doc_fixture string, af_metric string, difficulty string, "
    "system_name string, queried_service_ids array<string>, answer string, retrieval_ms double, generation_ms double, conflict_count int, is_cannot_answer boolean, prompt_tokens int, reply_tokens int, model string"
)
FIXTURE = "question_id string, bm25_query string, expected_ids array<string>, scores array<double>, top_k int, index string, doc_count long, generated_by string"


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines under the log's schema; lines that are none are skipped."""
    return spark.read.schema(LOG).option("mode", "DROPMALFORMED").json(path).where("question_id is not null")


def append_log(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def still_to_do(spark: SparkSession, todo: DataFrame, path: str) -> DataFrame:
    """Questions and systems that the log does not hold yet."""
    return pending(todo, read_log(spark, path), ["question_id", "system_name"])


def read_fixtures(spark: SparkSession, path: str) -> DataFrame:
    """Golden results, one JSON document per file."""
    return spark.read.schema(FIXTURE).option("multiLine", True).json(path)


def fixture_gaps(spark: SparkSession, path: str, wanted: list[str]) -> DataFrame:
    """(question_id, problem): wanted golden results that are missing or hold nothing to compare with."""
    have = read_fixtures(spark, path).select("question_id", (F.coalesce(F.size("expected_ids"), F.lit(0)) > 0).alias("usable"))
    want = spark.createDataFrame([(w,) for w in wanted], "question_id string")
    problem = F.when(F.col("usable").isNull(), "missing").when(~F.col("usable"), "empty")
    return want.join(have, "question_id", "left").select("question_id", problem.alias("problem")).where("problem is not null")


def write_fixtures(rows: DataFrame, path: str) -> None:
    """Writes golden results unless they exist."""
    rows.write.mode("ignore").json(path)


def write_metrics(metrics: dict[str, DataFrame], folder: str) -> None:
    """Each table of metrics, small by nature, as one CSV and one JSON file."""
    for name, df in metrics.items():
        one = df.coalesce(1)
        one.write.mode("overwrite").option("header", True).csv(f"{folder}/{name}_csv")
        one.write.mode("overwrite").json(f"{folder}/{name}_json")
