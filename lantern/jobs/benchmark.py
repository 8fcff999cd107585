"""Runs questions through strategies, appends to a log that a later run resumes, and reduces it to metrics."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..federation.engine import Engine
from ..operators import evaluate
from ..session import exists
from ..sources.logs import LOG, append_log, read_log, still_to_do, write_metrics


#: Rows of a right answer that are compared.
MOST = 200
#: Columns of a spot check.
SPOT = "question_id string, class string, system string, answer string, duration_ms double, timestamp string"


@dataclass(frozen=True)
class Question:
    """One question of a benchmark; required names the kinds of service that an answer needs."""

    question_id: str
    label: str
    text: str
    required: tuple[str, ...]
    metric: str = "f1"
    difficulty: str = "medium"


def run(spark: SparkSession, questions: list[Question], engines: dict[str, Engine], path: str) -> int:
    """Answers what the log at path does not hold yet, question by question; returns how many rows were added.

    An answer that fails is a row without queried services, so it is not tried again.
    """
    pairs = spark.createDataFrame([(q.question_id, s) for q in questions for s in engines], "question_id string, system_name string")
    if exists(spark, path):
        pairs = still_to_do(spark, pairs, path)
    todo = {tuple(r) for r in pairs.collect()}
    added = 0
    for q in questions:
        rows = []
        for name, engine in engines.items():
            if (q.question_id, name) not in todo:
                continue
            try:
                a = engine.ask(q.question_id, q.text)
                rest = (a.queried, a.answer, a.retrieval_ms, a.generation_ms, a.n_conflicts, a.refused, a.prompt_tokens, a.reply_tokens, a.model)
            except Exception as x:  # noqa: BLE001 - a failed answer is a result
                rest = ([], f"{type(x).__name__}", 0.0, 0.0, 0, True, 0, 0, "none")
            rows.append((q.question_id, q.label, list(q.required), q.text, None, None, None, q.metric, q.difficulty, name, *rest))
        if rows:
            append_log(spark.createDataFrame(rows, LOG).coalesce(1), path)
            added += len(rows)
    return added


def truths(spark: SparkSession, base: str, questions: list[Question], queries: dict[str, Callable[[SparkSession, str], DataFrame]]) -> DataFrame:
    """(question_id, truth): the right answer of each question that has one, from the query that holds it (see jobs.questions.truth).

    The ids of a result, else its first column, in the result's order; results are bounded reports.
    """
    from ..plans.documents import ASKED
    from .questions import truth

    rows, hits = [], None
    for q in questions:
        name = truth(q.question_id)
        if name is None:
            continue
        if name == "doc_search":
            hits = hits or queries[name](spark, base).orderBy("query_id", "rank_no").collect()
            asked = ASKED[int(q.question_id.rpartition("q")[2]) - 1][0]
            ids = [str(r.doc_id) for r in hits if r.query_id == asked]
        else:
            df = queries[name](spark, base)
            column = next((c for c in df.columns if c == "id" or c.endswith("_id")), df.columns[0])
            ids = [str(r[0]) for r in df.select(column).limit(MOST).collect()]
        rows.append((q.question_id, ids))
    return spark.createDataFrame(rows, "question_id string, truth array<string>")


def metrics(spark: SparkSession, path: str, right: DataFrame | None = None) -> dict[str, DataFrame]:
    """The tables of a report: coverage and, against right answers, accuracy by class, latency, translation and conflict rates, and a summary.

    Questions without a right answer have no accuracy and are not in its means.
    """
    log = evaluate.with_coverage(read_log(spark, path))
    found = {"coverage_by_class": evaluate.by_class(log, "sc"), "latency": evaluate.latency(log), "translation_rate": evaluate.translation_rate(log), "conflict_rate": evaluate.conflict_rate(log)}
    summary = found["coverage_by_class"].where("query_class = 'aggregate'").select("system_name", "n", F.col("mean").alias("coverage"))
    if right is not None:
        found["accuracy_by_class"] = evaluate.by_class(evaluate.with_accuracy(log, right), "af")
        summary = summary.join(found["accuracy_by_class"].where("query_class = 'aggregate'").select("system_name", F.col("mean").alias("accuracy")), "system_name", "left")
    summary = summary.join(found["latency"].select("system_name", F.col("mean").alias("mean_ms"), "p95"), "system_name", "left")
    found["summary"] = summary.join(found["conflict_rate"].select("system_name", F.col("rate").alias("conflicts")), "system_name", "left")
    return found


def report(spark: SparkSession, path: str, folder: str, right: DataFrame | None = None) -> None:
    write_metrics(metrics(spark, path, right), folder)


def spot_check(spark: SparkSession, questions: list[Question], engines: dict[str, Engine], path: str) -> int:
    """Answers a few questions with their wall time, appended to the CSV folder at path question by question."""
    for q in questions:
        rows = []
        for name, engine in engines.items():
            began = time.time()
            try:
                answer = engine.ask(q.question_id, q.text).answer
            except Exception as x:  # noqa: BLE001 - a failed answer is a result
                answer = f"[{type(x).__name__}]"
            rows.append((q.question_id, q.label, name, answer.strip(), round((time.time() - began) * 1000, 1), datetime.now(UTC).isoformat()))
        spark.createDataFrame(rows, SPOT).coalesce(1).write.mode("append").option("header", True).option("quoteAll", True).csv(path)
    return len(questions) * len(engines)
