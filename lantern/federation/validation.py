"""Checks on translated queries, as column expressions and with retry for a single query."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

REFUSAL = "CANNOT_ANSWER"


def sql_verdict(query: Column) -> Column:
    """A relational query may run if it starts with SELECT or WITH and is no refusal."""
    q = F.upper(F.trim(query))
    return q.rlike(r"^(SELECT|WITH)([^A-Z0-9_]|$)") & ~q.contains(REFUSAL)


def cypher_verdict(query: Column) -> Column:
    """A graph query may run if, comments apart, it is not empty, no refusal, no SQL statement, and returns something."""
    lines = F.filter(F.split(query, "\n"), lambda x: ~F.trim(x).startswith("//"))
    bare = F.trim(F.upper(F.array_join(lines, "\n")))
    verbs = r"^(SELECT|INSERT|UPDATE|DELETE|DROP|WITH X|CREATE TABLE)([^A-Z0-9_]|$)"
    return (bare != "") & ~F.upper(query).contains(REFUSAL) & ~bare.rlike(verbs) & bare.rlike(r"(^|[^A-Z0-9_])RETURN([^A-Z0-9_]|$)")


def parses(spark: SparkSession, query: str) -> bool:
    """Whether Spark's own parser takes a relational query; advice only, dialects differ."""
    try:
        spark._jsparkSession.sessionState().sqlParser().parsePlan(query)
        return True
    except Exception:  # noqa: BLE001 - any parser failure is the answer
        return False


def plain_sql_ok(query: str) -> bool:
    q = query.strip().upper()
    return (q.startswith(("SELECT ", "SELECT\n", "WITH ", "WITH\n"))) and REFUSAL not in q


def plain_cypher_ok(query: str) -> bool:
    bare = "\n".join(x for x in query.split("\n") if not x.strip().startswith("//")).strip().upper()
    words = bare.replace("(", " ").split()
    return bool(words) and REFUSAL not in query.upper() and words[0] not in ("SELECT", "INSERT", "UPDATE", "DELETE", "DROP") and "RETURN" in words


@dataclass(frozen=True)
class Outcome:
    """What became of a translation: valid, fixed after one more try, dropped, or not checked."""

    query: str
    status: str
    note: str = ""


def validate(language: str, query: str, retry: Callable[[str], str] | None = None) -> Outcome:
    """Checks a query, asks once more with the failed one if a retry is given, and drops it otherwise."""
    if language == "bm25":
        return Outcome(query, "dropped", "empty or failed translation") if not query.strip() or "TRANSLATION_ERROR" in query else Outcome(query, "skipped")
    ok = plain_sql_ok if language == "sql" else plain_cypher_ok
    if ok(query):
        return Outcome(query, "valid")
    if retry is not None:
        again = retry(query)
        if ok(again):
            return Outcome(again, "fixed", query)
    return Outcome(query, "dropped", "not a query that may run")
