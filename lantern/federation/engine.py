"""The whole way from a question to an answer, and the strategies it is compared with."""

from __future__ import annotations

import json
import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import integrate as I
from ..session import cut
from .catalog import Catalog, Service
from .execution import Executor, Result
from .planning import LANGUAGE, Plan, Provider, ServiceQuery, plan, strip_fences

CANNOT = "I cannot answer this question from the available sources."
#: Which kinds of service each strategy queries: all that were found, one kind, or a fixed set.
STRATEGIES = {"full": None, "sql_only": ("sql",), "document_only": ("document",), "sequential": None, "routed": None, "fixed": ("sql", "graph", "document")}
#: Rows that the routed strategy takes of a service, and of all of them.
ROUTED = 20


@dataclass(frozen=True)
class Answer:
    query_id: str
    question: str
    answer: str
    context: str
    queried: list[str]
    failed: dict[str, str]
    retrieval_ms: float
    n_conflicts: int
    generation_ms: float = 0.0
    prompt_tokens: int = 0
    reply_tokens: int = 0
    model: str = "none"

    @property
    def refused(self) -> bool:
        return self.answer.startswith("I cannot answer")


def generation_prompt(question: str, context: str) -> str:
    return f"Answer from these sources only and name them. If they do not hold the answer, say: {CANNOT}\n\n{context}\nQuestion: {question}\nAnswer:"


def generate(provider: Provider, question: str, context: str) -> str:
    """The provider's answer; without a context there is nothing to ask it."""
    return provider.complete(generation_prompt(question, context)) if context.strip() else CANNOT


class Engine:
    """Discovers services, translates, retrieves, integrates and answers."""

    def __init__(self, spark: SparkSession, catalog: Catalog, executor: Executor, translator: Provider, writer: Provider, strategy: str = "full"):
        if strategy not in STRATEGIES:
            raise ValueError(f"unknown strategy {strategy}")
        self.spark, self.catalog, self.executor, self.translator, self.writer, self.strategy = spark, catalog, executor, translator, writer, strategy

    def services(self, vector: list[float] | None = None) -> list[Service]:
        kinds = STRATEGIES[self.strategy]
        found = self.catalog.all() if self.strategy == "fixed" else self.catalog.discover(vector)
        return [s for s in found if kinds is None or s.kind in kinds]

    def items(self, p: Plan, results: list[Result]) -> DataFrame | None:
        """Items of the services that succeeded; failed ones are left out."""
        weights = {q.service_id: q.weight for q in p.queries}
        out = None
        for r in results:
            if not r.ok or not r.rows:
                continue
            df = self._frame(r)
            df = df.withColumn("query_id", F.lit(p.query_id))
            if r.kind == "document":
                df = df.withColumn("_id", F.col(self.executor.bindings[r.service_id].key).cast("string")).withColumn("body", F.col("text") if "text" in df.columns else F.lit(""))
                df = df if "title" in df.columns else df.withColumn("title", F.lit(""))
                df = df.select("query_id", "ord", "_id", "_score", F.coalesce("title", F.lit("")).alias("title"), "body", *[c for c in ("post_id", "user_id") if c in df.columns])
                one = I.normalise_hits(df, r.service_id, weights[r.service_id])
            else:
                one = (I.normalise_rows if r.kind == "sql" else I.normalise_records)(df, r.service_id, weights[r.service_id])
            out = one if out is None else out.unionByName(one)
        return out

    def _frame(self, r: Result) -> DataFrame:
        names = r.rows[0].__fields__
        rows = [(i, *row) for i, row in enumerate(r.rows, 1)]
        # A column of nulls only has no type of its own.
        empty = [j for j, n in enumerate(names, 1) if all(row[j] is None for row in rows)]
        kept = ["ord", *[n for j, n in enumerate(names, 1) if j not in empty]]
        return self.spark.createDataFrame([tuple(v for j, v in enumerate(row) if j not in empty) for row in rows], kept)

    def _usage(self) -> tuple[int, int]:
        """Tokens that the providers have counted so far."""
        usages = {id(p.usage): p.usage for p in (self.translator, self.writer) if hasattr(p, "usage")}.values()
        return sum(u.prompt_tokens for u in usages), sum(u.reply_tokens for u in usages)

    def route(self, query_id: str, question: str, services: list[Service]) -> Plan:
        """A plan from one reply that names services and a query for each; of a reply that cannot be read all services get the question."""
        listing = "\n".join(f"- {s.service_id} ({s.kind}): {s.summary}" for s in services)
        reply = self.translator.complete(f'Choose the services that can answer and write a query for each. Reply with JSON: {{"services": [ids], "queries": {{id: query}}}}\n{listing}\nQuestion: {question}')
        by_id = {s.service_id: s for s in services}
        try:
            said = json.loads(strip_fences(reply))
            chosen, natives = [x for x in said.get("services", []) if x in by_id], dict(said.get("queries") or {})
        except (ValueError, TypeError, AttributeError):
            chosen, natives = list(by_id), {}
        queries = [ServiceQuery(query_id, x, by_id[x].kind, LANGUAGE[by_id[x].kind], str(natives.get(x, question)), 1 / len(chosen), "skipped") for x in dict.fromkeys(chosen)]
        return Plan(query_id, question, queries, [], [])

    def _routed(self, query_id: str, question: str, services: list[Service]) -> tuple[list[Result], float, str]:
        """One service after the other; the first rows of each, in turn, are the context, the i-th with a score of 1/i."""
        p = self.route(query_id, question, services)
        results, ms = self.executor.run_in_turn(p)
        rows = [r for x in results if x.ok for r in x.rows[:ROUTED]][:ROUTED]
        lines = [f"[{i}] ({1 / i:.3f}) " + " | ".join(f"{k}: {v}" for k, v in r.asDict().items() if v is not None) for i, r in enumerate(rows, 1)]
        return results, ms, "\n".join(lines)

    def ask(self, query_id: str, question: str, vector: list[float] | None = None) -> Answer:
        before = self._usage()
        context, n_conflicts = "", 0
        if self.strategy == "routed":
            results, ms, context = self._routed(query_id, question, self.services(vector))
        else:
            p = plan(query_id, question, self.services(vector), self.translator)
            results, ms = self.executor.run_in_turn(p) if self.strategy == "sequential" else self.executor.run(p)
            items = self.items(p, results)
            if items is not None:
                # Context and conflicts read both; a question's items are few.
                items = cut(I.first_of_each(items))
                members = cut(I.groups(items))
                asked = self.spark.createDataFrame([(query_id,)], "query_id string")
                context = I.context(I.rank(I.merge_groups(items, members)), asked).first()["context"]
                n_conflicts = I.conflicts(items, members).count()
        began = time.time()
        answer = generate(self.writer, question, context)
        spent = (time.time() - began) * 1000
        used = [b - a for a, b in zip(before, self._usage())]
        model = getattr(self.writer, "model", "none")
        return Answer(query_id, question, answer, context, [r.service_id for r in results if r.ok], {r.service_id: r.error for r in results if not r.ok}, ms, n_conflicts, spent, *used, model)
