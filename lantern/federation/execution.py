"""Running the queries of a plan: bindings of services, parallel actions, timeouts and isolated failures."""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..operators.bm25 import search, search_index
from .cypher import GraphSource, run
from .planning import Plan, ServiceQuery

ROWS, HITS, SECONDS = 50, 10, 10.0


@dataclass
class Binding:
    """Where a service's data is: views for SQL, a graph, or documents with the boosts of their fields and, if it is stored, their index."""

    views: dict[str, DataFrame] = field(default_factory=dict)
    graph: GraphSource | None = None
    documents: DataFrame | None = None
    boosts: dict[str, float] = field(default_factory=dict)
    key: str = "doc_id"
    index: str | None = None

    @classmethod
    def jdbc(cls, spark: SparkSession, url: str, tables: list[str], **options: str) -> Binding:
        """Tables of a live relational server; filters and columns are pushed to it."""
        read = spark.read.format("jdbc").options(url=url, **options)
        return cls(views={t: read.option("dbtable", t).load() for t in tables})


@dataclass(frozen=True)
class Result:
    query_id: str
    service_id: str
    kind: str
    rows: list[Row]
    ms: float
    error: str = ""

    @property
    def ok(self) -> bool:
        return not self.error


class Executor:
    """Runs native queries against bindings; every service gets one row limit and one time limit."""

    def __init__(self, spark: SparkSession, bindings: dict[str, Binding], rows: int = ROWS, hits: int = HITS, seconds: float = SECONDS):
        self.spark, self.bindings, self.rows, self.hits, self.seconds = spark, bindings, rows, hits, seconds

    def frame(self, q: ServiceQuery) -> DataFrame:
        """The lazily planned result of one native query, within the row limit."""
        b = self.bindings[q.service_id]
        if q.language == "sql":
            # The views are handed over by name, so two services may use the same names.
            text = q.native.rstrip().rstrip(";")
            names = {t: f"{t}_{uuid.uuid4().hex[:8]}" for t in b.views}
            for t, df in b.views.items():
                df.createOrReplaceTempView(names[t])
            views = ", ".join(f"{t} AS (SELECT * FROM {n})" for t, n in names.items())
            body = text.lstrip()
            sql = f"WITH {views}, {body[4:].lstrip()}" if body[:4].upper() == "WITH" else f"WITH {views} {body}"
            try:
                # The plan holds the views' plans; their names are needed no longer.
                return self.spark.sql(sql if views else body).limit(self.rows)
            finally:
                for n in names.values():
                    self.spark.catalog.dropTempView(n)
        if q.language == "cypher":
            if b.graph is None:
                raise LookupError("the service has no graph")
            return run(b.graph, q.native).limit(self.rows)
        if b.documents is None:
            raise LookupError("the service has no documents")
        asked = self.spark.createDataFrame([(q.query_id, q.native)], "query_id string, text string")
        found = search_index(self.spark, b.index, b.boosts, asked, self.hits) if b.index else search(b.documents, b.key, b.boosts, asked, self.hits)
        found = found.select(F.col("doc"), F.col("score").alias("_score"), "rank_no")
        rows = b.documents.join(F.broadcast(found), b.documents[b.key] == found["doc"]).drop("doc")
        return rows.orderBy("rank_no")

    def one(self, q: ServiceQuery) -> Result:
        """One query, whatever happens to it: a failure or an overrun becomes a result with an error."""
        began = time.time()
        if q.service_id not in self.bindings:
            return Result(q.query_id, q.service_id, q.kind, [], 0.0, "ConfigError: the service has no binding")
        sc, group = self.spark.sparkContext, f"lantern-{uuid.uuid4().hex}"
        late = threading.Event()

        def stop() -> None:
            late.set()
            sc.cancelJobGroup(group)

        timer = threading.Timer(self.seconds, stop)
        timer.start()
        try:
            sc.setJobGroup(group, f"{q.service_id} for {q.query_id}", interruptOnCancel=True)
            rows = self.frame(q).collect()
            return Result(q.query_id, q.service_id, q.kind, rows, (time.time() - began) * 1000)
        except Exception as x:  # noqa: BLE001 - isolation is the point
            what = "TimeoutError: the service took too long" if late.is_set() else f"{type(x).__name__}: {str(x)[:300]}"
            return Result(q.query_id, q.service_id, q.kind, [], (time.time() - began) * 1000, what)
        finally:
            timer.cancel()

    def run(self, plan: Plan) -> tuple[list[Result], float]:
        """All queries of a plan at once, one thread each, in their order; and the wall time in ms."""
        began = time.time()
        if not plan.queries:
            return [], 0.0
        with ThreadPoolExecutor(max_workers=len(plan.queries)) as pool:
            results = list(pool.map(self.one, plan.queries))
        return results, (time.time() - began) * 1000

    def run_in_turn(self, plan: Plan, stop: Callable[[list[Result]], bool] = lambda r: False) -> tuple[list[Result], float]:
        """One after the other until `stop` is satisfied; the time is the sum of theirs."""
        results: list[Result] = []
        for q in plan.queries:
            results.append(self.one(q))
            if stop(results):
                break
        return results, sum(r.ms for r in results)
