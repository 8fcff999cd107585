"""Catalog, planning, validation, execution, the engine, sources and streams."""

import json
import time
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from lantern.federation.catalog import Catalog, Service
from lantern.federation.cypher import GraphSource
from lantern.federation.engine import CANNOT, Engine, generate
from lantern.federation.execution import Binding, Executor
from lantern.federation.planning import FixedProvider, RuleProvider, confirm_with, plan, prompt_for, strip_fences
from lantern.federation.relevance import prefilter, uniform_weights
from lantern.federation.validation import parses, validate
from lantern.sources import logs
from lantern.sources.dumps import read_all, read_communities, read_table
from lantern.streaming.heartbeats import expired, watch
from lantern.streaming.ingest import count_by_window, load_new, merge_new, read_merged


def service(n, kind="sql", **more):
    return Service(f"s{n}", kind, f"Service {n}", "about things", {"users": ["id", "name"]}, **more)


def test_catalog_life():
    clock = [0.0]
    c = Catalog(timeout=60, now=lambda: clock[0])
    c.register(service(1))
    c.register(service(2))
    assert [s.weight for s in c.all()] == [0, 0]
    assert [s.weight for s in c.discover()] == [0.5, 0.5]
    assert c.register(service(3)).weight == 0 and [s.weight for s in c.discover()] == [0.5, 0.5, 0]
    assert c.register(service(1, version="2")).weight == pytest.approx(1 / 3)
    clock[0] = 50
    c.heartbeat("s1")
    clock[0] = 70
    assert c.expire() == ["s2", "s3"] and [s.service_id for s in c.discover()] == ["s1"] and len(c) == 3
    c.set_weight("s1", 0.9)
    assert c.get("s1").weight == 0.9
    with pytest.raises(ValueError):
        c.set_weight("s1", 2)
    with pytest.raises(KeyError):
        c.set_weight("nobody", 0.1)


def test_catalog_relevance_and_rules():
    c = Catalog()
    for n, v in ((1, (1.0, 0.0)), (2, (0.0, 1.0)), (3, None)):
        c.register(service(n, vector=v))
    assert [s.service_id for s in c.discover([2.0, 0.1], k=2)] == ["s3", "s1"]
    assert [s.service_id for s in c.discover([1.0, 0.0], least=0.5)] == ["s1", "s3"]
    assert [s.service_id for s in c.discover(confirm=confirm_with(FixedProvider('["s2", 7]'), "?"))] == ["s2"]
    assert len(c.discover(confirm=confirm_with(FixedProvider("no list"), "?"))) == 3
    for bad in (service(1, kind="table"), service(1, vector=(1.0, 1.0)), Service("x", "sql", "x", "w " * 201)):
        with pytest.raises(ValueError):
            c.register(bad)


def test_prefilter_in_one_job(spark):
    qs = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [1.0])], "query_id int, vector array<double>")
    cat = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [-1.0, 0.0]), ("c", [0.6, 0.8])], "service_id string, vector array<double>")
    got = {(r.query_id, r.service_id): (r.similarity, r.rank_no) for r in prefilter(qs, cat, 2).collect()}
    assert got == {(1, "a"): (1.0, 1), (1, "c"): (0.6, 2), (2, "a"): (1.0, 1), (2, "b"): (1.0, 2), (3, "a"): (1.0, 1), (3, "b"): (1.0, 2)}
    assert uniform_weights(cat).select(F.sum("weight")).first()[0] == pytest.approx(1)


@pytest.mark.parametrize(
    "language, query, status",
    [("sql", "SELECT 1", "valid"), ("sql", "with x as (select 1) select 1", "valid"), ("sql", "SELEKT", "dropped"), ("sql", "-- CANNOT_ANSWER", "dropped"), ("cypher", "MATCH (u) RETURN u", "valid"), ("cypher", "MATCH (u)", "dropped"), ("cypher", "SELECT 1 RETURN", "dropped"), ("cypher", "// CANNOT_ANSWER", "dropped"), ("bm25", "AND OR", "skipped"), ("bm25", " ", "dropped"), ("bm25", "-- TRANSLATION_ERROR", "dropped")],
)
def test_validation(language, query, status):
    assert validate(language, query).status == status


def test_retry_and_parser(spark):
    assert validate("sql", "bad", lambda q: "SELECT 2").status == "fixed"
    assert validate("sql", "bad", lambda q: "worse").status == "dropped"
    assert parses(spark, "SELECT 1") and not parses(spark, "SELEKT 1")
    assert strip_fences("```sql\nSELECT 1\n```") == "SELECT 1" and strip_fences(" x ") == "x"


def test_plan_keeps_order_and_drops(spark):
    class Failing:
        def complete(self, prompt):
            if "(graph)" in prompt:
                raise RuntimeError("down")
            return "SELECT 1"

    found = [service(1), service(2, "graph"), service(3, "document")]
    p = plan("q", "who?", found, Failing())
    assert [q.service_id for q in p.queries] == ["s1", "s3"] and p.dropped == ["s2"] and [a["status"] for a in p.audit] == ["valid", "dropped", "skipped"]
    assert "users(id, name)" in prompt_for(found[0], "who?")


@pytest.fixture(scope="module")
def engine_parts(spark):
    users = spark.createDataFrame([(n, f"User {n}", 100 * n) for n in range(1, 81)], "user_id int, display_name string, reputation int")
    graph = GraphSource({"User": (users, "user_id")}, {"KNOWS": ("User", "User", spark.createDataFrame([(1, 2), (2, 3)], "src int, dst int"))})
    docs = spark.createDataFrame([(1, "Reputation", "how reputation grows", 2), (2, "Other", "nothing of note", 3)], "doc_id int, title string, text string, user_id int")
    catalog = Catalog()
    for n, kind in ((1, "sql"), (2, "graph"), (3, "document")):
        catalog.register(service(n, kind))
    executor = Executor(spark, {"s1": Binding(views={"users": users}), "s2": Binding(graph=graph), "s3": Binding(documents=docs, boosts={"title": 2.0, "text": 1.0})}, seconds=60)
    return catalog, executor


RULES = [(r"\(sql\)", "SELECT user_id, reputation FROM users WHERE reputation < 400"), (r"\(graph\)", "MATCH (u:User)-[:KNOWS]->(v:User) RETURN v.user_id AS user_id, v.reputation AS reputation"), (r"\(document\)", "reputation")]


def test_engine_end_to_end(spark, engine_parts):
    catalog, executor = engine_parts
    seen = []

    class Writer:
        def complete(self, prompt):
            seen.append(prompt)
            return "It grows."

    for strategy, kinds in (("full", {"s1", "s2", "s3"}), ("sql_only", {"s1"}), ("document_only", {"s3"}), ("sequential", {"s1", "s2", "s3"}), ("fixed", {"s1", "s2", "s3"})):
        a = Engine(spark, catalog, executor, RuleProvider(RULES), Writer(), strategy).ask("q1", "How does reputation grow?")
        assert set(a.queried) == kinds and not a.failed and a.answer == "It grows." and not a.refused
    assert "SQL + GRAPH" in seen[0] and "reputation: 200" in seen[0]
    nothing = Engine(spark, catalog, executor, RuleProvider([]), Writer(), "sql_only").ask("q2", "?")
    assert nothing.answer == CANNOT and nothing.refused and generate(Writer(), "?", " ") == CANNOT
    with pytest.raises(ValueError):
        Engine(spark, catalog, executor, RuleProvider([]), Writer(), "none")


def test_failures_stay_with_their_service(spark, engine_parts):
    catalog, executor = engine_parts
    rules = [(r"\(sql\)", "SELECT nothing FROM nowhere"), *RULES[1:]]
    p = plan("q", "?", [*catalog.all(), service(9)], RuleProvider(rules))
    results, wall = executor.run(p)
    assert [r.ok for r in results] == [False, True, True, False] and "ConfigError" in results[3].error and wall > 0
    assert results[0].rows == []


def test_limits(spark, engine_parts):
    _, executor = engine_parts
    p = plan("q", "?", [service(1)], FixedProvider("SELECT * FROM users ORDER BY user_id"))
    assert len(executor.run(p)[0][0].rows) == 50
    slow = Executor(spark, executor.bindings, seconds=1.5)
    p = plan("q", "?", [service(1)], FixedProvider("SELECT count(*) AS n FROM users a, users b, users c, users d, users e WHERE hash(a.user_id, b.user_id, c.user_id, d.user_id, e.user_id) = 7"))
    began = time.time()
    (r,), _ = slow.run(p)
    assert "TimeoutError" in r.error and time.time() - began < 30


@pytest.fixture()
def dump(tmp_path):
    for name in ("one", "two"):
        d = tmp_path / name
        d.mkdir()
        (d / "Users.xml").write_text('<?xml version="1.0"?>\n<users>\n<row Id="1" Reputation="5" CreationDate="2020-01-02T03:04:05.006Z" DisplayName="A &amp; B" />\n<row Id="-1" DisplayName="gone" />\n<row Id="2" Reputation="x" CreationDate="never" />\n</users>')
        (d / "Posts.xml").write_text('<posts><row Id="7" PostTypeId="1" Tags="&lt;a&gt;&lt;b&gt;" OwnerUserId="0" Score="3" Title="T" /><row Id="8" PostTypeId="2" ParentId="7" Tags="|a|b|" /></posts>')
        (d / "Badges.xml").write_text('<badges><row Id="1" UserId="1" Name="N" TagBased="True" /><row Id="2" UserId="1" Name="N" Class="1" TagBased="False" /></badges>')
    return tmp_path


def test_dumps(spark, dump):
    users = {r.id: r for r in read_table(spark, str(dump / "one"), "users").collect()}
    assert set(users) == {1, 2} and users[1].display_name == "A & B" and users[1].creation_date == datetime(2020, 1, 2, 3, 4, 5, 6000) and users[2].creation_date is None and users[2].reputation == 0 and users[1].account_id is None
    posts = {r.id: r for r in read_table(spark, str(dump / "one"), "posts").collect()}
    assert posts[7].tags == "<a><b>" and posts[7].owner_user_id is None and posts[8].parent_id == 7
    badges = {r.id: r for r in read_table(spark, str(dump / "one"), "badges").collect()}
    assert badges[1]["class"] == 3 and badges[1].tag_based and badges[2]["class"] == 1 and not badges[2].tag_based
    assert set(read_all(spark, str(dump / "one"))) == {"users", "posts", "badges"}
    with pytest.raises(FileNotFoundError):
        read_all(spark, str(dump / "one"), required=("votes",))
    assert read_communities(spark, {"one": str(dump / "one"), "two": str(dump / "two")}, "users").groupBy("id").count().where("count = 2").count() == 2


def test_logs(spark, tmp_path):
    path = str(tmp_path / "log")
    rows = spark.createDataFrame([("c1", "full", 12.5)], "question_id string, system_name string, retrieval_ms double")
    logs.append_log(rows, path)
    (tmp_path / "log" / "broken.json").write_text('{"question_id": \nnot json\n')
    assert logs.read_log(spark, path).count() == 1
    todo = spark.createDataFrame([("c1", "full"), ("c2", "full")], "question_id string, system_name string")
    assert [r.question_id for r in logs.still_to_do(spark, todo, path).collect()] == ["c2"]
    (tmp_path / "fix").mkdir()
    (tmp_path / "fix" / "a.json").write_text(json.dumps({"question_id": "c3", "expected_ids": ["post_1"], "scores": [2.5], "top_k": 10}, indent=1))
    assert logs.read_fixtures(spark, str(tmp_path / "fix")).first().expected_ids == ["post_1"]
    (tmp_path / "fix" / "b.json").write_text('{"question_id": "c4", "expected_ids": []}')
    assert {tuple(r) for r in logs.fixture_gaps(spark, str(tmp_path / "fix"), ["c3", "c4", "c5"]).collect()} == {("c4", "empty"), ("c5", "missing")}
    logs.write_metrics({"sc": rows}, str(tmp_path / "out"))
    assert spark.read.option("header", True).csv(str(tmp_path / "out" / "sc_csv")).count() == 1


SCHEMA = "id int, v string, loaded_at timestamp"


def write(spark, folder, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def test_incremental_loading(spark, tmp_path):
    src, out, merged = (str(tmp_path / x) for x in ("src", "out", "merged"))
    write(spark, src, [(1, "a", datetime(2024, 1, 1)), (2, "b", datetime(2024, 1, 1))])
    load_new(spark, src, SCHEMA, out, f"{tmp_path}/c1").awaitTermination()
    merge_new(spark, src, SCHEMA, merged, f"{tmp_path}/c2", ["id"], ["v"]).awaitTermination()
    write(spark, src, [(1, "new", datetime(2024, 2, 1)), (3, "c", datetime(2024, 2, 1))])
    for _ in range(2):  # the second run finds nothing new
        load_new(spark, src, SCHEMA, out, f"{tmp_path}/c1").awaitTermination()
        merge_new(spark, src, SCHEMA, merged, f"{tmp_path}/c2", ["id"], ["v"]).awaitTermination()
    assert spark.read.parquet(out).count() == 4
    now = read_merged(spark, merged, SCHEMA)
    assert {r.id: r.v for r in now.collect()} == {1: "new", 2: "b", 3: "c"}
    # A batch leaves the buckets alone that none of its keys falls into.
    for n in range(3):
        write(spark, src, [(100 + n, "x", datetime(2024, 3, 1 + n))])
        merge_new(spark, src, SCHEMA, merged, f"{tmp_path}/c2", ["id"], ["v"]).awaitTermination()
    assert {r.id: r.v for r in read_merged(spark, merged, SCHEMA).collect()} == {1: "new", 2: "b", 3: "c", 100: "x", 101: "x", 102: "x"}
    assert len(list((tmp_path / "merged" / "v4").glob("bucket=*"))) == 1
    assert read_merged(spark, f"{merged}0", SCHEMA).count() == 0


def test_heartbeats(spark, tmp_path):
    beats = [("a", datetime(2024, 1, 1, 0, 0)), ("b", datetime(2024, 1, 1, 0, 0)), ("a", datetime(2024, 1, 1, 0, 9)), ("c", None)]
    df = spark.createDataFrame(beats, "service string, ts timestamp_ntz")
    assert [r.service for r in expired(df, "service", "ts", "5 minutes").collect()] == ["b"]
    src = str(tmp_path / "beats")
    for n, part in enumerate((beats[:2], beats[2:3], [("z", datetime(2024, 1, 1, 1, 0))])):
        spark.createDataFrame(part, "service string, ts timestamp").coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema("service string, ts timestamp").parquet(src)
        q = watch(stream, "service", "ts", 300).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
        q.awaitTermination()
    # The last beat moves the watermark past both; the next batch finds them timed out.
    got = {r.service for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert {"a", "b"} >= got and "b" in got


def test_windows(spark, tmp_path):
    src = str(tmp_path / "events")
    rows = [("x", datetime(2024, 1, 1, 0, m)) for m in (0, 1, 11)] + [("y", datetime(2024, 1, 1, 5, 0))]
    spark.createDataFrame(rows, "kind string, ts timestamp_ntz").coalesce(1).write.parquet(src)
    counted = count_by_window(spark.readStream.schema("kind string, ts timestamp_ntz").parquet(src), "kind", "ts", "10 minutes", "1 minute")
    q = counted.writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r.kind, r.n) for r in spark.table("windows").collect()) == [("x", 1), ("x", 2), ("y", 1)]


def test_load_job(spark, dump, tmp_path):
    from lantern.jobs import load as job

    (dump / "one" / "Tags.xml").write_text('<tags><row Id="1" TagName="a" Count="2" ExcerptPostId="9" /><row Id="2" TagName="B" Count="1" /></tags>')
    (dump / "one" / "PostLinks.xml").write_text('<postlinks><row Id="1" PostId="7" RelatedPostId="7" LinkTypeId="1" /><row Id="2" PostId="7" RelatedPostId="99" LinkTypeId="3" /></postlinks>')
    (dump / "one" / "Posts.xml").write_text('<posts><row Id="7" PostTypeId="1" Tags="&lt;a&gt;&lt;x&gt;" OwnerUserId="1" AcceptedAnswerId="8" Score="3" Title="T" Body="b" /><row Id="8" PostTypeId="2" ParentId="7" OwnerUserId="2" Body=" " /><row Id="9" PostTypeId="4" Body="about a" /></posts>')
    out = str(tmp_path / "store")
    assert job.load(spark, str(dump / "one"), f"{out}/dry", dry_run=True)["posts"] == 3
    done = job.load(spark, str(dump / "one"), out)
    assert {k: done[k] for k in ("users", "posts", "documents", "edges_asked", "edges_answers", "edges_accepted", "edges_tagged_with", "edges_linked_to", "edges_duplicate_of")} == {"users": 2, "posts": 3, "documents": 3, "edges_asked": 1, "edges_answers": 1, "edges_accepted": 1, "edges_tagged_with": 1, "edges_linked_to": 1, "edges_duplicate_of": 0}
    assert {r._id for r in spark.read.parquet(f"{out}/documents.parquet").collect()} == {"post_7", "post_9", "tag_wiki_9"}
    assert job.load(spark, str(dump / "one"), out) == {}  # all parts are complete


def test_benchmark_job_resumes(spark, engine_parts, tmp_path):
    from lantern.jobs.benchmark import Question, metrics, report, run

    catalog, executor = engine_parts
    engines = {s: Engine(spark, catalog, executor, RuleProvider(RULES), FixedProvider("fine"), s) for s in ("full", "sql_only")}
    path = str(tmp_path / "log")
    first = Question("c1", "1", "How many?", ("sql",))
    assert run(spark, [first], engines, path) == 2
    assert run(spark, [first, Question("c2", "4a", "Who knows whom?", ("sql", "graph"))], engines, path) == 2
    assert run(spark, [first], engines, path) == 0
    got = {(r.system_name, r.query_class): r["mean"] for r in metrics(spark, path)["coverage_by_class"].collect()}
    # The services' ids say nothing of their kinds here, so only their count matters.
    assert set(got) == {(s, c) for s in engines for c in ("1", "4a", "aggregate")}
    report(spark, path, str(tmp_path / "report"))
    assert (tmp_path / "report" / "latency_csv").exists()


def fresh():
    """A catalog whose services have just been heard of."""
    catalog = Catalog()
    for n, kind in ((1, "sql"), (2, "graph"), (3, "document")):
        catalog.register(service(n, kind))
    return catalog


def test_answers_are_measured(spark, engine_parts, tmp_path):
    from lantern.jobs.benchmark import Question, metrics, report, run, spot_check

    catalog, executor = fresh(), engine_parts[1]
    engines = {"full": Engine(spark, catalog, executor, RuleProvider(RULES), FixedProvider("See 1001 and 1003."), "full")}
    asked = [Question("c1_q01", "1", "How many?", ("sql",)), Question("c2_q01", "2", "Who knows whom?", ("graph",), "ndcg10"), Question("c3_q01", "3", "How many?", ("sql",), "recall10"), Question("c5_q01", "5", "How many?", ("sql",))]
    path = str(tmp_path / "log")
    assert run(spark, asked, engines, path) == 4
    right = spark.createDataFrame([("c1_q01", ["1001", "1002"]), ("c2_q01", ["1001", "1003"]), ("c3_q01", ["1003", "1009"])], "question_id string, truth array<string>")
    found = metrics(spark, path, right)
    got = {r.query_class: (r.n, r["mean"]) for r in found["accuracy_by_class"].collect()}
    assert got == {"1": (1, 0.5), "2": (1, 1.0), "3": (1, 0.5), "aggregate": (3, 0.6667)}
    summary = found["summary"].first()
    assert summary.accuracy == 0.6667 and summary.n == 4 and summary.mean_ms > 0 and len(found) == 6
    report(spark, path, str(tmp_path / "report"), right)
    assert len([p for p in (tmp_path / "report").iterdir() if p.name.endswith("_csv")]) == 6
    assert spot_check(spark, asked[:2], engines, str(tmp_path / "spot")) == 2
    spot = spark.read.option("header", True).csv(str(tmp_path / "spot")).collect()
    assert {(r.question_id, r.answer) for r in spot} == {("c1_q01", "See 1001 and 1003."), ("c2_q01", "See 1001 and 1003.")} and all(float(r.duration_ms) > 0 for r in spot)


def test_routed_strategy_and_its_fallback(spark, engine_parts):
    catalog, executor = fresh(), engine_parts[1]
    ids = {s.kind: s.service_id for s in catalog.all()}
    said = json.dumps({"services": [ids["sql"], "nobody"], "queries": {ids["sql"]: "SELECT 7 AS seven"}})
    a = Engine(spark, catalog, executor, FixedProvider(said), FixedProvider("fine"), "routed").ask("q", "How many?")
    assert a.queried == [ids["sql"]] and a.context == "[1] (1.000) seven: 7" and a.answer == "fine" and a.n_conflicts == 0
    lost = Engine(spark, catalog, executor, FixedProvider("no idea"), FixedProvider("fine"), "routed").ask("q", "How many?")
    assert set(lost.queried) | set(lost.failed) == set(ids.values())
    none = Engine(spark, catalog, executor, FixedProvider('{"services": []}'), FixedProvider("fine"), "routed").ask("q", "How many?")
    assert none.refused and not none.queried


def test_http_provider():
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    from lantern.federation.providers import HttpProvider, from_environment

    seen = []

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            seen.append((body["messages"][0]["content"], self.headers.get("Authorization")))
            self.send_response(503 if len(seen) == 1 else 400 if "bad" in seen[-1][0] else 200)
            self.end_headers()
            self.wfile.write(json.dumps({"choices": [{"message": {"content": "SELECT 1"}}], "usage": {"prompt_tokens": 7, "completion_tokens": 2}}).encode())

        def log_message(self, *a):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}/"
    p = HttpProvider(url, "m", pause=0.01)
    assert p.complete("hello") == "SELECT 1" and len(seen) == 2  # the first try met a busy server
    assert (p.usage.calls, p.usage.prompt_tokens, p.usage.reply_tokens) == (1, 7, 2)
    with pytest.raises(Exception, match="400"):
        p.complete("bad")
    with pytest.raises(ValueError):
        HttpProvider(url, "m", reply_at="nothing.here").complete("x")
    assert from_environment({"LANTERN_LLM_URL": url, "LANTERN_LLM_KEY": "k"}).complete("x") == "SELECT 1" and seen[-1][1] == "Bearer k"
    assert from_environment({}).complete("x") == "CANNOT_ANSWER"
    server.shutdown()


def test_benchmark_questions():
    import __spark_entry__ as entry
    from lantern.jobs.questions import all_questions, truth

    qs = all_questions()
    assert len({q.question_id for q in qs}) == len(qs) == 120 and {q.label for q in qs} == {"1", "2", "3", "4a", "4b", "4c", "5"}
    known = entry.queries()
    assert all(truth(q.question_id) in known for q in qs if q.label in "123") and truth("c5_q01") is None
