"""Text search, integration and evaluation on inputs with results worked out by hand."""

import math

import pytest
from pyspark.sql import functions as F

from lantern.functions import sets
from lantern.functions.text import excerpt, long_numbers, mentions, parse_date, safe_bool, safe_int, simple_tags, tokens
from lantern.operators import evaluate, integrate
from lantern.operators.bm25 import build_index, field_tokens, keyword, postings, search, search_index

DOCS = [(1, "Red fox", "the fox runs"), (2, "", "fox fox dog"), (3, "Dog", "a quiet dog sleeps"), (4, None, None), (5, "Fox", "unrelated words here"), (6, "Fox", "unrelated words here")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, "id int, title string, text string")


def test_search_scores_by_best_field(spark, docs):
    asked = spark.createDataFrame([("q", "fox"), ("none", "the of"), ("empty", ""), ("both", "FOX dog fox")], "query_id string, text string")
    got = {(r.query_id, r.doc): r.score for r in search(docs, "id", {"title": 2.0, "text": 1.0}, asked).collect()}

    def idf(n, df):
        return math.log(1 + (n - df + 0.5) / (df + 0.5))

    # Titles: 4 with words, "fox" in 3, lengths 2 1 1 1; texts: 5, "fox" in 2, lengths 2 3 3 3 3.
    title = lambda dl: 2 * idf(4, 3) * 2.2 / (1 + 1.2 * (0.25 + 0.75 * dl / 1.25))
    text = lambda tf, dl: idf(5, 2) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / 2.8))
    assert got["q", 1] == pytest.approx(max(title(2), text(1, 2)), abs=1e-4)
    assert got["q", 2] == pytest.approx(text(2, 3), abs=1e-4)
    assert got["q", 5] == got["q", 6] == pytest.approx(title(1), abs=1e-4)
    assert {k[0] for k in got} == {"q", "both"} and ("both", 3) in got
    ranks = [r.doc for r in search(docs, "id", {"title": 2.0}, asked.where("query_id = 'q'")).orderBy("rank_no").collect()]
    assert ranks == [5, 6, 1]
    assert search(docs.limit(0), "id", {"title": 2.0}, asked).count() == 0


def test_postings_and_keyword(docs):
    rows = {(r.term, r.field, r.doc): r.tf for r in postings(field_tokens(docs, "id", ["title", "text"])).collect()}
    assert rows["fox", "text", 2] == 2 and ("the", "text", 1) not in rows
    assert [r.id for r in keyword(docs, "title", "Fox").orderBy("id").collect()] == [5, 6]


def test_search_over_a_stored_index(spark, docs, tmp_path):
    keyed = docs.withColumn("tag_name", F.when(F.col("id") == 4, "red fox").when(F.col("id") == 6, "fox"))
    asked = spark.createDataFrame([("q", "fox"), ("k", "red fox"), ("none", "the of"), ("empty", ""), ("null", None), ("both", "FOX dog fox"), ("odd", "zebra")], "query_id string, text string")
    path = str(tmp_path / "index")
    build_index(keyed, "id", ["title", "text"], ["tag_name"], path, 4)
    plain = {tuple(r) for r in search(docs, "id", {"title": 2.0, "text": 1.0}, asked.where("text is not null")).collect()}
    assert {tuple(r) for r in search_index(spark, path, {"title": 2.0, "text": 1.0}, asked).collect()} == plain
    found = search_index(spark, path, {"title": 2.0, "text": 1.0, "tag_name": 9.0}, asked)
    got = {(r.query_id, r.rank_no): r.doc for r in found.collect()}
    # The keyword field takes the whole question, as it stands.
    assert got["k", 1] == 4 and got["q", 1] == 6 and not any(q in ("none", "empty", "null", "odd") for q, _ in got)
    scan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in scan and "In(term" in scan
    build_index(keyed.limit(0), "id", ["title", "text"], ["tag_name"], f"{path}0")
    assert search_index(spark, f"{path}0", {"title": 2.0, "tag_name": 1.0}, asked).count() == 0


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_values(spark):
    lit = F.lit
    assert one(spark, tokens(lit("The Über-fox, x1 and É"))) == ["über", "fox", "x1", "é"]
    assert [one(spark, safe_int(lit(v))) for v in ("7", " 8 ", "x", None, "99999999999")] == [7, 8, 0, 0, 0]
    assert [one(spark, safe_bool(lit(v))) for v in ("True", "1", "yes", "no", None)] == [True, True, True, False, False]
    assert one(spark, parse_date(lit("2020-01-02T03:04:05.678Z"))).year == 2020 and one(spark, parse_date(lit("never"))) is None
    assert one(spark, simple_tags(lit("<a><b c>"))) == ["a", "b c"] and one(spark, simple_tags(lit("|a|b|"))) == ["a", "b"] and one(spark, simple_tags(lit(None).cast("string"))) == []
    assert one(spark, mentions(lit("Ann met Bob at éAlpha in NewYork, x Ab"))) == ["Ann", "Bob", "NewYork"]
    assert one(spark, long_numbers(lit("see 1234, a5678 and 99"))) == ["1234"]
    assert one(spark, excerpt(lit("abcdef"), 3)) == "abc…" and one(spark, excerpt(lit("abc"), 3)) == "abc"


def array(*xs):
    return F.array(*[F.lit(x) for x in xs]) if xs else F.array().cast("array<string>")


def test_measures(spark):
    assert one(spark, sets.f1(array("a", "b", "c"), array("a", "b", "d"))) == pytest.approx(2 / 3)
    assert [one(spark, sets.f1(array(*x), array(*y))) for x, y in (((), ()), (("a",), ()), ((), ("a",)), (("a",), ("b",)))] == [1, 0, 0, 0]
    assert one(spark, sets.recall_at(array(*"abcdefghijklmno"), array("a", "o"), 10)) == 0.5
    assert one(spark, sets.ndcg_at(array("a", "b"), array("a", "b"), 10)) == pytest.approx(1) and one(spark, sets.ndcg_at(array("b", "a"), array("a", "b"), 10)) < 1
    # What the truth holds beyond k is no gain.
    assert one(spark, sets.ndcg_at(array("c"), array("a", "b", "c"), 2)) == 0 and one(spark, sets.ndcg_at(array("c"), array("a", "b", "c"), 3)) > 0
    assert one(spark, sets.ndcg_at(array("x"), array(), 10)) == 1 and one(spark, sets.ndcg_at(array(), array("x"), 10)) == 0
    assert one(spark, sets.coverage(array("sql", "graph"), array("sql"))) == 0.5 and one(spark, sets.coverage(array(), array())) == 1
    assert [one(spark, sets.service_kind(F.lit(s))) for s in ("x-sql-1", "Neo4j", "elastic", "other")] == ["sql", "graph", "document", "other"]
    v = lambda *x: F.array(*map(F.lit, x))
    assert one(spark, sets.cosine(v(1.0, 0.0), v(1.0, 1.0))) == pytest.approx(2**-0.5) and one(spark, sets.cosine(v(1.0), v(1.0, 1.0))) == 1
    assert one(spark, sets.unit(v(0.0, 0.0))) is None


@pytest.fixture(scope="module")
def batch(spark):
    rows = spark.createDataFrame([("q", 1, 42, 7, 800, "x" * 300, "<python><pandas>"), ("q", 2, 43, None, 5, None, "a, b")], "query_id string, ord int, post_id int, user_id int, reputation int, title string, tags string")
    records = spark.createDataFrame([("q", 1, 7, 1000, ("n", 3))], "query_id string, ord int, user_id int, reputation int, t struct<name:string,count:int>")
    hits = spark.createDataFrame([("q", 1, "p1", 10.0, 42, "Title", "word " * 200), ("q", 2, "p2", 5.0, None, "", "Some Body"), ("z", 1, "p3", 0.0, None, "", None)], "query_id string, ord int, _id string, _score double, post_id int, title string, body string")
    return integrate.normalise_rows(rows, "sql", 0.5), integrate.normalise_records(records, "graph", 0.3), integrate.normalise_hits(hits, "doc", 0.2)


def test_normalising(batch):
    rows, records, hits = ({r.item_id: r for r in part.collect()} for part in batch)
    first = rows["sql:user_id:7"]
    assert {(e.type, e.value) for e in first.entities} == {("user_id", "7"), ("post_id", "42"), ("tag", "python"), ("tag", "pandas")}
    assert "title: " + "x" * 200 + "… | tags: <python>" in first.content and first.numbers["reputation"] == 800
    assert {e.value for e in rows["sql:post_id:43"].entities if e.type == "tag"} == {"a", "b"} and "title" not in rows["sql:post_id:43"].content
    graph = records["graph:user_id:7"]
    assert {(e.type, e.value) for e in graph.entities} == {("user_id", "7"), ("tag", "n")} and "t: {name=n, count=3}" in graph.content
    assert hits["doc:_id:p1"].score == 1.0 and hits["doc:_id:p2"].score == 0.5 and hits["doc:_id:p3"].score == 1.0
    assert hits["doc:_id:p1"].content.startswith("Title  word") and hits["doc:_id:p1"].content.endswith("…")
    assert ("post_id", "p2", 1.0) in {tuple(e) for e in hits["doc:_id:p2"].entities} and ("freetext_mention", "Some", 0.5) in {tuple(e) for e in hits["doc:_id:p2"].entities}


def test_merging_conflicts_and_context(spark, batch):
    items = integrate.first_of_each(batch[0].unionByName(batch[1]).unionByName(batch[2]).unionByName(batch[0]))
    assert items.count() == 6
    members = integrate.groups(items)
    group = {r.item_id: r.group_id for r in members.where("query_id = 'q'").collect()}
    assert group["sql:user_id:7"] == group["graph:user_id:7"] == group["doc:_id:p1"] == "doc:_id:p1" and group["sql:post_id:43"] == "sql:post_id:43"
    merged = {r.canonical_id: r for r in integrate.merge_groups(items, members).collect()}
    big = merged["doc:_id:p1"]
    assert big.is_cross_source and big.n_items == 3 and big.score == pytest.approx(1.0) and big.types == ["sql", "graph", "document"]
    assert big.content.startswith("[SQL] ") and "\n[GRAPH] " in big.content
    assert merged["sql:post_id:43"].score == pytest.approx(0.5) and merged["doc:_id:p2"].score == pytest.approx(0.1)
    clash = [tuple(r)[4:] for r in integrate.conflicts(items, members).collect()]
    assert clash == [("reputation", 1000.0, 800.0)]
    asked = spark.createDataFrame([("q",), ("z",), ("nothing",)], "query_id string")
    out = {r.query_id: r for r in integrate.integrate(items, asked).collect()}
    assert out["nothing"].n_items == 0 and out["nothing"].context == ""
    assert out["q"].context.startswith("[SOURCE: SQL + GRAPH + DOCUMENT | RANK: 1 | SCORE: 1.000]\n") and out["q"].n_items == 3
    short = integrate.context(integrate.rank(integrate.merge_groups(items, members)), asked, 100)
    assert {r.query_id: r.n_items for r in short.collect()}["q"] == 0  # the first block does not fit, later ones are not tried


def test_canonical_rows(spark):
    df = spark.createDataFrame([(2, None, "x"), (1, 5, "y")], "b int, a int, c string")
    assert [r.row for r in evaluate.canonical_rows(df).collect()] == ["b=1|a=5|c=y", "b=2|c=x"]
    assert [r.row for r in evaluate.canonical_rows(df, by_name=True, skip_nulls=False).collect()] == ["a=5|b=1|c=y", "a=|b=2|c=x"]


def test_evaluation(spark):
    log = spark.createDataFrame([("a", "1", ["sql"], ["x-sql"], 10.0, 0), ("a", "4a", ["sql", "graph"], ["x-sql"], 30.0, 2), ("b", "1", ["sql"], [], 20.0, 0)], "system_name string, query_class_label string, required_services array<string>, queried_service_ids array<string>, retrieval_ms double, conflict_count int")
    got = {(r.system_name, r.query_class): r["mean"] for r in evaluate.by_class(evaluate.with_coverage(log), "sc").collect()}
    assert got == {("a", "1"): 1.0, ("a", "4a"): 0.5, ("a", "aggregate"): 0.75, ("b", "1"): 0.0, ("b", "aggregate"): 0.0}
    assert {r.system_name: (r["mean"], r.p50, r.p95) for r in evaluate.latency(log).collect()}["a"] == (20.0, 20.0, 29.0)
    assert {(r.system_name, r.service): r.rate for r in evaluate.translation_rate(log).collect()} == {("a", "sql"): 1.0, ("a", "graph"): 0.0, ("b", "sql"): 0.0}
    assert {r.system_name: (r.n, r.rate) for r in evaluate.conflict_rate(log).collect()} == {"a": (1, 1.0), "b": (0, 0.0)}


def test_stemming(spark):
    from lantern.functions.stem import stem, stemmed

    # Examples of the published algorithm.
    want = {"caresses": "caress", "ponies": "poni", "agreed": "agre", "plastered": "plaster", "motoring": "motor", "conflated": "conflat", "hopping": "hop", "falling": "fall", "filing": "file", "sky": "sky", "relational": "relat", "digitizer": "digit", "hopefulness": "hope", "triplicate": "triplic", "adjustable": "adjust", "adoption": "adopt", "probate": "probat", "cease": "ceas", "controll": "control", "roll": "roll", "é": "é", "x1s": "x1s"}
    assert {k: stem(k) for k in want} == want
    assert one(spark, stemmed(array("running", "dogs"))) == ["run", "dog"] and one(spark, stemmed(F.lit(None).cast("array<string>"))) is None
