"""Graph operators and the query compiler on graphs small enough to check by hand."""

import pytest

from lantern.federation.cypher import CypherError, GraphSource, run
from lantern.operators.graph import attached, both_ways, chain_roots, communities, modularity, pagerank, shortest_path, within_hops
from lantern.plans import graphs


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame([(1, 2), (2, 3), (3, 4), (4, 2), (5, 6), (1, 2)], "src int, dst int")


def ids(df):
    return sorted(r[0] for r in df.collect())


def test_trails(edges):
    assert ids(within_hops(edges, 1, 1)) == [2]
    assert ids(within_hops(edges, 1, 2)) == [2, 3]
    assert ids(within_hops(edges, 1, 4)) == [2, 3, 4]
    assert ids(within_hops(edges, 5, 2, directed=False)) == [6]  # not back over the same edge
    assert ids(within_hops(edges, 99, 2)) == []
    assert within_hops(edges.limit(0), 1, 3).count() == 0


def test_chain_roots_counts_paths(spark):
    df = spark.createDataFrame([(1, 2), (2, 3), (4, 3), (7, 8), (8, 7)], "src int, dst int")
    assert {r.root: r.paths for r in chain_roots(df, 3).collect()} == {3: 3}
    assert {r.root: r.paths for r in chain_roots(df, 1).collect()} == {3: 2}
    looped = spark.createDataFrame([(1, 1), (1, 2)], "src int, dst int")
    assert {r.root: r.paths for r in chain_roots(looped, 3).collect()} == {2: 2}  # 1-2 and 1-1-2, the loop only once


def test_shortest_path(edges):
    assert shortest_path(edges, 1, 4) == 2 and shortest_path(edges, 1, 1) == 0
    assert shortest_path(edges, 1, 6) is None and shortest_path(edges, 1, 4, most=1) is None


def test_shortest_path_has_no_cap(spark):
    chain = spark.createDataFrame([(n, n + 1) for n in range(53)] + [(100, 101)], "src int, dst int").coalesce(1)
    assert shortest_path(chain, 0, 53) == 53 and shortest_path(chain, 0, 101) is None


def test_shortest_path_query_beyond_twelve(spark, monkeypatch):
    links = {1: spark.createDataFrame([(n, n + 1) for n in range(1, 10)], "src int, dst int"), 3: spark.createDataFrame([(n, n + 1) for n in range(10, 15)], "src int, dst int")}
    monkeypatch.setattr(graphs.Graph, "links", lambda self, kind: links[kind])
    assert graphs.graph_shortest_path(spark, "").first().path_length == 14


def test_pagerank_against_plain_python(spark, edges):
    pairs = sorted({tuple(r) for r in edges.collect()})
    score = {v: 0.15 for p in pairs for v in p}
    for _ in range(20):
        score = {v: 0.15 + 0.85 * sum(score[a] / sum(x == a for x, _ in pairs) for a, b in pairs if b == v) for v in score}
    got = {r.v: r.score for r in pagerank(edges).collect()}
    assert got.keys() == score.keys() and all(abs(got[v] - score[v]) < 1e-9 for v in score)


def test_communities_of_two_cliques(spark):
    rows = [(a, b, 5) for g in (range(0, 4), range(10, 14)) for a in g for b in g if a < b] + [(3, 10, 1)]
    got = {r.v: r.community for r in communities(spark.createDataFrame(rows, "src int, dst int, weight int"), "weight").collect()}
    assert {got[v] for v in range(4)} == {got[0]} and {got[v] for v in range(10, 14)} == {got[10]} and got[0] != got[10]


def test_modularity_by_definition(spark):
    rows = [(0, 1, 2.0), (1, 2, 1.0), (0, 2, 3.0), (2, 3, 1.0), (3, 4, 4.0)]
    edges, label = spark.createDataFrame(rows, "src int, dst int, w double"), {0: "a", 1: "a", 2: "a", 3: "b", 4: "b"}
    k = {v: sum(w for a, b, w in rows if v in (a, b)) for v in label}
    m2 = sum(k.values())
    weight = {(a, b): w for a, b, w in rows} | {(b, a): w for a, b, w in rows}
    want = sum(weight.get((i, j), 0) - k[i] * k[j] / m2 for i in label for j in label if label[i] == label[j]) / m2
    found = modularity(edges, "w", spark.createDataFrame(list(label.items()), "v int, community string")).first()[0]
    assert abs(found - want) < 1e-12
    own = communities(edges, "w")
    assert modularity(edges, "w", own).first()[0] >= want - 1e-12


def test_attached_and_both_ways(spark):
    e = spark.createDataFrame([(1, 2), (1, 9), (None, 2), (1, 2)], "src int, dst int")
    assert [tuple(r) for r in attached(e, spark.createDataFrame([(1,)], "id int"), spark.createDataFrame([(2,)], "id int")).collect()] == [(1, 2)]
    assert both_ways(e).count() == 8


@pytest.fixture(scope="module")
def graph(spark):
    make = spark.createDataFrame
    users = make([(1, "Ann", 50), (2, "Bo", 5), (3, "Cy", None)], "id int, name string, reputation int")
    questions = make([(10, 3), (11, 7), (12, 1)], "id int, score int")
    answers = make([(20, 1), (21, 2)], "id int, score int")
    tags = make([("sql", 3), ("spark", 1)], "name string, count int")
    edges = {
        "ASKED": ("User", "Question", make([(1, 10), (1, 11), (2, 12)], "src int, dst int")),
        "ANSWERED": ("User", "Answer", make([(2, 20), (1, 21)], "src int, dst int")),
        "ANSWERS": ("Answer", "Question", make([(20, 10), (21, 10)], "src int, dst int")),
        "TAGGED_WITH": ("Question", "Tag", make([(10, "sql"), (11, "sql"), (11, "spark")], "src int, dst string")),
        "CO_OCCURS_WITH": ("Tag", "Tag", make([("spark", "sql", 1)], "src string, dst string, weight int")),
        "LINKED_TO": ("Question", "Question", make([(10, 11), (11, 12), (12, 10)], "src int, dst int")),
    }
    return GraphSource({"User": (users, "id"), "Question": (questions, "id"), "Answer": (answers, "id"), "Tag": (tags, "name")}, edges)


@pytest.mark.parametrize(
    "text, want",
    [
        ("MATCH (who:User) RETURN who.id AS id", [(1,), (2,), (3,)]),
        ("MATCH (item)<-[:ASKED]-(:User {id: $who}) RETURN item.id AS item, item.score AS points ORDER BY points DESC", [(11, 7), (10, 3)]),
        ("MATCH (far:Question)<-[:LINKED_TO*1..2]-(:Question {id:11}) RETURN DISTINCT far.id AS id", [(10,), (12,)]),
        ("MATCH (:Question {id:12})-[:LINKED_TO*1..3]-(far:Question) RETURN DISTINCT far.id AS id", [(10,), (11,), (12,)]),
        ("MATCH (beside:Tag)-[pair:CO_OCCURS_WITH]-(:Tag {name:'spark'}) RETURN beside.name AS tag, pair.weight AS weight", [("sql", 1)]),
        ("MATCH (post)<-[:ANSWERED|ASKED]-(who:User) RETURN who.id AS who, COUNT(post) AS posts", [(1, 3), (2, 2)]),
        # No edge twice: the two tags of question 11 differ, and 10 alone gives no pair.
        ("MATCH (one:Tag)<-[:TAGGED_WITH]-(item:Question)-[:TAGGED_WITH]->(two:Tag) RETURN item.id AS item, one.name AS one, two.name AS two", [(11, "spark", "sql"), (11, "sql", "spark")]),
        ("MATCH (reply:Answer)-[:ANSWERS]->(item:Question), (reply)<-[:ANSWERED]-(helper:User), (asker:User)-[:ASKED]->(item) WHERE helper.id <> asker.id RETURN item.id AS item, helper.id AS helper", [(10, 2)]),
        ("MATCH (me:User)-[:ANSWERED]->(:Answer)-[:ANSWERS]->(item:Question)<-[:ASKED]-(me) RETURN COUNT(DISTINCT item) AS n", [(1,)]),
        ("MATCH (item)<-[:ASKED]-(who:User) WITH who, COUNT(item) AS items WHERE items > 1 RETURN who.id AS who, items", [(1, 2)]),
        ("MATCH (item:Question) WHERE NOT EXISTS { MATCH (item)-[:TAGGED_WITH]->() } RETURN item.id AS item", [(12,)]),
        ("MATCH (item:Question) WHERE item.score >= 5 AND EXISTS { (item)-[:TAGGED_WITH]->(:Tag) } RETURN item.id AS item", [(11,)]),
        ("MATCH (who:User) WHERE who.reputation IS NULL AND who.id IN [1, 3] RETURN who.name AS name // comment", [("Cy",)]),
        ("MATCH (item:Question) RETURN MAX(item.score) AS most, AVG(item.score) AS mean", [(7, 11 / 3)]),
        ("MATCH (item:Question) RETURN item.id AS item ORDER BY item DESC SKIP 1 LIMIT 1", [(11,)]),
        ("MATCH path = shortestPath((a:User {id: 1})-[*]-(b:User {id: $who2})) RETURN length(path) AS n", [(3,)]),
        ("MATCH (who:User) OPTIONAL MATCH (who)-[:ASKED]->(item:Question)-[:TAGGED_WITH]->(t:Tag) RETURN who.id AS who, COUNT(DISTINCT t) AS n", [(1, 2), (2, 0), (3, 0)]),
        ("MATCH (who:User) OPTIONAL MATCH (who)-[:ASKED]->(item:Question) WHERE item.score > 2 RETURN who.name AS who, item.id AS item, item.score AS points", [("Ann", 10, 3), ("Ann", 11, 7), ("Bo", None, None), ("Cy", None, None)]),
        ("MATCH (who:User {id: 2}) RETURN who", [((2, "Bo", 5),)]),
        ("CALL db.labels() YIELD label RETURN label ORDER BY label", [("Answer",), ("Question",), ("Tag",), ("User",)]),
        ("CALL db.relationshipTypes() YIELD relationshipType AS kind", [("ANSWERED",), ("ANSWERS",), ("ASKED",), ("CO_OCCURS_WITH",), ("LINKED_TO",), ("TAGGED_WITH",)]),
    ],
)
def test_queries(graph, text, want):
    got = [tuple(r) for r in run(graph, text, who=1, who2=2).collect()]
    assert got == want if "ORDER" in text else sorted(got, key=str) == sorted(want, key=str)


@pytest.mark.parametrize("text", ["MATCH (x:Nope) RETURN x", "MATCH (a:User), (b:Tag) RETURN a.id, b.name", "MATCH (a:User)-[:ASKED]->(q), (b:Answer)-[:ANSWERS]->(c) RETURN a.id, c.id", "MATCH (a:User) OPTIONAL MATCH (b:Tag) RETURN a.id", "CALL db.nothing() YIELD x RETURN x", "MATCH (u:User)-[:NOPE]->(q) RETURN q.id", "MATCH (u:User)", "OPTIONAL MATCH (u:User) RETURN u", "MATCH (u:User) RETURN u.nothing", "MATCH (q:Question)-[:LINKED_TO*]->(p) RETURN p.id", "MATCH (u:User {id: $missing}) RETURN u", "hello"])
def test_what_is_not_covered_is_refused(graph, text):
    with pytest.raises(CypherError):
        run(graph, text)
