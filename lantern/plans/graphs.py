"""The graph query corpus over edge tables derived from the archive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..federation.cypher import GraphSource, run
from ..operators.graph import attached, both_ways, chain_roots, communities, modularity, pagerank, shortest_path, within_hops
from ..operators.packed import split_packed
from ..session import derived, table
from .archive import TAGS_SQL
from .book import Book, latest, top
from .relational import MAIN, SECOND, THIRD

BOOK = Book()


def co_occurrence(tagged: DataFrame) -> DataFrame:
    """(src, dst, weight): tags and the number of questions that have both. Questions with equal tag sets are expanded once."""
    sets = tagged.groupBy("src").agg(F.sort_array(F.collect_list("dst")).alias("ts")).groupBy("ts").agg(F.count("*").alias("n"))
    pairs = sets.select("ts", "n", F.posexplode("ts").alias("p", "a")).select("n", F.col("a").alias("src"), F.explode(F.expr("slice(ts, p + 2, greatest(size(ts) - p - 1, 0))")).alias("dst"))
    return pairs.groupBy("src", "dst").agg(F.sum("n").alias("weight"))


class Graph:
    """Nodes and edges of an archive. An edge is there only if both its ends are."""

    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base = spark, base

    def posts(self, *columns: str, where: str | None = None) -> DataFrame:
        return latest(self.spark, self.base, "posts", "post_type_id", *columns, where=where)

    def users(self) -> DataFrame:
        return table(self.spark, self.base, "users").select("id").where("id is not null")

    def nodes(self, kind: int) -> DataFrame:
        return self.posts().where(f"post_type_id = {kind}").select("id")

    def asked(self) -> DataFrame:
        e = self.posts("owner_user_id", where="owner_user_id > 0").where("post_type_id = 1").select(F.col("owner_user_id").alias("src"), F.col("id").alias("dst"))
        return e.where("src is not null").join(self.users().withColumnRenamed("id", "src"), "src", "left_semi")

    def answered(self) -> DataFrame:
        e = self.posts("owner_user_id", where="owner_user_id > 0").where("post_type_id = 2").select(F.col("owner_user_id").alias("src"), F.col("id").alias("dst"))
        return e.where("src is not null").join(self.users().withColumnRenamed("id", "src"), "src", "left_semi")

    def answers(self) -> DataFrame:
        e = self.posts("parent_id", where="parent_id > 0").where("post_type_id = 2").select(F.col("id").alias("src"), F.col("parent_id").alias("dst"))
        return e.join(self.nodes(1).withColumnRenamed("id", "dst"), "dst", "left_semi")

    def accepted(self) -> DataFrame:
        e = self.posts("accepted_answer_id").where("post_type_id = 1").select(F.col("id").alias("src"), F.col("accepted_answer_id").alias("dst"))
        return e.join(self.nodes(2).withColumnRenamed("id", "dst"), "dst", "left_semi")

    def tagged(self) -> DataFrame:
        """(src, dst): questions and their tags, parsed once for all queries of a session."""
        return derived(self.spark, self.base, "tagged", ("posts", "tags"), self._tagged)

    def _tagged(self) -> DataFrame:
        posts = self.posts("tags").where("post_type_id = 1")
        e = split_packed(posts, "id", "tags").select(F.col("id").alias("src"), F.col("value").alias("dst")).distinct()
        return e.join(table(self.spark, self.base, "tags").select(F.lower("tag_name").alias("dst")).distinct(), "dst", "left_semi")

    def cooccurs(self) -> DataFrame:
        """(src, dst, weight), each unordered pair once. Questions with equal tag sets are expanded once."""
        return co_occurrence(self.tagged())

    def links(self, kind: int) -> DataFrame:
        e = latest(self.spark, self.base, "postlinks", "post_id", "related_post_id", "link_type_id").where(f"link_type_id = {kind}")
        e = e.select(F.col("post_id").alias("src"), F.col("related_post_id").alias("dst"))
        return attached(e, self.nodes(1), self.nodes(1))


_POSTS = "posts_l AS (SELECT * FROM posts QUALIFY row_number() OVER (PARTITION BY id ORDER BY loaded_at DESC) = 1)"
_EDGES = f"""{_POSTS},
postlinks_l AS (SELECT * FROM postlinks QUALIFY row_number() OVER (PARTITION BY id ORDER BY loaded_at DESC) = 1),
u AS (SELECT DISTINCT id FROM users), q AS (SELECT id FROM posts_l WHERE post_type_id = 1), a AS (SELECT id FROM posts_l WHERE post_type_id = 2),
asked AS (SELECT owner_user_id AS src, id AS dst FROM posts_l WHERE post_type_id = 1 AND owner_user_id IN (SELECT id FROM u)),
answered AS (SELECT owner_user_id AS src, id AS dst FROM posts_l WHERE post_type_id = 2 AND owner_user_id IN (SELECT id FROM u)),
answers AS (SELECT id AS src, parent_id AS dst FROM posts_l WHERE post_type_id = 2 AND parent_id IN (SELECT id FROM q)),
accepted AS (SELECT id AS src, accepted_answer_id AS dst FROM posts_l WHERE post_type_id = 1 AND accepted_answer_id IN (SELECT id FROM a)),
linked AS (SELECT DISTINCT post_id AS src, related_post_id AS dst FROM postlinks_l WHERE link_type_id = 1 AND post_id IN (SELECT id FROM q) AND related_post_id IN (SELECT id FROM q)),
dup AS (SELECT DISTINCT post_id AS src, related_post_id AS dst FROM postlinks_l WHERE link_type_id = 3 AND post_id IN (SELECT id FROM q) AND related_post_id IN (SELECT id FROM q))"""
_PLAIN = f"WITH {_EDGES}\n"
_TAGGED = f"""{TAGS_SQL}, {_EDGES},
tag_e AS (SELECT post_id AS src, tag AS dst FROM tagged WHERE tag IN (SELECT lower(tag_name) FROM tags)),
co AS (SELECT x.dst AS src, y.dst AS dst, count(*) AS weight FROM tag_e x JOIN tag_e y ON x.src = y.src AND x.dst < y.dst GROUP BY ALL),
co2 AS (SELECT src, dst, weight FROM co UNION ALL SELECT dst, src, weight FROM co)
"""


@BOOK.add("graph_two_hops", _PLAIN + "SELECT DISTINCT id FROM (SELECT dst AS id FROM linked WHERE src = 1 UNION ALL SELECT y.dst FROM linked x JOIN linked y ON y.src = x.dst AND NOT (y.src = x.src AND y.dst = x.dst) WHERE x.src = 1)")
def graph_two_hops(spark: SparkSession, base: str) -> DataFrame:
    """Directed variable-length path."""
    return within_hops(Graph(spark, base).links(1), 1, 2)


def _co_tags(spark: SparkSession, base: str, tag: str, n: int) -> DataFrame:
    e = both_ways(Graph(spark, base).cooccurs()).where(F.col("src") == tag)
    return top(e.select(F.col("dst").alias("tag"), "weight"), n, F.col("weight").desc(), F.col("tag"))


def _co_sql(tag: str, n: int) -> str:
    return _TAGGED + f"SELECT dst AS tag, weight FROM co2 WHERE src = '{tag}' ORDER BY weight DESC, tag LIMIT {n}"


@BOOK.add("graph_co_tags_main", _co_sql(MAIN, 20))
def graph_co_tags_main(spark: SparkSession, base: str) -> DataFrame:
    """Undirected expand from one node, top-k."""
    return _co_tags(spark, base, MAIN, 20)


@BOOK.add("graph_co_tags_second", _co_sql(SECOND, 15))
def graph_co_tags_second(spark: SparkSession, base: str) -> DataFrame:
    """As above for another tag and length."""
    return _co_tags(spark, base, SECOND, 15)


@BOOK.add("graph_co_tags_third", _co_sql(THIRD, 20))
def graph_co_tags_third(spark: SparkSession, base: str) -> DataFrame:
    """One-hop neighbourhood."""
    return _co_tags(spark, base, THIRD, 20)


@BOOK.add("graph_answerers_in_tag", _TAGGED + f"SELECT DISTINCT d.src AS user_id FROM answered d JOIN answers s ON s.src = d.dst JOIN tag_e t ON t.src = s.dst WHERE t.dst = '{MAIN}' ORDER BY user_id LIMIT 50")
def graph_answerers_in_tag(spark: SparkSession, base: str) -> DataFrame:
    """Typed multi-hop chain (G2, G4, J6): questions of the tag, then their answers, then the answerers, each a semi join."""
    g = Graph(spark, base)
    qs = g.tagged().where(F.col("dst") == MAIN).select(F.col("src").alias("dst"))
    ans = g.answers().join(qs, "dst", "left_semi").select(F.col("src").alias("dst"))
    return top(g.answered().join(ans, "dst", "left_semi").select(F.col("src").alias("user_id")).distinct(), 50, F.col("user_id"))


@BOOK.add("graph_duplicates", _PLAIN + "SELECT src AS duplicate_id, dst AS original_id FROM dup ORDER BY duplicate_id, original_id LIMIT 20")
def graph_duplicates(spark: SparkSession, base: str) -> DataFrame:
    """Edge scan."""
    return top(Graph(spark, base).links(3).select(F.col("src").alias("duplicate_id"), F.col("dst").alias("original_id")), 20, F.col("duplicate_id"), F.col("original_id"))


def _common(spark: SparkSession, base: str, a: str, b: str, n: int) -> DataFrame:
    e = both_ways(Graph(spark, base).cooccurs())
    x, y = (e.where(F.col("src") == t).select(F.col("dst").alias("tag")) for t in (a, b))
    return top(x.join(y, "tag", "left_semi").distinct(), n, F.col("tag"))


def _common_sql(a: str, b: str, n: int) -> str:
    return _TAGGED + f"SELECT x.dst AS tag FROM co2 x JOIN co2 y ON x.dst = y.dst WHERE x.src = '{a}' AND y.src = '{b}' ORDER BY tag LIMIT {n}"


@BOOK.add("graph_common_tags", _common_sql(MAIN, SECOND, 20))
def graph_common_tags(spark: SparkSession, base: str) -> DataFrame:
    """Conjunctive pattern with a shared variable."""
    return _common(spark, base, MAIN, SECOND, 20)


@BOOK.add("graph_common_tags_other", _common_sql(THIRD, SECOND, 15))
def graph_common_tags_other(spark: SparkSession, base: str) -> DataFrame:
    """As above for other tags."""
    return _common(spark, base, THIRD, SECOND, 15)


@BOOK.add(
    "graph_asked_and_answered",
    _TAGGED + f"""SELECT DISTINCT k.src AS user_id FROM asked k JOIN tag_e t ON t.src = k.dst AND t.dst = '{MAIN}' JOIN answered d ON d.src = k.src JOIN answers s ON s.src = d.dst JOIN tag_e t2 ON t2.src = s.dst AND t2.dst = '{MAIN}'
WHERE s.dst <> k.dst ORDER BY user_id LIMIT 30""",
)
def graph_asked_and_answered(spark: SparkSession, base: str) -> DataFrame:
    """Two branches that meet in user and tag without using an edge twice.

    That a user has an asked and an answered question that differ is decided from the least and the
    greatest of each, so neither side lists a user's questions against the other's.
    """
    g = Graph(spark, base)
    qs = g.tagged().where(F.col("dst") == MAIN).select("src")
    asked = g.asked().join(qs.withColumnRenamed("src", "dst"), "dst", "left_semi").groupBy("src").agg(F.min("dst").alias("lo"), F.max("dst").alias("hi"))
    of = g.answers().join(qs.withColumnRenamed("src", "dst"), "dst", "left_semi").select(F.col("src").alias("a"), F.col("dst").alias("q"))
    answered = g.answered().join(of, F.col("dst") == F.col("a")).groupBy("src").agg(F.min("q").alias("lo2"), F.max("q").alias("hi2"))
    both = asked.join(answered, "src").where("not (lo = hi and lo2 = hi2 and lo = lo2)")
    return top(both.select(F.col("src").alias("user_id")), 30, F.col("user_id"))


@BOOK.add("graph_accepted_other", _PLAIN + "SELECT c.src AS question_id FROM accepted c JOIN asked k ON k.dst = c.src JOIN answered d ON d.dst = c.dst WHERE k.src <> d.src ORDER BY question_id LIMIT 50")
def graph_accepted_other(spark: SparkSession, base: str) -> DataFrame:
    """Reverse arrow and inequality."""
    g = Graph(spark, base)
    e = g.accepted().select(F.col("src").alias("q"), F.col("dst").alias("a"))
    e = e.join(g.asked().select(F.col("dst").alias("q"), F.col("src").alias("asker")), "q").join(g.answered().select(F.col("dst").alias("a"), F.col("src").alias("answerer")), "a")
    return top(e.where("asker <> answerer").select(F.col("q").alias("question_id")), 50, F.col("question_id"))


@BOOK.add(
    "graph_duplicate_chains",
    _PLAIN + """, d1 AS (SELECT src, dst FROM dup), d2 AS (SELECT x.src, y.dst, x.src AS a, x.dst AS b FROM dup x JOIN dup y ON y.src = x.dst AND NOT (x.src = y.src AND x.dst = y.dst)),
d3 AS (SELECT p.src, y.dst FROM (SELECT x.src, y.src AS m, y.dst FROM dup x JOIN dup y ON y.src = x.dst AND NOT (x.src = y.src AND x.dst = y.dst)) p JOIN dup y ON y.src = p.dst AND NOT (y.src = p.m AND y.dst = p.dst) AND NOT (y.src = p.src AND y.dst = p.m)),
paths AS (SELECT dst FROM d1 UNION ALL SELECT dst FROM d2 UNION ALL SELECT dst FROM d3)
SELECT dst AS root_id, count(*) AS n_copies FROM paths WHERE dst NOT IN (SELECT src FROM dup) GROUP BY dst ORDER BY n_copies DESC, root_id LIMIT 20""",
)
def graph_duplicate_chains(spark: SparkSession, base: str) -> DataFrame:
    """Variable-length path with an existential subquery, counting paths."""
    rows = chain_roots(Graph(spark, base).links(3), 3).select(F.col("root").alias("root_id"), F.col("paths").alias("n_copies"))
    return top(rows, 20, F.col("n_copies").desc(), F.col("root_id"))


@BOOK.add("graph_link_in_degree", _PLAIN + "SELECT dst AS question_id, count(*) AS n_links FROM linked GROUP BY dst ORDER BY n_links DESC, question_id LIMIT 20")
def graph_link_in_degree(spark: SparkSession, base: str) -> DataFrame:
    """In-degree."""
    return top(Graph(spark, base).links(1).groupBy(F.col("dst").alias("question_id")).agg(F.count("*").alias("n_links")), 20, F.col("n_links").desc(), F.col("question_id"))


@BOOK.add("graph_link_out_degree", _PLAIN + "SELECT src AS question_id, count(*) AS links FROM linked GROUP BY src ORDER BY links DESC, question_id LIMIT 10")
def graph_link_out_degree(spark: SparkSession, base: str) -> DataFrame:
    """Out-degree."""
    return top(Graph(spark, base).links(1).groupBy(F.col("src").alias("question_id")).agg(F.count("*").alias("links")), 10, F.col("links").desc(), F.col("question_id"))


@BOOK.add("graph_user_degree", _PLAIN + "SELECT src AS user_id, count(*) AS degree FROM (SELECT * FROM asked UNION ALL SELECT * FROM answered) GROUP BY src ORDER BY degree DESC, user_id LIMIT 10")
def graph_user_degree(spark: SparkSession, base: str) -> DataFrame:
    """Alternation of edge types."""
    g = Graph(spark, base)
    e = g.asked().select("src", "dst").unionByName(g.answered().select("src", "dst"))
    return top(e.groupBy(F.col("src").alias("user_id")).agg(F.count("*").alias("degree")), 10, F.col("degree").desc(), F.col("user_id"))


@BOOK.add("graph_tag_degree", _TAGGED + "SELECT src AS tag, count(*) AS n_neighbours FROM co2 GROUP BY src ORDER BY n_neighbours DESC, tag LIMIT 10")
def graph_tag_degree(spark: SparkSession, base: str) -> DataFrame:
    """Undirected degree."""
    return top(both_ways(Graph(spark, base).cooccurs()).groupBy(F.col("src").alias("tag")).agg(F.count("*").alias("n_neighbours")), 10, F.col("n_neighbours").desc(), F.col("tag"))


@BOOK.add("graph_tag_two_hops", _TAGGED + f"SELECT DISTINCT tag FROM (SELECT dst AS tag FROM co2 WHERE src = '{THIRD}' UNION ALL SELECT y.dst FROM co2 x JOIN co2 y ON y.src = x.dst AND y.dst <> x.src WHERE x.src = '{THIRD}') ORDER BY tag LIMIT 30")
def graph_tag_two_hops(spark: SparkSession, base: str) -> DataFrame:
    """Undirected trails of one and two edges, never the same edge back."""
    return top(within_hops(Graph(spark, base).cooccurs(), THIRD, 2, directed=False).withColumnRenamed("id", "tag"), 30, F.col("tag"))


@BOOK.add("graph_distinct_tags", _TAGGED + "SELECT d.src AS user_id, count(DISTINCT t.dst) AS n_tags FROM answered d JOIN answers s ON s.src = d.dst JOIN tag_e t ON t.src = s.dst GROUP BY d.src ORDER BY n_tags DESC, user_id LIMIT 10")
def graph_distinct_tags(spark: SparkSession, base: str) -> DataFrame:
    """Chain with COUNT DISTINCT (A2, J6). A user's answers to one question are one row before the tags multiply them."""
    g = Graph(spark, base)
    pairs = g.answered().select(F.col("src").alias("user_id"), F.col("dst").alias("a")).join(g.answers().select(F.col("src").alias("a"), F.col("dst").alias("q")), "a").select("user_id", "q").distinct()
    rows = pairs.join(g.tagged().select(F.col("src").alias("q"), F.col("dst").alias("tag")), "q").select("user_id", "tag").distinct()
    return top(rows.groupBy("user_id").agg(F.count("*").alias("n_tags")), 10, F.col("n_tags").desc(), F.col("user_id"))


@BOOK.add("graph_self_accepted", _PLAIN + "SELECT count(DISTINCT c.src) AS n_questions FROM accepted c JOIN asked k ON k.dst = c.src JOIN answered d ON d.dst = c.dst AND d.src = k.src")
def graph_self_accepted(spark: SparkSession, base: str) -> DataFrame:
    """Cyclic pattern and a global aggregate."""
    g = Graph(spark, base)
    e = g.accepted().select(F.col("src").alias("q"), F.col("dst").alias("a")).join(g.asked().select(F.col("dst").alias("q"), F.col("src").alias("u")), "q")
    return e.join(g.answered().select(F.col("dst").alias("a"), F.col("src").alias("u")), ["a", "u"], "left_semi").agg(F.countDistinct("q").alias("n_questions"))


@BOOK.add("graph_many_questions", _PLAIN + "SELECT src AS user_id, count(*) AS n_asked FROM asked GROUP BY src HAVING count(*) > 5 ORDER BY n_asked DESC, user_id LIMIT 20")
def graph_many_questions(spark: SparkSession, base: str) -> DataFrame:
    """HAVING (P14, A4)."""
    return top(Graph(spark, base).asked().groupBy(F.col("src").alias("user_id")).agg(F.count("*").alias("n_asked")).where("n_asked > 5"), 20, F.col("n_asked").desc(), F.col("user_id"))


@BOOK.add("graph_both_tags", _TAGGED + f"SELECT x.src AS question_id FROM tag_e x JOIN tag_e y ON x.src = y.src WHERE x.dst = '{MAIN}' AND y.dst = '{THIRD}' ORDER BY question_id LIMIT 20")
def graph_both_tags(spark: SparkSession, base: str) -> DataFrame:
    """Two edges from one node (G7): both tags counted in one pass over the edges."""
    e = Graph(spark, base).tagged().where(F.col("dst").isin(MAIN, THIRD))
    return top(e.groupBy(F.col("src").alias("question_id")).agg(F.count("*").alias("n")).where("n = 2").select("question_id"), 20, F.col("question_id"))


@BOOK.add("graph_cooccurrence", _TAGGED + "SELECT src AS tag_a, dst AS tag_b, weight FROM co")
def graph_cooccurrence(spark: SparkSession, base: str) -> DataFrame:
    """Derived edge type with weights (K9)."""
    return Graph(spark, base).cooccurs().select(F.col("src").alias("tag_a"), F.col("dst").alias("tag_b"), "weight")


@BOOK.add("graph_tag_frequency", _TAGGED + "SELECT t.dst AS tag, count(*) AS freq FROM answered d JOIN answers s ON s.src = d.dst JOIN tag_e t ON t.src = s.dst WHERE d.src IN (1, 2, 3, 5, 8, 13, 21, 34, 55, 89) GROUP BY t.dst ORDER BY freq DESC, tag LIMIT 10")
def graph_tag_frequency(spark: SparkSession, base: str) -> DataFrame:
    """A list parameter (P13) over a chain."""
    g = Graph(spark, base)
    a = g.answered().where(F.col("src").isin(1, 2, 3, 5, 8, 13, 21, 34, 55, 89)).select(F.col("dst").alias("a"))
    qs = g.answers().select(F.col("src").alias("a"), F.col("dst").alias("q")).join(a, "a", "left_semi")
    rows = qs.join(g.tagged().select(F.col("src").alias("q"), F.col("dst").alias("tag")), "q").groupBy("tag").agg(F.count("*").alias("freq"))
    return top(rows, 10, F.col("freq").desc(), F.col("tag"))


@BOOK.add(
    "graph_shortest_path",
    _PLAIN.replace("WITH ", "WITH RECURSIVE ", 1) + """, e AS (SELECT src, dst FROM linked UNION SELECT dst, src FROM linked UNION SELECT src, dst FROM dup UNION SELECT dst, src FROM dup),
walk(v, n) USING KEY (v) AS (SELECT min(src), 0 FROM e UNION SELECT e.dst, min(w.n) + 1 FROM walk w JOIN e ON e.src = w.v LEFT JOIN recurring.walk r ON r.v = e.dst WHERE r.v IS NULL GROUP BY e.dst)
SELECT coalesce(min(n), -1)::INT AS path_length FROM walk WHERE v = (SELECT max(src) FROM e)""",
)
def graph_shortest_path(spark: SparkSession, base: str) -> DataFrame:
    """Shortest undirected path (G10, J10) between the first and the last linked question, however long; -1 if there is none."""
    g = Graph(spark, base)
    e = g.links(1).select("src", "dst").unionByName(g.links(3).select("src", "dst"))
    ends = both_ways(e).agg(F.min("src").alias("a"), F.max("src").alias("b")).first()
    n = shortest_path(e, ends.a, ends.b) if ends.a is not None else None
    return spark.createDataFrame([(-1 if n is None else n,)], "path_length int")


_RANKS = "\n".join(f", s{n + 1} AS (SELECT v.v, 0.15 + 0.85 * coalesce(x.s, 0.0) AS score FROM v LEFT JOIN (SELECT e.dst AS v, sum(s.score / o.deg) AS s FROM e JOIN o ON o.src = e.src JOIN s{n} s ON s.v = e.src GROUP BY e.dst) x ON x.v = v.v)" for n in range(20))


@BOOK.add("graph_pagerank", _PLAIN + ", e AS (SELECT * FROM linked), o AS (SELECT src, count(*) AS deg FROM e GROUP BY src), v AS (SELECT src AS v FROM e UNION SELECT dst FROM e), s0 AS (SELECT v, 0.15::DOUBLE AS score FROM v)" + _RANKS + "\nSELECT v AS question_id, round(score, 4) AS score FROM s20 ORDER BY round(score, 4) DESC, v LIMIT 10")
def graph_pagerank(spark: SparkSession, base: str) -> DataFrame:
    """PageRank over linked questions, 20 rounds."""
    ranks = pagerank(Graph(spark, base).links(1)).select(F.col("v").alias("question_id"), F.round("score", 4).alias("score"))
    return top(ranks, 10, F.col("score").desc(), F.col("question_id"))


@BOOK.add("graph_communities")
def graph_communities(spark: SparkSession, base: str) -> DataFrame:
    """Communities of tags (G12), by deterministic modularity optimisation."""
    return communities(Graph(spark, base).cooccurs(), "weight").select(F.col("v").alias("tag"), "community")


@BOOK.add(
    "graph_tag_modularity",
    _TAGGED + """, k AS (SELECT substr(src, 1, 1) AS c, sum(weight) AS k, sum(CASE WHEN substr(src, 1, 1) = substr(dst, 1, 1) THEN weight ELSE 0 END) AS inside FROM co2 GROUP BY 1)
SELECT round(sum(inside) / sum(k) - sum(k::DOUBLE * k) / (sum(k)::DOUBLE * sum(k)), 6) AS modularity FROM k""",
)
def graph_tag_modularity(spark: SparkSession, base: str) -> DataFrame:
    """Modularity of a given grouping, tags by their first letter."""
    g = Graph(spark, base)
    label = both_ways(g.cooccurs()).select(F.col("src").alias("v")).distinct().withColumn("community", F.substring("v", 1, 1))
    return modularity(g.cooccurs(), "weight", label).select(F.round("modularity", 6).alias("modularity"))


def source(spark: SparkSession, base: str) -> GraphSource:
    """The archive's graph for queries in the graph language."""
    g = Graph(spark, base)
    users = latest(spark, base, "users", "display_name", "reputation", "location")
    nodes = {
        "User": (users, "id"),
        "Question": (g.posts("score", "view_count", "answer_count", "title").where("post_type_id = 1"), "id"),
        "Answer": (g.posts("score").where("post_type_id = 2"), "id"),
        "Tag": (table(spark, base, "tags").select(F.lower("tag_name").alias("name"), "count"), "name"),
    }
    edges = {
        "ASKED": ("User", "Question", g.asked().select("src", "dst")),
        "ANSWERED": ("User", "Answer", g.answered().select("src", "dst")),
        "ANSWERS": ("Answer", "Question", g.answers().select("src", "dst")),
        "ACCEPTED": ("Question", "Answer", g.accepted().select("src", "dst")),
        "TAGGED_WITH": ("Question", "Tag", g.tagged().select("src", "dst")),
        "CO_OCCURS_WITH": ("Tag", "Tag", g.cooccurs()),
        "LINKED_TO": ("Question", "Question", g.links(1).select("src", "dst")),
        "DUPLICATE_OF": ("Question", "Question", g.links(3).select("src", "dst")),
    }
    return GraphSource(nodes, edges)


def _cypher(name: str, text: str, sql_of: str) -> None:
    BOOK.add(name, BOOK.sql[sql_of])(lambda spark, base: run(source(spark, base), text))


_cypher("graph_cypher_two_hops", "MATCH (near:Question)<-[:LINKED_TO*1..2]-(:Question {id:1}) RETURN DISTINCT near.id AS id", "graph_two_hops")
_cypher("graph_cypher_co_tags", f"MATCH (beside:Tag)-[together:CO_OCCURS_WITH]-(:Tag {{name:'{MAIN}'}}) RETURN beside.name AS tag, together.weight AS weight ORDER BY weight DESC LIMIT 20", "graph_co_tags_main")
_cypher("graph_cypher_answerers", f"MATCH (:Tag {{name:'{MAIN}'}})<-[:TAGGED_WITH]-(:Question)<-[:ANSWERS]-(:Answer)<-[:ANSWERED]-(helper:User) RETURN DISTINCT helper.id AS user_id ORDER BY user_id LIMIT 50", "graph_answerers_in_tag")
_cypher("graph_cypher_common_tags", f"MATCH (:Tag {{name:'{MAIN}'}})-[:CO_OCCURS_WITH]-(both:Tag)-[:CO_OCCURS_WITH]-(:Tag {{name:'{SECOND}'}}) RETURN DISTINCT both.name AS tag ORDER BY tag LIMIT 20", "graph_common_tags")
_cypher("graph_cypher_both", f"MATCH (topic:Tag {{name:'{MAIN}'}})<-[:TAGGED_WITH]-(own:Question)<-[:ASKED]-(person:User), (person)-[:ANSWERED]->(:Answer)-[:ANSWERS]->(other:Question)-[:TAGGED_WITH]->(topic) RETURN DISTINCT person.id AS user_id ORDER BY user_id LIMIT 30", "graph_asked_and_answered")
_cypher("graph_cypher_accepted", "MATCH (best:Answer)<-[:ACCEPTED]-(item:Question), (item)<-[:ASKED]-(first:User), (best)<-[:ANSWERED]-(second:User) WHERE second.id <> first.id RETURN item.id AS question_id ORDER BY question_id LIMIT 50", "graph_accepted_other")
_cypher("graph_cypher_chains", "MATCH (end:Question)<-[:DUPLICATE_OF*1..3]-(copy:Question) WHERE NOT EXISTS {MATCH (end)-[:DUPLICATE_OF]->()} RETURN end.id AS root_id, COUNT(copy) AS n_copies ORDER BY n_copies DESC LIMIT 20", "graph_duplicate_chains")
_cypher("graph_cypher_in_degree", "MATCH (from:Question)-[:LINKED_TO]->(target:Question) RETURN target.id AS question_id, COUNT(from) AS n_links ORDER BY n_links DESC LIMIT 20", "graph_link_in_degree")
_cypher("graph_cypher_degree", "MATCH (post)<-[:ANSWERED|ASKED]-(person:User) RETURN person.id AS user_id, COUNT(post) AS degree ORDER BY degree DESC LIMIT 10", "graph_user_degree")
_cypher("graph_cypher_distinct_tags", "MATCH (topic:Tag)<-[:TAGGED_WITH]-(:Question)<-[:ANSWERS]-(:Answer)<-[:ANSWERED]-(person:User) RETURN person.id AS user_id, COUNT(DISTINCT topic) AS n_tags ORDER BY n_tags DESC LIMIT 10", "graph_distinct_tags")
_cypher("graph_cypher_self_accepted", "MATCH (item:Question)<-[:ASKED]-(person:User), (item)-[:ACCEPTED]->(:Answer)<-[:ANSWERED]-(person) RETURN COUNT(DISTINCT item) AS n_questions", "graph_self_accepted")
_cypher("graph_cypher_having", "MATCH (:Question)<-[asking:ASKED]-(person:User) WITH person, COUNT(*) AS n_asked WHERE n_asked > 5 RETURN person.id AS user_id, n_asked ORDER BY n_asked DESC LIMIT 20", "graph_many_questions")
_cypher("graph_cypher_both_tags", f"MATCH (:Tag {{name:'{THIRD}'}})<-[:TAGGED_WITH]-(item:Question)-[:TAGGED_WITH]->(:Tag {{name:'{MAIN}'}}) RETURN item.id AS question_id ORDER BY question_id LIMIT 20", "graph_both_tags")

#: Any edge in both directions, its ends with their labels.
_ANY_EDGE = """, ends_l AS (SELECT 'u' || src AS s, 'q' || dst AS d FROM asked UNION SELECT 'u' || src, 'a' || dst FROM answered UNION SELECT 'a' || src, 'q' || dst FROM answers UNION SELECT 'q' || src, 'a' || dst FROM accepted
  UNION SELECT 'q' || src, 't' || dst FROM tag_e UNION SELECT 't' || src, 't' || dst FROM co UNION SELECT 'q' || src, 'q' || dst FROM linked UNION SELECT 'q' || src, 'q' || dst FROM dup),
any_e AS (SELECT s AS src, d AS dst FROM ends_l UNION SELECT d, s FROM ends_l)"""


def _path_sql(tables: str, edges: str, start: str, end: str) -> str:
    """A breadth-first search of any length: the recursion keeps one row per vertex and ends when no new one is met."""
    return tables.replace("WITH ", "WITH RECURSIVE ", 1) + f"""{edges},
walk(v, n) USING KEY (v) AS (SELECT ({start})::VARCHAR, 0 UNION SELECT e.dst, min(w.n) + 1 FROM walk w JOIN any_e e ON e.src = w.v LEFT JOIN recurring.walk r ON r.v = e.dst WHERE r.v IS NULL GROUP BY e.dst)
SELECT coalesce(min(n), -1)::INT AS path_length FROM walk WHERE v = ({end})::VARCHAR"""


@BOOK.add("graph_cypher_path", _path_sql(_TAGGED, _ANY_EDGE, "SELECT 'u' || min(src) FROM asked", "SELECT 'u' || max(src) FROM asked"))
def graph_cypher_path(spark: SparkSession, base: str) -> DataFrame:
    """Shortest path between two users over every type of edge (G10, J10): the first and the last who asked."""
    ends = Graph(spark, base).asked().agg(F.min("src").alias("a"), F.max("src").alias("b")).first()
    found = run(source(spark, base), f"MATCH p = shortestPath((a:User {{id:{ends.a}}})-[*]-(b:User {{id:{ends.b}}})) RETURN length(p) AS path_length")
    return found.agg(F.coalesce(F.min("path_length"), F.lit(-1)).alias("path_length"))


@BOOK.add("graph_cypher_optional", _PLAIN + "SELECT q.id AS question_id, count(d.dst) AS n_originals FROM q LEFT JOIN dup d ON d.src = q.id GROUP BY q.id")
def graph_cypher_optional(spark: SparkSession, base: str) -> DataFrame:
    """Questions with or without the pattern that follows."""
    return run(source(spark, base), "MATCH (item:Question) OPTIONAL MATCH (item)-[:DUPLICATE_OF]->(original:Question) RETURN item.id AS question_id, COUNT(original) AS n_originals")


@BOOK.add("graph_cypher_labels", "SELECT unnest(['Answer', 'Question', 'Tag', 'User']) AS label")
def graph_cypher_labels(spark: SparkSession, base: str) -> DataFrame:
    """What the graph knows of itself."""
    return run(source(spark, base), "CALL db.labels() YIELD label RETURN label ORDER BY label")


@BOOK.add("graph_cypher_node", _PLAIN + "SELECT id AS question_id, score, view_count FROM posts_l WHERE post_type_id = 1")
def graph_cypher_node(spark: SparkSession, base: str) -> DataFrame:
    """Whole nodes as structs (G14), flattened."""
    rows = run(source(spark, base), "MATCH (item:Question) RETURN item")
    return rows.select(F.col("item.id").alias("question_id"), "item.score", "item.view_count")


QUERIES, SQL = BOOK.queries, BOOK.sql
