"""The integration queries: three services answer a batch of questions about tags."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import integrate as I
from ..session import cut, table
from .book import Book
from .graphs import _TAGGED, Graph
from .relational import MAIN, SECOND, THIRD

BOOK = Book()
TOPICS = [("q1", MAIN), ("q2", SECOND), ("q3", THIRD), ("q4", "hexaflow-prior-choice"), ("q5", "no-such-tag")]
WEIGHTS = {"sql-posts": 0.5, "graph-users": 0.3, "document-texts": 0.2}


def questions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TOPICS, "query_id string, tag string")


def _ranked(df: DataFrame, n: int, *order) -> DataFrame:
    return df.withColumn("ord", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("ord") <= n)


def batch(spark: SparkSession, base: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What each service returns: best questions of the tag, their most frequent askers, longest texts of their threads."""
    g = Graph(spark, base)
    asked = g.tagged().join(F.broadcast(questions(spark)), F.col("dst") == F.col("tag")).select("query_id", F.col("src").alias("post_id"))
    posts = g.posts("owner_user_id", "score", "view_count", "title").where("post_type_id = 1").select(F.col("id").alias("post_id"), F.col("owner_user_id").alias("user_id"), "score", "view_count", "title")
    of = asked.join(posts, "post_id")
    rows = _ranked(of.select("query_id", "post_id", "user_id", "score", "view_count", "title"), 30, F.desc_nulls_last("score"), "post_id")
    askers = of.where("user_id > 0").groupBy("query_id", "user_id").agg(F.count("*").alias("questions"), F.sum("view_count").alias("view_count"))
    records = _ranked(askers, 30, F.desc("questions"), "user_id")
    docs = table(spark, base, "documents").where("post_id is not null and n_chars > 0").select("doc_id", "post_id", "title", "text", "n_chars")
    hits = _ranked(docs.join(asked, "post_id").select("query_id", F.concat(F.lit("doc_"), "doc_id").alias("_id"), F.col("n_chars").cast("double").alias("_score"), "post_id", F.coalesce("title", F.lit("")).alias("title"), F.col("text").alias("body"), "doc_id"), 10, F.desc("_score"), "doc_id").drop("doc_id")
    return rows, records, hits


def items(spark: SparkSession, base: str, with_mentions: bool = False) -> DataFrame:
    rows, records, hits = batch(spark, base)
    parts = [I.normalise_rows(rows, "sql-posts", WEIGHTS["sql-posts"]), I.normalise_records(records, "graph-users", WEIGHTS["graph-users"]), I.normalise_hits(hits, "document-texts", WEIGHTS["document-texts"], with_mentions)]
    # At most ROWS rows a service and question; read several times by what follows.
    return cut(I.first_of_each(parts[0].unionByName(parts[1]).unionByName(parts[2])))


_TOPICS = "SELECT * FROM (VALUES " + ", ".join(f"('{q}', '{t}')" for q, t in TOPICS) + ") AS v(query_id, tag)"
_BATCH = _TAGGED.replace("WITH ", "WITH RECURSIVE ", 1) + f""", topics AS ({_TOPICS}),
of AS (SELECT t.query_id, p.id AS post_id, p.owner_user_id AS user_id, p.score, p.view_count, p.title FROM topics t JOIN tag_e e ON e.dst = t.tag JOIN posts_l p ON p.id = e.src AND p.post_type_id = 1),
sql_rows AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC NULLS LAST, post_id)::INT AS ord FROM of QUALIFY ord <= 30),
graph_rows AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY questions DESC, user_id)::INT AS ord FROM (SELECT query_id, user_id, count(*) AS questions, sum(view_count)::BIGINT AS view_count FROM of WHERE user_id > 0 GROUP BY ALL) QUALIFY ord <= 30),
doc_rows AS (SELECT o.query_id, 'doc_' || d.doc_id AS _id, d.n_chars::DOUBLE AS _score, d.post_id, coalesce(d.title, '') AS title, d.text AS body, row_number() OVER (PARTITION BY o.query_id ORDER BY d.n_chars DESC, d.doc_id)::INT AS ord FROM documents d JOIN of o ON o.post_id = d.post_id WHERE d.n_chars > 0 QUALIFY ord <= 10),
items AS (
  SELECT query_id, 'sql-posts' AS service_id, 'sql' AS source_type, 0.5::DOUBLE AS weight, ord, coalesce('sql-posts:user_id:' || user_id, 'sql-posts:post_id:' || post_id) AS item_id,
    concat_ws(' | ', 'post_id: ' || post_id, 'user_id: ' || user_id, 'score: ' || score, 'view_count: ' || view_count, 'title: ' || CASE WHEN length(title) > 200 THEN title[1:200] || '…' ELSE title END) AS content, 1.0::DOUBLE AS score,
    post_id AS p, user_id AS u, view_count::DOUBLE AS views, score::DOUBLE AS points FROM sql_rows
  UNION ALL SELECT query_id, 'graph-users', 'graph', 0.3::DOUBLE, ord, 'graph-users:user_id:' || user_id, concat_ws(' | ', 'user_id: ' || user_id, 'questions: ' || questions, 'view_count: ' || view_count), 1.0::DOUBLE, NULL, user_id, view_count::DOUBLE, NULL FROM graph_rows
  UNION ALL SELECT query_id, 'document-texts', 'document', 0.2::DOUBLE, ord, 'document-texts:_id:' || _id, CASE WHEN title <> '' THEN title || '  ' ELSE '' END || CASE WHEN length(body) > 500 THEN body[1:500] || '…' ELSE body END, _score / max(_score) OVER (PARTITION BY query_id), post_id, NULL, NULL, NULL FROM doc_rows
), one AS (SELECT * FROM items QUALIFY row_number() OVER (PARTITION BY query_id, item_id ORDER BY service_id, ord) = 1),
keys AS (SELECT DISTINCT query_id, item_id, 'post_id' AS type, p::VARCHAR AS key FROM one WHERE p IS NOT NULL UNION SELECT DISTINCT query_id, item_id, 'user_id', u::VARCHAR FROM one WHERE u IS NOT NULL),
walk AS (SELECT query_id, item_id, item_id AS seen FROM one UNION SELECT w.query_id, w.item_id, b.item_id FROM walk w JOIN keys a ON a.query_id = w.query_id AND a.item_id = w.seen JOIN keys b ON b.query_id = a.query_id AND b.type = a.type AND b.key = a.key),
members AS (SELECT query_id, item_id, min(seen) AS group_id FROM walk GROUP BY ALL),
grouped AS (SELECT * FROM one JOIN members USING (query_id, item_id)),
merged AS (
  SELECT query_id, group_id AS canonical_id, count(*) AS n_items, count(DISTINCT service_id) > 1 AS is_cross_source,
    CASE WHEN count(*) = 1 THEN max(score * weight) ELSE least(sum(score * weight) / sum(weight), 1.0) END AS score,
    CASE WHEN count(*) = 1 THEN min(content) ELSE string_agg('[' || upper(source_type) || '] ' || content, E'\\n' ORDER BY weight DESC, service_id, ord) END AS content,
    list(source_type ORDER BY weight DESC, service_id, ord) AS types, min((service_id, ord)) AS first
  FROM grouped GROUP BY ALL),
ranked AS (SELECT *, round_even(least(score * CASE WHEN is_cross_source THEN 1.2 ELSE 1.0 END, 1.0), 4) AS final_score, row_number() OVER (PARTITION BY query_id ORDER BY round_even(least(score * CASE WHEN is_cross_source THEN 1.2 ELSE 1.0 END, 1.0), 4) DESC, first)::INT AS rank_no FROM merged QUALIFY rank_no <= 20)
"""


def _kind(kind: str) -> str:
    return f"SELECT query_id, ord, item_id, content, round(score, 4) AS score, weight FROM one WHERE source_type = '{kind}'"


def _normalised(spark: SparkSession, base: str, kind: str) -> DataFrame:
    return items(spark, base).where(F.col("source_type") == kind).select("query_id", "ord", "item_id", "content", F.round("score", 4).alias("score"), "weight")


@BOOK.add("integ_normalise_sql", _BATCH + _kind("sql"))
def integ_normalise_sql(spark: SparkSession, base: str) -> DataFrame:
    """Relational rows as items."""
    return _normalised(spark, base, "sql")


@BOOK.add("integ_normalise_graph", _BATCH + _kind("graph"))
def integ_normalise_graph(spark: SparkSession, base: str) -> DataFrame:
    """Graph records as items."""
    return _normalised(spark, base, "graph")


@BOOK.add("integ_normalise_doc", _BATCH + _kind("document"))
def integ_normalise_doc(spark: SparkSession, base: str) -> DataFrame:
    """Text hits as items, scores against the best of the question."""
    return _normalised(spark, base, "document")


@BOOK.add("integ_mentions", "SELECT word, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM (SELECT doc_id, unnest(list_filter(regexp_extract_all(text[1:500], '[\\p{L}\\p{N}_]+'), lambda w: regexp_full_match(w, '[A-Z][a-zA-Z]{2,}'))) AS word FROM documents WHERE text IS NOT NULL) GROUP BY word")
def integ_mentions(spark: SparkSession, base: str) -> DataFrame:
    """Capitalised mentions in texts."""
    words = table(spark, base, "documents").where("text is not null").select("doc_id", F.explode(I.mentions(F.col("text"))).alias("word"))
    # A document's repetitions are one row with a count before words are counted over documents.
    rows = words.groupBy("word", "doc_id").agg(F.count("*").alias("c")).groupBy("word").agg(F.sum("c").alias("n"), F.count("*").alias("n_docs"))
    return rows


@BOOK.add("integ_entity_keys", _BATCH + "SELECT * FROM keys")
def integ_entity_keys(spark: SparkSession, base: str) -> DataFrame:
    """What items can be merged by."""
    return I.entity_keys(items(spark, base))


@BOOK.add("integ_components", _BATCH + "SELECT * FROM members")
def integ_components(spark: SparkSession, base: str) -> DataFrame:
    """Items of one entity, transitively."""
    return I.groups(items(spark, base))


def _merged(spark: SparkSession, base: str) -> DataFrame:
    found = items(spark, base)
    return I.merge_groups(found, I.groups(found))


@BOOK.add("integ_merge_scores", _BATCH + "SELECT query_id, canonical_id, n_items, round(score, 4) AS score, content FROM merged")
def integ_merge_scores(spark: SparkSession, base: str) -> DataFrame:
    """Merged contents and weighted scores."""
    return _merged(spark, base).select("query_id", "canonical_id", "n_items", F.round("score", 4).alias("score"), "content")


@BOOK.add("integ_cross_source", _BATCH + "SELECT query_id, is_cross_source, count(*) AS n_groups, sum(n_items)::BIGINT AS n_items FROM merged GROUP BY ALL")
def integ_cross_source(spark: SparkSession, base: str) -> DataFrame:
    """Groups confirmed by more than one service (E5)."""
    return _merged(spark, base).groupBy("query_id", "is_cross_source").agg(F.count("*").alias("n_groups"), F.sum("n_items").alias("n_items"))


@BOOK.add(
    "integ_conflicts",
    _BATCH + """, cells AS (SELECT query_id, group_id, item_id, service_id, ord, 'user_id' AS attribute, u::DOUBLE AS value FROM grouped WHERE u IS NOT NULL UNION ALL SELECT query_id, group_id, item_id, service_id, ord, 'post_id', p::DOUBLE FROM grouped WHERE p IS NOT NULL UNION ALL SELECT query_id, group_id, item_id, service_id, ord, 'view_count', views FROM grouped WHERE views IS NOT NULL)
SELECT a.query_id, a.group_id, a.item_id AS item_a, b.item_id AS item_b, a.attribute, a.value AS value_a, b.value AS value_b FROM cells a JOIN cells b ON a.query_id = b.query_id AND a.group_id = b.group_id AND a.attribute = b.attribute AND (a.service_id, a.ord) < (b.service_id, b.ord) AND a.service_id <> b.service_id
WHERE abs(a.value - b.value) > 0.01 * greatest(abs(a.value), abs(b.value))""",
)
def integ_conflicts(spark: SparkSession, base: str) -> DataFrame:
    """Numbers on which services disagree about one entity."""
    found = items(spark, base)
    return I.conflicts(found, I.groups(found))


@BOOK.add("integ_rank", _BATCH + "SELECT query_id, rank_no, canonical_id, final_score FROM ranked")
def integ_rank(spark: SparkSession, base: str) -> DataFrame:
    """Boosted ranking."""
    return I.rank(_merged(spark, base)).select("query_id", "rank_no", "canonical_id", "final_score")


@BOOK.add(
    "integ_context",
    _BATCH + """, blocks AS (SELECT query_id, rank_no, '[SOURCE: ' || array_to_string(list_transform(list_filter(['sql', 'graph', 'document'], lambda t: list_contains(types, t)), lambda t: upper(t)), ' + ') || ' | RANK: ' || rank_no || ' | SCORE: ' || printf('%.3f', round_even(final_score, 3)) || E']\\n' || content || E'\\n' AS block FROM ranked),
fit AS (SELECT *, sum(length(block)) OVER (PARTITION BY query_id ORDER BY rank_no) AS upto FROM blocks QUALIFY upto <= 8000)
SELECT t.query_id, count(f.block) AS n_items, md5(coalesce(string_agg(f.block, E'\\n' ORDER BY f.rank_no), '')) AS context_md5 FROM topics t LEFT JOIN fit f USING (query_id) GROUP BY t.query_id""",
)
def integ_context(spark: SparkSession, base: str) -> DataFrame:
    """The whole way from results to size-capped contexts, a question without results included."""
    return I.integrate(items(spark, base), questions(spark)).select("query_id", "n_items", F.md5("context").alias("context_md5"))


QUERIES, SQL = BOOK.queries, BOOK.sql
