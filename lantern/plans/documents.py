"""The document query corpus: ranked text search and index statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import STOP_WORDS
from ..operators.bm25 import build_index, field_stats, field_tokens, keyword, postings, search, search_index
from ..session import exists, files_state, shared_folder, table
from .book import Book, top

BOOK = Book()
BOOSTS = {"title": 2.0, "text": 1.0}
#: Questions to the text index.
ASKED = [
    ("d01", "planner picks the wrong index"), ("d02", "why is the posterior stale"), ("d03", "rolling window frozen checkpoint"), ("d04", "Brontik bandwidth"), ("d05", "memory of the estimator"),
    ("d06", "resampling by hand"), ("d07", "error MN-8837 coefficient"), ("d08", "Velmatrix AND Nimbrel OR Norvane"), ("d09", "version 6.10 of Quorbase"), ("d10", "Stichprobe Varianz"),
    ("d11", "tabla partición índice"), ("d12", "shuffle the transaction log"), ("d13", "duplicate rows after merge"), ("d14", "sparse kernel embedding"), ("d15", "explain cost scan"),
    ("d16", "quantile of a censored sample"), ("d17", "how to vacuum"), ("d18", "the and of"), ("d19", ""), ("d20", "lag lead window"),
]


def asked(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ASKED, "query_id string, text string")


def _list(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def bm25_sql(docs: str, queries: str, k: int, fields: dict[str, float]) -> str:
    """Common table expressions up to hits(query_id, doc, score, rank_no); docs has doc and the fields, queries query_id and text."""
    cells = " UNION ALL ".join(f"SELECT doc, '{f}' AS field, {b}::DOUBLE AS boost, list_filter(regexp_extract_all(lower({f}), '[\\p{{L}}\\p{{N}}]+'), lambda w: NOT list_contains({_list(STOP_WORDS)}, w)) AS words FROM ({docs}) WHERE {f} IS NOT NULL" for f, b in fields.items())
    return f"""cells AS ({cells}), words AS (SELECT * FROM cells WHERE len(words) > 0),
stats AS (SELECT field, count(*) AS n, avg(len(words)) AS avgdl FROM words GROUP BY field),
asked AS (SELECT DISTINCT query_id, unnest(list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+'), lambda w: NOT list_contains({_list(STOP_WORDS)}, w))) AS term FROM ({queries})),
posted AS (SELECT doc, field, boost, dl, term, count(*) AS tf FROM (SELECT doc, field, boost, len(words) AS dl, unnest(words) AS term FROM words) WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
freq AS (SELECT term, field, count(*) AS df FROM posted GROUP BY ALL),
weighed AS (SELECT doc, field, boost, term, ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl)) AS w FROM posted JOIN freq USING (term, field) JOIN stats USING (field)),
best AS (SELECT query_id, doc, round(max(s), 4) AS score FROM (SELECT query_id, doc, field, sum(w) * boost AS s FROM weighed JOIN asked USING (term) GROUP BY query_id, doc, field, boost) GROUP BY query_id, doc),
hits AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc)::INT AS rank_no FROM best QUALIFY rank_no <= {k})"""


def _values(rows: list[tuple[str, str]]) -> str:
    return "SELECT * FROM (VALUES " + ", ".join(f"('{i}', '{t}')" for i, t in rows) + ") AS v(query_id, text)"


_DOCS = "SELECT doc_id AS doc, title, text FROM documents"
_HITS = "SELECT query_id, doc AS doc_id, score, rank_no FROM hits"


@BOOK.add("doc_search", "WITH " + bm25_sql(_DOCS, _values(ASKED), 10, BOOSTS) + _HITS)
def doc_search(spark: SparkSession, base: str) -> DataFrame:
    """All questions at once, best field, top ten of each."""
    return search(table(spark, base, "documents"), "doc_id", BOOSTS, asked(spark)).withColumnRenamed("doc", "doc_id")


#: The keyword field of the index, and questions that are one of its values.
KEYWORDS = {"source": 1.0}
WITH_KEYWORD = [*ASKED, ("d21", "metrics-hall"), ("d22", "query-yard"), ("d23", "no such source")]
_KEYED = "kw AS (SELECT query_id, doc_id AS doc, round(ln(1 + (n - df + 0.5) / (df + 0.5)), 4) AS score FROM (SELECT query_id, doc_id, count(*) OVER (PARTITION BY query_id) AS df FROM documents JOIN (" + _values(WITH_KEYWORD) + """) a ON source = a.text), (SELECT count(source) AS n FROM documents)),
every AS (SELECT query_id, doc, max(score) AS score FROM (SELECT query_id, doc, score FROM best UNION ALL SELECT * FROM kw) GROUP BY ALL)
SELECT query_id, doc AS doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc)::INT AS rank_no FROM every QUALIFY rank_no <= 10"""


def index(spark: SparkSession, base: str) -> str:
    """The folder of the documents' index, built once in the shared folder while the documents stay as they are."""
    path = f"{shared_folder(spark)}/index-{files_state(spark, base, ('documents',))[:32]}"
    if not exists(spark, f"{path}/stats/_SUCCESS"):
        build_index(table(spark, base, "documents"), "doc_id", list(BOOSTS), list(KEYWORDS), path)
    return path


@BOOK.add("doc_search_indexed", "WITH " + bm25_sql(_DOCS, _values(WITH_KEYWORD), 10, BOOSTS) + ", " + _KEYED)
def doc_search_indexed(spark: SparkSession, base: str) -> DataFrame:
    """All questions against the stored index: title, text and a keyword field, the best counts."""
    questions = spark.createDataFrame(WITH_KEYWORD, "query_id string, text string")
    return search_index(spark, index(spark, base), {**BOOSTS, **KEYWORDS}, questions).withColumnRenamed("doc", "doc_id")


@BOOK.add("doc_search_body", "WITH " + bm25_sql(_DOCS, _values(ASKED), 20, {"text": 1.0}) + _HITS)
def doc_search_body(spark: SparkSession, base: str) -> DataFrame:
    """A single field."""
    return search(table(spark, base, "documents"), "doc_id", {"text": 1.0}, asked(spark), 20).withColumnRenamed("doc", "doc_id")


@BOOK.add("doc_search_filtered", "WITH " + bm25_sql("SELECT doc_id AS doc, title, text FROM documents WHERE doc_type IN ('answer', 'comment') AND creation_date >= '2022-01-01'", _values(ASKED), 10, BOOSTS) + _HITS)
def doc_search_filtered(spark: SparkSession, base: str) -> DataFrame:
    """Search under term and range conditions (P15); statistics are those of the rows that pass."""
    docs = table(spark, base, "documents").where("doc_type in ('answer', 'comment') and creation_date >= timestamp_ntz'2022-01-01'")
    return search(docs, "doc_id", BOOSTS, asked(spark)).withColumnRenamed("doc", "doc_id")


@BOOK.add("doc_source_hits", "WITH " + bm25_sql(_DOCS, _values(ASKED), 10, BOOSTS) + "SELECT query_id, 'doc_' || d.doc_id AS _id, score AS _score, d.doc_type, coalesce(d.title, '') AS title, coalesce(d.post_id, 0) AS post_id FROM hits h JOIN documents d ON d.doc_id = h.doc")
def doc_source_hits(spark: SparkSession, base: str) -> DataFrame:
    """Hits with their source fields (D6, D7); the few hits are broadcast to the one scan that fetches them."""
    docs = table(spark, base, "documents")
    hits = search(docs, "doc_id", BOOSTS, asked(spark))
    rows = docs.select("doc_id", "doc_type", "title", "post_id").join(F.broadcast(hits), F.col("doc_id") == F.col("doc"))
    return rows.select("query_id", F.concat(F.lit("doc_"), F.col("doc_id")).alias("_id"), F.col("score").alias("_score"), "doc_type", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("post_id", F.lit(0)).alias("post_id"))


@BOOK.add("doc_index_stats", "WITH " + bm25_sql(_DOCS, _values(ASKED), 10, BOOSTS) + "SELECT field, n, round(avgdl, 4) AS avgdl FROM stats")
def doc_index_stats(spark: SparkSession, base: str) -> DataFrame:
    """Documents and mean length per field."""
    return field_stats(field_tokens(table(spark, base, "documents"), "doc_id", list(BOOSTS))).select("field", "n", F.round("avgdl", 4).alias("avgdl"))


@BOOK.add("doc_common_terms", "WITH " + bm25_sql(_DOCS, _values(ASKED), 10, BOOSTS) + "SELECT field, term, count(DISTINCT doc) AS df, count(*) AS cf FROM (SELECT field, doc, unnest(words) AS term FROM words) GROUP BY ALL ORDER BY df DESC, field, term LIMIT 100")
def doc_common_terms(spark: SparkSession, base: str) -> DataFrame:
    """The full postings reduced to document and collection frequency."""
    rows = postings(field_tokens(table(spark, base, "documents"), "doc_id", list(BOOSTS)))
    return top(rows.groupBy("field", "term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf")), 100, F.col("df").desc(), F.col("field"), F.col("term"))


@BOOK.add("doc_keyword", "SELECT id, tag_name, count FROM tags WHERE tag_name = 'vectors, sparse'")
def doc_keyword(spark: SparkSession, base: str) -> DataFrame:
    """A keyword field takes the whole question (D3)."""
    return keyword(table(spark, base, "tags"), "tag_name", "vectors, sparse").select("id", "tag_name", "count")


@BOOK.add("doc_empty_query", "WITH " + bm25_sql(_DOCS, _values([("e1", ""), ("e2", "the and of")]), 10, BOOSTS) + _HITS)
def doc_empty_query(spark: SparkSession, base: str) -> DataFrame:
    """Questions without terms find nothing."""
    empty = spark.createDataFrame([("e1", ""), ("e2", "the and of")], "query_id string, text string")
    return search(table(spark, base, "documents"), "doc_id", BOOSTS, empty).withColumnRenamed("doc", "doc_id")


# The fewest documents of each type that a complete index holds.
LEAST = {"question": 1000, "answer": 1000, "comment": 100, "user_about": 10, "tag_wiki": 5}


@BOOK.add("doc_type_counts", "SELECT t.doc_type, coalesce(n, 0) AS n, coalesce(n, 0) >= least AS enough FROM (VALUES " + ", ".join(f"('{k}', {v})" for k, v in LEAST.items()) + ") AS t(doc_type, least) LEFT JOIN (SELECT doc_type, count(*) AS n FROM documents GROUP BY doc_type) USING (doc_type)")
def doc_type_counts(spark: SparkSession, base: str) -> DataFrame:
    """Documents per type against the least expected."""
    counts = table(spark, base, "documents").groupBy("doc_type").agg(F.count("*").alias("n"))
    want = spark.createDataFrame(list(LEAST.items()), "doc_type string, least long")
    n = F.coalesce("n", F.lit(0).cast("long"))
    return want.join(counts, "doc_type", "left").select("doc_type", n.alias("n"), (n >= F.col("least")).alias("enough"))


QUERIES, SQL = BOOK.queries, BOOK.sql
