"""BM25 ranked search over the texts of a collection, for many questions in one job."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import tokens

K1, B = 1.2, 0.75


def field_tokens(docs: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(doc, field, words): analysed fields that are not empty."""
    cells = F.array(*[F.struct(F.lit(f).alias("field"), tokens(F.col(f)).alias("words")) for f in fields])
    return docs.select(F.col(key).alias("doc"), F.explode(cells).alias("c")).select("doc", "c.field", "c.words").where(F.size("words") > 0)


def field_stats(words: DataFrame) -> DataFrame:
    """(field, n, avgdl): one row per field."""
    return words.groupBy("field").agg(F.count("*").alias("n"), F.avg(F.size("words")).alias("avgdl"))


def postings(words: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """(term, field, doc, tf, dl), for the given terms only if there are any.

    The terms of the questions are matched where the document is read: of a document nothing but
    the words that some question asks for is shuffled.
    """
    rows = words.select("doc", "field", F.size("words").alias("dl"), F.explode("words").alias("term"))
    if terms is not None:
        rows = rows.join(F.broadcast(terms.select("term").distinct()), "term", "left_semi")
    return rows.groupBy("term", "field", "doc", "dl").agg(F.count("*").alias("tf"))


def _ranked(found: DataFrame, stats: DataFrame, asked: DataFrame, boosts: dict[str, float], k: int) -> DataFrame:
    """The k best documents of each question: its terms' postings weighed, added up by field, the best field taken."""
    df = found.groupBy("term", "field").agg(F.count("*").alias("df"))
    boost = F.create_map(*[F.lit(x) for f, b in boosts.items() for x in (f, float(b))])
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    # A keyword has no length; it counts as one of mean length.
    length = F.coalesce(F.col("dl") / F.col("avgdl"), F.lit(1.0))
    weight = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * length))
    scored = (
        found.join(F.broadcast(df), ["term", "field"])
        .join(F.broadcast(stats), "field")
        .select("term", "field", "doc", weight.alias("w"))
        .join(F.broadcast(asked), ["term", "field"])
        .groupBy("query_id", "doc", "field")
        .agg(F.sum("w").alias("s"))
        .groupBy("query_id", "doc")
        .agg(F.round(F.max(F.col("s") * boost[F.col("field")]), 4).alias("score"))
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc")
    return scored.withColumn("rank_no", F.row_number().over(order)).where(F.col("rank_no") <= k)


def _asked(questions: DataFrame, fields: list[str], keywords: list[str]) -> DataFrame:
    """(query_id, field, term): the terms of each question, each once, and for keyword fields the whole question."""
    texts = F.array(*[F.struct(F.lit(f).alias("field"), F.array_distinct(tokens(F.col("text"))).alias("terms")) for f in fields], *[F.struct(F.lit(f).alias("field"), F.array("text").alias("terms")) for f in keywords])
    return questions.where("text is not null").select("query_id", F.explode(texts).alias("c")).select("query_id", "c.field", F.explode("c.terms").alias("term"))


def search(docs: DataFrame, key: str, boosts: dict[str, float], questions: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, doc, score, rank_no): the k best documents of each question by its best field.

    questions has query_id and text; it is the stated query set and is broadcast. A field's score
    adds up its terms (each once), times the field's boost; a document has the score of its best
    field, rounded to four places so that equal documents stay equal, then the smaller id first. A
    question without terms finds nothing. The documents are read here; see search_index for many
    questions over time.
    """
    asked = _asked(questions, list(boosts), [])
    words = field_tokens(docs, key, list(boosts))
    return _ranked(postings(words, asked), field_stats(words), asked, boosts, k)


def build_index(docs: DataFrame, key: str, fields: list[str], keywords: list[str], path: str, buckets: int = 64) -> None:
    """Writes the postings of analysed and keyword fields in buckets by term, and the fields' statistics, under path.

    A bucket is a folder sorted by term, so a question reads the buckets and row groups of its terms
    only. Buckets of frequent terms are split between tasks. Statistics are written last: an index
    without them is not there.
    """
    words = field_tokens(docs, key, fields)
    rows = postings(words).select("term", "field", "doc", "tf", F.col("dl").cast("int").alias("dl"))
    stats = field_stats(words)
    for f in keywords:
        one = docs.where(F.col(f).isNotNull()).select(F.col(f).alias("term"), F.lit(f).alias("field"), F.col(key).alias("doc"), F.lit(1).cast("long").alias("tf"), F.lit(None).cast("int").alias("dl"))
        rows = rows.unionByName(one)
        stats = stats.unionByName(one.groupBy("field").agg(F.count("*").alias("n"), F.lit(None).cast("double").alias("avgdl")))
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int"))
    rows.hint("rebalance", "bucket").sortWithinPartitions("bucket", "term").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
    stats.withColumn("buckets", F.lit(buckets)).withColumn("doc", F.lit(dict(docs.dtypes)[key])).coalesce(1).write.mode("overwrite").parquet(f"{path}/stats")


#: Terms of questions that become a condition at the scan; more are joined.
LISTED = 1000


def search_index(spark: SparkSession, path: str, boosts: dict[str, float], questions: DataFrame, k: int = 10) -> DataFrame:
    """As search, over an index that build_index wrote; boosts names its fields, analysed and keyword ones.

    The questions are a stated set; their terms are collected to name the buckets to read. Query ids are
    text.
    """
    stats = spark.read.schema("field string, n long, avgdl double, buckets int, doc string").parquet(f"{path}/stats").where(F.col("field").isin(*boosts))
    known = stats.collect()
    keywords = [r.field for r in known if r.avgdl is None]
    buckets = known[0].buckets if known else 1
    asked = _asked(questions, [f for f in boosts if f not in keywords], keywords).withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int"))
    said = asked.collect()
    terms = {(r.bucket, r.term) for r in said}
    asked = spark.createDataFrame([(r.query_id, r.field, r.term) for r in said], "query_id string, field string, term string")
    # The postings' schema is fixed, so no file is opened to learn it.
    rows = spark.read.schema(f"term string, field string, doc {known[0].doc if known else 'bigint'}, tf long, dl int, bucket int").parquet(f"{path}/postings").where(F.col("field").isin(*boosts))
    if len(terms) <= LISTED:
        rows = rows.where(F.col("bucket").isin(*{b for b, _ in terms}) & F.col("term").isin(*{t for _, t in terms}))
    else:
        rows = rows.join(F.broadcast(spark.createDataFrame(sorted(terms), "bucket int, term string")), ["bucket", "term"], "left_semi")
    local = spark.createDataFrame([(r.field, r.n, r.avgdl) for r in known], "field string, n long, avgdl double")
    return _ranked(rows.drop("bucket"), local, asked, boosts, k)


def keyword(docs: DataFrame, field: str, text: str) -> DataFrame:
    """Rows whose un-analysed field equals the whole question."""
    return docs.where(F.col(field) == F.lit(text))
