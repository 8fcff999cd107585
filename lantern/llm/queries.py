"""Queries p3 to p10 and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.delivery import latest_delivery
from ..operators.packed import split_packed
from ..session import table
from .canonical import map_to_list
from .bytepair import VOCABULARY, decode_corpus, encode_corpus
from .components import connected_components
from .cooccur import surprising_pairs
from .pii import find_personal, lexicon
from .residue import message_templates, residue
from .tiling import leaks
from .topn import top_n


def p3_found(spark: SparkSession, base: str) -> DataFrame:
    """The place that each user's location means, 0 for none of the list."""
    users = latest_delivery(table(spark, base, "users"), ["id"], ["location"]).withColumnRenamed("id", "user_id")
    return map_to_list(users, "user_id", "location", table(spark, base, "places"))


def p3_misses(spark: SparkSession, base: str) -> DataFrame:
    """Locations that mean no place of the list, with the number of users who entered them."""
    users = latest_delivery(table(spark, base, "users"), ["id"], ["location"]).withColumnRenamed("id", "user_id")
    none = p3_found(spark, base).where("place_id = 0").select("user_id")
    return users.join(none, "user_id", "left_semi").groupBy("location").agg(F.count("*").alias("n_users"))


def personal(spark: SparkSession, base: str) -> DataFrame:
    """(user_id, field_name, kinds, redacted) of about_me and location in the latest deliveries."""
    users = table(spark, base, "users")
    given, family, rest = lexicon(users, "display_name", "id")
    latest = latest_delivery(users, ["id"], ["about_me", "location", "display_name"]).withColumnRenamed("id", "user_id")
    return find_personal(latest, "user_id", ["about_me", "location"], given, family, "display_name", rest)


def p5_found(spark: SparkSession, base: str) -> DataFrame:
    """Kinds of personal information by user and field."""
    return personal(spark, base).select("user_id", "field_name", F.explode("kinds").alias("kind"))


def p5_redacted(spark: SparkSession, base: str) -> DataFrame:
    """Every text with placeholders for what is personal in it."""
    return personal(spark, base).select("user_id", "field_name", "redacted")


def p4_found(spark: SparkSession, base: str) -> DataFrame:
    """Groups of posts joined by duplicate links."""
    links = table(spark, base, "postlinks").where("link_type_id = 3")
    return connected_components(links, "post_id", "related_post_id").withColumnRenamed("vertex", "post_id")


def question_tags(spark: SparkSession, base: str) -> DataFrame:
    """(post_id, tag) of the latest delivery of every question, each tag once."""
    posts = latest_delivery(table(spark, base, "posts"), ["id"], ["post_type_id", "tags"]).where("post_type_id = 1")
    return split_packed(posts.select(F.col("id").alias("post_id"), "tags"), "post_id", "tags").select("post_id", F.col("value").alias("tag")).distinct()


def p6_surprise(spark: SparkSession, base: str) -> DataFrame:
    """Pairs of tags on at least four questions with what the configuration model says of them."""
    pairs = surprising_pairs(question_tags(spark, base), "post_id", "tag")
    return pairs.select(F.col("item_a").alias("tag_a"), F.col("item_b").alias("tag_b"), "n_ab", "n_a", "n_b", F.round("expected", 4).alias("expected"), F.round("log10_p", 3).alias("log10_p"), F.round("q_value", 6).alias("q_value"))


def p6_found(spark: SparkSession, base: str) -> DataFrame:
    """Pairs of tags that share at least four questions and three times as many as chance would give."""
    pairs = surprising_pairs(question_tags(spark, base), "post_id", "tag")
    return pairs.where("n_ab >= 4 and n_ab * n >= 3 * n_a * n_b").select(F.col("item_a").alias("tag_a"), F.col("item_b").alias("tag_b"))


def p7_found(spark: SparkSession, base: str) -> DataFrame:
    """The three best answers of every question."""
    answers = latest_delivery(table(spark, base, "posts"), ["id"], ["post_type_id", "parent_id", "score"]).where("post_type_id = 2 and parent_id > 0")
    return top_n(answers.withColumnRenamed("id", "post_id"), ["parent_id"], "score", "post_id", 3)


def p8_ids(spark: SparkSession, base: str, path: str = VOCABULARY) -> DataFrame:
    """Token ids of every document."""
    return encode_corpus(table(spark, base, "documents"), "doc_id", "text", path)


def p8_roundtrip(spark: SparkSession, base: str, path: str = VOCABULARY) -> DataFrame:
    """Documents by whether decoding their ids gives their text again, null read as empty."""
    docs = table(spark, base, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("want"))
    back = decode_corpus(encode_corpus(docs, "doc_id", "want", path), "doc_id", path)
    return back.join(docs, "doc_id").groupBy((F.col("text") == F.col("want")).alias("same")).agg(F.count("*").alias("n_docs"))


def p9_leaks(spark: SparkSession, base: str) -> DataFrame:
    """Shared passages of documents and evaluation items, with the part of the item they cover."""
    found = leaks(table(spark, base, "documents"), "doc_id", "text", table(spark, base, "eval_items"), "item_id", "item_text")
    return found.withColumn("coverage", F.round(F.col("covered") / F.col("item_words"), 4))


def p9_report(spark: SparkSession, base: str) -> DataFrame:
    """By item: documents that leak any of it, and those that hold four fifths of it or more in whatever order."""
    return p9_leaks(spark, base).groupBy("item_id").agg(F.countDistinct("doc_id").alias("n_docs"), F.sum(F.when(F.col("coverage") >= 0.8, 1).otherwise(0)).alias("n_full"), F.max("longest").alias("longest"))


def p9_found(spark: SparkSession, base: str) -> DataFrame:
    """Documents and the evaluation items they leak."""
    return leaks(table(spark, base, "documents"), "doc_id", "text", table(spark, base, "eval_items"), "item_id", "item_text").select("doc_id", "item_id").distinct()


def p10_found(spark: SparkSession, base: str) -> DataFrame:
    """Documents that are residue or hold a piece of it where content should be."""
    return residue(table(spark, base, "documents"), "doc_id", "text").select("doc_id")


def p10_templates(spark: SparkSession, base: str) -> DataFrame:
    """Templates of stored messages that exclude a document, with the number of messages of each."""
    return message_templates(table(spark, base, "documents"), "text").where("verdict > 0").select("template", "n", "verdict")


QUERIES = {"p3_found": p3_found, "p3_misses": p3_misses, "p5_found": p5_found, "p5_redacted": p5_redacted, "p4_found": p4_found, "p6_found": p6_found, "p6_surprise": p6_surprise, "p7_found": p7_found, "p8_ids": p8_ids, "p8_roundtrip": p8_roundtrip, "p9_found": p9_found, "p9_leaks": p9_leaks, "p9_report": p9_report, "p10_found": p10_found, "p10_templates": p10_templates}

_TAGS = r"""
WITH latest AS (
  SELECT id AS post_id, tags, post_type_id FROM posts QUALIFY row_number() OVER (PARTITION BY id ORDER BY loaded_at DESC) = 1
), plain AS (
  SELECT post_id, replace(replace(replace(tags, '&lt;', '<'), '&gt;', '>'), '&quot;', '"') AS t FROM latest WHERE post_type_id = 1 AND trim(tags, E' \t\n') <> ''
), pieces AS (
  SELECT post_id, CASE
    WHEN regexp_matches(t, '^\s*\[.*\]\s*$') THEN list_transform(regexp_extract_all(t, '"((?:[^"\\]|\\.)*)"', 1), lambda x: regexp_replace(x, '\\(.)', '\1', 'g'))
    WHEN regexp_matches(t, '<[^<>]*>') THEN regexp_extract_all(t, '<([^<>]*)>', 1)
    WHEN regexp_matches(t, '[;,|\t]') OR regexp_matches(t, '^\s*["'']') THEN
      list_transform(regexp_extract_all(t, '\s*"(?:[^"]|"")*"|\s*''[^'']*''|[^;,|\t]+'),
        lambda x: CASE WHEN trim(x) LIKE '"%"' THEN replace(substr(trim(x), 2, length(trim(x)) - 2), '""', '"')
                       WHEN trim(x) LIKE '''%''' THEN substr(trim(x), 2, length(trim(x)) - 2) ELSE x END)
    ELSE regexp_split_to_array(t, '\s+') END AS v
  FROM plain
), tagged AS (SELECT DISTINCT post_id, tag FROM (SELECT post_id, lower(replace(trim(unnest(v), E' \t\n'), '&amp;', '&')) AS tag FROM pieces) WHERE tag <> ''),
single AS (SELECT tag, count(*) AS n FROM tagged GROUP BY tag),
pairs AS (SELECT a.tag AS tag_a, b.tag AS tag_b, count(*) AS n_ab FROM tagged a JOIN tagged b ON a.post_id = b.post_id AND a.tag < b.tag GROUP BY ALL HAVING count(*) >= 4)
"""

SQL = {
    "p4_found": """
WITH RECURSIVE ends AS (
  SELECT DISTINCT post_id AS u, related_post_id AS v FROM postlinks WHERE link_type_id = 3 AND post_id <> related_post_id
), both_ways AS (SELECT u, v FROM ends UNION SELECT v, u FROM ends),
walk AS (SELECT u AS post_id, u AS seen FROM both_ways UNION SELECT w.post_id, b.v FROM walk w JOIN both_ways b ON b.u = w.seen)
SELECT post_id, min(seen) AS group_id FROM walk GROUP BY post_id""",
    "p6_found": _TAGS + """
SELECT tag_a, tag_b FROM pairs JOIN single a ON a.tag = tag_a JOIN single b ON b.tag = tag_b
WHERE n_ab * (SELECT count(DISTINCT post_id) FROM tagged) >= 3 * a.n * b.n""",
    "p7_found": """
WITH latest AS (SELECT id, post_type_id, parent_id, score FROM posts QUALIFY row_number() OVER (PARTITION BY id ORDER BY loaded_at DESC) = 1)
SELECT parent_id, row_number() OVER (PARTITION BY parent_id ORDER BY score DESC NULLS LAST, id)::INT AS rank_no, id AS post_id
FROM latest WHERE post_type_id = 2 AND parent_id > 0 QUALIFY rank_no <= 3""",
    "p8_roundtrip": "SELECT TRUE AS same, count(*) AS n_docs FROM documents",
    "p9_found": r"""
WITH seqs AS (
  SELECT doc_id, regexp_extract_all(lower(regexp_replace(text, '</?[A-Za-z!?][^<>]*>', ' ', 'g')), '[\p{L}\p{N}]+') AS w FROM documents WHERE text IS NOT NULL
), items AS (
  SELECT item_id, regexp_extract_all(lower(regexp_replace(item_text, '</?[A-Za-z!?][^<>]*>', ' ', 'g')), '[\p{L}\p{N}]+') AS w FROM eval_items
), a AS (SELECT DISTINCT doc_id, array_to_string(w[i:i+11], ' ') AS g FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 11)) AS i FROM seqs WHERE len(w) >= 12)),
b AS (SELECT DISTINCT item_id, array_to_string(w[i:i+11], ' ') AS g FROM (SELECT item_id, w, unnest(generate_series(1, len(w) - 11)) AS i FROM items WHERE len(w) >= 12))
SELECT DISTINCT doc_id, item_id FROM a JOIN b USING (g)""",
}
