"""Queries p1 and p2 over the whole archive tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.delivery import latest_delivery
from ..operators.orphans import Reference, orphan_references, orphan_report
from ..operators.packed import split_packed
from ..session import table

REFERENCES = [
    Reference("posts", "owner_user_id", "users", "user"),
    Reference("posts", "accepted_answer_id", "posts", "post"),
    Reference("posts", "parent_id", "posts", "post"),
    Reference("votes", "post_id", "posts", "post"),
]


def _tables(spark: SparkSession, base: str) -> dict[str, DataFrame]:
    return {t: table(spark, base, t) for t in ("posts", "users", "votes")}


def p1_found(spark: SparkSession, base: str) -> DataFrame:
    """Broken references of posts and votes, one row per id and field."""
    return orphan_references(_tables(spark, base), table(spark, base, "deletions"), REFERENCES)


def p1_report(spark: SparkSession, base: str) -> DataFrame:
    """Broken references counted per table, field, month and reason."""
    return orphan_report(_tables(spark, base), table(spark, base, "deletions"), REFERENCES)


def p2_found(spark: SparkSession, base: str) -> DataFrame:
    """Every tag of every post with its place in the field."""
    posts = latest_delivery(table(spark, base, "posts"), ["id"], ["tags"]).withColumnRenamed("id", "post_id")
    return split_packed(posts, "post_id", "tags").withColumnRenamed("value", "tag")


QUERIES = {"p1_found": p1_found, "p1_report": p1_report, "p2_found": p2_found}

_P1 = """
WITH refs AS (
  SELECT 'posts' AS table_name, 'owner_user_id' AS field_name, 'user' AS entity, id AS row_id, owner_user_id AS value, loaded_at, creation_date FROM posts
  UNION ALL SELECT 'posts', 'accepted_answer_id', 'post', id, accepted_answer_id, loaded_at, creation_date FROM posts
  UNION ALL SELECT 'posts', 'parent_id', 'post', id, parent_id, loaded_at, creation_date FROM posts
  UNION ALL SELECT 'votes', 'post_id', 'post', id, post_id, loaded_at, creation_date FROM votes
), carried AS (
  SELECT table_name, field_name, entity, row_id, value, min(loaded_at) AS since, max(loaded_at) AS until, min(creation_date) AS creation_date
  FROM refs WHERE value > 0 GROUP BY table_name, field_name, entity, row_id, value
), one AS (
  SELECT * FROM carried QUALIFY row_number() OVER (PARTITION BY table_name, field_name, row_id ORDER BY until DESC, value DESC) = 1
), target AS (
  SELECT 'post' AS entity, id AS value, min(loaded_at) AS first, max(loaded_at) AS latest FROM posts GROUP BY id
  UNION ALL SELECT 'user', id, min(loaded_at), max(loaded_at) FROM users GROUP BY id
), gone AS (SELECT entity, entity_id AS value, max(deleted_at) AS deleted_at, 1 AS logged FROM deletions GROUP BY ALL),
judged AS (
  SELECT table_name, field_name, row_id,
    CASE WHEN latest IS NULL AND logged IS NULL THEN 'missing'
         WHEN logged = 1 AND (latest IS NULL OR deleted_at > latest) THEN 'deleted'
         WHEN first > since THEN 'late' END AS reason,
    coalesce(strftime(creation_date, '%Y-%m'), 'none') AS ref_month
  FROM one LEFT JOIN target USING (entity, value) LEFT JOIN gone USING (entity, value))
"""

#: Reading a packed field by rule, as text shared with other queries.
_PIECES = r"""
plain AS (
  SELECT post_id, replace(replace(replace(tags, '&lt;', '<'), '&gt;', '>'), '&quot;', '"') AS t FROM latest WHERE trim(tags, E' \t\n') <> ''
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
), tidy AS (SELECT post_id, list_filter(list_transform(v, lambda x: lower(replace(trim(x, E' \t\n'), '&amp;', '&'))), lambda x: x <> '') AS v FROM pieces)"""
_P2 = (
    """
WITH latest AS (
  SELECT id AS post_id, tags FROM (SELECT DISTINCT id, tags, loaded_at FROM posts)
  QUALIFY row_number() OVER (PARTITION BY id ORDER BY loaded_at DESC, tags DESC) = 1
),"""
    + _PIECES
    + """
SELECT post_id, pos::INT AS pos, v[pos] AS tag FROM (SELECT post_id, v, unnest(generate_series(1, len(v))) AS pos FROM tidy)"""
)
#: tagged(post_id, tag): the tags of every question, each once; further expressions may follow.
TAGS_SQL = (
    """
WITH latest AS (SELECT * FROM (SELECT id AS post_id, tags, post_type_id FROM posts QUALIFY row_number() OVER (PARTITION BY id ORDER BY loaded_at DESC) = 1) WHERE post_type_id = 1),"""
    + _PIECES
    + """,
tagged AS (SELECT DISTINCT post_id, unnest(v) AS tag FROM tidy)"""
)

SQL = {
    "p1_found": _P1 + "SELECT * FROM judged WHERE reason IS NOT NULL",
    "p1_report": _P1 + "SELECT table_name, field_name, ref_month, reason, count(*) AS n_refs FROM judged WHERE reason IS NOT NULL GROUP BY ALL",
    "p2_found": _P2,
}
