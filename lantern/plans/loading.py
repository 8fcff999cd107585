"""The loading queries: upserts, value parsing, referential checks and the document corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import none_if_zero, parse_date, safe_bool, safe_int, simple_tags
from ..operators.upsert import insert_new, merge_named, pending, upsert
from ..session import table
from .book import Book, latest, with_latest
from .graphs import _PLAIN, Graph

BOOK = Book()
_FIRST = "SELECT *, row_number() OVER (PARTITION BY id ORDER BY loaded_at) AS f, row_number() OVER (PARTITION BY id ORDER BY loaded_at DESC) AS l"


@BOOK.add(
    "etl_upsert_users",
    f"""WITH r AS ({_FIRST} FROM users WHERE id > 0)
SELECT a.id, strftime(a.creation_date, '%Y-%m-%d %H:%M:%S') AS creation_date, a.about_me, coalesce(a.account_id, 0) AS account_id, b.reputation, b.display_name, b.location, b.up_votes, b.down_votes, b.views
FROM r a JOIN r b ON a.id = b.id AND a.f = 1 AND b.l = 1""",
)
def etl_upsert_users(spark: SparkSession, base: str) -> DataFrame:
    """Users: some columns keep their first value, others take the last."""
    rows = upsert(table(spark, base, "users"), "id", ["creation_date", "about_me", "account_id"], ["reputation", "display_name", "location", "up_votes", "down_votes", "views"])
    return rows.withColumns({"creation_date": F.date_format("creation_date", "yyyy-MM-dd HH:mm:ss"), "account_id": F.coalesce("account_id", F.lit(0))})


@BOOK.add(
    "etl_upsert_posts",
    f"""WITH r AS ({_FIRST} FROM posts WHERE id > 0)
SELECT a.id, a.post_type_id, a.title, CASE WHEN a.owner_user_id > 0 THEN a.owner_user_id END::VARCHAR AS owner_user_id, CASE WHEN a.last_editor_user_id > 0 THEN a.last_editor_user_id END::VARCHAR AS last_editor_user_id,
b.score, b.view_count, b.answer_count, b.comment_count, b.tags FROM r a JOIN r b ON a.id = b.id AND a.f = 1 AND b.l = 1""",
)
def etl_upsert_posts(spark: SparkSession, base: str) -> DataFrame:
    """Posts: counters and tags take the last value, 0 and -1 are no reference (K2)."""
    rows = upsert(table(spark, base, "posts"), "id", ["post_type_id", "title", "owner_user_id", "last_editor_user_id"], ["score", "view_count", "answer_count", "comment_count", "tags"])
    return rows.withColumns({c: F.when(F.col(c) > 0, F.col(c)).cast("string") for c in ("owner_user_id", "last_editor_user_id")})


@BOOK.add("etl_first_wins", f"WITH r AS ({_FIRST} FROM votes WHERE id > 0) SELECT vote_type_id::INT AS vote_type_id, count(*) AS n, count(user_id) AS with_user, coalesce(sum(bounty_amount), 0)::BIGINT AS bounty FROM r WHERE f = 1 GROUP BY vote_type_id")
def etl_first_wins(spark: SparkSession, base: str) -> DataFrame:
    """Insert or do nothing (K3), summed up per type."""
    rows = insert_new(table(spark, base, "votes"), "id", ["vote_type_id", "user_id", "bounty_amount"])
    return rows.groupBy(F.col("vote_type_id").cast("int").alias("vote_type_id")).agg(F.count("*").alias("n"), F.count("user_id").alias("with_user"), F.coalesce(F.sum("bounty_amount"), F.lit(0)).cast("long").alias("bounty"))


@BOOK.add("etl_tags_merge", "SELECT lower(tag_name) AS tag_name, max(count) AS count, coalesce(min(excerpt_post_id), 0) AS excerpt_post_id, coalesce(min(wiki_post_id), 0) AS wiki_post_id FROM tags GROUP BY 1")
def etl_tags_merge(spark: SparkSession, base: str) -> DataFrame:
    """Tags by name: greatest count, first known references (K4)."""
    return merge_named(table(spark, base, "tags"), "tag_name", ["count"], ["excerpt_post_id", "wiki_post_id"]).fillna(0, ["excerpt_post_id", "wiki_post_id"])


@BOOK.add("etl_tag_parse", with_latest("posts") + "SELECT id, list_aggregate(list_filter(regexp_split_to_array(coalesce(tags, ''), '[<>|]+'), lambda x: trim(x) <> ''), 'string_agg', ',') AS tags FROM posts_l WHERE tags LIKE '<%' OR tags LIKE '|%'")
def etl_tag_parse(spark: SparkSession, base: str) -> DataFrame:
    """Both plain archive formats with one parser (N9); fields of any other form are for p2."""
    rows = latest(spark, base, "posts", "tags").where("tags like '<%' or tags like '|%'")
    values = simple_tags(F.col("tags"))
    return rows.select("id", F.when(F.size(values) > 0, F.array_join(values, ",")).alias("tags"))


@BOOK.add(
    "etl_safe_casts",
    """SELECT event_id, coalesce(try_cast(json_extract_string(props, '$.k') AS INT), 0) AS k, nullif(coalesce(try_cast(json_extract_string(props, '$.k') AS INT), 0), 0) IS NULL AS no_k,
lower(event_type) IN ('1', 'true', 'yes') AS flag, strftime(ts, '%Y-%m-%d %H:%M') AS minute FROM events""",
)
def etl_safe_casts(spark: SparkSession, base: str) -> DataFrame:
    """Values that may be no numbers, flags or dates (F1, F2)."""
    k = safe_int(F.get_json_object("props", "$.k"))
    stamp = parse_date(F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z")))
    return table(spark, base, "events").select("event_id", k.alias("k"), none_if_zero(k).isNull().alias("no_k"), safe_bool(F.col("event_type")).alias("flag"), F.date_format(stamp, "yyyy-MM-dd HH:mm").alias("minute"))


@BOOK.add("etl_edge_endpoints", _PLAIN + """SELECT link_type_id::INT AS link_type_id, count(*) AS n, count(*) FILTER (post_id IN (SELECT id FROM q) AND related_post_id IN (SELECT id FROM q)) AS attached
FROM (SELECT DISTINCT link_type_id, post_id, related_post_id FROM postlinks_l) GROUP BY link_type_id""")
def etl_edge_endpoints(spark: SparkSession, base: str) -> DataFrame:
    """Edges that the graph drops because an end is missing (K7, K8)."""
    g = Graph(spark, base)
    links = latest(spark, base, "postlinks", "post_id", "related_post_id", "link_type_id").select("link_type_id", "post_id", "related_post_id").distinct()
    q = g.nodes(1).withColumn("there", F.lit(1))
    both = links.join(q.toDF("post_id", "a"), "post_id", "left").join(q.toDF("related_post_id", "b"), "related_post_id", "left")
    return both.groupBy(F.col("link_type_id").cast("int").alias("link_type_id")).agg(F.count("*").alias("n"), F.count(F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), 1)).alias("attached"))


@BOOK.add("etl_graph_nodes", with_latest("posts") + """SELECT * FROM (SELECT 'User' AS label, count(DISTINCT id) AS n FROM users WHERE id > 0 UNION ALL SELECT 'Question', count(*) FROM posts_l WHERE post_type_id = 1 UNION ALL SELECT 'Answer', count(*) FROM posts_l WHERE post_type_id = 2 UNION ALL SELECT 'Tag', count(DISTINCT lower(tag_name)) FROM tags)""")
def etl_graph_nodes(spark: SparkSession, base: str) -> DataFrame:
    """Nodes per label after merging."""
    posts = Graph(spark, base).posts().where("post_type_id in (1, 2)").select(F.when(F.col("post_type_id") == 1, "Question").otherwise("Answer").alias("label"))
    rows = posts.groupBy("label").agg(F.count("*").alias("n"))
    rows = rows.unionByName(table(spark, base, "users").where("id > 0").agg(F.countDistinct("id").alias("n")).select(F.lit("User").alias("label"), "n"))
    return rows.unionByName(table(spark, base, "tags").agg(F.countDistinct(F.lower("tag_name")).alias("n")).select(F.lit("Tag").alias("label"), "n"))


@BOOK.add("etl_key_violations", "WITH u AS (SELECT DISTINCT id FROM users) SELECT 'badges' AS table_name, count(*) AS n FROM (SELECT DISTINCT id, user_id FROM badges) WHERE user_id NOT IN (SELECT id FROM u) UNION ALL SELECT 'votes', count(*) FROM (SELECT DISTINCT id, user_id FROM votes) WHERE user_id NOT IN (SELECT id FROM u)")
def etl_key_violations(spark: SparkSession, base: str) -> DataFrame:
    """Foreign keys that the load does not enforce, counted afterwards (K5)."""
    users = table(spark, base, "users").select(F.col("id").alias("user_id")).where("user_id is not null").distinct()
    refs = None
    for t in ("badges", "votes"):
        one = table(spark, base, t).select(F.lit(t).alias("table_name"), "id", "user_id").where("user_id is not null").distinct()
        refs = one if refs is None else refs.unionByName(one)
    counted = refs.join(users, "user_id", "left_anti").groupBy("table_name").agg(F.count("*").alias("n"))
    names = spark.createDataFrame([("badges",), ("votes",)], "table_name string")
    return names.join(counted, "table_name", "left").select("table_name", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


@BOOK.add("etl_resume", with_latest("posts") + "SELECT count(*) AS pending FROM posts_l WHERE post_type_id = 1 AND id NOT IN (SELECT post_id FROM documents WHERE doc_type = 'question' AND post_id IS NOT NULL)")
def etl_resume(spark: SparkSession, base: str) -> DataFrame:
    """What a resumed run still has to do (K6, K12, J14): questions not in the index yet."""
    todo = latest(spark, base, "posts", "post_type_id").where("post_type_id = 1").select("id")
    done = table(spark, base, "documents").where("doc_type = 'question' and post_id is not null").select(F.col("post_id").alias("id"))
    return pending(todo, done, ["id"]).agg(F.count("*").alias("pending"))


@BOOK.add(
    "etl_document_corpus",
    with_latest("users", "posts") + """SELECT 'user_about_' || id AS _id, 'user_about' AS doc_type, '' AS title, about_me AS body, '' AS tag_name FROM users_l WHERE trim(about_me) <> ''
UNION ALL SELECT 'tag_wiki_' || p.id, 'tag_wiki', '', coalesce(p.title, ''), t.tag_name FROM posts_l p JOIN tags t ON t.excerpt_post_id = p.id
UNION ALL SELECT 'post_' || id, CASE WHEN post_type_id = 1 THEN 'question' ELSE 'answer' END, coalesce(title, ''), title, '' FROM posts_l WHERE trim(title) <> ''""",
)
def etl_document_corpus(spark: SparkSession, base: str) -> DataFrame:
    """The document collection from its sources, empty bodies left out (K10, J11). Tags are a small dimension and are broadcast by their size."""
    users = latest(spark, base, "users", "about_me").where("trim(about_me) <> ''").select(F.concat(F.lit("user_about_"), "id").alias("_id"), F.lit("user_about").alias("doc_type"), F.lit("").alias("title"), F.col("about_me").alias("body"), F.lit("").alias("tag_name"))
    posts = latest(spark, base, "posts", "post_type_id", "title")
    tags = table(spark, base, "tags").select("excerpt_post_id", "tag_name").where("excerpt_post_id is not null")
    wikis = posts.join(tags, F.col("id") == F.col("excerpt_post_id")).select(F.concat(F.lit("tag_wiki_"), "id").alias("_id"), F.lit("tag_wiki").alias("doc_type"), F.lit("").alias("title"), F.coalesce("title", F.lit("")).alias("body"), "tag_name")
    own = posts.where("trim(title) <> ''").select(F.concat(F.lit("post_"), "id").alias("_id"), F.when(F.col("post_type_id") == 1, "question").otherwise("answer").alias("doc_type"), "title", F.col("title").alias("body"), F.lit("").alias("tag_name"))
    return users.unionByName(wikis).unionByName(own)


@BOOK.add("etl_communities", "SELECT replace(lower(trim(source, E' \\t\\n\\u00a0')), '_', '-') AS community, count(*) AS n, count(DISTINCT post_id) AS threads FROM documents WHERE source IS NOT NULL GROUP BY 1")
def etl_communities(spark: SparkSession, base: str) -> DataFrame:
    """Rows of several communities under one spelling of each name."""
    name = F.translate(F.lower(F.regexp_replace("source", r"^[ \t\n\u00a0]+|[ \t\n\u00a0]+$", "")), "_", "-")
    return table(spark, base, "documents").where("source is not null").groupBy(name.alias("community")).agg(F.count("*").alias("n"), F.countDistinct("post_id").alias("threads"))


QUERIES, SQL = BOOK.queries, BOOK.sql
