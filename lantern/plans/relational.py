"""The relational query corpus: projections, filters, joins, aggregates and top-k over the archive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from .archive import TAGS_SQL
from .book import Book, down, latest, top, with_latest

BOOK = Book()
#: The tags that stand in for those the reference's questions name.
MAIN, SECOND, THIRD = "sylphnet-fold-split", "marrowdb-bin-width", "calderyx-view-merge"


def questions(spark: SparkSession, base: str, *columns: str, where: str | None = None) -> DataFrame:
    return latest(spark, base, "posts", "post_type_id", *columns, where=where).where("post_type_id = 1")


@BOOK.add("rel_top_users", with_latest("users") + "SELECT id, display_name, reputation, location FROM users_l ORDER BY reputation DESC NULLS FIRST, id LIMIT 10")
def rel_top_users(spark: SparkSession, base: str) -> DataFrame:
    """Projection and top-k."""
    return top(latest(spark, base, "users", "display_name", "reputation", "location"), 10, down("reputation"), F.col("id"))


@BOOK.add("rel_users_filter_date", with_latest("users") + "SELECT id, display_name, reputation, creation_date::DATE::VARCHAR AS member_since FROM users_l WHERE reputation > 200 AND creation_date < '2021-01-01'")
def rel_users_filter_date(spark: SparkSession, base: str) -> DataFrame:
    """Conjunction, timestamp comparison, cast to date."""
    users = latest(spark, base, "users", "display_name", "reputation", "creation_date", where="creation_date < timestamp_ntz'2021-01-01'")
    return users.where("reputation > 200").select("id", "display_name", "reputation", F.to_date("creation_date").cast("string").alias("member_since"))


@BOOK.add("rel_top_questions", with_latest("posts") + "SELECT id, title, score, view_count, answer_count, tags FROM posts_l WHERE post_type_id = 1 ORDER BY score DESC NULLS FIRST, id LIMIT 20")
def rel_top_questions(spark: SparkSession, base: str) -> DataFrame:
    """Filter and top-k."""
    return top(questions(spark, base, "title", "score", "view_count", "answer_count", "tags").drop("post_type_id"), 20, down("score"), F.col("id"))


@BOOK.add("rel_top_tags", "SELECT tag_name, count FROM tags ORDER BY count DESC NULLS FIRST, tag_name LIMIT 20")
def rel_top_tags(spark: SparkSession, base: str) -> DataFrame:
    """Top-k over a dimension (O2)."""
    return top(table(spark, base, "tags").select("tag_name", "count"), 20, down("count"), F.col("tag_name"))


@BOOK.add("rel_tag_ilike", with_latest("posts") + f"SELECT id, title, score, view_count, creation_date::DATE::VARCHAR AS posted_on FROM posts_l WHERE post_type_id = 1 AND tags ILIKE '%<{MAIN}>%' ORDER BY score DESC NULLS FIRST, id LIMIT 20")
def rel_tag_ilike(spark: SparkSession, base: str) -> DataFrame:
    """Case-insensitive pattern."""
    rows = questions(spark, base, "title", "score", "view_count", "creation_date", "tags").where(F.col("tags").ilike(f"%<{MAIN}>%"))
    return top(rows, 20, down("score"), F.col("id")).select("id", "title", "score", "view_count", F.to_date("creation_date").cast("string").alias("posted_on"))


@BOOK.add("rel_upvoters", with_latest("users") + "SELECT id, display_name, up_votes, down_votes, reputation FROM users_l WHERE up_votes > 50")
def rel_upvoters(spark: SparkSession, base: str) -> DataFrame:
    """Comparison."""
    return latest(spark, base, "users", "display_name", "up_votes", "down_votes", "reputation").where("up_votes > 50")


@BOOK.add("rel_accepted_scored", with_latest("posts") + "SELECT id, title, score, accepted_answer_id, answer_count FROM posts_l WHERE post_type_id = 1 AND accepted_answer_id IS NOT NULL AND score > 10")
def rel_accepted_scored(spark: SparkSession, base: str) -> DataFrame:
    """IS NOT NULL."""
    return questions(spark, base, "title", "score", "accepted_answer_id", "answer_count").where("accepted_answer_id is not null and score > 10").drop("post_type_id")


@BOOK.add("rel_badge_count", with_latest("users", "badges") + "SELECT u.id, u.display_name, count(b.id) AS n_badges FROM users_l u JOIN badges_l b ON b.user_id = u.id GROUP BY u.id, u.display_name ORDER BY n_badges DESC, u.id LIMIT 20")
def rel_badge_count(spark: SparkSession, base: str) -> DataFrame:
    """Join, count, top-k (J1, A1): badges are counted per user before they meet the users, so a user with many badges is one row."""
    counts = latest(spark, base, "badges", "user_id", where="user_id is not null").groupBy("user_id").agg(F.count("*").alias("n_badges"))
    rows = latest(spark, base, "users", "display_name").join(counts, F.col("id") == F.col("user_id"))
    return top(rows.select("id", "display_name", "n_badges"), 20, F.col("n_badges").desc(), F.col("id"))


@BOOK.add("rel_gold_holders", with_latest("users", "badges") + "SELECT DISTINCT u.id, u.display_name, u.reputation FROM users_l u JOIN badges_l b ON b.user_id = u.id WHERE b.class = 1")
def rel_gold_holders(spark: SparkSession, base: str) -> DataFrame:
    """Join with DISTINCT (A5), which is a semi join: no badge row multiplies a user."""
    gold = latest(spark, base, "badges", "user_id", "class").where("class = 1").select("user_id")
    return latest(spark, base, "users", "display_name", "reputation").join(gold, F.col("id") == F.col("user_id"), "left_semi")


@BOOK.add("rel_many_answers", with_latest("posts") + "SELECT id, title, score, answer_count, view_count FROM posts_l WHERE post_type_id = 1 AND answer_count > 4")
def rel_many_answers(spark: SparkSession, base: str) -> DataFrame:
    """Filter (P2)."""
    return questions(spark, base, "title", "score", "answer_count", "view_count").where("answer_count > 4").drop("post_type_id")


@BOOK.add("rel_monthly_volume", with_latest("posts") + "SELECT date_trunc('month', creation_date)::DATE::VARCHAR AS month, count(*) AS n_questions FROM posts_l WHERE post_type_id = 1 AND creation_date >= '2022-01-01' AND creation_date < '2023-01-01' GROUP BY 1")
def rel_monthly_volume(spark: SparkSession, base: str) -> DataFrame:
    """Half-open time range, group by an expression."""
    rows = questions(spark, base, "creation_date", where="creation_date >= timestamp_ntz'2022-01-01' and creation_date < timestamp_ntz'2023-01-01'")
    return rows.groupBy(F.to_date(F.date_trunc("month", "creation_date")).cast("string").alias("month")).agg(F.count("*").alias("n_questions"))


@BOOK.add("rel_two_metrics", with_latest("users") + "SELECT id, display_name, up_votes, down_votes, reputation FROM users_l WHERE up_votes > 20 AND down_votes > 2")
def rel_two_metrics(spark: SparkSession, base: str) -> DataFrame:
    """Conjunction."""
    return latest(spark, base, "users", "display_name", "up_votes", "down_votes", "reputation").where("up_votes > 20 and down_votes > 2")


@BOOK.add("rel_most_comments", with_latest("posts") + "SELECT id, title, post_type_id, comment_count FROM posts_l ORDER BY comment_count DESC NULLS FIRST, id LIMIT 20")
def rel_most_comments(spark: SparkSession, base: str) -> DataFrame:
    """Top-k with nulls first."""
    return top(latest(spark, base, "posts", "title", "post_type_id", "comment_count"), 20, down("comment_count"), F.col("id"))


@BOOK.add("rel_views_gt", with_latest("posts") + "SELECT id, title, view_count, score, tags FROM posts_l WHERE post_type_id = 1 AND view_count > 1000")
def rel_views_gt(spark: SparkSession, base: str) -> DataFrame:
    """Filter (P2)."""
    return questions(spark, base, "title", "view_count", "score", "tags").where("view_count > 1000").drop("post_type_id")


@BOOK.add("rel_location_ilike", with_latest("users") + "SELECT id, display_name, reputation, location FROM users_l WHERE location ILIKE '%trikifelia%'")
def rel_location_ilike(spark: SparkSession, base: str) -> DataFrame:
    """Case-insensitive pattern."""
    return latest(spark, base, "users", "display_name", "reputation", "location").where(F.col("location").ilike("%trikifelia%"))


@BOOK.add("rel_tag_badge_holders", with_latest("badges") + "SELECT name AS badge_name, count(DISTINCT user_id) AS n_holders FROM badges_l WHERE tag_based = TRUE GROUP BY name ORDER BY n_holders DESC, name LIMIT 20")
def rel_tag_badge_holders(spark: SparkSession, base: str) -> DataFrame:
    """Boolean predicate, count distinct."""
    rows = latest(spark, base, "badges", "name", "user_id", "tag_based").where("tag_based")
    return top(rows.groupBy(F.col("name").alias("badge_name")).agg(F.countDistinct("user_id").alias("n_holders")), 20, F.col("n_holders").desc(), F.col("badge_name"))


@BOOK.add("rel_answer_scores", with_latest("posts") + "SELECT id AS answer_id, score, creation_date::DATE::VARCHAR AS posted_on FROM posts_l WHERE post_type_id = 2 AND parent_id = 1")
def rel_answer_scores(spark: SparkSession, base: str) -> DataFrame:
    """Key lookup."""
    rows = latest(spark, base, "posts", "post_type_id", "score", "creation_date", where="parent_id = 1").where("post_type_id = 2")
    return rows.select(F.col("id").alias("answer_id"), "score", F.to_date("creation_date").cast("string").alias("posted_on"))


@BOOK.add("rel_zero_reputation", with_latest("users") + "SELECT id, display_name, creation_date::DATE::VARCHAR AS member_since FROM users_l WHERE reputation = 1 ORDER BY creation_date DESC NULLS FIRST, id LIMIT 50")
def rel_zero_reputation(spark: SparkSession, base: str) -> DataFrame:
    """Sort by an unselected expression (O1, O2)."""
    rows = latest(spark, base, "users", "display_name", "reputation", "creation_date").where("reputation = 1")
    return top(rows, 50, down("creation_date"), F.col("id")).select("id", "display_name", F.to_date("creation_date").cast("string").alias("member_since"))


@BOOK.add("rel_closed_duplicates", with_latest("posts", "postlinks") + "SELECT DISTINCT p.id, p.title, p.score FROM posts_l p JOIN postlinks_l l ON l.post_id = p.id AND l.link_type_id = 3 WHERE p.closed_date IS NOT NULL")
def rel_closed_duplicates(spark: SparkSession, base: str) -> DataFrame:
    """Join with a constant in ON and DISTINCT (J2, A5), as a semi join."""
    links = latest(spark, base, "postlinks", "post_id", "link_type_id", where="post_id is not null").where("link_type_id = 3").select("post_id")
    posts = latest(spark, base, "posts", "title", "score", "closed_date").where("closed_date is not null").drop("closed_date")
    return posts.join(links, F.col("id") == F.col("post_id"), "left_semi")


@BOOK.add(
    "rel_avg_score_per_tag",
    TAGS_SQL + """, scored AS (SELECT id, score FROM posts QUALIFY row_number() OVER (PARTITION BY id ORDER BY loaded_at DESC) = 1)
SELECT t.tag_name, avg(s.score)::DECIMAL(10,2)::DOUBLE AS avg_score, count(*) AS n_questions
FROM (SELECT DISTINCT tag_name FROM tags) t JOIN tagged g ON g.tag = lower(t.tag_name) JOIN scored s ON s.id = g.post_id
GROUP BY t.tag_name HAVING count(*) >= 5 ORDER BY avg_score DESC, t.tag_name LIMIT 15""",
)
def rel_avg_score_per_tag(spark: SparkSession, base: str) -> DataFrame:
    """Join by a data-dependent pattern (P7, J3), written as explode and equi-join; decimal average and HAVING (A3, A4)."""
    from .graphs import Graph  # which takes its constants from here

    # The parsed tags that the graph queries share as well.
    edges = Graph(spark, base).tagged().select(F.col("src").alias("id"), F.col("dst").alias("tag"))
    tagged = edges.join(questions(spark, base, "score").select("id", "score"), "id")
    per_tag = tagged.groupBy("tag").agg(F.avg("score").cast("decimal(10,2)").cast("double").alias("avg_score"), F.count("*").alias("n_questions")).where("n_questions >= 5")
    names = table(spark, base, "tags").select("tag_name").distinct()
    rows = names.join(per_tag, F.lower("tag_name") == F.col("tag")).select("tag_name", "avg_score", "n_questions")
    return top(rows, 15, F.col("avg_score").desc(), F.col("tag_name"))


@BOOK.add("rel_asker_reputation", with_latest("posts", "users") + f"SELECT DISTINCT p.owner_user_id AS user_id, u.reputation, u.display_name FROM posts_l p JOIN users_l u ON u.id = p.owner_user_id WHERE p.post_type_id = 1 AND p.tags ILIKE '%<{MAIN}>%' ORDER BY u.reputation DESC NULLS FIRST, user_id LIMIT 20")
def rel_asker_reputation(spark: SparkSession, base: str) -> DataFrame:
    """Join, DISTINCT, pattern, top-k."""
    askers = questions(spark, base, "owner_user_id", "tags").where(F.col("tags").ilike(f"%<{MAIN}>%")).select("owner_user_id")
    users = latest(spark, base, "users", "reputation", "display_name").join(askers, F.col("id") == F.col("owner_user_id"), "left_semi")
    return top(users.withColumnRenamed("id", "user_id"), 20, down("reputation"), F.col("user_id"))


@BOOK.add("rel_scored_in_tag", with_latest("posts") + f"SELECT id, score, view_count, answer_count FROM posts_l WHERE post_type_id = 1 AND tags ILIKE '%<{SECOND}>%' ORDER BY score DESC NULLS FIRST, id LIMIT 20")
def rel_scored_in_tag(spark: SparkSession, base: str) -> DataFrame:
    """Filter, pattern, top-k."""
    rows = questions(spark, base, "score", "view_count", "answer_count", "tags").where(F.col("tags").ilike(f"%<{SECOND}>%"))
    return top(rows.drop("post_type_id", "tags"), 20, down("score"), F.col("id"))


@BOOK.add("rel_active_high_rep", with_latest("users", "posts") + "SELECT id AS user_id, display_name, reputation FROM users_l u WHERE reputation > 300 AND EXISTS (SELECT 1 FROM posts_l p WHERE p.owner_user_id = u.id AND p.creation_date >= '2023-01-01') ORDER BY reputation DESC, id LIMIT 20")
def rel_active_high_rep(spark: SparkSession, base: str) -> DataFrame:
    """Correlated EXISTS as a semi join."""
    active = table(spark, base, "posts").where("creation_date >= timestamp_ntz'2023-01-01' and owner_user_id > 0").select("owner_user_id")
    users = latest(spark, base, "users", "display_name", "reputation").where("reputation > 300")
    return top(users.join(active, F.col("id") == F.col("owner_user_id"), "left_semi").withColumnRenamed("id", "user_id"), 20, down("reputation"), F.col("user_id"))


@BOOK.add("rel_score_distribution", with_latest("posts") + "SELECT coalesce(post_type_id, 0)::INT AS post_type_id, count(*) AS n, round(quantile_cont(score, 0.5), 4) AS p50, round(quantile_cont(score, 0.95), 4) AS p95, round(avg(CASE WHEN score > 0 THEN 1.0 ELSE 0.0 END), 4) AS positive FROM posts_l WHERE score IS NOT NULL GROUP BY ROLLUP (post_type_id)")
def rel_score_distribution(spark: SparkSession, base: str) -> DataFrame:
    """Percentiles and a conditional ratio with a total row."""
    posts = latest(spark, base, "posts", "post_type_id", "score").where("score is not null")
    # One pass keeps every score's count, so the exact percentiles are computed from a small histogram.
    hist = posts.groupBy("post_type_id", "score").agg(F.count("*").alias("n"))
    return hist.rollup("post_type_id").agg(
        F.sum("n").alias("n"),
        F.round(F.expr("percentile(score, 0.5, n)"), 4).alias("p50"),
        F.round(F.expr("percentile(score, 0.95, n)"), 4).alias("p95"),
        F.round(F.sum(F.when(F.col("score") > 0, F.col("n")).otherwise(0)) / F.sum("n"), 4).alias("positive"),
    ).withColumn("post_type_id", F.coalesce(F.col("post_type_id").cast("int"), F.lit(0)))


QUERIES, SQL = BOOK.queries, BOOK.sql
