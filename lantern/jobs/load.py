"""Loads archive dumps: python -m lantern.jobs.load --out DIR NAME=FOLDER... [--only TABLE...] [--dry-run].

Every community gets a folder of its own under DIR, with the relational tables, the edges of its
graph and its documents as parquet, so ids of different communities never meet. A part that is
complete is skipped when the job runs again; a community that fails does not stop the others.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import simple_tags
from ..operators.bm25 import build_index
from ..operators.upsert import insert_new, merge_named, upsert
from ..plans.graphs import Graph, co_occurrence
from ..session import exists
from ..sources.dumps import FILES, read_all

# Columns of users and posts that a later delivery changes.
CHANGING = {
    "users": ["reputation", "display_name", "location", "up_votes", "down_votes", "views"],
    "posts": ["score", "view_count", "answer_count", "comment_count", "tags"],
}


def merged(name: str, df: DataFrame) -> DataFrame:
    """Rows of a dump as the store keeps them: one per key, see operators.upsert."""
    columns = [c for c in df.columns if c not in ("id", "loaded_at")]
    if name in CHANGING:
        return upsert(df, "id", [c for c in columns if c not in CHANGING[name]], CHANGING[name])
    if name == "tags":
        return merge_named(df, "tag_name", ["count"], ["id", "excerpt_post_id", "wiki_post_id"])
    return insert_new(df, "id", columns)


def documents(tables: dict[str, DataFrame]) -> DataFrame:
    """(_id, doc_type, title, text, post_id, user_id, tag_name): the text collection, empty bodies left out.

    Posts that are no questions are answers, as the collection has always had it; tag wikis also
    stand under their own id.
    """
    none = F.lit(None)
    posts = tables["posts"]
    own = posts.select(F.concat(F.lit("post_"), "id").alias("_id"), F.when(F.col("post_type_id") == 1, "question").otherwise("answer").alias("doc_type"), "title", F.col("body").alias("text"), F.col("id").alias("post_id"), F.col("owner_user_id").alias("user_id"), none.cast("string").alias("tag_name"))
    parts = [own]
    if "comments" in tables:
        parts.append(tables["comments"].select(F.concat(F.lit("comment_"), "id").alias("_id"), F.lit("comment").alias("doc_type"), none.cast("string").alias("title"), "text", "post_id", "user_id", none.cast("string").alias("tag_name")))
    parts.append(tables["users"].select(F.concat(F.lit("user_about_"), "id").alias("_id"), F.lit("user_about").alias("doc_type"), none.cast("string").alias("title"), F.col("about_me").alias("text"), none.cast("int").alias("post_id"), F.col("id").alias("user_id"), none.cast("string").alias("tag_name")))
    if "tags" in tables:
        tags = tables["tags"].where("excerpt_post_id is not null").select("excerpt_post_id", "tag_name")
        wikis = posts.join(tags, F.col("id") == F.col("excerpt_post_id"))
        parts.append(wikis.select(F.concat(F.lit("tag_wiki_"), "id").alias("_id"), F.lit("tag_wiki").alias("doc_type"), none.cast("string").alias("title"), F.col("body").alias("text"), F.col("id").alias("post_id"), none.cast("int").alias("user_id"), "tag_name"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.where("trim(text) <> ''")


def complete(spark: SparkSession, path: str) -> bool:
    """Whether a part was written to its end."""
    return exists(spark, f"{path}/_SUCCESS")


def load(spark: SparkSession, folder: str, out: str, only: tuple[str, ...] = (), dry_run: bool = False) -> dict[str, int]:
    """Rows per part that were written now (or would be); parts that are complete are not listed."""
    stamp = F.current_timestamp().cast("timestamp_ntz")
    raw = read_all(spark, folder, required=() if only else ("users", "posts"), only=only)
    done: dict[str, int] = {}

    def write(name: str, df: DataFrame) -> None:
        path = f"{out}/{name}.parquet"
        if dry_run:
            done[name] = df.count()
        elif not complete(spark, path):
            df.write.mode("overwrite").parquet(path)
            done[name] = spark.read.parquet(path).count()

    tables = {k: merged(k, df.withColumn("loaded_at", stamp)).withColumn("loaded_at", stamp) for k, df in raw.items()}
    for name, df in tables.items():
        write(name, df)
    if only or dry_run:
        return done
    write("documents", documents(tables))
    index = f"{out}/index.parquet"
    if not complete(spark, f"{index}/stats"):
        build_index(spark.read.parquet(f"{out}/documents.parquet"), "_id", ["title", "text"], ["tag_name"], index)
    g = Graph(spark, out)
    for name, edges in {"asked": g.asked, "answered": g.answered, "answers": g.answers, "accepted": g.accepted}.items():
        write(f"edges_{name}", edges())
    if "tags" in tables:
        known = tables["tags"].select(F.lower("tag_name").alias("dst"))
        tagged = tables["posts"].where("post_type_id = 1").select(F.col("id").alias("src"), F.explode(simple_tags(F.lower("tags"))).alias("dst")).distinct().join(known, "dst", "left_semi")
        write("edges_tagged_with", tagged.select("src", "dst"))
        write("edges_co_occurs_with", co_occurrence(spark.read.parquet(f"{out}/edges_tagged_with.parquet")))
    if "postlinks" in tables:
        write("edges_linked_to", g.links(1))
        write("edges_duplicate_of", g.links(3))
    return done


def main(args: list[str]) -> int:
    p = argparse.ArgumentParser(prog="lantern.jobs.load")
    p.add_argument("communities", nargs="+", metavar="NAME=FOLDER")
    p.add_argument("--out", required=True)
    p.add_argument("--only", nargs="*", default=[], choices=list(FILES))
    p.add_argument("--dry-run", action="store_true")
    a = p.parse_args(args)
    spark, failed = SparkSession.builder.appName("load").getOrCreate(), 0
    for item in a.communities:
        name, _, folder = item.partition("=")
        try:
            for part, n in load(spark, folder, f"{a.out}/{name}", tuple(a.only), a.dry_run).items():
                print(f"{name}: {part}: {n} rows", flush=True)
        except Exception as x:  # noqa: BLE001 - the other communities go on
            failed += 1
            print(f"{name}: {type(x).__name__}: {str(x)[:300]}", file=sys.stderr, flush=True)
    return int(failed > 0)


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
