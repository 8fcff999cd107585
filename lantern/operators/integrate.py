"""Integration of what several services found for many questions: one schema, one entity, one context.

Every table here is keyed by query_id, so all questions are integrated in one job. A service returns
at most ROWS rows for a question, which bounds every group that is worked on as a whole.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import STOP_WORDS, excerpt, mentions

ROWS = 50
# Which columns hold ids, tags and long text, and the limits of a context.
ID_COLUMNS = ["id", "user_id", "post_id", "owner_user_id", "parent_id", "accepted_answer_id", "last_editor_user_id", "related_post_id"]
KEY_COLUMNS = ["id", "_id", "user_id", "post_id"]
TAG_COLUMNS = ["tag_name", "name", "tags"]
TEXT_COLUMNS = ["title", "body", "display_name", "location", "about_me"]
MERGE_TYPES = ["user_id", "post_id", "tag", "freetext_mention"]
BOOST, TOP, CONTEXT_CHARS, CONFLICT = 1.2, 20, 8000, 0.01
_CELLS = ("query_id", "ord")


def _entity(kind: str, value: Column, conf: float) -> Column:
    return F.struct(F.lit(kind).alias("type"), value.cast("string").alias("value"), F.lit(conf).alias("conf"))


def _present(entities: list[Column]) -> Column:
    none = "array<struct<type:string,value:string,conf:double>>"
    return F.filter(F.array(*entities), lambda e: e["value"].isNotNull()) if entities else F.array().cast(none)


def _item_id(service: str, columns: list[str], content: Column) -> Column:
    """Service, column and value of the first key column that is known; else the row's place and a digest of it."""
    keys = [F.concat(F.lit(f"{service}:{c}:"), F.col(c).cast("string")) for c in KEY_COLUMNS if c in columns]
    return F.coalesce(*keys, F.concat(F.lit(f"{service}:row"), F.col("ord").cast("string"), F.lit(":"), F.substring(F.md5(content), 1, 8)))


def _numbers(df: DataFrame, columns: list[str]) -> Column:
    """The numeric columns by name, as the conflict check compares them; booleans count as numbers."""
    kinds = (T.NumericType, T.BooleanType)
    cells = [F.struct(F.lit(c).alias("k"), F.col(c).cast("double").alias("v")) for c in columns if isinstance(df.schema[c].dataType, kinds)]
    empty = F.create_map().cast("map<string,double>")
    return F.map_from_entries(F.filter(F.array(*cells), lambda x: x["v"].isNotNull())) if cells else empty


def _row_content(columns: list[str]) -> Column:
    cells = []
    for c in columns:
        text = F.col(c).cast("string")
        cells.append(F.concat(F.lit(f"{c}: "), excerpt(text, 200) if c in TEXT_COLUMNS else text))
    return F.concat_ws(" | ", *cells)


def _items(df: DataFrame, service: str, kind: str, weight: float, columns: list[str], content: Column, score: Column, entities: Column) -> DataFrame:
    rows = df.where(F.col("ord") <= ROWS)
    return rows.select("query_id", F.lit(service).alias("service_id"), F.lit(kind).alias("source_type"), F.lit(weight).alias("weight"), F.col("ord").cast("int").alias("ord"), _item_id(service, columns, content).alias("item_id"), content.alias("content"), score.alias("score"), entities.alias("entities"), _numbers(df, columns).alias("numbers"))


def normalise_rows(df: DataFrame, service: str, weight: float) -> DataFrame:
    """Items of a relational service; df has query_id, ord and the columns of its rows."""
    columns = [c for c in df.columns if c not in _CELLS]
    entities = [F.array(_entity(c, F.col(c), 1.0)) for c in ID_COLUMNS if c in columns]
    for c in TAG_COLUMNS:
        if c in columns:
            angled = F.regexp_extract_all(F.col(c), F.lit("<([^>]+)>"), F.lit(1))
            plain = F.filter(F.transform(F.split(F.col(c), ","), lambda x: F.trim(x)), lambda x: x != "")
            tags = F.coalesce(F.when(F.size(angled) > 0, angled).otherwise(plain), F.array().cast("array<string>"))
            entities.append(F.transform(tags, lambda x: _entity("tag", x, 1.0)))
    found = F.filter(F.concat(*entities), lambda e: e["value"].isNotNull()) if entities else _present([])
    return _items(df, service, "sql", weight, columns, _row_content(columns), F.lit(1.0), found)


def normalise_records(df: DataFrame, service: str, weight: float) -> DataFrame:
    """Items of a graph service (N4); a struct column is a node, whose fields are entities and content as well."""
    columns = [c for c in df.columns if c not in _CELLS]
    cells, entities = [], []
    for c in columns:
        kind = df.schema[c].dataType
        fields = [(f"{c}.{f.name}", f.name) for f in kind.fields] if isinstance(kind, T.StructType) else [(c, c)]
        for path, name in fields:
            if name in ("id", "user_id", "post_id"):
                entities.append(_entity(name, F.col(path), 1.0))
            elif name == "name":
                entities.append(_entity("tag", F.col(path), 1.0))
            cells.append(F.concat(F.lit(f"{path}: "), F.col(path).cast("string")))
        if isinstance(kind, T.StructType):
            inner = F.concat_ws(", ", *[F.concat(F.lit(f"{f.name}="), F.col(f"{c}.{f.name}").cast("string")) for f in kind.fields if f.name not in ("_labels", "_type")])
            cells.append(F.concat(F.lit(f"{c}: {{"), inner, F.lit("}")))
    return _items(df, service, "graph", weight, columns, F.concat_ws(" | ", *cells), F.lit(1.0), _present(entities))


def normalise_hits(df: DataFrame, service: str, weight: float, with_mentions: bool = True) -> DataFrame:
    """Items of a text service; df has query_id, ord, _id, _score, title, body and maybe post_id and user_id."""
    content = F.when(F.length("title") > 0, F.concat("title", F.lit("  "), excerpt(F.coalesce("body", F.lit("")), 500))).otherwise(excerpt(F.coalesce("body", F.lit("")), 500))
    best = F.max("_score").over(Window.partitionBy("query_id"))
    rows = df.where(F.col("ord") <= ROWS).withColumn("_best", best)
    score = F.when(F.col("_best") <= 0, 1.0).otherwise(F.least(F.col("_score") / F.col("_best"), F.lit(1.0)))
    columns = [c for c in df.columns if c not in _CELLS]
    post = F.coalesce(F.col("post_id").cast("string"), F.col("_id")) if "post_id" in columns else F.col("_id")
    sure = ([_entity("user_id", F.col("user_id"), 1.0)] if "user_id" in columns else []) + [_entity("post_id", post, 1.0)]
    found = _present(sure)
    if with_mentions:
        found = F.concat(found, F.transform(mentions(content), lambda x: _entity("freetext_mention", x, 0.5)))
    return _items(rows, service, "document", weight, columns, content, score, found)


def entity_key(kind: Column, value: Column) -> Column:
    """Comparable form of an entity's value: ids as numbers where they are, tags and mentions folded."""
    number = F.trim(value).try_cast("long").cast("string")
    return F.when(kind.isin("user_id", "post_id"), F.coalesce(number, value)).otherwise(F.lower(F.trim(value)))


def entity_keys(items: DataFrame, least: float = 0.5) -> DataFrame:
    """(query_id, item_id, type, key): what items may be merged by (E1-E3); stop words and short mentions are no keys."""
    rows = items.select("query_id", "item_id", F.explode("entities").alias("e")).select("query_id", "item_id", "e.*")
    key = entity_key(F.col("type"), F.col("value"))
    rows = rows.where(F.col("type").isin(*MERGE_TYPES)).select("query_id", "item_id", "type", key.alias("key"), "conf")
    word = (F.col("type") != "freetext_mention") | ((F.col("conf") >= least) & (F.length("key") >= 3) & ~F.col("key").isin(*STOP_WORDS))
    return rows.where(word).select("query_id", "item_id", "type", "key").distinct()


def first_of_each(items: DataFrame) -> DataFrame:
    """One item per id and question, the first in order of services."""
    order = Window.partitionBy("query_id", "item_id").orderBy("service_id", "ord")
    return items.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def _union_find(pdf: pd.DataFrame) -> pd.DataFrame:
    parent = {i: i for i in pdf["item_id"]}

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for _, ids in pdf.dropna(subset=["key"]).groupby(["type", "key"])["item_id"]:
        first = root(ids.iloc[0])
        for other in ids.iloc[1:]:
            a, b = sorted((first, root(other)))
            parent[b] = first = a
    out = pdf[["query_id", "item_id"]].drop_duplicates()
    return out.assign(group_id=[root(i) for i in out["item_id"]])


def groups(items: DataFrame) -> DataFrame:
    """(query_id, item_id, group_id): items joined by shared keys, directly or through others; the smallest id names the group.

    The items of one question are few by construction (ROWS a service), so each question is solved
    in one call.
    """
    rows = items.select("query_id", "item_id").distinct().join(entity_keys(items), ["query_id", "item_id"], "left")
    return rows.groupBy("query_id").applyInPandas(_union_find, "query_id string, item_id string, group_id string")


def merge_groups(items: DataFrame, members: DataFrame) -> DataFrame:
    """One row per group: contents by weight, weighted score, services and types."""
    rows = items.join(members, ["query_id", "item_id"])
    cell = F.struct((-F.col("weight")).alias("w"), F.col("service_id"), F.col("ord"), F.col("source_type"), F.col("content"))
    merged = rows.groupBy("query_id", "group_id").agg(
        F.array_sort(F.collect_list(cell)).alias("cells"),
        F.sum(F.col("score") * F.col("weight")).alias("sw"),
        F.sum("weight").alias("w"),
        F.max(F.col("score") * F.col("weight")).alias("single"),
        F.count("*").alias("n_items"),
        F.min(F.struct("service_id", "ord")).alias("first"),
    )
    score = F.when(F.col("n_items") == 1, F.col("single")).when(F.col("w") == 0, 0.0).otherwise(F.least(F.col("sw") / F.col("w"), F.lit(1.0)))
    joined = F.array_join(F.transform("cells", lambda c: F.concat(F.lit("["), F.upper(c["source_type"]), F.lit("] "), c["content"])), "\n")
    return merged.select(
        "query_id",
        F.col("group_id").alias("canonical_id"),
        F.when(F.col("n_items") == 1, F.col("cells")[0]["content"]).otherwise(joined).alias("content"),
        score.alias("score"),
        F.array_distinct(F.transform("cells", lambda c: c["service_id"])).alias("services"),
        F.array_distinct(F.transform("cells", lambda c: c["source_type"])).alias("types"),
        (F.size(F.array_distinct(F.transform("cells", lambda c: c["service_id"]))) > 1).alias("is_cross_source"),
        "n_items",
        "first",
    )


def conflicts(items: DataFrame, members: DataFrame) -> DataFrame:
    """(query_id, group_id, item_a, item_b, attribute, value_a, value_b): numbers of one entity on which two services differ by over 1 %."""
    cells = items.join(members, ["query_id", "item_id"]).select("query_id", "group_id", "item_id", "service_id", "ord", F.explode("numbers").alias("attribute", "value"))
    a, b = (cells.select("query_id", "group_id", "attribute", *[F.col(c).alias(f"{c}_{s}") for c in ("item_id", "service_id", "ord", "value")]) for s in "ab")
    pairs = a.join(b, ["query_id", "group_id", "attribute"]).where("(service_id_a, ord_a) < (service_id_b, ord_b) and service_id_a <> service_id_b")
    most = F.greatest(F.abs("value_a"), F.abs("value_b"))
    return pairs.where((most > 0) & (F.abs(F.col("value_a") - F.col("value_b")) > CONFLICT * most)).select("query_id", "group_id", F.col("item_id_a").alias("item_a"), F.col("item_id_b").alias("item_b"), "attribute", "value_a", "value_b")


def rank(merged: DataFrame, top: int = TOP) -> DataFrame:
    """Groups by final score, boosted across sources, equal ones as they came."""
    final = F.least(F.col("score") * F.when(F.col("is_cross_source"), BOOST).otherwise(1.0), F.lit(1.0))
    rows = merged.withColumn("final_score", F.bround(final, 4))
    order = Window.partitionBy("query_id").orderBy(F.desc("final_score"), "first")
    return rows.withColumn("rank_no", F.row_number().over(order)).where(F.col("rank_no") <= top)


def context(ranked: DataFrame, questions: DataFrame, chars: int = CONTEXT_CHARS) -> DataFrame:
    """(query_id, n_items, context): blocks in rank order up to the first that no longer fits; questions without any get an empty one."""
    head = F.concat(F.lit("[SOURCE: "), F.array_join(F.transform("types", F.upper), " + "), F.lit(" | RANK: "), F.col("rank_no").cast("string"), F.lit(" | SCORE: "), F.format_string("%.3f", F.bround("final_score", 3)), F.lit("]\n"))
    blocks = ranked.select("query_id", "rank_no", F.concat(head, "content", F.lit("\n")).alias("block"))
    upto = F.sum(F.length("block")).over(Window.partitionBy("query_id").orderBy("rank_no").rowsBetween(Window.unboundedPreceding, 0))
    fit = blocks.withColumn("upto", upto).where(F.col("upto") <= chars)
    packed = fit.groupBy("query_id").agg(F.count("*").alias("n_items"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank_no", "block"))), lambda x: x["block"]), "\n").alias("context"))
    return questions.select("query_id").join(packed, "query_id", "left").select("query_id", F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"), F.coalesce("context", F.lit("")).alias("context"))


def integrate(items: DataFrame, questions: DataFrame) -> DataFrame:
    """Items of all services and questions to contexts."""
    items = first_of_each(items)
    return context(rank(merge_groups(items, groups(items))), questions)
