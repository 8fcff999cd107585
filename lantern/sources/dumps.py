"""Archive dumps: XML files of <row .../> elements, one file per table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import none_if_zero, parse_date, safe_bool, safe_int
from ..session import exists

_I, _N, _S, _D, _B = "int", "int or null", "string", "date", "bool"
# Attributes of each dump file, the columns they become, and their kinds.
FILES = {
    "users": ("Users.xml", {"Id": _I, "Reputation": _I, "CreationDate": _D, "DisplayName": _S, "Location": _S, "AboutMe": _S, "UpVotes": _I, "DownVotes": _I, "Views": _I, "AccountId": _N}),
    "posts": ("Posts.xml", {"Id": _I, "PostTypeId": _I, "AcceptedAnswerId": _N, "ParentId": _N, "Score": _I, "ViewCount": _N, "AnswerCount": _N, "CommentCount": _N, "OwnerUserId": _N, "LastEditorUserId": _N, "CreationDate": _D, "LastEditDate": _D, "LastActivityDate": _D, "Tags": _S, "ClosedDate": _D, "Title": _S, "Body": _S}),
    "votes": ("Votes.xml", {"Id": _I, "PostId": _I, "VoteTypeId": _I, "CreationDate": _D, "UserId": _N, "BountyAmount": _N}),
    "badges": ("Badges.xml", {"Id": _I, "UserId": _I, "Name": _S, "Class": _I, "TagBased": _B, "Date": _D}),
    "tags": ("Tags.xml", {"Id": _I, "TagName": _S, "Count": _I, "ExcerptPostId": _N, "WikiPostId": _N}),
    "comments": ("Comments.xml", {"Id": _I, "PostId": _I, "Score": _I, "UserId": _N, "CreationDate": _D, "Text": _S}),
    "postlinks": ("PostLinks.xml", {"Id": _I, "CreationDate": _D, "PostId": _I, "RelatedPostId": _I, "LinkTypeId": _I}),
}
DEFAULTS = {("badges", "Class"): 3}


def _snake(name: str) -> str:
    return "".join(("_" if c.isupper() and i else "") + c.lower() for i, c in enumerate(name))


def _value(table: str, name: str, kind: str) -> Column:
    c = F.col(f"`{name}`")
    out = {_I: lambda: safe_int(c, DEFAULTS.get((table, name), 0)), _N: lambda: none_if_zero(safe_int(c)), _D: lambda: parse_date(c).cast("timestamp_ntz"), _B: lambda: safe_bool(c), _S: lambda: c}[kind]()
    return out.alias(_snake(name))


def read_table(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """One table of a dump with typed columns; rows with an id of 0 or below, or none, are dropped.

    The file is split by rows between tasks. All attributes are read as text under a fixed schema,
    so nothing is inferred; missing ones are null, unreadable numbers and dates take their default.
    """
    file, columns = FILES[table]
    raw = spark.read.format("xml").option("rowTag", "row").option("attributePrefix", "").schema(", ".join(f"`{c}` string" for c in columns)).load(f"{folder}/{file}")
    return raw.select(*[_value(table, c, k) for c, k in columns.items()]).where("id > 0")


def read_all(spark: SparkSession, folder: str, required: tuple[str, ...] = ("users", "posts"), only: tuple[str, ...] = ()) -> dict[str, DataFrame]:
    """Every table of a dump folder, on whatever file system, whose file is there; a required one that is missing raises FileNotFoundError."""
    out = {}
    for t, (file, _) in FILES.items():
        if only and t not in only:
            continue
        if exists(spark, f"{folder}/{file}"):
            out[t] = read_table(spark, folder, t)
        elif t in required:
            raise FileNotFoundError(f"{folder}/{file}")
    return out


def read_communities(spark: SparkSession, folders: dict[str, str], table: str) -> DataFrame:
    """One table of several communities, with the community of each row, so that equal ids stay apart."""
    out = None
    for name, folder in folders.items():
        one = read_table(spark, folder, table).withColumn("community", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out
