"""Deliveries, upserts, broken references and packed values on small inputs with known results."""

from collections import Counter
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from lantern.operators.delivery import latest_delivery
from lantern.operators.orphans import Reference, heavy_keys, orphan_references, orphan_report
from lantern.operators.packed import codebook, candidate_readings, split_packed
from lantern.operators.upsert import insert_new, merge_named, pending, upsert, with_namespace

D = lambda d: datetime(2024, 1, d)


def test_latest_delivery_nulls_ties_and_clashing_names(spark):
    rows = [(1, "old", D(1), "x"), (1, "new", D(2), "x"), (2, "a", None, "x"), (2, "b", D(1), "x"), (3, "p", D(1), "x"), (3, "q", D(1), "x"), (None, "n", D(1), "x"), (1, "new", D(2), "x")]
    df = spark.createDataFrame(rows, "id int, v string, loaded_at timestamp_ntz, _row string")
    assert {r.id: r.v for r in latest_delivery(df, ["id"], ["v"]).collect()} == {1: "new", 2: "b", 3: "q"}
    assert latest_delivery(df.limit(0), ["id"], ["v"]).count() == 0


def test_upsert_keeps_first_and_updates_last(spark):
    df = spark.createDataFrame([(1, "a", 5, D(1)), (1, "b", 7, D(3)), (1, "c", 6, D(2)), (0, "z", 1, D(1)), (-1, "z", 1, D(1)), (2, None, None, D(1))], "id int, made string, score int, loaded_at timestamp_ntz")
    assert sorted(tuple(r) for r in upsert(df, "id", ["made"], ["score"]).collect()) == [(1, "a", 7), (2, None, None)]
    assert {r.id: r.made for r in insert_new(df, "id", ["made"]).collect()} == {1: "a", 2: None}
    tags = spark.createDataFrame([("Ab", 3, None), ("ab", 5, 9), (None, 1, 1)], "tag_name string, count int, wiki int")
    assert [tuple(r) for r in merge_named(tags, "tag_name", ["count"], ["wiki"]).collect()] == [("ab", 5, 9)]
    assert [r.id for r in pending(df, df.where("id = 1"), ["id"]).where("id > 0").collect()] == [2]
    assert with_namespace({"x": df, "y": df}).groupBy("community").count().count() == 2


REFS = [Reference("posts", "owner_user_id", "users", "user"), Reference("posts", "accepted_answer_id", "posts", "post"), Reference("posts", "parent_id", "posts", "post"), Reference("votes", "post_id", "posts", "post")]


@pytest.fixture(scope="module")
def tables(spark):
    posts = [
        (1, 10, None, None, D(5), D(1)), (1, 10, 2, None, D(5), D(2)), (2, 11, None, 1, D(6), D(1)), (3, 12, None, 99, None, D(1)), (4, 0, -1, 0, D(7), D(1)), (5, 13, None, 1, D(7), D(1)), (6, 14, 7, None, D(7), D(1)), (7, None, None, None, D(7), D(4)),
    ]
    users = [(10, D(1)), (12, D(1)), (13, D(3)), (14, D(1)), (14, D(9))]
    votes = [(1, 1, D(9), D(1)), (1, 1, D(9), D(1)), (2, 55, None, D(1)), (3, 3, D(9), None), (4, 66, D(9), D(1)), (None, 77, D(9), D(1)), (5, None, D(9), D(1))]
    gone = [("user", 12, D(2)), ("user", 14, D(5)), ("user", 14, D(2)), ("post", 66, D(1)), ("post", 3, D(1)), ("post", 66, D(2)), ("tag", 1, D(1))]
    make = spark.createDataFrame
    return {
        "posts": make([(*r, "t") for r in posts], "id int, owner_user_id int, accepted_answer_id int, parent_id int, creation_date timestamp_ntz, loaded_at timestamp_ntz, value string"),
        "users": make([(*r, "t") for r in users], "id int, loaded_at timestamp_ntz, entity string"),
        "votes": make([(*r, "t") for r in votes], "id int, post_id int, creation_date timestamp_ntz, loaded_at timestamp_ntz, reason string"),
    }, make(gone, "entity string, entity_id int, deleted_at timestamp_ntz")


WANT = {
    ("posts", "owner_user_id", 2, "missing", "2024-01"), ("posts", "owner_user_id", 3, "deleted", "none"), ("posts", "owner_user_id", 5, "late", "2024-01"),
    ("posts", "parent_id", 3, "missing", "none"), ("posts", "accepted_answer_id", 6, "late", "2024-01"), ("votes", "post_id", 2, "missing", "none"), ("votes", "post_id", 4, "deleted", "2024-01"),
}


@pytest.mark.parametrize("share", [1 / 2000, 0.9, 0.2])
def test_orphans_whatever_counts_as_heavy(spark, tables, share):
    data, gone = tables
    out = orphan_references(data, gone, REFS, share)
    assert {tuple(r) for r in out.collect()} == WANT and out.count() == len(WANT)
    counted = {(t, f, m, r): n for t, f, m, r, n in orphan_report(data, gone, REFS, share).collect()}
    assert counted == Counter((t, f, m, r) for t, f, _, r, m in WANT)


def test_heavy_keys_are_few(spark, tables):
    data, _ = tables
    assert ("post", 1) in heavy_keys(data, REFS, 0.2) and len(heavy_keys(data, REFS, 0.2)) <= 5


def test_orphans_of_empty_tables(spark, tables):
    data, gone = tables
    empty = {k: v.limit(0) for k, v in data.items()}
    assert orphan_references(empty, gone.limit(0), REFS).count() == 0 and orphan_report(empty, gone.limit(0), REFS).count() == 0
    assert orphan_references({**data, "users": data["users"].limit(0)}, gone.limit(0), REFS[:1]).count() == 6 - 1


PACKED = [
    ("<a-b><c, d><E>", ["a-b", "c, d", "e"]), ("&lt;a&gt;&lt;b; c&gt;", ["a", "b; c"]), ('["x", "y, z", "the \\"t\\" f"]', ["x", "y, z", 'the "t" f']), ("|a|b|", ["a", "b"]), ("||a||b", ["a", "b"]), ("a;b,c", ["a", "b", "c"]), ("a\tb", ["a", "b"]),
    ("  a   b ", ["a", "b"]), ("A", ["a"]), ("'v, s'; w", ["v, s", "w"]), ('"v; s",w,', ["v; s", "w"]), ('"the ""t"" f"; w', ['the "t" f', "w"]), ('"p-value\'s"; q', ["p-value's", "q"]), ("<p-value's><k=2>", ["p-value's", "k=2"]), ("< a >< b >", ["a", "b"]),
    ("<a>, <b>", ["a", "b"]), ("a,,b", ["a", "b"]), ("a,b,a", ["a", "b", "a"]), ("r&d;x", ["r&d", "x"]), ("<><a>", ["a"]), ("[]", []), ("<>", []), ("", []), (" ", []), (None, []), ("'long format'", ["long format"]), ("a,b\\,c", ["a", "b,c"]), ('["é"]', ["é"]), ("α|ß", ["α", "ß"]),
]


def test_packed_forms(spark):
    df = spark.createDataFrame([(n, t, "x", "y") for n, (t, _) in enumerate(PACKED)], "post_id int, tags string, key string, value string")
    got: dict[int, list] = {}
    for r in split_packed(df, "post_id", "tags").orderBy("post_id", "pos").collect():
        got.setdefault(r.post_id, []).append(r.value)
        assert r.pos == len(got[r.post_id])
    for n, (text, want) in enumerate(PACKED):
        assert got.get(n, []) == want, text
    assert split_packed(df.limit(0), "post_id", "tags").count() == 0


def test_packed_long_field_and_codebook_bound(spark):
    long = "ab " * 100000
    rows = [(1, ",".join(f"t{n}" for n in range(5000))), (2, "<t1><t2>"), (3, "t1;t2"), (4, f"<{long}>"), (5, f"\"{long}\";x"), (6, f"x,{long}"), (7, f"[\"{long}\"]")]
    df = spark.createDataFrame(rows, "id int, tags string")
    out = split_packed(df, "id", "tags")
    assert out.where("id = 1").count() == 5000
    assert {r.id: r.n for r in out.where("id > 3 and length(value) > 299000").groupBy("id").agg(F.count("*").alias("n")).collect()} == {4: 1, 5: 1, 6: 1, 7: 1}
    assert out.exceptAll(split_packed(df, "id", "tags", 2)).count() == 0


@pytest.mark.parametrize("size", [0, 1, 2, 7])
def test_packed_alike_whatever_part_of_the_codebook_is_broadcast(spark, size):
    # Whether the quotes of an open field belong to a value is decided by what other fields hold.
    plain = ["'v, s'", "p-value", "x's", "dog's", "v", "s", "rock 'n' roll", "a<b", "c>d"]
    texts = [";".join(plain[:n]) for n in range(1, 10)] * 3 + ["'v;x's;p-value", "dog's, 'v, s', it's", "a<b, c>d", "<a|b, c>d", "'p-value', 'q", "rock 'n' roll|'x|y'"] + [t for t, _ in PACKED]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, tags string")
    assert codebook(candidate_readings(df, "id", "tags")).count() > 7
    assert {tuple(r) for r in split_packed(df, "id", "tags", size).collect()} == {tuple(r) for r in split_packed(df, "id", "tags").collect()}
