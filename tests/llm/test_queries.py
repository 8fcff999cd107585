"""Every query of this subpackage on the smallest data, against its SQL where it has one."""

import pytest

from lantern.llm import queries as q
from tests.sql_check import BASE, differences, present

pytestmark = pytest.mark.skipif(not present(), reason="no test data here")


@pytest.mark.parametrize("name", list(q.QUERIES))
def test_query(spark, name):
    df = q.QUERIES[name](spark, BASE)
    if name in q.SQL:
        assert differences(df, q.SQL[name]) == ([], [])
    else:
        assert df.count() >= 0


def test_columns_of_found(spark):
    want = {
        "p3_found": ["user_id int", "place_id int"], "p4_found": ["post_id int", "group_id int"], "p5_found": ["user_id int", "field_name string", "kind string"], "p6_found": ["tag_a string", "tag_b string"],
        "p7_found": ["parent_id int", "rank_no int", "post_id int"], "p8_ids": ["doc_id bigint", "ids array<int>"], "p9_found": ["doc_id bigint", "item_id int"], "p10_found": ["doc_id bigint"],
    }
    for name, columns in want.items():
        df = q.QUERIES[name](spark, BASE)
        assert [f"{c} {t}" for c, t in df.dtypes] == columns, name
        if name != "p8_ids":
            assert df.count() == df.distinct().count(), name
