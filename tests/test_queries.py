"""Every query of the core on the smallest data, against its SQL where it has one, and the driver's contract."""

import importlib
import os
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry
from tests.sql_check import BASE, differences, present

ROOT = Path(__file__).resolve().parent.parent
CORE = {k: (f, m.SQL.get(k)) for m in map(importlib.import_module, entry._PLANS) for k, f in m.QUERIES.items()}


@pytest.mark.skipif(not present(), reason="no test data here")
@pytest.mark.parametrize("name", list(CORE))
def test_query(spark, name):
    build, sql = CORE[name]
    df = build(spark, BASE)
    if sql:
        assert differences(df, sql) == ([], [])
    else:
        assert df.count() > 0


def test_contract(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(CORE) <= set(entry.queries())
    if present():
        assert entry.entry(spark).count() > 0


def test_workers_find_the_package_from_anywhere(tmp_path):
    code = f"""
import sys; sys.path.insert(0, {str(ROOT)!r})
import __spark_entry__ as e
from lantern.session import local_session
from lantern.functions.stem import stemmed
from pyspark.sql import functions as F
spark = local_session(cores="2")
q = e._shipping(lambda spark, base: spark.range(1).select(stemmed(F.array(F.lit("running"))).alias("x")))
assert q(spark, "").first().x == ["run"]
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", code], check=True, cwd=tmp_path, env=env, capture_output=True)


def test_core_does_not_need_the_subpackage():
    code = "import sys; sys.modules['lantern.llm'] = None; import __spark_entry__ as e; assert 'p1_found' in e.queries() and 'p3_found' not in e.queries()"
    subprocess.run([sys.executable, "-c", code], check=True)


def test_no_plan_reads_more_than_it_needs(spark):
    if not present():
        pytest.skip("no test data here")
    plan = CORE["rel_top_users"][0](spark, BASE)._jdf.queryExecution().executedPlan().toString()
    assert "about_me" not in plan and "TakeOrderedAndProject" in plan
    plan = CORE["rel_monthly_volume"][0](spark, BASE)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(creation_date" in plan.split("PushedFilters: ")[1].split("]")[0]
    plan = CORE["rel_gold_holders"][0](spark, BASE)._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan
