"""Every query with SQL gives that SQL's rows on the smallest tables."""

import granary.plans.documents  # noqa: F401
import granary.plans.stored  # noqa: F401
import pytest
from granary.plans.queries import ORACLES, QUERIES

from tests.oracle import connect, same

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, con, name):
    same(QUERIES[name](spark, FOLDER), con, ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    assert QUERIES[name](spark, FOLDER).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_topk_is_pushed_below_the_shuffle(spark):
    plan = QUERIES["bm25_topk"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
    assert "Python" not in plan
