"""Every registered query against its SQL twin, on whole tables."""

from __future__ import annotations

import re

import conftest
import pytest

import __spark_entry__ as driver
from shelfline.plans.registry import QUERIES
from verification.oracles import ORACLES
from verification.compare import duck, mismatch


@pytest.fixture(scope="module")
def connection():
    return duck(conftest.DATA)


def test_every_query_has_a_twin():
    assert set(QUERIES) == set(ORACLES)
    assert set(driver.oracle_sql()) <= set(driver.queries())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, connection, name):
    assert mismatch(spark, connection, name, conftest.DATA) is None


def test_flagship_has_rows(spark):
    flagship = driver.entry(spark)
    assert flagship.columns[:3] == ["sale_date", "region", "product_category"]
    assert flagship.limit(1).count() == 1


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_pairwise_join_in_any_plan(spark, name):
    if name.startswith(("stream_", "medallion", "catalog")):
        pytest.skip("reads back what a run has written")
    plan = driver.queries()[name](spark, conftest.DATA)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("CartesianProduct|BroadcastNestedLoopJoin", plan)
