"""Every registered query of the engine against its DuckDB twin."""

import pytest

from oracle import agree, connect
from oscilla.plans import registry


@pytest.fixture(scope="module")
def db(small):
    return connect(small)


def test_every_query_has_a_twin():
    assert set(registry.QUERIES) == set(registry.ORACLE_SQL)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_matches_its_twin(spark, small, db, name):
    agree(registry.QUERIES[name](spark, small), db, registry.ORACLE_SQL[name])


def test_scans_read_only_the_columns_they_need(spark, small):
    plan = registry.QUERIES["rmse"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<user_id:bigint,value:double,props:string>" in plan


def test_one_shuffle_serves_stacked_windows(spark, small):
    plan = registry.QUERIES["jerk"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
