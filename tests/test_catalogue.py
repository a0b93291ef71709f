import pytest

from silverquill.plans import catalogue

from .oracle import DATA, check

SQL = catalogue.oracle_sql()


def test_every_query_has_sql():
    assert set(SQL) == set(catalogue.queries())


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, name):
    check(catalogue.queries()[name], SQL[name], spark)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0


def test_timeline_plan_is_a_bounded_heap(spark):
    plan = catalogue.timeline_page(spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "PushedFilters: [IsNotNull(o_orderstatus)" in plan
