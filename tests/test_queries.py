"""Every registered query against its oracle, and the contract of the entry module."""

import pytest

import __spark_entry__ as entry_module
from codelode.plans import registry
from tests.compare import connect, rows

registry.load()


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_matches_oracle(spark, data, name):
    got = registry.QUERIES[name](spark, data).toPandas()
    want = connect(data).execute(registry.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_runs_without_oracle(spark, data, name):
    assert registry.QUERIES[name](spark, data).count() > 0


def test_entry(spark, data):
    assert entry_module.entry(spark).count() > 0
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())


def test_plans_read_only_what_they_need(spark, data):
    plan = registry.QUERIES["symbol_kind_filter"](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(p_type)" in plan or "EqualTo(p_type,PROMO)" in plan
    assert "p_retailprice" not in plan
    plan = registry.QUERIES["file_history_by_path"](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "Or(EqualTo(l_partkey,77),EqualTo(l_partkey,177))" in plan and "l_extendedprice" not in plan


def test_event_route_sends_every_event(spark, tmp_path):
    """Events of all kinds and numbers reach the members of their project or the user they name; those without a kind reach nobody."""
    types = ["view", "click", "purchase", "signup", "error", "refund", None]
    spark.createDataFrame([(i, i % 50, types[i % 7]) for i in range(140)], "event_id long, user_id long, event_type string").write.parquet(f"{tmp_path}/events.parquet")
    spark.createDataFrame([(i, i % 25) for i in range(75)], "c_custkey long, c_nationkey int").write.parquet(f"{tmp_path}/customer.parquet")
    got = registry.QUERIES["event_route"](spark, str(tmp_path)).toPandas()
    assert rows(got) == rows(connect(str(tmp_path)).execute(registry.ORACLES["event_route"]).df())
    assert set(got["event_id"]) == {i for i in range(140) if types[i % 7]} and len(got) == 100 * 3 + 20
