"""Plan guards: no cross joins anywhere; pushdown and pruning where promised."""

import pytest

import __spark_entry__ as entry
from data_paths import SF_SMALL

SQL_QUERIES = sorted(n for n in entry.oracle_sql() if n[:2] in ("q_", "t_"))


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", SQL_QUERIES)
def test_no_cross_join(spark, name):
    plan = _plan(entry.queries()[name](spark, SF_SMALL))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_event_scan_pushdown_and_pruning(spark):
    plan = _plan(entry.queries()["q_trailing_event_counts"](spark, SF_SMALL))
    assert "PushedFilters: [IsNotNull(ts), LessThanOrEqual(ts," in plan
    assert "ReadSchema: struct<ts:timestamp_ntz,user_id:bigint>" in plan


def test_population_reads_only_the_key(spark):
    from retentia.sources.tables import _scored
    plan = _plan(_scored(spark, SF_SMALL))
    assert "ReadSchema: struct<o_orderkey:bigint>" in plan


def test_dimension_joins_broadcast(spark):
    for name in ["q_band_lookup", "q_dept_lookup", "q_location_lookup"]:
        assert "BroadcastHashJoin" in _plan(entry.queries()[name](spark, SF_SMALL))


def test_top200_is_take_ordered(spark):
    assert "TakeOrderedAndProject(limit=200" in _plan(entry.queries()["q_lookup_top200"](spark, SF_SMALL))
