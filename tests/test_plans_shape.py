"""Physical-plan guards over every oracle-checked catalog query: no cartesian
products or nested-loop joins, and no Python evaluation anywhere."""

import __spark_entry__ as E

from paths import SF001

FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython",
             "PythonUDF", "FlatMapGroupsInPandas", "MapInPandas")


def test_no_pairs_and_no_python_in_plans(spark):
    bad = {}
    for name in E.oracle_sql():
        df = E.queries()[name](spark, SF001)
        plan = df._jdf.queryExecution().executedPlan().toString()
        hits = [f for f in FORBIDDEN if f in plan]
        if hits:
            bad[name] = hits
    assert bad == {}


def test_scan_pruning_on_fact_table(spark):
    df = E.queries()["b3_location_sales"](spark, SF001)
    plan = df._jdf.queryExecution().executedPlan().toString()
    # only the columns the query needs are read from the events table
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz,user_id:bigint,value:double>" in plan
