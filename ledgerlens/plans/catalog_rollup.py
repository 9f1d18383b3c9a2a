"""Catalog entries answered from the roll-up, after three additions to it. The SQL is that of
the same measure over the rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.plans.catalog import HANOI, ORACLE, SUMMARY_SQL, q
from ledgerlens.plans.oracle_views import with_views
from ledgerlens.plans.rollup import Rollup, Router
from ledgerlens.schema import TX_ID, FilterParams
from ledgerlens.session import shared_dir
from ledgerlens.sources import fixtures as fx

VIEWS = {"tx": fx.tx, "tx_o": fx.tx_o}
_built: dict[tuple[str, str, str], str] = {}        # per session and input: the roll-up's folder


def rollup_of(spark: SparkSession, sf: str, view: str) -> Router:
    """The view's roll-up, made from three deliveries of its rows, once per session."""
    rows = VIEWS[view](spark, sf)
    key = (spark.sparkContext.applicationId, sf, view)
    if key not in _built:
        root = shared_dir(spark, f"fixtures/rollup-{view}-{uuid.uuid4().hex}")
        made = Rollup(spark, root)
        for i in range(3):
            made.add(rows.where(F.pmod(F.xxhash64(TX_ID), F.lit(3)) == i))
        _built[key] = root
    return Router(rows, Rollup(spark, _built[key]))


def _answer(spark: SparkSession, sf: str, view: str, measure: str, params: FilterParams | None = None, **args) -> DataFrame:
    router = rollup_of(spark, sf, view)
    assert router.source(measure, params, **args) == "rollup", measure
    return router.answer(measure, params, **args)


def _entry(name: str, like: str, view: str, measure: str, **args) -> None:
    @q(name, ORACLE[like])
    def fn(spark, sf):
        return _answer(spark, sf, view, measure, **args)


for _name, _like, _view, _measure, _args in [
        ("a_summary_from_rollup", "a_summary", "tx", "summary", {}),
        ("b4_distributions_from_rollup", "b4_distributions", "tx", "distributions", {}),
        ("b5_monthly_trend_from_rollup", "b5_monthly_trend", "tx_o", "trend", {"granularity": "month"}),
        ("b6_quarterly_trend_from_rollup", "b6_quarterly_trend", "tx_o", "trend", {"granularity": "quarter"}),
        ("b7_amount_by_hour_from_rollup", "b7_amount_by_hour", "tx", "amount_by_hour", {}),
        ("b8_count_by_hour_from_rollup", "b8_count_by_hour", "tx", "count_by_hour", {}),
        ("b9_count_by_weekday_from_rollup", "b9_count_by_weekday", "tx", "count_by_weekday", {}),
        ("b10_flows_from_rollup", "b10_payment_category_flows", "tx", "flows", {}),
        ("b11_funnel_from_user_state", "b11_user_funnel", "tx_o", "funnel", {}),
        ("b14_growth_from_rollup", "b14_growth_display", "tx", "growth", {}),
        ("i1_i2_insights_from_rollup", "i1_i2_insights", "tx", "insights", {}),
        ("u1_rfm_from_user_state", "u1_rfm", "tx_o", "rfm", {}),
        ("u7_preferred_payment_from_user_state", "u7_preferred_payment", "tx", "preferred_payment", {})]:
    _entry(_name, _like, _view, _measure, **_args)


@q("a_summary_filtered_from_rollup", with_views(
    "select " + ", ".join(f"{v.replace('from tx', 'from f')} as {k}" for k, v in SUMMARY_SQL.items()), "tx",
    extra=[f"f as (select * from tx where Location = '{HANOI}')"]))
def summary_filtered(spark, sf):
    return _answer(spark, sf, "tx", "summary", FilterParams(location=HANOI))
