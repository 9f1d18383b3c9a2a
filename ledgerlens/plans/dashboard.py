"""Composite plans: what one dashboard / page request needs, as lazy DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ledgerlens.operators import customers as U
from ledgerlens.operators import metrics as M
from ledgerlens.operators.filters import apply_filters, search
from ledgerlens.operators.forecast import baseline_forecast
from ledgerlens.operators.listing import page, page_total, project_rows
from ledgerlens.schema import TS, FilterParams


def dashboard(df: DataFrame, params: FilterParams | None = None) -> dict[str, DataFrame]:
    """Summary, breakdowns, monthly trend, funnel, flows, insights on one filtered frame."""
    f = apply_filters(df, params)
    return {
        "summary": M.summary(f),
        "distributions": M.distributions(f),
        "trend": M.trend(f, "month"),
        "funnel": M.user_funnel(f),
        "flows": M.category_flows(f),
        "insights": M.insights(f),
        "by_hour": M.amount_by_hour(f),
    }


def transactions_page(df: DataFrame, params: FilterParams | None = None, keyword: str = "",
                      sort_by: str = TS, sort_order: str = "desc", page_no: int = 1,
                      page_size: int = 20) -> dict[str, DataFrame]:
    f = search(apply_filters(df, params), keyword)
    return {"total": page_total(f),
            "rows": project_rows(page(f, sort_by, sort_order, page_no, page_size))}


def segmentation_page(df: DataFrame) -> dict[str, DataFrame]:
    """K-Means segments on the unfiltered table plus the monthly forecast."""
    _, clustered = U.fit_segments(U.rfm(df))
    seg = U.name_segments(clustered)
    return {"segments": seg, "summary": U.segment_profile(seg),
            "forecast": baseline_forecast(M.trend(df, "month"))}
