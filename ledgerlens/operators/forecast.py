"""Baseline spend forecast."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def baseline_forecast(trend_df: DataFrame, order_col: str = "period") -> DataFrame:
    """First two periods = actual; afterwards the half-up rounded mean of the two
    previous *actual* values. (Shown as a learned forecast in the reference UI,
    but this moving average is what it computes.)

    Runs on a post-aggregate trend (one row per period), so the un-partitioned
    window sees only as many rows as there are periods.
    """
    w = Window.orderBy(order_col)
    l1, l2 = F.lag("value", 1).over(w), F.lag("value", 2).over(w)
    fc = F.when(l2.isNull(), F.col("value")).otherwise(F.floor((l1 + l2) / 2 + 0.5).cast("double"))
    return trend_df.select(order_col, "value", fc.alias("forecast"))
