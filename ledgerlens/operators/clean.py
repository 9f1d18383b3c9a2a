"""Cleaning and normalisation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.labels import localise_category, localise_payment
from ledgerlens.functions.parse import parse_amount, parse_flag, parse_int, timestamp_column
from ledgerlens.operators.quantile import approx_quantiles, exact_quantiles
from ledgerlens.schema import (
    AMOUNT, CATEGORY, DEFAULT_TS_FORMAT, FRAUD, HOUR, LOCATION, PAYMENT, RISK, TS, TX_ID,
    USER_ID, WEEKEND,
)


def _replace(df: DataFrame, exprs: dict) -> DataFrame:
    """withColumns restricted to the columns the frame actually has."""
    present = {k: v for k, v in exprs.items() if k in df.columns}
    return df.withColumns(present) if present else df


def localise(df: DataFrame) -> DataFrame:
    """Vietnamese category and payment labels; skipped when a column is absent."""
    return _replace(df, {CATEGORY: localise_category(CATEGORY), PAYMENT: localise_payment(PAYMENT)})


def clean_transactions(df: DataFrame, ts_format: str = DEFAULT_TS_FORMAT) -> DataFrame:
    """Dashboard cleaning: C1 timestamp, C2 amount, C3 fraud flag, C4 drop bad
    timestamps, C5/C6 localisation; C7/C8 when the hour / weekend columns exist.
    ``ts_format`` is used for text only (see ``infer_ts_format``)."""
    out = _replace(df, {
        TS: timestamp_column(df, TS, ts_format),
        AMOUNT: parse_amount(AMOUNT),
        FRAUD: parse_flag(FRAUD),
        HOUR: parse_int(HOUR, 12),
        WEEKEND: parse_flag(WEEKEND),
    })
    out = out.where(F.col(TS).isNotNull())
    return localise(out)


def clean_fraud_input(df: DataFrame) -> DataFrame:
    """Fraud-model cleaning: C2, C3, C5-C8. Timestamps are not parsed, no row is dropped."""
    out = localise(df)
    return _replace(out, {
        AMOUNT: parse_amount(AMOUNT),
        FRAUD: parse_flag(FRAUD),
        HOUR: parse_int(HOUR, 12),
        WEEKEND: parse_flag(WEEKEND),
    })


def drop_incomplete(df: DataFrame) -> DataFrame:
    """Drop rows missing any of the four required keys."""
    return df.dropna(subset=[TX_ID, USER_ID, TS, AMOUNT])


def fill_unknown(df: DataFrame, value: str = "Unknown") -> DataFrame:
    """Missing payment / category / location → ``Unknown``."""
    cols = [c for c in (PAYMENT, CATEGORY, LOCATION) if c in df.columns]
    return df.fillna(value, subset=cols) if cols else df


def iqr_upper_bound(df: DataFrame, col: str = AMOUNT, whisker: float = 3.0,
                    exact: bool = True) -> float | None:
    """C11 fit: ``Q3 + whisker·(Q3 - Q1)`` with linearly interpolated quartiles.

    ``exact=True`` uses the distributed exact selection (a few passes, one path at every size);
    ``exact=False`` a one-pass quantile sketch.
    """
    q = (exact_quantiles if exact else approx_quantiles)(df, col, [0.25, 0.75])
    if q[0] is None:
        return None
    return q[1] + whisker * (q[1] - q[0])


def clip_amount(df: DataFrame, upper: float | None, col: str = AMOUNT, lower: float = 0.0) -> DataFrame:
    """C11 apply: clip to ``[lower, upper]``."""
    c = F.greatest(F.col(col), F.lit(lower))
    if upper is not None:
        c = F.least(c, F.lit(float(upper)))
    return df.withColumn(col, c)


def clean_strict(df: DataFrame, exact: bool = True) -> DataFrame:
    """C9-C11 in order (the quartiles are fitted on the rows left after C9)."""
    out = fill_unknown(drop_incomplete(df))
    return clip_amount(out, iqr_upper_bound(out, exact=exact))


def with_default(df: DataFrame, col: str = RISK, default: int = 0) -> DataFrame:
    """Optional integer column; absent → constant default, NULL → default."""
    if col in df.columns:
        return df.withColumn(col, F.coalesce(parse_int(col, default), F.lit(default)))
    return df.withColumn(col, F.lit(default))
