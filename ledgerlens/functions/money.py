"""Exact money arithmetic: sums through DECIMAL so any partitioning gives the same value.

Amounts keep six decimals. One of 1e22 or more does not fit and is left out of sums like a
missing one; it never fails a query."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerlens.schema import MONEY


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def money(c: str | Column) -> Column:
    return _col(c).try_cast(MONEY)


def exact_sum(c: str | Column) -> Column:
    """Sum as DECIMAL(38,6) → double. Independent of row order across partitions."""
    return F.sum(money(c)).cast("double")


def trunc_to_long(c: str | Column) -> Column:
    """Python ``int(x)`` semantics: truncate toward zero; out of range → NULL."""
    return _col(c).try_cast("bigint")
