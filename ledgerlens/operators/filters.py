"""Filters, filter-value lookups and keyword search."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.schema import CATEGORY, LOCATION, PAYMENT, TX_ID, USER_ID, FilterParams


def filter_predicate(params: FilterParams | None) -> Column:
    """AND of the optional equality filters; ``lit(True)`` when none is set.

    A plain equality conjunction, so Catalyst pushes it into the parquet scan
    (row-group statistics / dictionary filtering).
    """
    cond = F.lit(True)
    if params is None:
        return cond
    for col, value in ((LOCATION, params.location), (PAYMENT, params.payment_method),
                       (CATEGORY, params.merchant_category)):
        if value:
            cond = cond & (F.col(col) == F.lit(value))
    return cond


def apply_filters(df: DataFrame, params: FilterParams | None) -> DataFrame:
    return df.where(filter_predicate(params))


FILTER_FIELDS = (("locations", LOCATION), ("payment_methods", PAYMENT), ("merchant_categories", CATEGORY))


def filter_values_long(df: DataFrame) -> DataFrame:
    """F5 in long form ``(field, value)`` (see ``distinct_values``)."""
    return distinct_values(df, FILTER_FIELDS)


def distinct_values(df: DataFrame, fields: Iterable[tuple[str, str]]) -> DataFrame:
    """Distinct non-null ``(field, value)`` of the columns named by ``(field, column)`` pairs.
    One scan gives every row's values; the distinct happens in a grouped shuffle (partially
    deduplicated in every task), so no single task ever sees more than its share of them."""
    pairs = [F.struct(F.lit(name).alias("field"), F.col(c).cast("string").alias("value")) for name, c in fields]
    return df.select(F.inline(F.array(*pairs))).where(F.col("value").isNotNull()).distinct()


def filter_values(df: DataFrame) -> DataFrame:
    """sorted distinct non-null values of location, payment and category in
    one row of arrays (code-point order). Values are deduplicated by the
    distributed distinct first; only the final lists — the requested output —
    are gathered."""
    long = filter_values_long(df)
    return long.agg(*[F.array_sort(F.collect_list(F.when(F.col("field") == name, F.col("value"))))
                      .alias(name) for name, _ in FILTER_FIELDS])


def search(df: DataFrame, keyword: str, regex: bool = True) -> DataFrame:
    """case-folded match of ``keyword`` against id, user and category.

    ``regex=True`` (reference behaviour) treats the keyword as a regex with Unicode
    classes; a bad pattern raises ``ValueError`` before the table is read. NULL text never
    matches. An empty keyword returns the frame unchanged.
    """
    if not keyword:
        return df
    kw = keyword.lower()
    if regex:
        kw = "(?U)" + kw      # Unicode classes, as in the reference
        try:    # checked by the engine that runs it, on a literal
            df.sparkSession.range(1).select(F.lit("").rlike(kw)).collect()
        except Exception as e:  # noqa: BLE001 — the JVM's pattern error
            raise ValueError(f"invalid search pattern {keyword!r}") from e
    conds = []
    for c in (TX_ID, USER_ID, CATEGORY):
        text = F.lower(F.col(c).cast("string"))
        conds.append(text.rlike(kw) if regex else text.contains(F.lit(kw)))
    cond = F.coalesce(conds[0] | conds[1] | conds[2], F.lit(False))
    return df.where(cond)
