"""Label lookups as literal-map / CASE expressions (no join needed)."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerlens.schema import CATEGORY_LABELS, PAYMENT_LABELS, WEEKDAY_LABELS


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def map_lookup(c: str | Column, mapping: dict[str, str]) -> Column:
    """``mapping[c]`` when present, else ``c`` unchanged (NULL stays NULL)."""
    c = _col(c)
    m = F.create_map(*[F.lit(x) for x in chain.from_iterable(mapping.items())])
    return F.coalesce(F.try_element_at(m, c), c)


def localise_category(c: str | Column) -> Column:
    return map_lookup(c, CATEGORY_LABELS)


def localise_payment(c: str | Column) -> Column:
    return map_lookup(c, PAYMENT_LABELS)


def weekday_no(ts: str | Column) -> Column:
    """0 = Monday … 6 = Sunday."""
    return F.weekday(_col(ts))


def weekday_label_of(no: str | Column) -> Column:
    """Label for a weekday number (0 = Monday)."""
    labels = F.array(*[F.lit(x) for x in WEEKDAY_LABELS])
    return F.try_element_at(labels, _col(no) + 1)


def weekday_label(ts: str | Column) -> Column:
    return weekday_label_of(weekday_no(ts))
