"""Sorted, paged transaction listing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.money import trunc_to_long
from ledgerlens.operators.clean import with_default
from ledgerlens.schema import (
    AMOUNT, CATEGORY, FRAUD, LOCATION, PAYMENT, RISK, SORTABLE_COLUMNS, TS, TX_ID, USER_ID,
)
from ledgerlens.session import written


def sort_keys(sort_by: str = TS, sort_order: str = "desc") -> list[Column]:
    """Allow-listed sort column (fallback ``Timestamp``), NULLs last both ways,
    ``Transaction_ID`` as a deterministic tie-break."""
    col = sort_by if sort_by in SORTABLE_COLUMNS else TS
    asc = (sort_order or "").lower() == "asc"
    first = F.col(col).asc_nulls_last() if asc else F.col(col).desc_nulls_last()
    tie = F.col(TX_ID).asc_nulls_last() if asc else F.col(TX_ID).desc_nulls_last()
    return [first, tie]


def sorted_rows(df: DataFrame, sort_by: str = TS, sort_order: str = "desc") -> DataFrame:
    return df.orderBy(*sort_keys(sort_by, sort_order))


def page(df: DataFrame, sort_by: str = TS, sort_order: str = "desc", page_no: int = 1,
         page_size: int = 20) -> DataFrame:
    """Rows ``(page-1)*size … +size`` of the sorted frame (start clamped at 0).

    Plans as ``TakeOrderedAndProject(limit, offset)``: every task keeps only its
    best ``offset + size`` rows. For deep pages use :func:`page_after` behind a known row, or
    :func:`page_at` by number.
    """
    start = max((page_no - 1) * page_size, 0)
    out = df.orderBy(*sort_keys(sort_by, sort_order))
    if start:
        out = out.offset(start)
    return out.limit(page_size)


def page_after(df: DataFrame, last_value, last_id: str | None, sort_by: str = TS, sort_order: str = "desc",
               page_size: int = 20) -> DataFrame:
    """P2 keyset form: the page following the row ``(last_value, last_id)``.

    The predicate removes every earlier row before the top-k, so a deep page
    costs the same as the first one. Rows with a NULL sort value come last, rows with a
    NULL id last among equal sort values; rows equal in both are not told apart, so those
    with a NULL id are returned on the page that follows the last row with an id.
    """
    col = sort_by if sort_by in SORTABLE_COLUMNS else TS
    asc = (sort_order or "").lower() == "asc"
    c, i = F.col(col), F.col(TX_ID)
    if last_id is None:     # nulls sort last: nothing with this sort value follows
        tied = F.lit(False)
    else:
        tied = F.coalesce((i > F.lit(last_id)) if asc else (i < F.lit(last_id)), F.lit(True))
    if last_value is None:  # already inside the NULL tail
        after = c.isNull() & tied
    else:
        v = F.lit(last_value).cast(df.schema[col].dataType)
        beyond = (c > v) if asc else (c < v)
        after = c.isNull() | beyond | ((c == v) & tied)
    return df.where(after).orderBy(*sort_keys(col, sort_order)).limit(page_size)


ROW_HASH = "_row_hash"
PIVOTS, SPAN = 32, 10_000       # keys counted per pass, and rows a page may be sought in
MANY_KEYS = 1 << 20             # keys left after a pass that are written for the next one


def _before(keys: list[tuple[str, bool]], at: list) -> Column:
    """Whether a row comes strictly before the key ``at`` (nulls last on every column)."""
    cond = F.lit(False)
    for (name, asc), v in reversed(list(zip(keys, at))):
        c = F.col(name)
        if v is None:
            ahead, same = c.isNotNull(), c.isNull()
        else:
            # the null test keeps the comparison two-valued, so it can be negated
            ahead = c.isNotNull() & ((c < F.lit(v)) if asc else (c > F.lit(v)))
            same = c.isNotNull() & (c == F.lit(v))
        cond = F.coalesce(ahead, F.lit(False)) | (F.coalesce(same, F.lit(False)) & cond)
    return cond


def rank_start(rows: DataFrame, keys: list[tuple[str, bool]], offset: int, span: int = SPAN,
               pivots: int = PIVOTS) -> tuple[list | None, int]:
    """(key, rows before it): the last known key with at most ``offset`` rows before it, and
    fewer than ``span`` more rows up to the wanted one where keys differ.

    Each pass draws ``pivots`` keys of the rows still in question (by a hash, so evenly) and
    counts the rows before each in one global aggregate; the two around ``offset`` bound the next
    pass. While many keys are left they are written between passes, so all passes together read
    a few times the table's keys. Passes grow with the logarithm of the table; only keys and counts reach the driver."""
    names = [k for k, _ in keys]
    order = [F.col(k).asc_nulls_last() if asc else F.col(k).desc_nulls_last() for k, asc in keys]
    start, end, below, base = None, None, 0, rows.select(*names)
    part, left = base, None
    while left is None or left > span:
        drawn = part.orderBy(F.xxhash64(*names)).limit(pivots).distinct().orderBy(*order).collect()
        if not drawn:
            break
        counts = part.agg(F.count(F.lit(1)).alias("all"), *[F.count_if(_before(keys, list(p))).alias(f"c{i}") for i, p in enumerate(drawn)]).first()
        ahead = [i for i in range(len(drawn)) if below + counts[f"c{i}"] <= offset]
        stop = next((i for i in range(len(drawn)) if below + counts[f"c{i}"] > offset), None)
        high = counts[f"c{stop}"] if stop is not None else counts["all"]
        low = counts[f"c{ahead[-1]}"] if ahead else 0
        if stop is not None:
            end = list(drawn[stop])
        if ahead:
            start, below = list(drawn[ahead[-1]]), below + low
        part = base     # the newest bounds imply the earlier ones
        if end is not None:
            part = part.where(_before(keys, end))
        if start is not None:
            part = part.where(~_before(keys, start))
        if left is not None and high - low >= left:      # the rows left all have one key
            break
        left = high - low
        if left > max(span, MANY_KEYS):
            part = base = written(part, "page-keys")
    return start, below


def page_at(df: DataFrame, page_no: int, page_size: int = 20, sort_by: str = TS, sort_order: str = "desc",
            span: int = SPAN, pivots: int = PIVOTS) -> DataFrame:
    """P2 by page number at any depth: the rank of the page's first row is narrowed to a key
    near it (:func:`rank_start`), rows before that key are filtered out, and the top-k keeps
    fewer than ``span + page_size`` rows per task instead of ``page_no * page_size``. ``df`` is
    computed once and written; the passes read its key columns.

    The order is that of :func:`page` with a hash of the whole row behind the id, so rows equal
    in sort value and id (or without an id) are told apart and pages never overlap; only
    rows equal in every column may stand for each other."""
    col = sort_by if sort_by in SORTABLE_COLUMNS else TS
    asc = (sort_order or "").lower() == "asc"
    keys = [(col, asc), (TX_ID, asc), (ROW_HASH, True)]
    rows = written(df.withColumn(ROW_HASH, F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])), "page-rows")
    offset = max((page_no - 1) * page_size, 0)
    start, below = rank_start(rows, keys, offset, span, pivots)
    if start is not None:
        rows = rows.where(~_before(keys, start))
    out = rows.orderBy(*[F.col(k).asc_nulls_last() if a else F.col(k).desc_nulls_last() for k, a in keys])
    if offset > below:
        out = out.offset(offset - below)
    return out.limit(page_size).drop(ROW_HASH)


def page_total(df: DataFrame) -> DataFrame:
    """Total row count of the (filtered / searched) frame."""
    return df.agg(F.count(F.lit(1)).alias("total"))


def project_rows(df: DataFrame) -> DataFrame:
    """API projection — renamed columns, amount as int (truncated), timestamp text."""
    d = with_default(df, RISK, 0)
    if FRAUD not in d.columns:
        d = d.withColumn(FRAUD, F.lit(0))
    return d.select(
        F.col(TX_ID).cast("string").alias("transaction_id"),
        F.col(USER_ID).cast("string").alias("user_id"),
        trunc_to_long(AMOUNT).alias("amount_vnd"),
        F.date_format(TS, "yyyy-MM-dd HH:mm:ss").alias("timestamp"),
        F.col(PAYMENT).cast("string").alias("payment_method"),
        F.col(CATEGORY).cast("string").alias("merchant_category"),
        F.col(LOCATION).cast("string").alias("location"),
        F.col(RISK).cast("int").alias("risk_score"),
        F.col(FRAUD).cast("int").alias("is_fraud"),
    )


def label_value(df: DataFrame, label_col: str, value_col: str) -> DataFrame:
    """P5: rename a (key, measure) pair to ``label`` / ``value``."""
    return df.withColumnsRenamed({label_col: "label", value_col: "value"})
