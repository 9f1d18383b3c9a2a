"""Text → typed parsing with the reference's "bad value → default" rules.

Spark's ``try_cast('12d' as double)`` yields 12.0 and ``'nan'`` yields NaN, while
the reference's parser rejects both, so numbers are gated by a strict pattern
first. Everything here is a plain ``Column`` expression and stays inside
whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.schema import DEFAULT_TS_FORMAT, NA_TOKENS

# Plain decimal / scientific notation, optional sign and surrounding blanks.
NUMBER_PATTERN = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def na_to_null(c: str | Column, tokens: list[str] | None = None) -> Column:
    """Missing-value tokens (``NA``, ``null``, empty, ...) → NULL; other text is kept, a
    token with blanks around it too."""
    c = _col(c)
    toks = NA_TOKENS if tokens is None else tokens
    return F.when(c.isin(*toks), F.lit(None).cast("string")).otherwise(c)


def parse_number(c: str | Column) -> Column:
    """Strict numeric parse: text matching ``NUMBER_PATTERN`` → double, else NULL."""
    c = _col(c).cast("string")
    return F.when(c.rlike(NUMBER_PATTERN), F.trim(c).try_cast("double"))


def parse_amount(c: str | Column, default: float = 0.0) -> Column:
    """Amount text → double; unparseable or missing → ``default``."""
    return F.coalesce(parse_number(c), F.lit(float(default)))


def parse_int(c: str | Column, default: int) -> Column:
    """Number text → int truncated toward zero; unparseable or missing → ``default``."""
    # try_cast double→int truncates toward zero and gives NULL when out of range
    return F.coalesce(parse_number(c).try_cast("int"), F.lit(int(default)))


def parse_flag(c: str | Column, default: int = 0) -> Column:
    """As ``parse_int``; ``True`` / ``False`` (text or boolean column) are 1 / 0."""
    word = F.lower(F.trim(_col(c).cast("string")))
    return F.when(word == "true", 1).when(word == "false", 0).otherwise(parse_int(c, default))


def parse_timestamp(c: str | Column, fmt: str = DEFAULT_TS_FORMAT) -> Column:
    """Text → ``timestamp_ntz`` with an explicit pattern; bad text → NULL.
    (Columns that are already timestamps or dates: see ``timestamp_column``.)

    ``to_timestamp_ntz`` reads the wall-clock value with no time zone involved
    (a zoned parse would move times inside a daylight-saving gap), but raises
    on bad text under ANSI mode, so ``try_to_timestamp`` guards it.
    """
    c = _col(c).cast("string")
    f = F.lit(fmt)
    return F.when(F.try_to_timestamp(c, f).isNotNull(), F.to_timestamp_ntz(c, f))


# Text shapes the format of a file is taken from, and the pattern each one means.
TS_SHAPES = (
    (r"\d{4}-\d\d-\d\d \d\d:\d\d:\d\d", "yyyy-MM-dd HH:mm:ss"),
    (r"\d{4}-\d\d-\d\d \d\d:\d\d:\d\d\.\d{1,6}", "yyyy-MM-dd HH:mm:ss[.SSSSSS][.SSSSS][.SSSS][.SSS][.SS][.S]"),
    (r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d", "yyyy-MM-dd'T'HH:mm:ss"),
    (r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d\.\d{1,6}", "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][.SSSSS][.SSSS][.SSS][.SS][.S]"),
    (r"\d{4}-\d\d-\d\d \d\d:\d\d", "yyyy-MM-dd HH:mm"),
    (r"\d{4}-\d\d-\d\dT\d\d:\d\d", "yyyy-MM-dd'T'HH:mm"),
    (r"\d{4}-\d\d-\d\d", "yyyy-MM-dd"),
    (r"\d{4}/\d\d/\d\d \d\d:\d\d:\d\d", "yyyy/MM/dd HH:mm:ss"),
    (r"\d\d/\d\d/\d{4} \d\d:\d\d:\d\d", "MM/dd/yyyy HH:mm:ss"),
    (r"\d\d/\d\d/\d{4}", "MM/dd/yyyy"),
)


class UnknownTimestampFormat(ValueError):
    """A text column has values, but none in a known shape."""


def ts_votes(df: DataFrame, col: str) -> DataFrame:
    """One row per known shape: ``pattern``, and ``n`` values of the column that have it; and a
    row without a pattern for the values that have none. One aggregate over the column."""
    text = F.trim(F.col(col))
    shape = F.lit(None).cast("int")
    for i, (regex, _) in reversed(list(enumerate(TS_SHAPES))):
        shape = F.when(text.rlike(f"^(?:{regex})$"), F.lit(i)).otherwise(shape)
    counts = df.where(F.col(col).isNotNull()).groupBy(shape.alias("shape")).agg(F.count(F.lit(1)).alias("n"))
    patterns = F.array(*[F.lit(fmt) for _, fmt in TS_SHAPES])
    return counts.select(F.get(patterns, F.col("shape")).alias("pattern"), "shape", "n")


def infer_ts_format(df: DataFrame, col: str) -> str:
    """The pattern of a text column's timestamps: the shape that most of its values have (ties:
    the earlier in ``TS_SHAPES``), counted over the whole column, so it depends neither on
    the rows' order nor on a few bad first values. The default for a column without values;
    values without any known shape are an error, not an empty table."""
    if col not in df.columns or df.schema[col].dataType != T.StringType():
        return DEFAULT_TS_FORMAT
    votes = ts_votes(df, col).collect()         # one row per shape at most
    known = [v for v in votes if v.shape is not None]
    if not known:
        if votes:
            raise UnknownTimestampFormat(f"none of the {votes[0].n} values of {col!r} has a known timestamp shape; pass ts_format")
        return DEFAULT_TS_FORMAT
    return min(known, key=lambda v: (-v.n, v.shape)).pattern


def timestamp_column(df: DataFrame, col: str, fmt: str = DEFAULT_TS_FORMAT) -> Column:
    """``col`` as ``timestamp_ntz``: typed timestamps and dates are taken as they are (zoned ones
    as wall-clock time of the session zone), only text is parsed."""
    if isinstance(df.schema[col].dataType, (T.TimestampNTZType, T.TimestampType, T.DateType)):
        return F.col(col).cast("timestamp_ntz")
    return parse_timestamp(col, fmt)
