"""Headered-CSV transaction reader (S1) with missing-value tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.functions.parse import na_to_null


def read_transactions(spark: SparkSession, path: str, na_tokens: list[str] | None = None,
                      multi_line: bool = False) -> DataFrame:
    """Read a headered CSV (file, directory or glob) with every column as text.

    No schema inference (that would need an extra pass over the data and could
    guess differently per file); parsing is explicit in ``clean_*``. Spark CSV
    takes a single ``nullValue``, so the full token list is applied as a
    projection instead. Quotes inside quoted fields are doubled (``""``). Set
    ``multi_line`` for files with line breaks inside quotes; such a file is then one
    task, so it is not the default.
    """
    raw = (spark.read.option("header", True).option("inferSchema", False)
           .option("quote", '"').option("escape", '"').option("multiLine", multi_line)
           .option("mode", "PERMISSIVE").csv(path))
    return raw.select(*[na_to_null(F.col(f"`{c}`"), na_tokens).alias(c) for c in raw.columns])


def write_transactions_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Write a transaction frame as headered CSV (one file per partition)."""
    (df.write.mode(mode).option("header", True).option("quote", '"').option("escape", '"')
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))
