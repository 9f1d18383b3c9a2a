"""Top-N reads (S5), JSON record sink (S6) and database-table access."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class TableMissing(RuntimeError):
    """The requested table or one of its columns does not exist."""


def latest_n(df: DataFrame, ts_col: str, n: int, cols: list[str] | None = None,
             tie_col: str | None = None) -> DataFrame:
    """Newest ``n`` rows by ``ts_col`` (ties broken by ``tie_col`` descending).

    ``orderBy(...).limit(n)`` plans as ``TakeOrderedAndProject``: each task keeps
    its own top ``n`` and only ``n × tasks`` rows reach the final merge.
    """
    try:
        keys = [F.col(ts_col).desc_nulls_last()]
        if tie_col:
            keys.append(F.col(tie_col).desc_nulls_last())
        out = df.orderBy(*keys).limit(n)
        return out.select(*cols) if cols else out
    except AnalysisException as e:  # unresolved column
        raise TableMissing(f"column missing for latest_n: {e}") from e


def read_db_table(spark: SparkSession, url: str, table: str, properties: dict | None = None,
                  partition_column: str | None = None, lower: int | None = None,
                  upper: int | None = None, num_partitions: int | None = None) -> DataFrame:
    """Read a database table over JDBC; parallel range reads when a partition column is given."""
    try:
        reader = spark.read.options(**jdbc_options(url, table, properties))
        if partition_column:
            reader = reader.options(partitionColumn=partition_column, lowerBound=str(lower),
                                    upperBound=str(upper), numPartitions=str(num_partitions))
        return reader.format("jdbc").load()
    except AnalysisException as e:
        raise TableMissing(f"table {table!r} is not readable: {e}") from e


def latest_n_from_db(spark: SparkSession, url: str, table: str, ts_col: str, n: int, cols: list[str] | None = None,
                     tie_col: str | None = None, properties: dict | None = None) -> DataFrame:
    """Newest ``n`` rows of a database table; order, limit and projection run in the
    database, so ``n`` rows travel. Names are quoted."""
    try:
        return spark.read.options(**jdbc_options(url, top_n_query(table, ts_col, n, cols, tie_col), properties)).format("jdbc").load()
    except AnalysisException as e:
        raise TableMissing(f"table {table!r} is not readable: {e}") from e


def top_n_query(table: str, ts_col: str, n: int, cols: list[str] | None = None, tie_col: str | None = None) -> str:
    """The derived table of ``latest_n_from_db``."""
    quoted = lambda x: '"' + x.replace('"', '""') + '"'
    keys = [f"{quoted(c)} DESC NULLS LAST" for c in (ts_col, tie_col) if c]
    what = ", ".join(map(quoted, cols)) if cols else "*"
    name = ".".join(map(quoted, table.split(".")))
    return f"(SELECT {what} FROM {name} ORDER BY {', '.join(keys)} LIMIT {int(n)}) AS latest"


def jdbc_options(url: str, table: str, properties: dict | None = None) -> dict[str, str]:
    """Options for ``spark.read.format('jdbc')`` (no connection is opened here)."""
    opts = {"url": url, "dbtable": table, "fetchsize": "10000"}
    opts.update({k: str(v) for k, v in (properties or {}).items()})
    return opts


def _json_ready(df: DataFrame) -> list:
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            # a fraction where there is one, an offset where the type has a zone
            zone = "xxx" if isinstance(f.dataType, T.TimestampType) else ""
            whole = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss" + zone)
            c = F.when(F.date_format(c, "SSSSSS") == "000000", whole).otherwise(
                F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS" + zone))
        elif isinstance(f.dataType, T.DateType):
            c = F.date_format(c, "yyyy-MM-dd")
        elif isinstance(f.dataType, T.DecimalType):
            c = c.cast("double")
        cols.append(c.alias(f.name))
    return cols


def to_json_records(df: DataFrame) -> DataFrame:
    """One JSON object per row in a ``value`` column; ISO timestamps, decimals as numbers."""
    return df.select(F.to_json(F.struct(*_json_ready(df)), {"ignoreNullFields": "false"}).alias("value"))


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """JSON-lines sink with the same value conversions as ``to_json_records``."""
    df.select(*_json_ready(df)).write.mode(mode).option("ignoreNullFields", "false").json(path)
