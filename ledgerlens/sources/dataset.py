"""Choosing and switching the active dataset.

A :class:`Dataset` owns one raw source (headered CSV or parquet), its cleaned
frame (persisted on first use) and the fraud-model registry folder tied to it.
Switching datasets closes the old one: cached blocks are released and its
trained models are no longer offered.
"""

from __future__ import annotations

import hashlib

from pyspark import StorageLevel
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.functions.parse import infer_ts_format
from ledgerlens.schema import TS
from ledgerlens.session import shared_dir
from ledgerlens.sources.csv import read_transactions


class DatasetError(ValueError):
    """Missing file or unsupported format."""


MONTH = "month"


class Dataset:
    def __init__(self, spark: SparkSession, path: str, fmt: str, ts_format: str | None = None):
        self.spark = spark
        self.path = path
        self.fmt = fmt
        self.ts_format = ts_format
        self.key = self._signature()
        self._clean: DataFrame | None = None
        self._clean_format: str | None = None
        self._months = False
        self.closed = False

    def _signature(self) -> str:
        """Names the data: path plus the listing's file names, sizes and times, so a reopened
        dataset finds its models and a changed file does not. Only file metadata is
        read, folded on the executors."""
        files = (self.spark.read.format("binaryFile").option("recursiveFileLookup", True).load(self.path)
                 .select(F.xxhash64("path", "length", "modificationTime").cast("decimal(38,0)").alias("h")))
        n, total = files.agg(F.count(F.lit(1)), F.sum("h")).first()
        return hashlib.sha1(f"{self.path}|{n}|{total}".encode()).hexdigest()[:12]

    # -- frames -------------------------------------------------------------
    def raw(self) -> DataFrame:
        if self.fmt == "csv":
            return read_transactions(self.spark, self.path)
        return self.spark.read.parquet(self.path)

    def cleaned(self, ts_format: str | None = None) -> DataFrame:
        """Cleaned dashboard frame, persisted (memory, spilling to disk) on first use. The
        timestamp pattern is ``ts_format``, else the dataset's, else the one its first
        values have; asking for another pattern cleans anew."""
        self._check_open()
        wanted = ts_format or self.ts_format
        if self._clean is None or (ts_format and ts_format != self._clean_format):
            frame, fmt = self._cleaned(wanted)
            self._release()
            self._clean, self._clean_format = frame.persist(StorageLevel.MEMORY_AND_DISK), fmt
        return self._clean

    def _cleaned(self, ts_format: str | None) -> tuple[DataFrame, str]:
        from ledgerlens.operators.clean import clean_transactions

        raw = self.raw()
        fmt = ts_format or infer_ts_format(raw, TS)
        return clean_transactions(raw, ts_format=fmt), fmt

    def materialize(self, path: str | None = None, ts_format: str | None = None) -> DataFrame:
        """Write the cleaned table once as parquet partitioned by month and read it back.

        The write cuts the lineage back to the CSV text (a lost executor then
        re-reads parquet, not re-parses CSV). Rows are dealt by month first, heavy months
        over several tasks, so the number of files follows the data's size. The ``month``
        column stays: ``between`` turns a time range into a predicate on it that prunes
        folders. The default location is under the shared ``spark.checkpoint.dir``.
        """
        self._check_open()
        frame, fmt = self._cleaned(ts_format or self.ts_format)
        out = path or shared_dir(self.spark, f"datasets/{self.key}-{hashlib.sha1(fmt.encode()).hexdigest()[:6]}/clean")
        frame.withColumn(MONTH, F.date_format(TS, "yyyy-MM")).hint("rebalance", MONTH).write.mode("overwrite") \
            .partitionBy(MONTH).parquet(out)
        fresh = self.spark.read.parquet(out).withColumn(MONTH, F.col(MONTH).cast("string"))
        self._release()
        self._clean, self._clean_format, self._months = fresh, fmt, True
        return fresh

    def rollup(self):
        """The roll-up of the cleaned table (``plans.rollup``), built on first use and found
        again by every later session: its folder is named by the files' signature."""
        from ledgerlens.plans.rollup import Rollup

        clean = self.cleaned()
        made = Rollup(self.spark, shared_dir(self.spark, f"datasets/{self.key}-{hashlib.sha1(self._clean_format.encode()).hexdigest()[:6]}/rollup"))
        if not made.version:
            made.add(clean)
        return made

    def between(self, start=None, stop=None) -> DataFrame:
        """Cleaned rows from ``start`` up to before ``stop`` (either may be None)."""
        out = self.cleaned()
        for value, after in ((start, True), (stop, False)):
            if value is None:
                continue
            at = F.lit(value).cast("timestamp_ntz")
            out = out.where(F.col(TS) >= at if after else F.col(TS) < at)
            if self._months:
                month = F.date_format(at, "yyyy-MM")
                out = out.where(F.col(MONTH) >= month if after else F.col(MONTH) <= month)
        return out

    def registry_path(self) -> str:
        return shared_dir(self.spark, f"models/{self.key}")

    # -- lifecycle ----------------------------------------------------------
    def _release(self) -> None:
        if self._clean is not None:
            self._clean.unpersist()
            self._clean, self._clean_format, self._months = None, None, False

    def close(self) -> None:
        self._release()
        self.closed = True

    def _check_open(self) -> None:
        if self.closed:
            raise DatasetError(f"dataset {self.path!r} was closed")


def open_dataset(spark: SparkSession, path: str, previous: Dataset | None = None,
                 ts_format: str | None = None) -> Dataset:
    """Open ``path`` (``.csv`` file/folder or parquet); closes ``previous`` on success.

    Existence is checked by resolving the source (the reader lists the files
    through the cluster file system), so HDFS/S3 paths work the same way.
    """
    p = path.rstrip("/").lower()
    if p.endswith(".csv"):
        fmt = "csv"
    elif p.endswith(".parquet"):
        fmt = "parquet"
    else:
        raise DatasetError(f"unsupported dataset type (need .csv or .parquet): {path}")
    try:
        reader = spark.read.option("header", True) if fmt == "csv" else spark.read
        reader.format(fmt).load(path).schema  # resolves the file listing only
    except AnalysisException as e:
        raise DatasetError(f"dataset not found: {path}") from e
    ds = Dataset(spark, path, fmt, ts_format)
    if previous is not None:
        previous.close()
    return ds
