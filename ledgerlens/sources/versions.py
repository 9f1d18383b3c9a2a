"""A log of versions in a shared folder: what a reader sees is always one whole commit.

A version is a small JSON text that names the files it consists of. Writers put their files
into fresh folders first and commit the text last, as a one-row Parquet folder of its own; Spark
moves the row's file into place in one rename when the write job commits. A writer that
stops earlier leaves files that no version names, and readers go on with the version before.
"""

from __future__ import annotations

import json
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import SparkSession
from pyspark.sql import functions as F


class VersionConflict(RuntimeError):
    """Another writer committed a version in between."""


class VersionLog:
    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    def fresh(self, name: str) -> str:
        """A folder for files of a version still to be committed."""
        return f"{self.root}/files/{name}-{uuid.uuid4().hex}"

    def latest(self) -> tuple[int, dict]:
        """The last version's number and content; (0, {}) before the first commit."""
        try:
            log = self.spark.read.schema("version long, content string, writer string").option(
                "recursiveFileLookup", True).parquet(f"{self.root}/versions")
        except AnalysisException:
            return 0, {}
        # of two commits of one number (a race) every reader takes the same one
        row = log.orderBy(F.desc("version"), F.asc("writer")).limit(1).collect()
        return (row[0].version, json.loads(row[0].content)) if row else (0, {})

    def commit(self, content: dict, after: int) -> int:
        """Makes ``content`` the version that follows ``after``."""
        if self.latest()[0] != after:
            raise VersionConflict(f"{self.root}: version {after} is not the last one any more")
        version, writer = after + 1, uuid.uuid4().hex
        row = self.spark.range(1).select(F.lit(version).cast("long").alias("version"), F.lit(json.dumps(content)).alias("content"),
                                         F.lit(writer).alias("writer"))
        row.coalesce(1).write.parquet(f"{self.root}/versions/{version:09d}-{writer}")
        if self.latest() != (version, content):
            raise VersionConflict(f"{self.root}: version {version} was committed by another writer")
        return version
