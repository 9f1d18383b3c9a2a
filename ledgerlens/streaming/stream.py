"""File-stream source → cleaning / scoring → parquet sink with checkpointed progress."""

from __future__ import annotations

import hashlib

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ledgerlens.functions.parse import na_to_null
from ledgerlens.operators.clean import clean_fraud_input
from ledgerlens.operators.fraud import FraudModel, score
from ledgerlens.schema import RAW_SCHEMA
from ledgerlens.session import shared_dir


def read_transaction_stream(spark: SparkSession, path: str, max_files_per_trigger: int = 100,
                            columns: list[str] | None = None) -> DataFrame:
    """New headered CSV files under ``path`` as a stream of raw text rows.

    A stream needs its columns up front: ``columns``, else the header of the files that are
    already there, else the ten usual ones; every column is text, parsed by the same
    cleaning operators as batch data. A file whose header has another order stops the
    stream with an error instead of having its columns swapped.
    """
    if columns is None:
        try:
            columns = spark.read.option("header", True).csv(path).columns
        except AnalysisException:       # no file yet
            columns = []
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns]) if columns else RAW_SCHEMA
    raw = (spark.readStream.schema(schema).option("header", True).option("enforceSchema", False)
           .option("quote", '"').option("escape", '"').option("maxFilesPerTrigger", max_files_per_trigger).csv(path))
    return raw.select(*[na_to_null(F.col(f"`{c}`")).alias(c) for c in raw.columns])


def scored_stream(model: FraudModel, raw_stream: DataFrame) -> DataFrame:
    """Clean (fraud path) and score each arriving row with a fitted model."""
    return score(model, clean_fraud_input(raw_stream))


def start_sink(df: DataFrame, path: str, checkpoint: str | None = None,
               available_now: bool = False, processing_time: str | None = None) -> StreamingQuery:
    """Append ``df`` to parquet at ``path``.

    Progress and sink metadata live under ``checkpoint`` (default: a folder of the shared
    ``spark.checkpoint.dir`` that belongs to the sink path), so a restarted query resumes
    exactly where the last committed batch ended, also after losing executors or the driver.
    """
    own = hashlib.sha1(path.rstrip("/").encode()).hexdigest()[:16]
    ckpt = checkpoint or shared_dir(df.sparkSession, f"streams/{own}")
    w = df.writeStream.format("parquet").option("path", path).option("checkpointLocation", ckpt) \
        .outputMode("append")
    if available_now:
        w = w.trigger(availableNow=True)
    elif processing_time:
        w = w.trigger(processingTime=processing_time)
    return w.start()
