"""Session settings the plans are written for, and the shared checkpoint folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Runtime re-planning: coalesce small shuffle partitions, split skewed join
# partitions (a hot key holding a large share of rows), and demote joins to
# broadcast only when the runtime size is small.
RECOMMENDED_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "4",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    # 100 TB at 512 MB per scan split is ~200k tasks: a few waves on 1000
    # executors, with little per-task overhead.
    "spark.sql.files.maxPartitionBytes": "512m",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(master: str | None = None, app: str = "ledgerlens",
                  shuffle_partitions: int | None = None, extra: dict | None = None) -> SparkSession:
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    for k, v in RECOMMENDED_CONF.items():
        b = b.config(k, v)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    shared_dir(spark)
    return spark


def shared_dir(spark: SparkSession, sub: str | None = None) -> str:
    """The cluster-shared folder named by ``spark.checkpoint.dir``.

    Read from the session; where it is unset, a folder inside the session's warehouse,
    which every executor reaches, is used and registered.
    """
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 — remote (Connect) sessions expose no context
        sc = None
    base = spark.conf.get("spark.checkpoint.dir", None) or (sc.getCheckpointDir() if sc else None)
    if not base:
        base = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_shared"
        spark.conf.set("spark.checkpoint.dir", base)
    if sc is not None and sc.getCheckpointDir() is None:
        sc.setCheckpointDir(base)
    base = base.rstrip("/")
    return f"{base}/{sub}" if sub else base


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once in the shared folder and read back, so that several passes over it
    compute it once and read only the columns they need. Any column names and untyped
    (``void``) columns are kept."""
    fields = df.schema.fields
    path = shared_dir(df.sparkSession, f"scratch/{name}-{uuid.uuid4().hex}")
    plain = df.toDF(*[f"c{i}" for i in range(len(fields))])
    plain = plain.withColumns({f"c{i}": F.col(f"c{i}").cast("string") for i, f in enumerate(fields) if f.dataType.typeName() == "void"})
    plain.write.parquet(path)
    back = df.sparkSession.read.schema(plain.schema).parquet(path)
    return back.select(*[(F.lit(None) if f.dataType.typeName() == "void" else F.col(f"c{i}")).alias(f.name) for i, f in enumerate(fields)])


def advisory_bytes(spark: SparkSession) -> int:
    """The size a task's data should have, as the session's adaptive execution is told."""
    text = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64m").strip().lower().rstrip("b")
    units = {"k": 1 << 10, "m": 1 << 20, "g": 1 << 30, "t": 1 << 40}
    return max(1, int(text[:-1]) * units[text[-1]] if text[-1:] in units else int(text))
