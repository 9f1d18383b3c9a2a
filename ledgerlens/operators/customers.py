"""Customer analytics (U1-U10): RFM, scaling, K-Means segments and their reports."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.money import money, trunc_to_long
from ledgerlens.operators.kmeans import Clustering, fit_restarts
from ledgerlens.session import advisory_bytes
from ledgerlens.schema import (
    AMOUNT, KMEANS_K, KMEANS_RESTARTS, MODEL_SEED, PAYMENT, SEGMENT_NAMES, TS, TX_ID, USER_ID,
)

STEP_ROW_BYTES = 64          # of one (user, restart) pair in a K-Means step
RFM_COLS = ["Recency", "Frequency", "Monetary"]


class TooFewUsers(ValueError):
    """Fewer distinct users than requested clusters."""


def rfm(df: DataFrame) -> DataFrame:
    """One row per user — Recency (whole days before max(ts) + 1 day),
    Frequency (non-null transaction ids), Monetary (sum of amounts).

    The reference date is a scalar subquery; the per-user fold is one
    aggregate with map-side partial aggregation (a heavy user is collapsed
    inside each task).
    """
    ref = df.agg(F.max(TS)).scalar() + F.expr("INTERVAL 1 DAY")
    g = (df.where(F.col(USER_ID).isNotNull()).groupBy(USER_ID)
         .agg(F.max(TS).alias("last"), F.count(TX_ID).alias("Frequency"),
              F.sum(money(AMOUNT)).cast("double").alias("Monetary")))
    # NTZ minus NTZ is a day-time interval computed without any time zone;
    # its DAY field is the count of whole 24-hour days.
    recency = F.extract(F.lit("DAY"), ref - F.col("last")).cast("bigint")
    return g.select(USER_ID, recency.alias("Recency"), "Frequency", "Monetary")


def rfm_scaled(rfm_df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Standardise with the population std; a zero std maps to 0.

    Means and stds are one struct-valued scalar subquery over the RFM frame.
    """
    cols = cols or RFM_COLS
    st = rfm_df.agg(F.struct(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(cols)],
                             *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(cols)])).scalar()
    scaled = {}
    for i, c in enumerate(cols):
        s = st[f"s{i}"]
        scaled[f"{c}_scaled"] = F.when(s == 0, F.lit(0.0)).otherwise((F.col(c) - st[f"m{i}"]) / s)
    return rfm_df.withColumns(scaled)


def fit_segments(rfm_df: DataFrame, k: int = KMEANS_K, n_init: int = KMEANS_RESTARTS,
                 seed: int = MODEL_SEED, max_iter: int = 300, path: str | None = None,
                 keep: bool = False) -> tuple[Clustering, DataFrame]:
    """K-Means on the scaled RFM vectors, ``n_init`` restarts (seeds
    ``seed … seed+n_init-1``) fitted together (one job per step), keeping the lowest cost.

    The scaled rows are persisted for the fit; a step reads them in tasks of the session's
    advisory size, so a small table is one task and a large one as many as it needs. Returns ``(clustering,
    frame with Cluster)``. The frame is computed from the RFM rows when used; with ``path`` it
    is written there and read back (the caller owns that folder), with ``keep`` it stays
    persisted until the caller unpersists it.
    """
    cols = [f"{c}_scaled" for c in RFM_COLS]
    scaled = rfm_scaled(rfm_df)
    data = scaled.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        n_users = data.count()
        if n_users < k:
            raise TooFewUsers(f"{n_users} users cannot form {k} clusters")
        # the reference library's rule: summed squared centre shift <= 1e-4 x mean feature
        # variance, which is 1 after scaling
        # a step's work is one row per user and restart: tasks of the session's advisory size
        tasks = max(1, n_users * n_init * STEP_ROW_BYTES // advisory_bytes(rfm_df.sparkSession))
        best = fit_restarts(data.coalesce(tasks), cols, USER_ID, k, list(range(seed, seed + n_init)), max_iter, tol=1e-4)
        if path or keep:
            frame = data.select(*rfm_df.columns, best.cluster().alias("Cluster"))
            if not path:
                frame = frame.persist(StorageLevel.MEMORY_AND_DISK)
                frame.count()
                return best, frame
            frame.write.mode("overwrite").parquet(path)
            return best, rfm_df.sparkSession.read.parquet(path)
    finally:
        data.unpersist()
    return best, scaled.select(*rfm_df.columns, best.cluster().alias("Cluster"))


def name_segments(clustered: DataFrame, names: list[str] | None = None) -> DataFrame:
    """U4: clusters ranked by ascending mean Monetary take ``names`` in order
    (extra clusters take the last name). The k-row name table is broadcast."""
    names = names or SEGMENT_NAMES
    means = clustered.groupBy("Cluster").agg(F.avg("Monetary").alias("mean_monetary"))
    from pyspark.sql import Window

    rk = F.row_number().over(Window.orderBy("mean_monetary", "Cluster"))
    arr = F.array(*[F.lit(n) for n in names])
    table = means.select("Cluster", F.element_at(arr, F.least(rk, F.lit(len(names)))).alias("Segment_Name"))
    return clustered.join(F.broadcast(table), "Cluster")


def segment_totals(segmented: DataFrame) -> DataFrame:
    """Users and spend per segment, ``rank`` by user count descending."""
    from pyspark.sql import Window

    g = segmented.groupBy(F.col("Segment_Name").alias("segment")).agg(
        F.count(USER_ID).alias("user_count"), F.sum(money("Monetary")).cast("double").alias("total_spend"))
    return g.withColumn("rank", F.row_number().over(
        Window.orderBy(F.col("user_count").desc(), F.col("segment"))))


def preferred_payment(df: DataFrame) -> DataFrame:
    """Each user's most used payment method (ties → smallest name).

    Two aggregates, no window: ``(user, method)`` counts, then a per-user
    ``min_by`` over ``(-count, method)`` — a heavy user never becomes one
    sorted window partition.
    """
    c = (df.where(F.col(USER_ID).isNotNull() & F.col(PAYMENT).isNotNull())
         .groupBy(USER_ID, PAYMENT).agg(F.count(F.lit(1)).alias("n")))
    return most_used(c)


def most_used(c: DataFrame) -> DataFrame:
    """U7 of counts ``n`` per (user, method)."""
    return c.groupBy(USER_ID).agg(
        F.min_by(PAYMENT, F.struct((-F.col("n")).alias("m"), F.col(PAYMENT).alias("p")))
        .alias("preferred_payment_method"))


def top_users(rfm_like: DataFrame, tx_df: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` biggest spenders with count, preferred method and segment
    (when present). The ``n`` ids are broadcast to cut the transaction scan
    down to their rows before the per-user mode."""
    keep = [USER_ID, "Frequency", "Monetary"] + (["Segment_Name"] if "Segment_Name" in rfm_like.columns else [])
    top = rfm_like.select(*keep).orderBy(F.col("Monetary").desc(), F.col(USER_ID)).limit(n)
    ids = F.broadcast(top.select(USER_ID))
    pref = preferred_payment(tx_df.join(ids, USER_ID, "left_semi"))
    j = top.join(F.broadcast(pref), USER_ID, "left")
    cols = [F.col(USER_ID).cast("string").alias("user_id"),
            trunc_to_long("Monetary").alias("total_spend"),
            F.col("Frequency").cast("long").alias("transaction_count"),
            F.col("preferred_payment_method")]
    if "Segment_Name" in rfm_like.columns:
        cols.append(F.col("Segment_Name").alias("segment"))
    return j.select(*cols)


def segment_profile(segmented: DataFrame) -> DataFrame:
    """Users and mean R/F/M per segment, plus the UI's rounded forms."""
    g = segmented.groupBy("Segment_Name").agg(
        F.count(USER_ID).alias("users"), F.avg("Recency").alias("mean_recency"),
        F.avg("Frequency").alias("mean_frequency"), F.avg("Monetary").alias("mean_monetary"))
    return g.withColumns({
        "recency_days": F.round("mean_recency", 0).cast("int"),
        "frequency_1dp": F.round("mean_frequency", 1),
    })


def export_segments(segmented: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Per-user segments written as parquet partitioned by segment."""
    segmented.write.mode(mode).partitionBy("Segment_Name").parquet(path)


def user_analytics(df: DataFrame, segmented: DataFrame | None = None) -> dict[str, DataFrame]:
    """U8: segments (U5), top users (U6), count by hour (B8) and weekday (B9) of a
    (filtered) frame. Segments are fitted here unless given; a frame without users gives
    four empty results."""
    from ledgerlens.operators.metrics import count_by_hour, count_by_weekday

    if segmented is None:
        users = rfm(df)
        if users.head(1):
            segmented = name_segments(fit_segments(users)[1])
        else:
            segmented = users.withColumns({"Cluster": F.lit(0), "Segment_Name": F.lit("")})
    return {
        "segments": segment_totals(segmented),
        "top_users": top_users(segmented, df),
        "by_hour": count_by_hour(df),
        "by_day": count_by_weekday(df),
    }
