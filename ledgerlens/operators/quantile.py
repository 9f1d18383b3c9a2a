"""Exact quantiles without gathering the column into one task or on the driver.

``percentile(c, p)`` is exact but its final merge holds every distinct value of the
column in one task. Here the order statistics of all ranks are searched together:
a pass splits each rank's current value range into ``BUCKETS`` equal parts and counts the
rows of every part with its least and greatest value (partially aggregated in each
task), so at most ``ranks * BUCKETS`` rows reach the driver whatever the column holds.
The part that contains the rank becomes its next range, narrowed to the values that
occur in it; a rank is found when its range holds one value. The same path runs at every
size, and a value that holds a third of the rows is one part like any other.

Linear interpolation between neighbouring ranks matches the usual ``quantile_cont`` /
pandas default. Infinite values count as the largest finite double.
"""

from __future__ import annotations

import math
import sys

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_ACCURACY = 10_000
BUCKETS = 1024


def _finite(col: str):
    c = F.col(col).cast("double")
    big = F.lit(sys.float_info.max)
    return F.when(c.isNotNull() & ~F.isnan(c), F.greatest(F.least(c, big), -big))


def _count_parts(vals: DataFrame, ranges: list[tuple[float, float]]) -> list[list]:
    """Per range its non-empty parts in value order."""
    v = F.col("v")
    which, part = F.lit(None).cast("int"), F.lit(None).cast("int")
    for i, (lo, hi) in enumerate(ranges):
        inside = (v >= F.lit(lo)) & (v <= F.lit(hi))
        # halves first, so the width of the widest range stays finite
        share = F.try_divide(v / 2 - F.lit(lo / 2), F.lit(hi / 2 - lo / 2))
        spot = F.coalesce(F.floor(share * BUCKETS), F.when(v == F.lit(lo), 0).otherwise(BUCKETS))
        which = F.when(inside, F.lit(i)).otherwise(which)
        part = F.when(inside, F.least(spot, F.lit(BUCKETS - 1)).cast("int")).otherwise(part)
    rows = (vals.select("v", which.alias("r"), part.alias("p")).where("r is not null").groupBy("r", "p")
            .agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("least"), F.max("v").alias("most")).collect())
    parts: list[list] = [[] for _ in ranges]
    for x in sorted(rows, key=lambda x: (x.r, x.p)):
        parts[x.r].append(x)
    return parts


def _kth_values(vals: DataFrame, ranks: list[int], least: float, most: float) -> dict[int, float]:
    """Exact values at 0-based ``ranks`` of the column ``v``."""
    open_ = {k: (least, most, 0) for k in ranks}        # range and rows below it
    found: dict[int, float] = {}
    while open_:
        for k, (lo, hi, _) in list(open_.items()):
            if lo == hi:
                found[k] = lo
                del open_[k]
        ranges = sorted({(lo, hi) for lo, hi, _ in open_.values()})
        if not ranges:
            break
        parts = _count_parts(vals, ranges)
        for k, (lo, hi, below) in open_.items():
            for x in parts[ranges.index((lo, hi))]:
                if k < below + x.n:
                    break
                below += x.n
            open_[k] = (x.least, x.most, below)
    return found


def exact_quantiles(df: DataFrame, col: str, probs: list[float]) -> list[float | None]:
    """Exact linearly-interpolated quantiles of ``col`` (NULL and NaN ignored).

    A *fit* step: a few passes over one column, which is kept for them."""
    vals = df.select(_finite(col).alias("v")).where(F.col("v").isNotNull()).persist()
    try:
        n, least, most = vals.agg(F.count(F.lit(1)), F.min("v"), F.max("v")).first()
        if n == 0:
            return [None for _ in probs]
        pos = [p * (n - 1) for p in probs]
        ranks = sorted({math.floor(x) for x in pos} | {math.ceil(x) for x in pos})
        kth = _kth_values(vals, ranks, least, most)
    finally:
        vals.unpersist()
    return [kth[math.floor(x)] + (x - math.floor(x)) * (kth[math.ceil(x)] - kth[math.floor(x)]) for x in pos]


def approx_quantiles(df: DataFrame, col: str, probs: list[float],
                     accuracy: int = DEFAULT_ACCURACY) -> list[float | None]:
    """Sketch-based quantiles (one pass, fixed memory, rank error ≤ n/accuracy)."""
    r = df.agg(F.percentile_approx(F.col(col).cast("double"), probs, accuracy).alias("q")).first()["q"]
    return [None for _ in probs] if r is None else [float(x) for x in r]
