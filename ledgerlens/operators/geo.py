"""Geographic breakdown (G1-G4): map bubbles and choropleth classes.

Inputs are post-aggregate location sales (one row per location); the province
lookup is a fixed 10-row table, so joins against it broadcast with a known bound.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlens.schema import (
    BUBBLE_MIN_RADIUS, BUBBLE_SCALE, CHOROPLETH_CUTS, PROVINCE_ALIASES, PROVINCE_COORDS,
    PROVINCE_PREFIXES,
)


def province_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PROVINCE_COORDS, "province string, lat double, lon double")


def _max_value() -> Column:
    """max(value) over all locations, floored at 1: a window over the
    post-aggregate sales (one row per location), so no second scan."""
    return F.greatest(F.max(F.col("value").cast("double")).over(Window.partitionBy()), F.lit(1.0))


def map_points(sales: DataFrame, coords: DataFrame | None = None) -> DataFrame:
    """Attach coordinates (unknown locations dropped) and a bubble radius
    ``max(5, value / max · 25)``. The fixed table is broadcast; how a caller's own is joined
    follows its size."""
    coords = coords if coords is not None else F.broadcast(province_table(sales.sparkSession))
    s = sales.withColumn("max_value", _max_value())   # before the join drops unknown places
    j = s.join(coords, s["label"] == coords["province"])
    return j.select("label", "value", "lat", "lon",
                    F.greatest(F.lit(BUBBLE_MIN_RADIUS), F.col("value") / F.col("max_value") * F.lit(BUBBLE_SCALE))
                    .alias("radius"))


def normalise_province(c: Column) -> Column:
    """Drop the administrative prefixes from a province name."""
    for p in PROVINCE_PREFIXES:
        c = F.replace(c, F.lit(p), F.lit(""))
    return c


def _alias(c: Column) -> Column:
    out = None
    for k, v in PROVINCE_ALIASES.items():
        out = F.when(c == k, F.lit(v)) if out is None else out.when(c == k, F.lit(v))
    return out


def choropleth_class(value: Column, max_value: Column) -> Column:
    """4 / 3 / 2 / 1 for > 0.8 / 0.5 / 0.2 / 0 of the maximum, else 0."""
    hi, mid, lo = CHOROPLETH_CUTS
    return (F.when(value > max_value * hi, 4).when(value > max_value * mid, 3)
            .when(value > max_value * lo, 2).when(value > 0, 1).otherwise(0))


def map_classes(sales: DataFrame, provinces: DataFrame | None = None) -> DataFrame:
    """One row per province name with its sales value and fill class.

    Names are normalised; a province with no direct value takes its alias's
    value (TP.HCM ≡ Hồ Chí Minh). ``provinces`` needs a ``province`` column.
    A province matching no sales row has value 0 and class 0.
    """
    provinces = provinces if provinces is not None else province_table(sales.sparkSession)
    s = sales.select(F.col("label").alias("k"), F.col("value").alias("v"), _max_value().alias("mx"))
    p = provinces.select("province").withColumn("clean", normalise_province(F.col("province")))
    p = p.withColumn("alias", _alias(F.col("clean")))
    direct = s.withColumnsRenamed({"k": "k1", "v": "v1", "mx": "mx1"})
    other = s.withColumnsRenamed({"k": "k2", "v": "v2", "mx": "mx2"})
    j = (p.join(direct, p["clean"] == direct["k1"], "left")
         .join(other, p["alias"] == other["k2"], "left"))
    v1 = F.coalesce(F.col("v1"), F.lit(0.0))
    val = F.when(v1 == 0, F.coalesce(F.col("v2"), F.lit(0.0))).otherwise(v1)
    mx = F.coalesce(F.col("mx1"), F.col("mx2"), F.lit(1.0))
    return j.select("province", val.alias("value"), choropleth_class(val, mx).alias("fill_class"))
