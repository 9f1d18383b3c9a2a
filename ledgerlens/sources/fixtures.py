"""Transaction views derived from the driver's star-schema tables.

* ``tx_raw`` — dirty CSV-like text rows built from ``events`` (hours, weekdays,
  a planted fraud rule, injected bad values).
* ``tx``     — ``tx_raw`` cleaned (C1-C8).
* ``tx_o``   — clean multi-month rows built from ``orders``.

Joins: ``events``/``orders`` ⋈ ``customer`` is the large equi-join (broadcast
while customer is small, else sort-merge with AQE splitting hot keys); the city
comes from the 25-row nation ⋈ region map, broadcast onto the joined rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.schema import (
    AMOUNT, CATEGORY, FRAUD, HOUR, LOCATION, PAYMENT, TS, TX_ID, USER_ID, WEEKEND,
)

# FIXED VALUES — region name → city used as the transaction location.
REGION_CITY = {
    "AFRICA": "Hà Nội",
    "AMERICA": "TP.HCM",
    "ASIA": "Đà Nẵng",
    "EUROPE": "Cần Thơ",
}
OTHER_REGION_CITY = "Hải Phòng"

# FIXED VALUES — event type → raw (English) merchant category.
EVENT_CATEGORY = {
    "click": "Transport",
    "view": "Utilities",
    "purchase": "Shopping",
    "signup": "Supermarket",
}
OTHER_EVENT_CATEGORY = "Food & Beverage"

# FIXED VALUES — props.k modulo 4 → raw payment method.
PAYMENT_BY_K = ["E-Wallet", "Credit Card", "Bank Transfer"]
OTHER_PAYMENT = "QR"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _case(c: Column, mapping: dict, other: str) -> Column:
    expr = None
    for k, v in mapping.items():
        expr = F.when(c == k, v) if expr is None else expr.when(c == k, v)
    return expr.otherwise(other)


def nation_city(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(n_nationkey, city): 25 rows, the region name mapped to a city."""
    nation = read_table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    region = read_table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    return (nation.join(region, nation.n_regionkey == region.r_regionkey)
            .select("n_nationkey", _case(F.col("r_name"), REGION_CITY, OTHER_REGION_CITY).alias("city")))


def with_city(facts: DataFrame, key: str, spark: SparkSession, sf_dir: str,
              customer_cols: tuple[str, ...] = ()) -> DataFrame:
    """Attach the customer's city to fact rows keyed by customer ``key``.

    Facts join ``customer`` first (one row per customer: the dimension is the
    build side — broadcast while small, else a sort-merge join whose hot keys
    AQE splits), then the 25-row nation→city map, which is always broadcast.
    Joining customer to nation first would hide the customer table's size
    behind a join estimate and can flip the build side onto the fact table.
    """
    cust = read_table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", *customer_cols)
    j = facts.join(cust, facts[key] == cust.c_custkey)
    city = F.broadcast(nation_city(spark, sf_dir))
    return j.join(city, j.c_nationkey == city.n_nationkey).drop("n_nationkey", "c_nationkey")


def _facts(spark: SparkSession, sf_dir: str, name: str, partitions: int | None) -> DataFrame:
    """A fact table; ``partitions`` spreads a file that arrives as a single split
    (one row group) over the cores before the per-row work — a cluster's many
    input files need no such step."""
    df = read_table(spark, sf_dir, name)
    return df.repartition(partitions) if partitions else df


def tx_raw(spark: SparkSession, sf_dir: str, partitions: int | None = None) -> DataFrame:
    """Dirty text rows, one per event (see module doc)."""
    j = with_city(_facts(spark, sf_dir, "events", partitions), "user_id", spark, sf_dir)
    eid, value, ts = F.col("event_id"), F.col("value"), F.col("ts")
    k = F.get_json_object("props", "$.k").cast("int")
    payment = F.when(k % 4 == 0, PAYMENT_BY_K[0]).when(k % 4 == 1, PAYMENT_BY_K[1]) \
        .when(k % 4 == 2, PAYMENT_BY_K[2]).otherwise(OTHER_PAYMENT)
    return j.select(
        F.concat(F.lit("E"), eid.cast("string")).alias(TX_ID),
        F.concat(F.lit("U"), F.col("user_id").cast("string")).alias(USER_ID),
        F.when(eid % 89 == 0, "abc").when(eid % 91 == 0, "NA")
         .otherwise(value.cast("decimal(18,2)").cast("string")).alias(AMOUNT),
        F.when(eid % 97 == 0, "not-a-date")
         .otherwise(F.date_format(ts, "yyyy-MM-dd HH:mm:ss")).alias(TS),
        payment.alias(PAYMENT),
        _case(F.col("event_type"), EVENT_CATEGORY, OTHER_EVENT_CATEGORY).alias(CATEGORY),
        F.when(eid % 83 == 0, F.lit(None).cast("string")).otherwise(F.col("city")).alias(LOCATION),
        F.when(eid % 101 == 0, "x").when((value >= 100) & (F.hour(ts) < 6), "1")
         .otherwise("0").alias(FRAUD),
        F.when(eid % 103 == 0, "h").otherwise(F.hour(ts).cast("string")).alias(HOUR),
        F.when(F.weekday(ts) >= 5, "1").otherwise("0").alias(WEEKEND),
    )


def tx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``tx_raw`` cleaned for the dashboards (bad timestamps dropped)."""
    from ledgerlens.operators.clean import clean_transactions

    return clean_transactions(tx_raw(spark, sf_dir))


def tx_fraud(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``tx_raw`` cleaned for the fraud models (timestamps not needed, no rows dropped)."""
    from ledgerlens.operators.clean import clean_fraud_input

    return clean_fraud_input(tx_raw(spark, sf_dir))


def tx_o(spark: SparkSession, sf_dir: str, partitions: int | None = None) -> DataFrame:
    """Clean multi-month transactions, one per order."""
    j = with_city(_facts(spark, sf_dir, "orders", partitions), "o_custkey", spark, sf_dir, ("c_mktsegment",))
    return j.select(
        F.col("o_orderkey").cast("string").alias(TX_ID),
        F.col("o_custkey").cast("string").alias(USER_ID),
        F.col("o_totalprice").alias(AMOUNT),
        F.col("o_orderdate").cast("timestamp_ntz").alias(TS),
        F.col("o_orderpriority").alias(PAYMENT),
        F.col("c_mktsegment").alias(CATEGORY),
        F.col("city").alias(LOCATION),
        F.when(F.col("o_orderstatus") == "F", 1).otherwise(0).alias(FRAUD),
    )
