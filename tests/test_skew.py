"""A key holding a third of the rows: results stay exact, and the fact⋈customer
join is split by AQE's skew handling when it runs as a sort-merge join."""

import math

from pyspark.sql import functions as F

from ledgerlens.operators import customers as U
from ledgerlens.operators import metrics as M
from ledgerlens.sources import fixtures as fx

from paths import SF01


def _hot(spark):
    """tx_o with every third order moved to one user in one city."""
    t = fx.tx_o(spark, SF01)
    hot = (F.col("Transaction_ID").cast("long") % 3) == 0
    return t.withColumns({"User_ID": F.when(hot, F.lit("HOT")).otherwise(F.col("User_ID")),
                          "Location": F.when(hot, F.lit("Hà Nội")).otherwise(F.col("Location"))})


def test_hot_key_results_exact(spark):
    df = _hot(spark).repartition(6)
    pdf = df.toPandas()
    s = M.summary(df).first()
    assert s.total_transactions == len(pdf)
    by_loc = pdf.groupby("Location").Amount_VND.sum()
    assert s.top_city == by_loc.idxmax()
    r = {x.User_ID: x for x in U.rfm(df).collect()}
    hot = pdf[pdf.User_ID == "HOT"]
    assert r["HOT"].Frequency == len(hot) and len(hot) > len(pdf) / 4
    assert math.isclose(r["HOT"].Monetary, round(hot.Amount_VND.sum(), 2), rel_tol=1e-12)
    top = U.top_users(U.rfm(df), df, 3).collect()
    assert top[0].user_id == "HOT"
    mode = hot.Payment_Method.value_counts()
    assert top[0].preferred_payment_method == sorted(mode[mode == mode.max()].index)[0]
    funnel = [x.value for x in M.user_funnel(df).orderBy("step").collect()]
    assert funnel[0] == pdf.User_ID.nunique()


def test_skewed_join_is_split(spark):
    keys = {"spark.sql.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.skewJoin.enabled": "true",
            "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
            "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4k",
            "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k, None) for k in keys}
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        orders = fx.read_table(spark, SF01, "orders")
        # every third order belongs to customer 1: one join key with a third of the rows
        orders = orders.withColumn("o_custkey", F.when(F.col("o_orderkey") % 3 == 0, F.lit(1).cast("long"))
                                   .otherwise(F.col("o_custkey")))
        # AQE splits a hot partition by ranges of map outputs; the test file is one
        # row group (one map task), so spread it as a cluster's many files would be
        orders = orders.repartition(6)
        j = fx.with_city(orders, "o_custkey", spark, SF01)
        rows = j.collect()   # runs this frame's own plan, so the final adaptive plan is inspectable
        assert len(rows) == orders.count()
        plan = j._jdf.queryExecution().executedPlan().toString()
        assert "isFinalPlan=true" in plan and "SortMergeJoin" in plan
        assert "SortMergeJoin(skew=true)" in plan and "AQEShuffleRead skewed" in plan
    finally:
        for k, v in old.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)
