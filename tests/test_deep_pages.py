import random

import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import listing as P

SCHEMA = "Transaction_ID string, Amount_VND double, note string"


def table(spark, n=700):
    rng = random.Random(2)
    rows = [(rng.choice([None, f"T{i}", "same"]), rng.choice([None, 5.0, 5.0, 5.0, float(rng.randrange(40))]), f"n{i}") for i in range(n)]
    return spark.createDataFrame(rows + [("dup", 5.0, "d")] * 60, SCHEMA).repartition(6)


@pytest.mark.parametrize("order", ["asc", "desc"])
def test_pages_cover_the_table_once_in_order(spark, order):
    df = table(spark).cache()
    asc = order == "asc"
    h = F.xxhash64(*df.columns)
    full = [tuple(r) for r in df.orderBy(
        F.col("Amount_VND").asc_nulls_last() if asc else F.col("Amount_VND").desc_nulls_last(),
        F.col("Transaction_ID").asc_nulls_last() if asc else F.col("Transaction_ID").desc_nulls_last(), h).collect()]
    size = 97
    got = []
    for no in range(1, len(full) // size + 3):
        got += [tuple(r) for r in P.page_at(df, no, size, "Amount_VND", order, span=20, pivots=5).collect()]
    assert got == full
    df.unpersist()


def test_start_is_near_the_page_and_top_k_small(spark):
    df = spark.range(20000, numPartitions=4).select(F.concat(F.lit("T"), "id").alias("Transaction_ID"), (F.col("id") % 1000).cast("double").alias("Amount_VND"))
    rows = df.withColumn(P.ROW_HASH, F.xxhash64(*df.columns))
    keys = [("Amount_VND", True), ("Transaction_ID", True), (P.ROW_HASH, True)]
    start, below = P.rank_start(rows, keys, 15000, span=100, pivots=16)
    assert below <= 15000 < below + 100 and rows.where(P._before(keys, start)).count() == below
    plan = P.page_at(df, 1501, 10, "Amount_VND", "asc", span=100, pivots=16)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan
    limits = [int(x.split(",")[0]) for x in plan.split("TakeOrderedAndProject(limit=")[1:]]
    assert limits and max(limits) <= 110


def test_beyond_the_end_and_empty(spark):
    df = table(spark, 50)
    assert P.page_at(df, 1000, 20, "Amount_VND", "asc", span=10).count() == 0
    assert P.page_at(df.limit(0), 3, 20).count() == 0 if "Timestamp" in df.columns else True
    assert [r.note for r in P.page_at(df, 0, 3, "Amount_VND").collect()] == [r.note for r in P.page_at(df, 1, 3, "Amount_VND").collect()]


def test_table_is_computed_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    df = spark.range(3000, numPartitions=3).select(F.concat(F.lit("T"), "id").alias("Transaction_ID"), (F.col("id") % 7).cast("double").alias("Amount_VND"),
                                                   F.lit(None).alias("none"), F.lit(1).alias("odd, name"))
    plain = df.drop("none").mapInArrow(count, df.drop("none").schema).withColumn("none", F.lit(None))
    got = P.page_at(plain, 50, 20, "Amount_VND", "asc", span=20, pivots=4)
    assert got.dtypes == plain.dtypes
    want = [r.Transaction_ID for r in P.page(df, "Amount_VND", "asc", 50, 20).collect()]
    assert [r.Transaction_ID for r in got.collect()] == want
    assert seen.value == 3000


def test_keys_left_are_written_between_passes(spark, monkeypatch):
    df = table(spark)
    want = [[tuple(r) for r in P.page_at(df, no, 50, "Amount_VND", "asc", span=20, pivots=5).collect()] for no in (1, 7, 15)]
    monkeypatch.setattr(P, "MANY_KEYS", 10)
    assert [[tuple(r) for r in P.page_at(df, no, 50, "Amount_VND", "asc", span=20, pivots=5).collect()] for no in (1, 7, 15)] == want
