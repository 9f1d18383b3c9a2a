from pyspark.sql import functions as F

from ledgerlens.operators.rank import numbered


def test_numbers_match_a_sort(spark, tmpdir_path):
    df = spark.range(1000, numPartitions=7).select((F.col("id") * 37 % 1000).alias("v"), (F.col("id") % 5).alias("g"))
    got = numbered(df, f"{tmpdir_path}/r", F.col("g").desc(), F.col("v")).collect()
    want = sorted(((r.v, r.g) for r in df.collect()), key=lambda x: (-x[1], x[0]))
    assert [(r.v, r.g) for r in sorted(got, key=lambda r: r["rank"])] == want
    assert sorted(r["rank"] for r in got) == list(range(1, 1001))


def test_ties_nulls_and_empty(spark, tmpdir_path):
    df = spark.createDataFrame([(None,), (None,), ("b",), ("a",), ("a",)], "s string")
    got = {(r.s, r.n) for r in numbered(df, f"{tmpdir_path}/t", F.col("s").asc_nulls_last(), name="n").collect()}
    assert got == {("a", 1), ("a", 2), ("b", 3), (None, 4), (None, 5)}
    assert numbered(df.limit(0), f"{tmpdir_path}/e", F.col("s")).count() == 0
