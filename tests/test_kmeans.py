import random

import pytest
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from ledgerlens.operators import kmeans as K


def blobs(spark, n=400, seed=1, parts=5):
    rng = random.Random(seed)
    at = [(0, 0, 0), (8, 0, 1), (0, 9, 2), (7, 8, -3)]
    rows = [(f"u{i}", *(c + rng.gauss(0, 1) for c in at[i % 4])) for i in range(n)]
    return spark.createDataFrame(rows, "id string, a double, b double, c double").repartition(parts)


def cost_of(df, clustering):
    near = F.least(*[sum((F.col(c) - v) * (F.col(c) - v) for c, v in zip(clustering.columns, p)) for p in clustering.centres])
    return df.agg(F.sum(near)).first()[0]


def test_no_worse_than_separate_fits(spark):
    df = blobs(spark).persist()
    got = K.fit_restarts(df, ["a", "b", "c"], "id", 4, list(range(10)))
    assert got.cost == min(got.costs) and abs(cost_of(df, got) - got.cost) < 1e-6 * got.cost
    vec = VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(df)
    apart = min(KMeans(k=4, seed=s, maxIter=300, tol=0.005).fit(vec).summary.trainingCost for s in range(10))
    assert got.cost <= apart * (1 + 1e-3)
    assert df.withColumn("j", got.cluster()).groupBy("j").count().count() == 4
    df.unpersist()


def test_one_job_per_step(spark):
    df = blobs(spark, 200).persist()
    df.count()
    sc = spark.sparkContext
    sc.setJobGroup("kmeans-jobs", "x")
    got = K.fit_restarts(df, ["a", "b", "c"], "id", 4, list(range(10)))
    jobs = len(sc.statusTracker().getJobIdsForGroup("kmeans-jobs"))
    sc.setJobGroup("", "")
    # adaptive execution runs an aggregate as a map job and a result job at most
    assert jobs <= 2 * (4 + max(got.iterations) + 1)
    df.unpersist()


def test_partitioning_does_not_matter(spark):
    seeds = list(range(3))
    a = K.fit_restarts(blobs(spark, parts=1), ["a", "b", "c"], "id", 4, seeds)
    b = K.fit_restarts(blobs(spark, parts=7), ["a", "b", "c"], "id", 4, seeds)
    assert a.iterations == b.iterations
    assert all(abs(x - y) < 1e-9 for p, q in zip(a.centres, b.centres) for x, y in zip(p, q))


def test_lloyd_step_by_hand(spark):
    rows = spark.createDataFrame([("p", 0.0, 0.0), ("q", 2.0, 0.0), ("r", 9.0, 1.0)], "key string, x0 double, x1 double")
    one, two = K.lloyd_step(rows, [[[0.0, 0.0], [10.0, 0.0]], [[2.0, 0.0], [2.0, 0.0]]], 2)
    assert one == (6.0, {0: (2, [2.0, 0.0]), 1: (1, [9.0, 1.0])})
    assert two == (54.0, {0: (3, [11.0, 1.0])})        # equal centres: the first takes all


@pytest.mark.parametrize("rows", [[("a", 1.0), ("b", 1.0), ("c", 1.0)], [("a", 1.0), ("b", 5.0), ("c", 5.0)]])
def test_fewer_distinct_rows_than_clusters(spark, rows):
    got = K.fit_restarts(spark.createDataFrame(rows, "id string, v double"), ["v"], "id", 3, [1, 2])
    assert got.cost == 0.0 and len(got.centres) == 3


def test_a_hot_point_and_no_rows_lost(spark):
    df = blobs(spark, 100).unionByName(spark.range(300).select(F.concat(F.lit("h"), "id").alias("id"), F.lit(0.0).alias("a"),
                                                              F.lit(0.0).alias("b"), F.lit(0.0).alias("c")))
    step = K.lloyd_step(df.toDF("key", "x0", "x1", "x2"), [[[0.0] * 3, [8.0, 8.0, 0.0]]] * 2, 3)
    assert [sum(n for n, _ in clusters.values()) for _, clusters in step] == [400, 400]
