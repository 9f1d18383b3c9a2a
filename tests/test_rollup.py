import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import customers as U
from ledgerlens.operators import metrics as M
from ledgerlens.operators.filters import apply_filters
from ledgerlens.plans.rollup import Rollup, Router, days_of
from ledgerlens.schema import LOCATION, FilterParams
from ledgerlens.sources.versions import VersionConflict, VersionLog

SCHEMA = ("Transaction_ID string, User_ID string, Amount_VND double, Timestamp timestamp_ntz, Payment_Method string, "
          "Merchant_Category string, Location string, Is_Fraud int")


def rows(seed=4, n=400):
    rng = random.Random(seed)
    out = [(f"T{i}" if rng.random() > .05 else None, rng.choice([None, "hot", *[f"U{j}" for j in range(40)]]), rng.choice([1.5, 20.25, None, 300.0]),
            dt.datetime(2025, rng.randint(10, 12), rng.randint(1, 28), rng.randrange(24), rng.randrange(60)), rng.choice(["QR", "Card", None]),
            rng.choice(["Food", "Ride", None]), rng.choice(["Hà Nội", "Huế", None]), rng.choice([0, 0, 1, None])) for i in range(n)]
    # a day and a month in which nobody is known
    return out + [("T-x", None, 5.0, dt.datetime(2026, 3, 3, 3), "QR", "Food", "Huế", 0)]


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    df = spark.createDataFrame(rows(), SCHEMA).withColumn("k", F.pmod(F.xxhash64("Transaction_ID", "Timestamp", "User_ID"), F.lit(4)))
    r = Rollup(spark, str(tmp_path_factory.mktemp("rollup")))
    for i in range(4):
        r.add(df.where(F.col("k") == i).drop("k"))
    return df.drop("k").cache(), r


def same(a, b):
    assert sorted(a.columns) == sorted(b.columns)
    cols = sorted(a.columns)
    key = lambda df: sorted((tuple(str(r[c]) for c in cols) for r in df.collect()))
    assert key(a) == key(b)


FILTERS = [None, FilterParams(location="Hà Nội"), FilterParams("Huế", "QR", "Food"), FilterParams(location="nowhere")]


@pytest.mark.parametrize("params", FILTERS)
def test_every_measure_equals_the_rows(made, params):
    df, r = made
    router, f = Router(df, r), apply_filters(df, params)
    for name, want, args in [("summary", M.summary(f), {}), ("distributions", M.distributions(f), {}),
                             ("breakdown", M.breakdown(f, LOCATION), {"col": LOCATION}), ("trend", M.trend(f, "quarter"), {"granularity": "quarter"}),
                             ("amount_by_hour", M.amount_by_hour(f), {}), ("count_by_hour", M.count_by_hour(f), {}),
                             ("count_by_weekday", M.count_by_weekday(f), {}), ("flows", M.category_flows(f, .1), {"min_share": .1}),
                             ("insights", M.insights(f), {})]:
        assert router.source(name, params, **args) == "rollup"
        same(router.answer(name, params, **args), want)


def test_user_state_equals_the_full_fold_and_survives_compaction(spark, made):
    df, r = made
    for _ in range(2):
        router = Router(df, r)
        same(router.answer("rfm"), U.rfm(df))
        same(router.answer("preferred_payment"), U.preferred_payment(df))
        same(router.answer("funnel"), M.user_funnel(df))
        same(router.answer("summary"), M.summary(df))
        if len(r.parts["cells"]) > 1:
            r.compact()
    assert [len(p) for p in r.parts.values()] == [1] * 4
    codes = [x.code for x in r.table("codes").collect()]
    assert sorted(codes) == list(range(len(codes))) and r.n_users == len(codes)


def test_no_fact_row_and_no_user_rows_in_the_plan(made):
    df, r = made
    plan = Router(df, r).answer("summary", FilterParams(location="Huế"))._jdf.queryExecution().toString()
    assert "InMemoryRelation" not in plan and "User_ID" not in plan and "bitmap_or_agg" in plan
    months = Router(df, r).answer("trend", None, dt.datetime(2025, 11, 1), dt.datetime(2025, 12, 1))
    assert "PartitionFilters: [isnotnull(month" in months._jdf.queryExecution().executedPlan().toString()
    assert [x.period for x in months.collect()] == ["2025-11"]


def test_router_goes_to_the_rows_where_it_must(made):
    df, r = made
    router = Router(df, r)
    half = dt.datetime(2025, 11, 15)
    for measure, kw in [("summary", {"search": "t1"}), ("summary", {"start": half}), ("rfm", {"params": FilterParams(location="Huế")}),
                        ("funnel", {"stop": dt.datetime(2025, 11, 1)}), ("breakdown", {"col": "User_ID"})]:
        assert router.source(measure, **kw) == "rows"
    same(router.answer("summary", start=half), M.summary(df.where(F.col("Timestamp") >= F.lit(half).cast("timestamp_ntz"))))
    assert Router(df, None).source("summary") == "rows"
    with pytest.raises(ValueError):
        router.answer("no such measure")


def test_empty_table(spark, tmpdir_path):
    none = spark.createDataFrame([], SCHEMA)
    r = Rollup(spark, f"{tmpdir_path}/r")
    r.add(none)
    router = Router(none, r)
    for name, want in [("summary", M.summary(none)), ("funnel", M.user_funnel(none)), ("insights", M.insights(none)), ("rfm", U.rfm(none))]:
        same(router.answer(name), want)
    df = spark.createDataFrame(rows(), SCHEMA)
    r.add(df)
    same(Router(df, r).answer("summary"), M.summary(df))


def test_a_stopped_addition_is_not_seen(spark, tmpdir_path, monkeypatch):
    df = spark.createDataFrame(rows(), SCHEMA)
    r = Rollup(spark, f"{tmpdir_path}/r")
    r.add(df)
    monkeypatch.setattr("ledgerlens.plans.rollup.users_of", lambda d: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        r.add(df)
    same(Router(df, Rollup(spark, f"{tmpdir_path}/r")).answer("summary"), M.summary(df))


def test_version_log(spark, tmpdir_path):
    log = VersionLog(spark, f"{tmpdir_path}/log")
    assert log.latest() == (0, {})
    assert log.commit({"a": 1}, 0) == 1 and log.commit({"a": [2]}, 1) == 2
    with pytest.raises(VersionConflict):
        VersionLog(spark, f"{tmpdir_path}/log").commit({"a": 3}, 1)
    assert log.latest() == (2, {"a": [2]})


def test_an_addition_is_computed_once(spark, tmpdir_path):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    df = spark.createDataFrame(rows(), SCHEMA)
    r = Rollup(spark, f"{tmpdir_path}/r")
    r.add(df.mapInArrow(count, df.schema))
    assert seen.value == len(rows())
    same(Router(df, r).answer("summary"), M.summary(df))


def test_days_exchange_no_bitmap_and_broadcast_no_codes(spark):
    df = spark.createDataFrame(rows(), SCHEMA)
    codes = spark.createDataFrame([("hot", 0), *[(f"U{j}", 40000 * (j + 1)) for j in range(40)]], "User_ID string, code long")
    plan = days_of(df, codes)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan
    above = plan[:plan.index("SortMergeJoin")]
    assert above.count("Exchange") == 1 and above.index("bitmap_construct_agg") < above.index("Exchange")
    assert "partial_bitmap_construct_agg" not in above[above.index("Exchange"):]
    want = df.join(codes, "User_ID", "left").groupBy(F.to_date("Timestamp").alias("day"), F.expr("bitmap_bucket_number(code)").alias("bucket")).agg(
        F.countDistinct("Location", "Merchant_Category", "Payment_Method").alias("n"))
    assert days_of(df, codes).select("day", "bucket").distinct().count() == want.count()
