import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerlens.functions.parse import na_to_null, parse_amount, parse_int, parse_timestamp
from ledgerlens.operators import clean as C
from ledgerlens.operators.quantile import approx_quantiles, exact_quantiles
from ledgerlens.schema import AMOUNT, NA_TOKENS


def _col(spark, values, name="x", typ="string"):
    return spark.createDataFrame([(v,) for v in values], f"{name} {typ}")


def test_amount_text(spark):
    vals = ["1e3", " 5 ", "12d", "1,000", "nan", "", "-3", None]
    out = _col(spark, vals).select(parse_amount("x").alias("a")).collect()
    assert [r.a for r in out] == [1000.0, 5.0, 0.0, 0.0, 0.0, 0.0, -3.0, 0.0]


def test_int_parse_truncates_and_defaults(spark):
    vals = ["1", "0", "x", "2.9", "-2.9", None, "99999999999"]
    out = _col(spark, vals).select(parse_int("x", 12).alias("h")).collect()
    assert [r.h for r in out] == [1, 0, 12, 2, -2, 12, 12]


def test_timestamp_text(spark):
    vals = ["2026-01-05 10:00:00", "2026-01-05", "05/01/2026", "junk", None]
    out = _col(spark, vals).select(parse_timestamp("x").alias("t")).collect()
    assert out[0].t is not None and out[0].t.hour == 10
    assert [r.t for r in out[1:]] == [None, None, None, None]


def test_na_tokens(spark):
    vals = ["", "NA", "N/A", "null", "None", "NaN", "keep"]
    out = _col(spark, vals).select(na_to_null("x").alias("y")).collect()
    assert [r.y for r in out] == [None] * 6 + ["keep"]
    assert "NA" in NA_TOKENS


def test_localise_unknown_passes_through(spark):
    df = spark.createDataFrame([("Transport", "E-Wallet"), ("Other", "Cash"), (None, None)],
                               "Merchant_Category string, Payment_Method string")
    out = C.localise(df).collect()
    assert out[0].Merchant_Category == "Giao thông & Di chuyển" and out[0].Payment_Method == "Ví điện tử"
    assert out[1].Merchant_Category == "Other" and out[1].Payment_Method == "Cash"
    assert out[2].Merchant_Category is None


def test_clean_transactions_drops_bad_timestamps(spark):
    df = spark.createDataFrame(
        [("T1", "U1", "10", "2026-01-05 10:00:00", "QR", "Shopping", None, "0"),
         ("T2", "U1", "abc", "junk", "QR", "Shopping", "Hà Nội", "1")],
        "Transaction_ID string, User_ID string, Amount_VND string, Timestamp string, "
        "Payment_Method string, Merchant_Category string, Location string, Is_Fraud string")
    out = C.clean_transactions(df).collect()
    assert len(out) == 1 and out[0].Amount_VND == 10.0 and out[0].Merchant_Category == "Mua sắm"


def test_clip(spark):
    df = _col(spark, [-5.0, 10.0, 1e9], AMOUNT, "double")
    out = [r[AMOUNT] for r in C.clip_amount(df, 100.0).collect()]
    assert out == [0.0, 10.0, 100.0]


def test_quantile_small(spark):
    df = _col(spark, [1.0, 2.0, 3.0, 4.0], "v", "double")
    assert exact_quantiles(df, "v", [0.25]) == [1.75]
    assert exact_quantiles(df.where("v > 10"), "v", [0.5]) == [None]


def test_exact_quantile_narrowing_with_hot_value(spark):
    rnd = random.Random(7)
    vals = [rnd.uniform(-100, 100) for _ in range(4000)] + [42.0] * 2000  # one value holds a third
    df = _col(spark, vals, "v", "double").repartition(7)
    probs = [0.1, 0.25, 0.5, 0.75, 0.99]
    # small limits force several narrowing rounds
    got = exact_quantiles(df, "v", probs)
    want = np.quantile(np.array(vals), probs, method="linear")
    for g, w in zip(got, want):
        assert math.isclose(g, w, rel_tol=1e-12, abs_tol=1e-9)
    approx = approx_quantiles(df, "v", [0.5])
    assert abs(approx[0] - want[2]) < 5


@settings(max_examples=15, deadline=None)
@given(st.lists(st.floats(-1e6, 1e6, allow_nan=False), min_size=1, max_size=60))
def test_exact_quantile_property(spark, xs):
    df = _col(spark, xs, "v", "double")
    got = exact_quantiles(df, "v", [0.25, 0.75])
    want = np.quantile(np.array(xs), [0.25, 0.75], method="linear")
    for g, w in zip(got, want):
        assert math.isclose(g, w, rel_tol=1e-9, abs_tol=1e-6)


def test_iqr_bound_and_strict(spark):
    df = spark.createDataFrame(
        [(f"T{i}", "U1", "2026-01-01 00:00:00", float(v), None, "c", "l") for i, v in enumerate([1, 2, 3, 4, 1000])],
        "Transaction_ID string, User_ID string, Timestamp string, Amount_VND double, "
        "Payment_Method string, Merchant_Category string, Location string")
    upper = C.iqr_upper_bound(df)
    assert upper == 4.0 + 3.0 * (4.0 - 2.0)
    out = C.clean_strict(df).orderBy("Transaction_ID").collect()
    assert out[-1].Amount_VND == 10.0 and out[0].Payment_Method == "Unknown"


def test_with_default(spark):
    df = _col(spark, ["a"], "x")
    assert C.with_default(df).first().Risk_Score == 0
    df2 = spark.createDataFrame([("a", "7"), ("b", None)], "x string, Risk_Score string")
    assert [r.Risk_Score for r in C.with_default(df2).collect()] == [7, 0]


def test_timestamp_ignores_session_zone(spark):
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
        r = _col(spark, ["2024-03-31 02:30:00"]).select(parse_timestamp("x").alias("t")).first()
        assert (r.t.hour, r.t.minute) == (2, 30)  # inside the DST gap: wall clock kept
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


@settings(max_examples=10, deadline=None)
@given(st.lists(st.floats(-1e12, 1e12, allow_nan=False), min_size=1, max_size=30), st.floats(0, 1e6))
def test_clip_bounds_property(spark, xs, upper):
    df = _col(spark, xs, AMOUNT, "double")
    out = [r[AMOUNT] for r in C.clip_amount(df, upper).collect()]
    assert all(0.0 <= v <= upper for v in out)
    assert out == [min(max(x, 0.0), upper) for x in xs]
