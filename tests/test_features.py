import datetime as dt
import math

import pytest

from ledgerlens.operators.features import Preprocessor, fit_categories, one_hot, time_features

SCHEMA = ("Transaction_ID string, User_ID string, Amount_VND double, Timestamp timestamp_ntz, "
          "Payment_Method string, Merchant_Category string, Location string")


def _rows():
    sat = dt.datetime(2026, 1, 3, 22)   # a Saturday
    vals = [1.0, 2.0, 3.0, 4.0, 1000.0]
    pays = ["QR", "Card", "QR", None, "Card"]
    return [(f"T{i}", "U1", v, sat + dt.timedelta(days=i), p, "Mua sắm", None) for i, (v, p) in enumerate(zip(vals, pays))]


def test_time_features(spark):
    r = time_features(spark.createDataFrame(_rows(), SCHEMA)).orderBy("Transaction_ID").collect()
    assert [(x.hour, x.day_of_week, x.month, x.is_weekend) for x in r[:3]] == [(22, 5, 1, 1), (22, 6, 1, 1), (22, 0, 1, 0)]


def test_preprocessor_fit_transform(spark):
    df = spark.createDataFrame(_rows(), SCHEMA)
    pp = Preprocessor().fit(df)
    assert pp.upper == 4.0 + 3.0 * (4.0 - 2.0)          # quartiles 2 and 4 → 10
    clipped = [1.0, 2.0, 3.0, 4.0, 10.0]
    mean = sum(clipped) / 5
    std = math.sqrt(sum((x - mean) ** 2 for x in clipped) / 5)
    assert math.isclose(pp.mean, mean) and math.isclose(pp.std, std)
    assert pp.vocab["Payment_Method"] == ["Card", "QR", "Unknown"]
    out = {r.Transaction_ID: r for r in pp.transform(df).collect()}
    assert out["T4"].Amount_VND == 10.0 and out["T3"].Payment_Method == "Unknown"
    assert math.isclose(out["T0"].amount_scaled, (1.0 - mean) / std)
    assert out["T1"]["Payment_Method_Card"] == 1.0 and out["T1"]["Payment_Method_QR"] == 0.0
    assert out["T0"].Location == "Unknown"
    # inference reuses the fitted statistics; an unseen payment value is all zero
    new = spark.createDataFrame([("N1", "U2", 50.0, dt.datetime(2026, 1, 5), "Cash", "Ăn uống", "Hà Nội")], SCHEMA)
    r = pp.process(new, training=False).first()
    assert r.Amount_VND == 10.0 and r["Payment_Method_Card"] == 0.0 and r["Payment_Method_QR"] == 0.0


def test_too_many_categories_are_an_error(spark, monkeypatch):
    from ledgerlens.operators import features as E

    df = spark.createDataFrame(_rows(), SCHEMA)
    monkeypatch.setattr(E, "MAX_CATEGORIES", 2)
    assert E.fit_categories(df, ["Payment_Method"]) == {"Payment_Method": ["Card", "QR"]}
    with pytest.raises(ValueError, match="distinct values"):
        E.fit_categories(df, ["Payment_Method", "Merchant_Category"])


def test_one_hot_vocab(spark):
    df = spark.createDataFrame(_rows(), SCHEMA)
    vocab = fit_categories(df, ["Payment_Method"])
    assert vocab == {"Payment_Method": ["Card", "QR"]}
    cols = one_hot(df, vocab).columns
    assert cols[-2:] == ["Payment_Method_Card", "Payment_Method_QR"]
