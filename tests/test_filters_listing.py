import datetime as dt

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerlens.operators import filters as FL
from ledgerlens.operators import listing as P
from ledgerlens.schema import FilterParams

SCHEMA = ("Transaction_ID string, User_ID string, Amount_VND double, Timestamp timestamp_ntz, "
          "Payment_Method string, Merchant_Category string, Location string, Is_Fraud int")


def _tx(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def _rows(n=30):
    base = dt.datetime(2026, 1, 1)
    out = []
    for i in range(n):
        out.append((f"T{i:03d}", f"U{i % 7}", float(i % 5) if i % 9 else None, base + dt.timedelta(hours=i),
                    ["QR", "Ví điện tử"][i % 2], ["Mua sắm", "Ăn uống", "Siêu thị"][i % 3],
                    ["Hà Nội", "TP.HCM", None][i % 3], i % 2))
    return out


def test_filters(spark):
    df = _tx(spark, _rows())
    assert FL.apply_filters(df, FilterParams()).count() == 30
    assert FL.apply_filters(df, FilterParams(location="")).count() == 30
    assert FL.apply_filters(df, FilterParams(location="Hà Nội")).count() == 10
    n = FL.apply_filters(df, FilterParams("Hà Nội", "QR", "Mua sắm")).count()
    assert n == sum(1 for r in _rows() if r[6] == "Hà Nội" and r[4] == "QR" and r[5] == "Mua sắm")


def test_filter_values(spark):
    r = FL.filter_values(_tx(spark, _rows())).first()
    assert r.locations == ["Hà Nội", "TP.HCM"]
    assert r.payment_methods == ["QR", "Ví điện tử"]
    long = {(x.field, x.value) for x in FL.filter_values_long(_tx(spark, _rows())).collect()}
    assert ("locations", "TP.HCM") in long and len(long) == 7


def test_filter_values_read_the_table_once(spark, tmp_path):
    path = str(tmp_path / "t.parquet")
    _tx(spark, _rows()).write.parquet(path)
    plan = FL.filter_values(spark.read.parquet(path))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1


def test_search(spark):
    rows = _rows() + [("X1", None, 1.0, dt.datetime(2026, 2, 1), "QR", None, None, 0)]
    df = _tx(spark, rows)
    ids = {r.Transaction_ID for r in FL.search(df, "u1.").collect()}
    assert ids == set()  # users are U0..U6: 'u1' followed by any char never occurs
    ids = {r.Transaction_ID for r in FL.search(df, "U1").collect()}
    assert ids == {r[0] for r in rows if r[1] == "U1"}
    assert FL.search(df, "mua").count() == 10
    assert FL.search(df, "x1").count() == 1
    with pytest.raises(ValueError):
        FL.search(df, "(")
    assert FL.search(df, "(", regex=False).count() == 0
    assert FL.search(df, "").count() == len(rows)


def test_sort_nulls_last_both_ways(spark):
    df = _tx(spark, _rows())
    asc = [r.Amount_VND for r in P.sorted_rows(df, "Amount_VND", "asc").collect()]
    desc = [r.Amount_VND for r in P.sorted_rows(df, "Amount_VND", "desc").collect()]
    assert asc[-1] is None and desc[-1] is None
    assert asc[0] == 0.0 and desc[0] == 4.0
    # unknown sort column falls back to Timestamp
    assert P.sorted_rows(df, "bogus", "desc").first().Transaction_ID == "T029"


def test_paging(spark):
    df = _tx(spark, _rows())
    p0 = [r.Transaction_ID for r in P.page(df, page_no=0).collect()]
    p1 = [r.Transaction_ID for r in P.page(df, page_no=1).collect()]
    assert p0 == p1 and len(p1) == 20
    assert P.page(df, page_no=3, page_size=20).count() == 0
    assert P.page_total(df).first().total == 30


@settings(max_examples=6, deadline=None)
@given(st.integers(1, 9), st.sampled_from(["Amount_VND", "Timestamp", "Location"]), st.sampled_from(["asc", "desc"]))
def test_pages_concatenate_to_full_sort(spark, size, col, order):
    df = _tx(spark, _rows())
    full = [r.Transaction_ID for r in P.sorted_rows(df, col, order).collect()]
    pages, k = [], 1
    while True:
        pg = [r.Transaction_ID for r in P.page(df, col, order, k, size).collect()]
        if not pg:
            break
        pages += pg
        k += 1
    assert pages == full
    # keyset paging walks the same rows
    keyset, last = [], None
    while True:
        if last is None:
            pg = P.page(df, col, order, 1, size).collect()
        else:
            pg = P.page_after(df, last[col], last.Transaction_ID, col, order, size).collect()
        if not pg:
            break
        keyset += [r.Transaction_ID for r in pg]
        last = pg[-1]
    assert keyset == full


def test_projection(spark):
    r = P.project_rows(_tx(spark, _rows())).where("transaction_id = 'T001'").first()
    assert r.amount_vnd == 1 and r.timestamp == "2026-01-01 01:00:00" and r.risk_score == 0
    r = P.label_value(spark.createDataFrame([("a", 1.0)], "k string, v double"), "k", "v").first()
    assert r.label == "a" and r.value == 1.0
