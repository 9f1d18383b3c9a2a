import datetime as dt

import pytest

from ledgerlens.operators import customers as U

SCHEMA = ("Transaction_ID string, User_ID string, Amount_VND double, Timestamp timestamp_ntz, "
          "Payment_Method string")


def test_recency_whole_days(spark):
    rows = [("T1", "A", 1.0, dt.datetime(2026, 5, 3, 2), "QR"),
            ("T2", "B", 2.0, dt.datetime(2026, 5, 6, 1), "QR")]
    r = {x.User_ID: x for x in U.rfm(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert r["A"].Recency == 3      # reference 2026-05-07 01:00 minus 2026-05-03 02:00
    assert r["B"].Recency == 1
    assert r["A"].Frequency == 1 and r["B"].Monetary == 2.0


def test_scaling_zero_std(spark):
    rows = [(f"T{i}", f"U{i}", 5.0, dt.datetime(2026, 1, 1), "QR") for i in range(3)]
    out = U.rfm_scaled(U.rfm(spark.createDataFrame(rows, SCHEMA))).collect()
    assert all(r.Monetary_scaled == 0.0 and r.Recency_scaled == 0.0 for r in out)


def test_too_few_users(spark):
    rows = [("T1", "A", 1.0, dt.datetime(2026, 1, 1), "QR"), ("T2", "B", 1.0, dt.datetime(2026, 1, 2), "QR")]
    with pytest.raises(U.TooFewUsers):
        U.fit_segments(U.rfm(spark.createDataFrame(rows, SCHEMA)), k=4, n_init=1)


def test_segments_named_by_monetary(spark):
    rows = []
    for u in range(40):
        spend = [1.0, 10.0, 100.0, 1000.0][u % 4]
        for j in range(1 + u % 4):
            rows.append((f"T{u}-{j}", f"U{u}", spend, dt.datetime(2026, 1, 1 + (u % 4) * 7), "QR"))
    rfm = U.rfm(spark.createDataFrame(rows, SCHEMA))
    model, clustered = U.fit_segments(rfm, n_init=2)
    seg = U.name_segments(clustered)
    means = {r.Segment_Name: r.mean_monetary for r in U.segment_profile(seg).collect()}
    order = sorted(means, key=means.get)
    assert order == ["Người dùng mới/Ít hoạt động", "Khách hàng phổ thông", "Khách hàng tiềm năng", "Khách hàng VIP"]
    tot = U.segment_totals(seg).collect()
    assert sum(r.user_count for r in tot) == 40


def test_name_segments_extra_clusters_take_last(spark):
    df = spark.createDataFrame([(i, f"U{i}", float(i)) for i in range(6)], "Cluster int, User_ID string, Monetary double")
    names = {r.Cluster: r.Segment_Name for r in U.name_segments(df, ["a", "b"]).collect()}
    assert names == {0: "a", 1: "b", 2: "b", 3: "b", 4: "b", 5: "b"}


def test_preferred_payment_and_top_users(spark):
    rows = [("T1", "A", 5.0, dt.datetime(2026, 1, 1), "QR"), ("T2", "A", 5.0, dt.datetime(2026, 1, 1), "Card"),
            ("T3", "A", 5.0, dt.datetime(2026, 1, 1), "QR"), ("T4", "B", 1.0, dt.datetime(2026, 1, 1), "Card"),
            ("T5", "B", 1.0, dt.datetime(2026, 1, 1), "Ví"), ("T6", "C", 0.5, dt.datetime(2026, 1, 1), None)]
    df = spark.createDataFrame(rows, SCHEMA)
    pref = {r.User_ID: r.preferred_payment_method for r in U.preferred_payment(df).collect()}
    assert pref == {"A": "QR", "B": "Card"}   # tie 1-1 → smallest name
    top = U.top_users(U.rfm(df), df, 2).collect()
    assert [(r.user_id, r.total_spend, r.transaction_count) for r in top] == [("A", 15, 3), ("B", 2, 2)]


def test_recency_ignores_session_zone(spark):
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
        rows = [("T1", "A", 1.0, dt.datetime(2024, 3, 29, 2, 30), "QR"),
                ("T2", "B", 1.0, dt.datetime(2024, 4, 1, 2, 0), "QR")]
        df = spark.createDataFrame(rows, SCHEMA)
        r = {x.User_ID: x.Recency for x in U.rfm(df).collect()}
        # reference 2024-04-02 02:00 (wall clock); A: 3 days 23.5 h → 3
        assert r == {"A": 3, "B": 1}
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


def test_user_analytics_and_export(spark, tmpdir_path):
    import os

    from ledgerlens.sources import fixtures as fx

    from paths import SF001

    df = fx.tx_o(spark, SF001)
    out = U.user_analytics(df)
    assert set(out) == {"segments", "top_users", "by_hour", "by_day"}
    seg_rows = out["segments"].collect()
    assert sum(r.user_count for r in seg_rows) == df.select("User_ID").distinct().count()
    assert [r.rank for r in sorted(seg_rows, key=lambda r: -r.user_count)] == sorted(r.rank for r in seg_rows)
    top = out["top_users"].collect()
    assert len(top) == 10 and all(r.segment for r in top)
    _, clustered = U.fit_segments(U.rfm(df), n_init=2)
    seg = U.name_segments(clustered)
    path = os.path.join(tmpdir_path, "segments")
    U.export_segments(seg, path)
    parts = sorted(p for p in os.listdir(path) if p.startswith("Segment_Name="))
    assert 1 <= len(parts) <= 4
    assert spark.read.parquet(path).count() == seg.count()
