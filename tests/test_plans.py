from ledgerlens.plans.dashboard import dashboard, segmentation_page, transactions_page
from ledgerlens.schema import FilterParams
from ledgerlens.sources import fixtures as fx

from paths import SF001


def test_dashboard_plan(spark):
    d = dashboard(fx.tx(spark, SF001), FilterParams(location="Hà Nội"))
    assert set(d) == {"summary", "distributions", "trend", "funnel", "flows", "insights", "by_hour"}
    s = d["summary"].first()
    assert s.total_transactions > 0 and s.top_city == "Hà Nội"
    total = d["distributions"].where("breakdown = 'location_sales'").first().value
    assert abs(total - sum(r.value for r in d["by_hour"].collect())) < 1e-6


def test_transactions_page_plan(spark):
    p = transactions_page(fx.tx(spark, SF001), keyword="u1", sort_by="Amount_VND", page_no=2, page_size=5)
    total = p["total"].first().total
    rows = p["rows"].collect()
    assert len(rows) == min(5, max(total - 5, 0))
    assert all("u1" in (r.user_id.lower() + r.transaction_id.lower() + r.merchant_category.lower()) for r in rows)


def test_segmentation_page_plan(spark):
    p = segmentation_page(fx.tx_o(spark, SF001))
    assert p["summary"].count() <= 4
    assert p["segments"].count() == fx.tx_o(spark, SF001).select("User_ID").distinct().count()
    f = p["forecast"].orderBy("period").collect()
    assert f[0].forecast == f[0].value


def test_service_facade(spark, tmpdir_path):
    import os

    from ledgerlens.plans.registry import ModelNotTrained
    from ledgerlens.plans.service import AnalyticsService
    from ledgerlens.sources.csv import write_transactions_csv

    from paths import SF01

    path = os.path.join(tmpdir_path, "tx.csv")
    write_transactions_csv(fx.tx_raw(spark, SF01), path)
    svc = AnalyticsService(spark, path)
    assert svc.summary().first().total_transactions == 9896
    assert svc.transactions(FilterParams(location="Hà Nội"), page_size=5)["rows"].count() == 5
    try:
        svc.predict(spark.createDataFrame([(1.0,)], "Amount_VND double"))
        raise AssertionError("expected ModelNotTrained")
    except ModelNotTrained:
        pass
    m = svc.train("decision_tree").first()
    assert m.accuracy > 0.98
    req = spark.createDataFrame([(5_500_000.0, 2, 1, "Ví điện tử", "Mua sắm", "TP.HCM"),
                                 (450_000.0, 14, 0, "Chuyển khoản", "Ăn uống", "Hà Nội")],
                                "Amount_VND double, Hour int, Is_Weekend int, Payment_Method string, "
                                "Merchant_Category string, Location string")
    out = svc.predict(req).collect()
    assert len(out) == 2 and all(len(r.rules) >= 1 for r in out)
    assert out[0].is_fraud_pred == 1 and out[1].is_fraud_pred == 0
    old_registry = svc.registry.root
    other = os.path.join(tmpdir_path, "other.csv")
    write_transactions_csv(fx.tx_raw(spark, SF001), other)
    svc.change_dataset(other)
    assert svc.registry.root != old_registry and not svc.registry.is_trained("decision_tree")
    svc.change_dataset(path)                       # the same files again: their models are found
    assert svc.registry.root == old_registry and svc.registry.is_trained("decision_tree")


def test_service_materialized(spark, tmpdir_path):
    import os

    from ledgerlens.plans.service import AnalyticsService
    from ledgerlens.sources.csv import write_transactions_csv

    path = os.path.join(tmpdir_path, "small.csv")
    write_transactions_csv(fx.tx_raw(spark, SF001), path)
    svc = AnalyticsService(spark, path, materialize=True)
    n = svc.summary().first().total_transactions
    assert n == fx.tx(spark, SF001).count()
    plan = svc.summary(FilterParams(location="Hà Nội"))._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(Location), EqualTo(Location" in plan
