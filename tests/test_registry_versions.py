import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import fraud as FR
from ledgerlens.operators.treerules import explain
from ledgerlens.plans import registry as R
from ledgerlens.sources import fixtures as fx

from paths import SF01


def test_a_training_that_stops_leaves_the_one_before(spark, tmpdir_path, monkeypatch):
    data = fx.tx_fraud(spark, SF01)
    reg = R.ModelRegistry(spark, f"{tmpdir_path}/m")
    assert [(r.model, r.trained, r.accuracy) for r in reg.status_rows().orderBy("model").collect()] == [
        ("decision_tree", False, None), ("random_forest", False, None)]
    before = reg.train(data, "decision_tree").first()
    with monkeypatch.context() as m:       # the model of other labels is written, its metrics are not
        m.setattr(R, "metrics_from_counts", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            reg.train(data.withColumn("Is_Fraud", (F.col("Hour") > 12).cast("int")), "decision_tree")
    again = R.ModelRegistry(spark, f"{tmpdir_path}/m")
    assert again.metrics("decision_tree").first() == before
    score = FR.evaluate(again.model("decision_tree"), data).first()
    assert score.accuracy == before.accuracy
    row = {r.model: r for r in again.status_rows().collect()}
    assert row["decision_tree"].trained and row["decision_tree"].active and not row["random_forest"].trained
    assert sum(c["count"] for c in row["decision_tree"].confusion) == FR.split_by_hash(data).where("is_test").count()


def test_one_verdict_per_row_for_missing_categories(spark):
    data = fx.tx_fraud(spark, SF01)
    gone = data.withColumn("Location", F.when(F.col("Hour") % 3 != 0, F.col("Location")))
    model = FR.fit_fraud_model(gone, "decision_tree")
    scored = FR.score(model, gone, null_is_absent=False).select("Transaction_ID", "is_fraud_pred", "Location")
    tested = FR.predict(model, gone).select("Transaction_ID", F.col("prediction").cast("int").alias("p"))
    paths = explain(model, FR.with_absent_defaults(gone)).select("Transaction_ID", F.col("path_prediction").cast("int").alias("q"))
    both = scored.join(tested, "Transaction_ID").join(paths, "Transaction_ID")
    assert both.where("is_fraud_pred <> p or p <> q").count() == 0
    assert scored.where("Location is null").count() == gone.where("Location is null").count() > 0
