import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import fraud as FR
from ledgerlens.operators.treerules import compile_tree, explain
from ledgerlens.sources import fixtures as fx

from paths import SF01


@pytest.fixture(scope="module")
def data(spark):
    return fx.tx_fraud(spark, SF01).cache()


@pytest.fixture(scope="module")
def tree(data):
    return FR.fit_fraud_model(data, "decision_tree")


@pytest.fixture(scope="module")
def forest(data):
    return FR.fit_fraud_model(data, "random_forest")


def _planted(df):
    return df.where((F.col("Amount_VND") >= 100) & (F.col("Hour") < 6) & (F.col("Is_Fraud") == 1))


@pytest.mark.parametrize("which", ["tree", "forest"])
def test_planted_rule_recovered(request, data, which):
    model = request.getfixturevalue(which)
    pred = FR.test_predictions(model, data)
    held = _planted(pred)
    n = held.count()
    hit = held.where(F.col("prediction") == 1).count()
    assert n > 20 and hit / n >= 0.9
    m = FR.classification_metrics(pred).first()
    assert m.accuracy > 0.98 and 0 <= m.f1_score <= 1


def test_probabilities_and_verdicts(tree, data):
    s = FR.score(tree, data)
    r = s.agg(F.min("probability").alias("lo"), F.max("probability").alias("hi"),
              F.count_if(F.col("unseen_category")).alias("unseen")).first()
    assert 0.0 <= r.lo <= r.hi <= 1.0 and r.unseen == 0
    v = {x.verdict for x in s.select("verdict").distinct().collect()}
    assert v == {"PHÁT HIỆN GIAN LẬN", "GIAO DỊCH AN TOÀN"}


def test_unseen_category_scores_as_zero_block(spark, tree):
    df = spark.createDataFrame([("X", 5_500_000.0, 2, 1, "Ví điện tử", "Điện nước", "TP.HCM"),
                                ("Y", None, None, None, None, None, None)],
                               "Transaction_ID string, Amount_VND double, Hour int, Is_Weekend int, "
                               "Payment_Method string, Merchant_Category string, Location string")
    out = {r.Transaction_ID: r for r in FR.score(tree, df).collect()}
    assert out["X"].unseen_category is True
    assert out["Y"].Hour == 12 and out["Y"].Location == "Hà Nội" and out["Y"].unseen_category is False


def test_explanations_follow_the_model(tree, forest, data):
    d = FR.with_input_defaults(data)
    ex = explain(tree, FR.predict(tree, d))
    bad = ex.where(F.col("path_prediction") != F.col("prediction")).count()
    assert bad == 0
    assert ex.where(F.size("rules") == 0).count() == 0
    rules = {t for r in ex.select(F.explode("rules").alias("t")).distinct().collect() for t in [r.t]}
    assert any(t.startswith("Số tiền giao dịch") for t in rules)
    fx_ = explain(forest, d)
    assert fx_.where(F.size("rules") == 0).count() == 0


def test_compile_hand_written_tree(spark):
    feats = [("Payment_Method", "QR"), ("Amount_VND", None), ("Hour", None), ("Is_Weekend", None)]
    nodes = {
        0: {"prediction": 0.0, "left": 1, "right": 2, "feature": 1, "values": [1000.5], "ncat": -1},
        1: {"prediction": 0.0, "left": -1, "right": -1, "feature": -1, "values": [], "ncat": -1},
        2: {"prediction": 0.0, "left": 3, "right": 4, "feature": 0, "values": [0.0], "ncat": 2},
        3: {"prediction": 0.0, "left": 5, "right": 6, "feature": 3, "values": [0.5], "ncat": -1},
        4: {"prediction": 1.0, "left": -1, "right": -1, "feature": -1, "values": [], "ncat": -1},
        5: {"prediction": 0.0, "left": -1, "right": -1, "feature": -1, "values": [], "ncat": -1},
        6: {"prediction": 1.0, "left": -1, "right": -1, "feature": -1, "values": [], "ncat": -1},
    }
    rules, pred = compile_tree(nodes, feats)
    df = spark.createDataFrame([(5.0, "QR", 1, 0), (2000.0, "QR", 3, 0), (2000.0, "Card", 3, 1)],
                               "Amount_VND double, Payment_Method string, Hour int, Is_Weekend int")
    out = df.select(rules.alias("r"), pred.alias("p")).collect()
    assert out[0].r == ["Số tiền giao dịch ≤ 1,000 đ"] and out[0].p == 0.0
    assert out[1].r == ["Số tiền giao dịch > 1,000 đ", "Thanh toán bằng QR"] and out[1].p == 1.0
    assert out[2].r == ["Số tiền giao dịch > 1,000 đ", "Không thanh toán bằng QR", "Giao dịch vào cuối tuần"]


def test_split_is_stable_across_partitionings(data):
    a = FR.split_by_hash(data.repartition(3)).where("is_test").select("Transaction_ID")
    b = FR.split_by_hash(data.repartition(11)).where("is_test").select("Transaction_ID")
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
    frac = a.count() / data.count()
    assert 0.17 < frac < 0.23


def test_one_class_training_raises(spark, data):
    with pytest.raises(FR.OneClassTraining):
        FR.fit_fraud_model(data.where("Is_Fraud = 0"), "decision_tree")
    with pytest.raises(ValueError):
        FR.build_pipeline("svm")


def test_metrics_against_hand_computation(spark):
    rows = [(1, 1)] * 3 + [(1, 0)] * 1 + [(0, 0)] * 5 + [(0, 1)] * 1
    df = spark.createDataFrame(rows, "Is_Fraud int, prediction int")
    m = FR.classification_metrics(df).first()
    p1, r1, p0, r0 = 3 / 4, 3 / 4, 5 / 6, 5 / 6
    f = lambda p, r: 2 * p * r / (p + r)
    assert m.accuracy == pytest.approx(0.8)
    assert m.precision == pytest.approx((4 * p1 + 6 * p0) / 10)
    assert m.recall == pytest.approx((4 * r1 + 6 * r0) / 10)
    assert m.f1_score == pytest.approx((4 * f(p1, r1) + 6 * f(p0, r0)) / 10)
    cm = {(r.label, r.prediction): r["count"] for r in FR.confusion(df).collect()}
    assert cm == {(0, 0): 5, (0, 1): 1, (1, 0): 1, (1, 1): 3}
    # predictions of a class absent from the labels: zero division → 0
    m2 = FR.classification_metrics(spark.createDataFrame([(0, 1), (0, 0)], "Is_Fraud int, prediction int")).first()
    assert m2.precision == pytest.approx(1.0) and m2.recall == pytest.approx(0.5)


def test_compare_models(spark):
    rows = [("decision_tree", 0.95, 0.9, 0.9, 0.9), ("random_forest", 0.9505, 0.8, 0.95, 0.9)]
    m = spark.createDataFrame(rows, "model string, accuracy double, precision double, recall double, f1_score double")
    out = {r.metric: (r.winner, round(r.margin, 6)) for r in FR.compare_models(m).collect()}
    assert out["accuracy"] == ("Tương đương", 0.0)
    assert out["precision"] == ("Decision Tree", 10.0)
    assert out["recall"] == ("Random Forest", 5.0)
