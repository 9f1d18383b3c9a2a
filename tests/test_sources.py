import json
import os

import pytest

from ledgerlens.operators.fraud import FraudModel
from ledgerlens.plans.registry import ModelNotTrained, ModelRegistry
from ledgerlens.sources import fixtures as fx
from ledgerlens.sources.csv import read_transactions, write_transactions_csv
from ledgerlens.sources.dataset import DatasetError, open_dataset
from ledgerlens.sources.tables import jdbc_options, latest_n, to_json_records, write_json

from paths import SF001, SF01


def test_csv_round_trip(spark, tmpdir_path):
    raw = fx.tx_raw(spark, SF001)
    path = os.path.join(tmpdir_path, "tx.csv")
    write_transactions_csv(raw, path)
    back = read_transactions(spark, path)
    assert sorted(back.columns) == sorted(raw.columns)
    assert back.count() == raw.count()
    # 'NA' amounts come back as missing values
    assert back.where("Amount_VND is null").count() == raw.where("Amount_VND = 'NA'").count()


def test_open_dataset_and_switch(spark, tmpdir_path):
    with pytest.raises(DatasetError):
        open_dataset(spark, os.path.join(tmpdir_path, "missing.csv"))
    with pytest.raises(DatasetError):
        open_dataset(spark, os.path.join(tmpdir_path, "data.txt"))
    path = os.path.join(tmpdir_path, "a.csv")
    write_transactions_csv(fx.tx_raw(spark, SF001), path)
    ds = open_dataset(spark, path)
    n = ds.cleaned().count()
    assert n == fx.tx(spark, SF001).count()
    mat = ds.materialize(os.path.join(tmpdir_path, "clean_parquet"))
    assert mat.count() == n
    ds2 = open_dataset(spark, path, previous=ds)
    assert ds.closed and not ds2.closed and ds2.registry_path() == ds.registry_path()   # same data, same models
    with pytest.raises(DatasetError):
        ds.cleaned()


def test_latest_n_and_json(spark, tmpdir_path):
    t = fx.tx(spark, SF001)
    top = latest_n(t, "Timestamp", 5, ["Transaction_ID", "Timestamp", "Location"], tie_col="Transaction_ID")
    rows = top.collect()
    assert len(rows) == 5 and rows[0].Timestamp >= rows[-1].Timestamp
    recs = [json.loads(r.value) for r in to_json_records(top).collect()]
    assert set(recs[0]) == {"Transaction_ID", "Timestamp", "Location"} and "T" in recs[0]["Timestamp"]
    out = os.path.join(tmpdir_path, "json")
    write_json(top, out)
    assert spark.read.json(out).count() == 5
    assert jdbc_options("jdbc:postgresql://db/x", "transactions", {"user": "u"})["dbtable"] == "transactions"


def test_registry(spark, tmpdir_path):
    reg = ModelRegistry(spark, os.path.join(tmpdir_path, "models"))
    with pytest.raises(ModelNotTrained):
        reg.model("decision_tree")
    data = fx.tx_fraud(spark, SF01)
    m = reg.train(data, "decision_tree").first()
    assert m.model == "decision_tree" and m.total_samples == 10000
    reg2 = ModelRegistry(spark, os.path.join(tmpdir_path, "models"))
    assert reg2.is_trained("decision_tree") and not reg2.is_trained("random_forest")
    assert isinstance(reg2.model("decision_tree"), FraudModel)
    cm = {(r.label, r.prediction): r["count"] for r in reg2.confusion("decision_tree").collect()}
    assert len(cm) == 4 and cm[(0, 0)] > 0 and cm[(1, 1)] > 0
    with pytest.raises(ValueError):
        reg2.set_active("svm")


def test_latest_n_missing_column_is_clear(spark):
    from ledgerlens.sources.tables import TableMissing

    with pytest.raises(TableMissing):
        latest_n(fx.tx(spark, SF001), "transaction_time", 10)
