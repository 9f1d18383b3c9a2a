"""Inputs that earlier versions lost or failed on."""

import datetime as dt
import glob
import os

import pytest

from ledgerlens.operators import quantile as Q
from ledgerlens.operators.clean import clean_transactions
from ledgerlens.operators.customers import user_analytics
from ledgerlens.operators.filters import apply_filters, search
from ledgerlens.operators.listing import page_after, sorted_rows
from ledgerlens.operators.treerules import tree_nodes
from ledgerlens.plans.service import AnalyticsService
from ledgerlens.schema import FilterParams
from ledgerlens.sources import fixtures as fx
from ledgerlens.sources.csv import read_transactions, write_transactions_csv
from ledgerlens.sources.dataset import open_dataset
from ledgerlens.sources.tables import to_json_records, top_n_query

from paths import SF001

RAW = "Transaction_ID string, User_ID string, Amount_VND string, Timestamp string, Is_Fraud string"


def test_quantile_passes_bring_back_a_fixed_number_of_rows(spark, monkeypatch):
    seen, real = [], Q._count_parts

    def counted(vals, ranges):
        out = real(vals, ranges)
        seen.append((len(ranges), sum(map(len, out))))
        return out
    monkeypatch.setattr(Q, "_count_parts", counted)
    for n in (3_000, 300_000):
        df = spark.range(n).selectExpr("cast(pmod(id * 7919, %d) as double) / 3 as v" % n)
        assert Q.exact_quantiles(df, "v", [0.25, 0.75]) == pytest.approx([(n - 1) / 12, (n - 1) / 4])
    assert all(rows <= ranges * Q.BUCKETS for ranges, rows in seen) and len(seen) <= 6


def test_quantiles_of_extreme_values(spark):
    values = [float("inf"), -1e308, 1e308, 0.0, 5e-324, 5e-324, None, float("nan"), 1.0]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert Q.exact_quantiles(df, "v", [0.0, 0.5]) == [-1e308, 1.0] or Q.exact_quantiles(df, "v", [0.5]) == [5e-324]


def test_csv_quotes_and_line_breaks(spark, tmpdir_path):
    path = os.path.join(tmpdir_path, "q.csv")
    with open(path, "w") as f:
        f.write('a,b,c\n1,"say ""hi"", x",2\n3,"two\nlines",4\n')
    rows = read_transactions(spark, path, multi_line=True).collect()
    assert [tuple(r) for r in rows] == [("1", 'say "hi", x', "2"), ("3", "two\nlines", "4")]
    assert read_transactions(spark, path).first().b == 'say "hi", x'


def test_iso_text_keeps_its_rows_through_the_service(spark, tmpdir_path):
    path = os.path.join(tmpdir_path, "iso.csv")
    with open(path, "w") as f:
        f.write("Transaction_ID,User_ID,Amount_VND,Timestamp,Payment_Method,Merchant_Category,Location,Is_Fraud,Hour,Is_Weekend\n"
                "T1,u1,5,2026-01-05T10:00:00,QR,Shopping,X,True,10,False\nT2,u2,1e17,2026-01-06T11:00:00,QR,Shopping,X,False,11,False\n")
    s = AnalyticsService(spark, path)
    r = s.summary().first()
    assert (r.total_transactions, r.fraud_rate, r.total_gmv) == (2, 50.0, 10 ** 17 + 5)
    assert s.funnel(FilterParams(location="none")).count() == 0
    assert all(d.count() == 0 for d in s.user_analytics(FilterParams(location="none")).values())
    keyed = s.transactions_after(5.0, "T1", sort_by="Amount_VND", sort_order="asc").collect()
    assert [x.transaction_id for x in keyed] == ["T2"]


def test_typed_timestamps_are_kept(spark):
    t = dt.datetime(2026, 1, 5, 10, 0, 0, 123456)
    for kind, want in (("timestamp_ntz", t), ("date", dt.datetime(2026, 1, 5))):
        df = spark.createDataFrame([("T", "u", "1", t, "1")], "Transaction_ID string, User_ID string, Amount_VND string, "
                                   "Timestamp timestamp_ntz, Is_Fraud string")
        df = df.withColumn("Timestamp", df.Timestamp.cast(kind))
        assert clean_transactions(df).first().Timestamp == want


def test_keyset_pages_hold_every_row_with_null_ids(spark):
    rows = [(f"T{i}" if i % 3 else None, "u", float(i % 2), None, "0") for i in range(9)]
    df = spark.createDataFrame(rows, "Transaction_ID string, User_ID string, Amount_VND double, Timestamp timestamp_ntz, Is_Fraud string")
    for order in ("asc", "desc"):
        whole = [(r.Amount_VND, r.Transaction_ID) for r in sorted_rows(df, "Amount_VND", order).collect()]
        at = next(i for i, (_, x) in enumerate(whole) if x is not None)
        rest = page_after(df, *whole[at], "Amount_VND", order, 100).collect()
        assert [(r.Amount_VND, r.Transaction_ID) for r in rest] == whole[at + 1:]


def test_search_checks_the_pattern_and_knows_unicode(spark):
    df = spark.createDataFrame([("T", "u", "Ăn uống")], "Transaction_ID string, User_ID string, Merchant_Category string")
    assert search(df, r"^\w\w uống").count() == 1
    with pytest.raises(ValueError):
        search(df, "(")


def test_dataset_key_follows_the_data(spark, tmpdir_path):
    path = os.path.join(tmpdir_path, "d.csv")
    raw = fx.tx_raw(spark, SF001)
    write_transactions_csv(raw.limit(10).coalesce(1), path)
    first = open_dataset(spark, path).key
    assert open_dataset(spark, path).key == first
    write_transactions_csv(raw.limit(20).coalesce(1), path)
    assert open_dataset(spark, path).key != first


def test_materialized_months_prune_and_files_stay_few(spark, tmpdir_path):
    path = os.path.join(tmpdir_path, "o.parquet")
    fx.tx_o(spark, SF001).repartition(8).write.parquet(path)
    ds, out = open_dataset(spark, path), os.path.join(tmpdir_path, "clean")
    whole = ds.materialize(out)
    months = whole.select("month").distinct().count()
    assert len(glob.glob(out + "/month=*/*.parquet")) <= months + 8
    some = ds.between("1996-01-01", "1996-03-01")
    assert 0 < some.count() == whole.where("Timestamp >= '1996-01-01' and Timestamp < '1996-03-01'").count()
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(month" in plan


def test_json_times_keep_fraction_and_offset(spark):
    df = spark.sql("select timestamp_ntz'2026-01-05 10:00:00' a, timestamp_ntz'2026-01-05 10:00:00.5' b, timestamp'2026-01-05 10:00:00Z' c")
    assert to_json_records(df).first().value == '{"a":"2026-01-05T10:00:00","b":"2026-01-05T10:00:00.500000","c":"2026-01-05T10:00:00+00:00"}'


def test_database_top_n_is_one_query():
    assert top_n_query("app.tx", "ts", 5, ["id", 'a"b'], "id") == (
        '(SELECT "id", "a""b" FROM "app"."tx" ORDER BY "ts" DESC NULLS LAST, "id" DESC NULLS LAST LIMIT 5) AS latest')


def test_nodes_come_from_the_models_text(spark):
    from ledgerlens.operators.fraud import fit_fraud_model
    from paths import SF01
    m = fit_fraud_model(fx.tx_fraud(spark, SF01), "decision_tree")
    nodes = tree_nodes(m.classifier)
    assert len(nodes) == m.classifier.numNodes
    assert all(n["left"] < 0 or (n["left"] in nodes and n["right"] in nodes) for n in nodes.values())


def test_no_users_give_empty_analytics(spark):
    out = user_analytics(apply_filters(fx.tx(spark, SF001), FilterParams(location="nowhere")))
    assert {k: v.count() for k, v in out.items()} == {"segments": 0, "top_users": 0, "by_hour": 0, "by_day": 0}
