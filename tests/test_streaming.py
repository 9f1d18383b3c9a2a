import os

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from ledgerlens.operators.fraud import fit_fraud_model
from ledgerlens.sources import fixtures as fx
from ledgerlens.sources.csv import write_transactions_csv
from ledgerlens.streaming import read_transaction_stream, scored_stream, start_sink

from paths import SF001, SF01


def test_stream_scoring_matches_batch(spark, tmpdir_path):
    model = fit_fraud_model(fx.tx_fraud(spark, SF01), "decision_tree")
    src = os.path.join(tmpdir_path, "incoming")
    raw = fx.tx_raw(spark, SF001)
    write_transactions_csv(raw.where("Transaction_ID < 'E5'"), os.path.join(src, "part1"))
    write_transactions_csv(raw.where("Transaction_ID >= 'E5'"), os.path.join(src, "part2"))
    stream = read_transaction_stream(spark, os.path.join(src, "*"))
    out = os.path.join(tmpdir_path, "scored")
    q = start_sink(scored_stream(model, stream), out, os.path.join(tmpdir_path, "ckpt"), available_now=True)
    q.awaitTermination(300)
    got = spark.read.parquet(out)
    assert got.count() == raw.count()
    assert got.where("probability < 0 or probability > 1").count() == 0


def test_stream_restart_resumes_without_duplicates(spark, tmpdir_path):
    model = fit_fraud_model(fx.tx_fraud(spark, SF01), "decision_tree")
    src = os.path.join(tmpdir_path, "in")
    out = os.path.join(tmpdir_path, "out")
    ckpt = os.path.join(tmpdir_path, "ck")
    raw = fx.tx_raw(spark, SF001)
    first = raw.where("Transaction_ID < 'E5'")
    write_transactions_csv(first, os.path.join(src, "a"))
    q = start_sink(scored_stream(model, read_transaction_stream(spark, os.path.join(src, "*"))), out, ckpt,
                   available_now=True)
    q.awaitTermination(300)
    assert spark.read.parquet(out).count() == first.count()
    # a new file arrives; the restarted query (same checkpoint) reads only that file
    write_transactions_csv(raw.where("Transaction_ID >= 'E5'"), os.path.join(src, "b"))
    q = start_sink(scored_stream(model, read_transaction_stream(spark, os.path.join(src, "*"))), out, ckpt,
                   available_now=True)
    q.awaitTermination(300)
    got = spark.read.parquet(out)
    assert got.count() == raw.count()
    assert got.select("Transaction_ID").distinct().count() == raw.count()


def test_default_checkpoint_belongs_to_the_sink(spark, tmpdir_path):
    src, out = os.path.join(tmpdir_path, "in"), os.path.join(tmpdir_path, "out")
    raw = fx.tx_raw(spark, SF001)
    for part, cond in (("a", "Transaction_ID < 'E5'"), ("b", "Transaction_ID >= 'E5'")):
        write_transactions_csv(raw.where(cond), os.path.join(src, part))
        start_sink(read_transaction_stream(spark, os.path.join(src, "*")), out, available_now=True).awaitTermination(300)
    got = spark.read.parquet(out)
    assert got.count() == got.select("Transaction_ID").distinct().count() == raw.count()


def test_columns_follow_the_files_header(spark, tmpdir_path):
    src, out = os.path.join(tmpdir_path, "in"), os.path.join(tmpdir_path, "out")
    raw = fx.tx_raw(spark, SF001)
    turned = raw.select("User_ID", *[c for c in raw.columns if c != "User_ID"]).withColumn("Risk_Score", F.lit("3"))
    write_transactions_csv(turned, os.path.join(src, "a"))
    start_sink(read_transaction_stream(spark, os.path.join(src, "*")), out, available_now=True).awaitTermination(300)
    got = spark.read.parquet(out)
    assert got.where("User_ID like 'U%' and Transaction_ID like 'E%' and Risk_Score = '3'").count() == raw.count()
    # a later file in another order stops the stream instead of swapping columns
    write_transactions_csv(raw.withColumn("Risk_Score", F.lit("3")), os.path.join(src, "b"))
    q = start_sink(read_transaction_stream(spark, os.path.join(src, "*"), columns=turned.columns), out, available_now=True)
    with pytest.raises(StreamingQueryException):
        q.awaitTermination(300)
