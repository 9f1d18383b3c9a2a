"""Catalog entries of deep pages, encoded inputs, given probabilities and the model registry."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerlens.functions.parse import ts_votes
from ledgerlens.operators import fraud as FR
from ledgerlens.operators import listing as P
from ledgerlens.plans.catalog import q
from ledgerlens.plans.oracle_views import with_views
from ledgerlens.plans.registry import CLASS_COUNTS, ModelRegistry
from ledgerlens.schema import AMOUNT, CATEGORY, FRAUD, HOUR, LOCATION, PAYMENT, TS, TX_ID, VERDICT_FRAUD, VERDICT_SAFE, WEEKEND
from ledgerlens.session import shared_dir
from ledgerlens.sources import fixtures as fx


# --- C1 rejects ---------------------------------------------------------------------------
@q("c1_shape_votes", with_views(
    "select case when regexp_full_match(Timestamp, '\\d{4}-\\d\\d-\\d\\d \\d\\d:\\d\\d:\\d\\d') then 'yyyy-MM-dd HH:mm:ss' end as pattern, "
    "count(*) as n from tx_raw where Timestamp is not null group by 1", "tx_raw"))
def c1_votes(spark, sf):
    return ts_votes(fx.tx_raw(spark, sf), TS).select("pattern", "n")


# --- P2 by page number ---------------------------------------------------------------------
@q("p2_deep_page_by_number", with_views(
    "select * from (select Transaction_ID, Timestamp, cast(row_number() over (order by Timestamp desc nulls last, Transaction_ID desc) "
    "as integer) as pos from tx) where pos between 601 and 640", "tx"))
def p2_deep(spark, sf):
    got = P.page_at(fx.tx(spark, sf), 16, 40, TS, "desc", span=50, pivots=8)
    pos = 600 + F.row_number().over(Window.orderBy(*P.sort_keys(TS, "desc")))
    return got.select(TX_ID, TS, pos.cast("int").alias("pos"))


@q("p2_deep_page_tied_values", with_views(
    "select Transaction_ID, h from (select Transaction_ID, case when Hour % 5 = 0 then null else Hour end as h, row_number() over "
    "(order by case when Hour % 5 = 0 then null else Hour end asc nulls last, Transaction_ID asc) as pos from tx) where pos between 421 and 490", "tx"))
def p2_tied(spark, sf):
    d = fx.tx(spark, sf).withColumn(AMOUNT, F.when(F.col(HOUR) % 5 != 0, F.col(HOUR)))
    return P.page_at(d, 7, 70, AMOUNT, "asc", span=30, pivots=6).select(TX_ID, F.col(AMOUNT).alias("h"))


# --- M2, M9, M14 ---------------------------------------------------------------------------
_SLOTS = " union all ".join(
    f"select distinct {i} as k, coalesce({c}, 'nan') as v from tx_fraud" for i, c in enumerate((PAYMENT, CATEGORY, LOCATION)))


@q("m2_encoded", with_views(
    "select Transaction_ID, list_concat((select list(case when s.v = case s.k when 0 then coalesce(Payment_Method, 'nan') "
    "when 1 then coalesce(Merchant_Category, 'nan') else coalesce(Location, 'nan') end then 1.0::double else 0.0::double end order by s.k, s.v) "
    "from s), [Amount_VND::double, Hour::double, Is_Weekend::double]) as features from tx_fraud", "tx_fraud", extra=[f"s as ({_SLOTS})"]))
def m2_encoded(spark, sf):
    return FR.encoded(fx.tx_fraud(spark, sf))


@q("m9_given_probability", with_views(
    "select Transaction_ID, round((Amount_VND + 0.003) / 1000, 6) as probability, round(round((Amount_VND + 0.003) / 1000, 6) * 100, 1) as probability_pct, "
    f"case when Amount_VND >= 500 then '{VERDICT_FRAUD}' else '{VERDICT_SAFE}' end as verdict from tx_fraud", "tx_fraud"))
def m9_given(spark, sf):
    d = fx.tx_fraud(spark, sf).withColumns({"probability": F.round((F.col(AMOUNT) + 0.003) / 1000, 6), "is_fraud_pred": (F.col(AMOUNT) >= 500).cast("int")})
    return FR.with_verdict(d).select(TX_ID, "probability", "probability_pct", "verdict")


@q("m9_absent_fields_only", with_views(
    "select Transaction_ID, Payment_Method, Merchant_Category, Location, coalesce(Amount_VND, 0.0) as Amount_VND, 12 as Hour, "
    "0 as Is_Weekend from tx_fraud", "tx_fraud"))
def m9_absent(spark, sf):
    d = fx.tx_fraud(spark, sf).drop(HOUR, WEEKEND)
    return FR.with_absent_defaults(d).select(TX_ID, PAYMENT, CATEGORY, LOCATION, AMOUNT, HOUR, WEEKEND)


@q("m14_status_rows", with_views(
    "select 'decision_tree' as model, true as trained, true as active, (select count(*) from tx_fraud) as total_samples, "
    "(select count(*) from tx_fraud where Is_Fraud = 1) as fraud_samples, (select count(*) from tx_fraud where Is_Fraud = 0) as normal_samples "
    "union all select 'random_forest', false, false, null, null, null", "tx_fraud"))
def m14_status(spark, sf):
    registry = ModelRegistry(spark, shared_dir(spark, f"fixtures/models-{uuid.uuid4().hex}"))
    registry.train(fx.tx_fraud(spark, sf).withColumn(FRAUD, F.col(FRAUD)), "decision_tree")
    return registry.status_rows().select("model", "trained", "active", *CLASS_COUNTS)
