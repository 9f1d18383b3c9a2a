"""Catalog entries on harder inputs: typed and ISO timestamps, word flags, large amounts,
nulls, given segments and given trees. Same form as ``catalog``; registered with it.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.operators import clean as C
from ledgerlens.operators import customers as U
from ledgerlens.operators import features as E
from ledgerlens.operators import filters as FL
from ledgerlens.operators import fraud as FR
from ledgerlens.operators import listing as P
from ledgerlens.operators import metrics as M
from ledgerlens.operators.treerules import compile_tree
from ledgerlens.plans.catalog import _METRICS_BODY, _PREF, _rfm_sql, q
from ledgerlens.plans.oracle_views import hash_bucket, money_sum, with_views
from ledgerlens.schema import (
    AMOUNT, CATEGORY, COMPARE_TIE, FRAUD, HOUR, LOCATION, MODEL_NAMES, PAYMENT, RISK, SEGMENT_NAMES, TS, TX_ID, USER_ID, WEEKEND,
    FilterParams,
)
from ledgerlens.session import shared_dir
from ledgerlens.sources import fixtures as fx
from ledgerlens.sources.csv import read_transactions, write_transactions_csv
from ledgerlens.sources.dataset import open_dataset

NAMES_SQL = "[" + ", ".join(f"'{n}'" for n in SEGMENT_NAMES) + "]"


# --- S1, S2 ----------------------------------------------------------------------
def _awkward(spark, sf) -> DataFrame:
    """Raw rows with quotes, commas and missing-value words in two text columns."""
    n = F.expr("cast(substr(Transaction_ID, 2) as bigint)")
    return fx.tx_raw(spark, sf).withColumns({
        CATEGORY: F.when(n % 5 == 0, F.concat(F.lit('say ""hi"", '), F.col(CATEGORY), F.lit('"'))).otherwise(F.col(CATEGORY)),
        LOCATION: F.when(n % 7 == 0, "null").when(n % 11 == 0, "a NA b").otherwise(F.col(LOCATION))})


_AWKWARD = """aw as (select Transaction_ID, Amount_VND, case when cast(substr(Transaction_ID, 2) as bigint) % 5 = 0
  then concat('say ""hi"", ', Merchant_Category, '"') else Merchant_Category end as Merchant_Category,
  case when cast(substr(Transaction_ID, 2) as bigint) % 7 = 0 then 'null' when cast(substr(Transaction_ID, 2) as bigint) % 11 = 0
  then 'a NA b' else Location end as Location from tx_raw)"""


@q("s1_csv_round_trip", with_views(
    "select Transaction_ID, nullif(Amount_VND, 'NA') as Amount_VND, Merchant_Category, nullif(Location, 'null') as Location from aw",
    "tx_raw", extra=[_AWKWARD]))
def s1(spark, sf):
    path = shared_dir(spark, "fixtures/csv-" + hashlib.sha1(sf.encode()).hexdigest()[:12] + ".csv")
    write_transactions_csv(_awkward(spark, sf), path)
    return read_transactions(spark, path).select(TX_ID, AMOUNT, CATEGORY, LOCATION)


_PADDED = """pd as (select Transaction_ID, case cast(substr(Transaction_ID, 2) as bigint) % 4 when 0 then ' NA ' when 1 then 'NA'
  when 2 then ' ' else Location end as Location from tx_raw)"""


@q("s2_padded_token", with_views("select Transaction_ID, nullif(Location, 'NA') as Location from pd", "tx_raw", extra=[_PADDED]))
def s2_padded(spark, sf):
    n = F.expr("cast(substr(Transaction_ID, 2) as bigint)") % 4
    d = fx.tx_raw(spark, sf).withColumn(LOCATION, F.when(n == 0, " NA ").when(n == 1, "NA").when(n == 2, " ").otherwise(F.col(LOCATION)))
    path = shared_dir(spark, "fixtures/padded-" + hashlib.sha1(sf.encode()).hexdigest()[:12] + ".csv")
    write_transactions_csv(d, path)
    return read_transactions(spark, path).select(TX_ID, LOCATION)


# --- S3, S4 ------------------------------------------------------------------------
_SPAN = "1996-03-15", "1997-02-01"


def _delivered(spark, sf) -> str:
    """The clean multi-month rows delivered as a headered CSV folder."""
    path = shared_dir(spark, "fixtures/orders-" + hashlib.sha1(sf.encode()).hexdigest()[:12] + ".csv")
    write_transactions_csv(fx.tx_o(spark, sf).withColumn(TS, F.date_format(TS, "yyyy-MM-dd HH:mm:ss")), path)
    return path


@q("s3_reused_clean_table", with_views(
    "select Merchant_Category, count(*) as n, (select count(*) from tx_o) as n_all from tx_o group by 1", "tx_o"))
def s3_reused(spark, sf):
    """Two questions to one dataset, both answered from its cleaned table as written once."""
    ds = open_dataset(spark, _delivered(spark, sf))
    ds.materialize()
    n_all = ds.cleaned().count()
    return ds.cleaned().groupBy(CATEGORY).agg(F.count(F.lit(1)).alias("n"), F.lit(n_all).cast("long").alias("n_all"))


@q("s4_switched_and_pruned", with_views(
    "select Transaction_ID, Timestamp, Amount_VND, Location from tx_o "
    f"where Timestamp >= timestamp '{_SPAN[0]}' and Timestamp < timestamp '{_SPAN[1]}'", "tx_o"))
def s4_switched(spark, sf):
    """From another dataset to this one; a time range then reads its months only."""
    before = open_dataset(spark, f"{sf.rstrip('/')}/orders.parquet")
    ds = open_dataset(spark, _delivered(spark, sf), previous=before)
    assert before.closed and not ds.closed
    ds.materialize()
    return ds.between(*_SPAN).select(TX_ID, TS, AMOUNT, LOCATION)


# --- C1, C3, C8, C9, C12, money -----------------------------------------------------
def _typed(spark, sf, kind: str) -> DataFrame:
    """The raw rows with timestamps of another type or text shape, made from the parsed ones."""
    raw = fx.tx_raw(spark, sf)
    at = F.try_to_timestamp(F.col(TS), F.lit("yyyy-MM-dd HH:mm:ss")).cast("timestamp_ntz") + F.expr("interval 250 milliseconds")
    return raw.withColumn(TS, {"ntz": at, "date": at.cast("date"), "iso": F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSS")}[kind])


def _typed_sql(sql: str) -> str:
    return with_views(f"select Transaction_ID, {sql} as ts from tx", "tx")


@q("c1_typed_timestamp", _typed_sql("strftime(Timestamp + interval 250 milliseconds, '%Y-%m-%d %H:%M:%S.%g')"))
def c1_ntz(spark, sf):
    return C.clean_transactions(_typed(spark, sf, "ntz")).select(TX_ID, F.date_format(TS, "yyyy-MM-dd HH:mm:ss.SSS").alias("ts"))


@q("c1_date_column", _typed_sql("strftime(Timestamp, '%Y-%m-%d 00:00:00')"))
def c1_date(spark, sf):
    return C.clean_transactions(_typed(spark, sf, "date")).select(TX_ID, F.date_format(TS, "yyyy-MM-dd HH:mm:ss").alias("ts"))


@q("c1_iso_text", _typed_sql("strftime(Timestamp + interval 250 milliseconds, '%Y-%m-%d %H:%M:%S.%g')"))
def c1_iso(spark, sf):
    from ledgerlens.functions.parse import infer_ts_format

    raw = _typed(spark, sf, "iso")
    out = C.clean_transactions(raw, infer_ts_format(raw, TS))
    return out.select(TX_ID, F.date_format(TS, "yyyy-MM-dd HH:mm:ss.SSS").alias("ts"))


@q("c3_c8_word_flags", with_views("select Transaction_ID, cast(Is_Fraud = 1 as integer) as Is_Fraud, Is_Weekend from tx", "tx"))
def c3_words(spark, sf):
    raw = fx.tx_raw(spark, sf).withColumns({
        FRAUD: F.when(F.col(FRAUD) == "1", "True").otherwise(" false"), WEEKEND: F.col(WEEKEND) == "1"})
    return C.clean_transactions(raw).select(TX_ID, FRAUD, WEEKEND)


@q("c2_large_amounts", with_views(
    "select count(*) as total_transactions, cast(trunc(sum(case when cast(substr(Transaction_ID, 2) as bigint) % 9973 = 5 "
    "then cast('100000000000000000' as decimal(28,6)) else try_cast(Amount_VND as decimal(28,6)) end)) as bigint) as total_gmv from tx", "tx"))
def c2_large(spark, sf):
    n = F.expr("cast(substr(Transaction_ID, 2) as bigint)")
    raw = fx.tx_raw(spark, sf).withColumn(AMOUNT, F.when(n % 9973 == 5, "1e17").otherwise(F.col(AMOUNT)))
    return M.summary(C.clean_transactions(raw)).select("total_transactions", "total_gmv")


@q("c9_required_dropna_nulls", with_views(
    "select Transaction_ID, User_ID from (select case when hour(Timestamp) = 3 then null else Transaction_ID end as Transaction_ID, "
    "case when hour(Timestamp) = 4 then null else User_ID end as User_ID, case when hour(Timestamp) = 5 then null else Amount_VND end as a "
    "from tx) where Transaction_ID is not null and User_ID is not null and a is not null", "tx"))
def c9_nulls(spark, sf):
    gone = lambda h, c: F.when(F.hour(TS) != h, F.col(c))
    d = fx.tx(spark, sf).withColumns({TX_ID: gone(3, TX_ID), USER_ID: gone(4, USER_ID), AMOUNT: gone(5, AMOUNT)})
    return C.drop_incomplete(d).select(TX_ID, USER_ID)


@q("p4_projection_with_risk", with_views(
    "select Transaction_ID as transaction_id, case when Hour % 4 = 0 then 0 when Hour % 4 = 1 then 0 else Hour end as risk_score from tx", "tx"))
def p4_risk(spark, sf):
    text = F.when(F.col(HOUR) % 4 == 0, F.lit(None)).when(F.col(HOUR) % 4 == 1, "x").otherwise(F.concat(F.col(HOUR), F.lit(".9")))
    return P.project_rows(fx.tx(spark, sf).withColumn(RISK, text)).select("transaction_id", "risk_score")


@q("e4_one_hot_columns", with_views(
    "select Transaction_ID, coalesce(Location, 'Unknown') as Location, case when Payment_Method = 'QR' then 1.0 else 0.0 end as is_qr, "
    "case when Merchant_Category = 'Mua sắm' then 1.0 else 0.0 end as is_shopping from tx", "tx"))
def e4_columns(spark, sf):
    out = E.Preprocessor().process(fx.tx(spark, sf))
    return out.select(TX_ID, LOCATION, F.col(f"`{PAYMENT}_QR`").alias("is_qr"), F.col(f"`{CATEGORY}_Mua sắm`").alias("is_shopping"))


# --- P2, F6, B10, B11, U8 -------------------------------------------------------------
_NO_ID = "case when Hour = 7 then null else Transaction_ID end"


@q("p2_keyset_page", with_views(
    "select round(a, 0) as a, id from (select round(Amount_VND, 0) as a, " + _NO_ID + " as id from tx) where a is null or a < 40 or "
    "(a = 40 and (id < 'E5' or id is null)) order by a desc nulls last, id desc nulls last limit 200", "tx"))
def p2_keyset(spark, sf):
    d = fx.tx(spark, sf).withColumns({AMOUNT: F.round(AMOUNT, 0), TX_ID: F.when(F.col(HOUR) != 7, F.col(TX_ID))})
    return P.page_after(d, 40.0, "E5", AMOUNT, "desc", 200).select(F.col(AMOUNT).alias("a"), F.col(TX_ID).alias("id"))


@q("f6_unicode_search", with_views("select Transaction_ID from tx where Merchant_Category = 'Ăn uống'", "tx"))
def f6_unicode(spark, sf):
    return FL.search(fx.tx(spark, sf), r"^\w\w uống\b").select(TX_ID)


@q("b10_small_share", with_views(
    'select "from", "to", cast(v as double) as value from g where cast(v as double) >= cast((select sum(v) from g) as double) * 0.0006', "tx",
    extra=[f"g as (select Payment_Method as \"from\", concat(Merchant_Category, cast(Hour as varchar), coalesce(Location, '')) as \"to\", "
           f"{money_sum()} as v from tx group by 1, 2)"]))
def b10_small(spark, sf):
    d = fx.tx(spark, sf).withColumn(CATEGORY, F.concat(CATEGORY, F.col(HOUR).cast("string"), F.coalesce(LOCATION, F.lit(""))))
    return M.category_flows(d, min_share=0.0006)


NOWHERE = FilterParams(location="nowhere")


@q("b11_empty_funnel", with_views("select 1 as step, '' as label, count(*) as value from tx where false group by 1", "tx"))
def b11_empty(spark, sf):
    return M.user_funnel(FL.apply_filters(fx.tx(spark, sf), NOWHERE))


@q("u8_empty", with_views("select '' as segment, count(*) as user_count, 0.0 as total_spend, 1 as rank from tx where false group by 1", "tx"))
def u8_empty(spark, sf):
    return U.user_analytics(FL.apply_filters(fx.tx(spark, sf), NOWHERE))["segments"]


# --- U4-U6, U9 on given clusters --------------------------------------------------------
def _given(spark, sf) -> DataFrame:
    return U.name_segments(U.rfm(fx.tx_o(spark, sf)).withColumn("Cluster", (F.col("Frequency") % 6).cast("int")))


_GIVEN = [_rfm_sql("tx_o"), "cl as (select *, cast(Frequency % 6 as integer) as Cluster from rfm)",
          f"nm as (select Cluster, {NAMES_SQL}[least(row_number() over (order by avg(Monetary), Cluster), {len(SEGMENT_NAMES)})] "
          "as Segment_Name from cl group by Cluster)", "seg as (select * from cl join nm using (Cluster))"]


@q("u4_names_of_given_clusters", with_views("select User_ID, Cluster, Segment_Name from seg", "tx_o", extra=_GIVEN))
def u4_given(spark, sf):
    return _given(spark, sf).select(USER_ID, "Cluster", "Segment_Name")


@q("u5_totals_of_given_segments", with_views(
    "select Segment_Name as segment, count(*) as user_count, cast(sum(cast(Monetary as decimal(28,6))) as double) as total_spend, "
    "cast(row_number() over (order by count(*) desc, Segment_Name) as integer) as rank from seg group by 1", "tx_o", extra=_GIVEN))
def u5_given(spark, sf):
    return U.segment_totals(_given(spark, sf))


@q("u6_top_users_with_segment", with_views(
    "select cast(User_ID as varchar) as user_id, cast(trunc(Monetary) as bigint) as total_spend, Frequency as transaction_count, "
    "preferred_payment_method, Segment_Name as segment from (select * from seg order by Monetary desc, User_ID limit 10) t "
    "left join pref using (User_ID)", "tx_o", extra=[*_GIVEN, _PREF.format(v="tx_o")]))
def u6_given(spark, sf):
    return U.user_analytics(fx.tx_o(spark, sf), _given(spark, sf))["top_users"]


_U8_PARTS = {
    "segments": "select Segment_Name as label, cast(sum(cast(Monetary as decimal(28,6))) as double) as value from seg group by 1",
    "top_users": "select cast(User_ID as varchar), trunc(Monetary) from (select * from seg order by Monetary desc, User_ID limit 10)",
    "by_hour": "select cast(hour(Timestamp) as varchar), cast(count(Transaction_ID) as double) from tx group by 1",
    "by_day": "select cast(isodow(Timestamp) - 1 as varchar), cast(count(Transaction_ID) as double) from tx group by 1"}


@q("u8_all_parts", with_views(
    " union all ".join(f"select '{part}' as part, label, value from ({sql}) as t(label, value)" for part, sql in _U8_PARTS.items()), "tx",
    extra=[_rfm_sql("tx"), *_GIVEN[1:]]))
def u8_all(spark, sf):
    """All four lists of the user analytics, on given segments, as (part, label, value)."""
    d = fx.tx(spark, sf)
    seg = U.name_segments(U.rfm(d).withColumn("Cluster", (F.col("Frequency") % 6).cast("int")))
    got = U.user_analytics(d, seg)
    named = {"segments": ("segment", "total_spend"), "top_users": ("user_id", "total_spend"),
             "by_hour": ("label", "value"), "by_day": ("weekday_no", "value")}
    parts = [got[part].select(F.lit(part).alias("part"), F.col(label).cast("string").alias("label"), F.col(value).cast("double").alias("value"))
             for part, (label, value) in named.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@q("u9_profile_of_given_segments", with_views(
    "select Segment_Name, count(*) as users, round(avg(Recency), 6) as mean_recency, round(avg(Frequency), 6) as mean_frequency, "
    "round(avg(Monetary), 4) as mean_monetary from seg group by 1", "tx_o", extra=_GIVEN))
def u9_given(spark, sf):
    return U.segment_profile(_given(spark, sf)).select(
        "Segment_Name", "users", F.round("mean_recency", 6).alias("mean_recency"),
        F.round("mean_frequency", 6).alias("mean_frequency"), F.round("mean_monetary", 4).alias("mean_monetary"))


# --- M7, M11, M13 on given predictions and a given tree -----------------------------------
@q("m7_three_labels", with_views(
    "select t.label, t.prediction, count(pr.label) as count from (select label, prediction from pr union values (0, 0), (0, 1), (1, 0), (1, 1)) "
    "t(label, prediction) left join pr on pr.label = t.label and pr.prediction = t.prediction group by 1, 2", "tx_fraud",
    extra=["pr as (select cast(Hour % 3 as integer) as label, cast(Hour % 2 as integer) as prediction from tx_fraud)"]))
def m7_three(spark, sf):
    d = fx.tx_fraud(spark, sf).withColumns({FRAUD: F.col(HOUR) % 3, "prediction": F.col(HOUR) % 2})
    return FR.confusion(d)


_FEATURES = [(PAYMENT, "QR"), (AMOUNT, None), (HOUR, None), (WEEKEND, None)]
_LEAF = {"left": -1, "right": -1, "feature": -1, "values": [], "ncat": -1}
_TREE = {0: {"prediction": 0.0, "left": 1, "right": 2, "feature": 1, "values": [60.5], "ncat": -1}, 1: {"prediction": 0.0, **_LEAF},
         2: {"prediction": 0.0, "left": 3, "right": 4, "feature": 0, "values": [0.0], "ncat": 2},
         3: {"prediction": 0.0, "left": 5, "right": 6, "feature": 3, "values": [0.5], "ncat": -1}, 4: {"prediction": 1.0, **_LEAF},
         5: {"prediction": 0.0, **_LEAF}, 6: {"prediction": 1.0, **_LEAF}}


@q("m11_explain_given_tree", with_views(
    "select Transaction_ID, case when Amount_VND <= 60.5 then 'Số tiền giao dịch ≤ 60 đ' when Payment_Method = 'QR' then "
    "'Số tiền giao dịch > 60 đ|Thanh toán bằng QR' when Is_Weekend <= 0.5 then "
    "'Số tiền giao dịch > 60 đ|Không thanh toán bằng QR|Giao dịch trong tuần' else "
    "'Số tiền giao dịch > 60 đ|Không thanh toán bằng QR|Giao dịch vào cuối tuần' end as rules, "
    "case when Amount_VND <= 60.5 then 0.0 when coalesce(Payment_Method, '') = 'QR' then 1.0 when Is_Weekend <= 0.5 then 0.0 else 1.0 end "
    "as path_prediction from tx_fraud", "tx_fraud"))
def m11_given(spark, sf):
    rules, pred = compile_tree(_TREE, _FEATURES)
    return fx.tx_fraud(spark, sf).select(TX_ID, F.array_join(rules, "|").alias("rules"), pred.alias("path_prediction"))


def _given_rules(spark, sf) -> DataFrame:
    """Metric rows of two planted rules standing for the two models."""
    held = FR.split_by_hash(fx.tx_fraud(spark, sf)).where(F.col("is_test"))
    conds = {"decision_tree": (F.col(AMOUNT) >= 100) & (F.col(HOUR) < 6), "random_forest": F.col(AMOUNT) >= 100}
    rows = [FR.classification_metrics(held.withColumn("prediction", c.cast("int"))).select(F.lit(k).alias("model"), "*")
            for k, c in conds.items()]
    return rows[0].unionByName(rows[1])


def _rule_ctes(letter: str, cond: str) -> list[str]:
    return [f"cc{letter} as (select Is_Fraud as label, cast({cond} as integer) as prediction, count(*) as n from tx_fraud "
            f"where {hash_bucket()} < 20 group by 1, 2)",
            f"m{letter} as ({_METRICS_BODY.replace('from cc', 'from cc' + letter)})"]


@q("m13_compare_given_metrics", with_views(
    "select metric, round(a, 6) as value_a, round(b, 6) as value_b, case when abs(a - b) < 0.1 then '" + COMPARE_TIE + "' when a > b then '"
    + MODEL_NAMES["decision_tree"] + "' else '" + MODEL_NAMES["random_forest"] + "' end as winner, "
    "round(case when abs(a - b) < 0.1 then 0.0 else abs(a - b) end, 6) as margin from (" + " union all ".join(
        f"select '{n}' as metric, (select {n} from ma) * 100 as a, (select {n} from mb) * 100 as b"
        for n in ("accuracy", "f1_score", "precision", "recall")) + ")", "tx_fraud",
    extra=[*_rule_ctes("a", "Amount_VND >= 100 and Hour < 6"), *_rule_ctes("b", "Amount_VND >= 100")]))
def m13_given(spark, sf):
    out = FR.compare_models(_given_rules(spark, sf))
    return out.select("metric", F.round("value_a", 6).alias("value_a"), F.round("value_b", 6).alias("value_b"), "winner",
                      F.round("margin", 6).alias("margin"))


@q("u10_export_of_given_segments", with_views(
    "select User_ID, Segment_Name, Recency, Frequency, Monetary from seg", "tx_o", extra=_GIVEN))
def u10_given(spark, sf):
    path = shared_dir(spark, "fixtures/segments-" + hashlib.sha1(sf.encode()).hexdigest()[:12])
    U.export_segments(_given(spark, sf), path)
    return spark.read.parquet(path).select(USER_ID, "Segment_Name", "Recency", "Frequency", "Monetary")
