"""Query catalog: one entry per inventory row, each ``(spark, sf_dir) -> DataFrame``,
with the DuckDB oracle text where the row is SQL-expressible.

Every query reads the driver tables through the views in
``ledgerlens.sources.fixtures`` and runs over the whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlens.operators import clean as C
from ledgerlens.operators import customers as U
from ledgerlens.operators import features as E
from ledgerlens.operators import filters as FL
from ledgerlens.operators import fraud as FR
from ledgerlens.operators import geo as G
from ledgerlens.operators import listing as P
from ledgerlens.operators import metrics as M
from ledgerlens.operators.forecast import baseline_forecast
from ledgerlens.operators.treerules import explain
from ledgerlens.plans.oracle_views import hash_bucket, money_sum, with_views
from ledgerlens.schema import (
    AMOUNT, CATEGORY, FRAUD, FRAUD_INPUT_DEFAULTS, HOUR, LOCATION, PAYMENT, RISK, TS, TX_ID,
    USER_ID, WEEKEND, FilterParams,
)
from ledgerlens.sources import fixtures as fx
from ledgerlens.sources.tables import latest_n, to_json_records

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def q(name: str, sql: str | None = None):
    def deco(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


MS = money_sum()
HANOI = "Hà Nội"
PAY_VALUE = "Ví điện tử"
CAT_VALUE = "Mua sắm"


def _ms(c: str = "Amount_VND") -> str:
    return f"cast({money_sum(c)} as double)"


# ---------------------------------------------------------------------------
# S5, S6 sources and sinks
# ---------------------------------------------------------------------------
@q("s5_latest_transactions", with_views(
    "select Transaction_ID, User_ID, Amount_VND, Timestamp from tx "
    "order by Timestamp desc, Transaction_ID desc limit 100", "tx"))
def s5(spark, sf):
    return latest_n(fx.tx(spark, sf), TS, 100, [TX_ID, USER_ID, AMOUNT, TS], tie_col=TX_ID)


@q("s6_json_records", with_views(
    "select to_json({'Transaction_ID': Transaction_ID, 'Amount_VND': Amount_VND, "
    "'Timestamp': strftime(Timestamp, '%Y-%m-%dT%H:%M:%S'), 'Location': Location}) as value "
    "from (select * from tx order by Timestamp desc, Transaction_ID desc limit 100)", "tx"))
def s6(spark, sf):
    top = latest_n(fx.tx(spark, sf), TS, 100, [TX_ID, AMOUNT, TS, LOCATION], tie_col=TX_ID)
    return to_json_records(top)


# ---------------------------------------------------------------------------
# C1-C12 cleaning
# ---------------------------------------------------------------------------
@q("c1_timestamp_parse", with_views(
    "select Transaction_ID, try_strptime(Timestamp, '%Y-%m-%d %H:%M:%S') as Timestamp from tx_raw", "tx_raw"))
def c1(spark, sf):
    from ledgerlens.functions.parse import parse_timestamp
    return fx.tx_raw(spark, sf).select(TX_ID, parse_timestamp(TS).alias(TS))


@q("c2_amount_parse", with_views("select Transaction_ID, Amount_VND from tx_fraud", "tx_fraud"))
def c2(spark, sf):
    return fx.tx_fraud(spark, sf).select(TX_ID, AMOUNT)


@q("c3_fraud_flag_parse", with_views("select Transaction_ID, Is_Fraud from tx_fraud", "tx_fraud"))
def c3(spark, sf):
    return fx.tx_fraud(spark, sf).select(TX_ID, FRAUD)


@q("c4_drop_bad_timestamps", with_views("select * from tx", "tx"))
def c4(spark, sf):
    return fx.tx(spark, sf)


@q("c5_category_localise", with_views("select Transaction_ID, Merchant_Category from tx_fraud", "tx_fraud"))
def c5(spark, sf):
    return fx.tx_fraud(spark, sf).select(TX_ID, CATEGORY)


@q("c6_payment_localise", with_views("select Transaction_ID, Payment_Method from tx_fraud", "tx_fraud"))
def c6(spark, sf):
    return fx.tx_fraud(spark, sf).select(TX_ID, PAYMENT)


@q("c7_hour_parse", with_views("select Transaction_ID, Hour from tx_fraud", "tx_fraud"))
def c7(spark, sf):
    return fx.tx_fraud(spark, sf).select(TX_ID, HOUR)


@q("c8_weekend_parse", with_views("select Transaction_ID, Is_Weekend from tx_fraud", "tx_fraud"))
def c8(spark, sf):
    return fx.tx_fraud(spark, sf).select(TX_ID, WEEKEND)


@q("c9_required_dropna", with_views(
    "select * from tx_o where Transaction_ID is not null and User_ID is not null "
    "and Timestamp is not null and Amount_VND is not null", "tx_o"))
def c9(spark, sf):
    return C.drop_incomplete(fx.tx_o(spark, sf))


@q("c10_fill_unknown", with_views(
    "select Transaction_ID, coalesce(Payment_Method, 'Unknown') as Payment_Method, "
    "coalesce(Merchant_Category, 'Unknown') as Merchant_Category, "
    "coalesce(Location, 'Unknown') as Location from tx", "tx"))
def c10(spark, sf):
    return C.fill_unknown(fx.tx(spark, sf)).select(TX_ID, PAYMENT, CATEGORY, LOCATION)


@q("c11_iqr_clip", with_views(
    "select Transaction_ID, least(greatest(Amount_VND, 0.0), (select q3 + 3.0 * (q3 - q1) from b)) "
    "as Amount_VND from tx_o", "tx_o",
    extra=["b as (select quantile_cont(Amount_VND, 0.25) as q1, quantile_cont(Amount_VND, 0.75) as q3 from tx_o)"]))
def c11(spark, sf):
    d = fx.tx_o(spark, sf)
    return C.clip_amount(d, C.iqr_upper_bound(d)).select(TX_ID, AMOUNT)


@q("c12_risk_score_default", with_views("select Transaction_ID, 0 as Risk_Score from tx", "tx"))
def c12(spark, sf):
    return C.with_default(fx.tx(spark, sf), RISK, 0).select(TX_ID, RISK)


# ---------------------------------------------------------------------------
# F1-F6 filters
# ---------------------------------------------------------------------------
@q("f1_location_filter", with_views(f"select * from tx where Location = '{HANOI}'", "tx"))
def f1(spark, sf):
    return FL.apply_filters(fx.tx(spark, sf), FilterParams(location=HANOI))


@q("f2_payment_filter", with_views(f"select * from tx where Payment_Method = '{PAY_VALUE}'", "tx"))
def f2(spark, sf):
    return FL.apply_filters(fx.tx(spark, sf), FilterParams(payment_method=PAY_VALUE))


@q("f3_category_filter", with_views(f"select * from tx where Merchant_Category = '{CAT_VALUE}'", "tx"))
def f3(spark, sf):
    return FL.apply_filters(fx.tx(spark, sf), FilterParams(merchant_category=CAT_VALUE))


@q("f4_combined_filters", with_views(
    f"select * from tx where Location = '{HANOI}' and Payment_Method = '{PAY_VALUE}' "
    f"and Merchant_Category = '{CAT_VALUE}'", "tx"))
def f4(spark, sf):
    return FL.apply_filters(fx.tx(spark, sf), FilterParams(HANOI, PAY_VALUE, CAT_VALUE))


@q("f5_filter_values", with_views(
    "select list_sort(list(distinct Location) filter (where Location is not null)) as locations, "
    "list_sort(list(distinct Payment_Method) filter (where Payment_Method is not null)) as payment_methods, "
    "list_sort(list(distinct Merchant_Category) filter (where Merchant_Category is not null)) "
    "as merchant_categories from tx", "tx"))
def f5(spark, sf):
    return FL.filter_values(fx.tx(spark, sf))


@q("f5_filter_values_long", with_views(
    " union ".join(f"select '{name}' as field, cast({col} as varchar) as value from tx where {col} is not null"
                   for name, col in FL.FILTER_FIELDS), "tx"))
def f5l(spark, sf):
    return FL.filter_values_long(fx.tx(spark, sf))


@q("f6_keyword_search", with_views(
    "select * from tx where regexp_matches(lower(Transaction_ID), 'u1.') "
    "or regexp_matches(lower(User_ID), 'u1.') or regexp_matches(lower(Merchant_Category), 'u1.')", "tx"))
def f6(spark, sf):
    return FL.search(fx.tx(spark, sf), "U1.")


# ---------------------------------------------------------------------------
# P1-P5 listing
# ---------------------------------------------------------------------------
def _paged(df: DataFrame, sort_by: str, order: str, page_no: int, size: int) -> DataFrame:
    """A page plus its 1-based position in the full order (window over ≤ size rows)."""
    pg = P.page(df, sort_by, order, page_no, size)
    start = max((page_no - 1) * size, 0)
    return pg.withColumn("pos", F.lit(start) + F.row_number().over(Window.orderBy(*P.sort_keys(sort_by, order))))


@q("p1_sort_amount_asc", with_views(
    "select Transaction_ID, Amount_VND, cast(row_number() over (order by Amount_VND asc nulls last, "
    "Transaction_ID asc) as integer) as pos from tx order by pos limit 20", "tx"))
def p1(spark, sf):
    return _paged(fx.tx(spark, sf), AMOUNT, "asc", 1, 20).select(TX_ID, AMOUNT, F.col("pos").cast("int"))


@q("p2_page_three_desc", with_views(
    "select * from (select Transaction_ID, Timestamp, cast(row_number() over (order by Timestamp desc "
    "nulls last, Transaction_ID desc) as integer) as pos from tx) where pos between 41 and 60", "tx"))
def p2(spark, sf):
    return _paged(fx.tx(spark, sf), TS, "desc", 3, 20).select(TX_ID, TS, F.col("pos").cast("int"))


@q("p3_page_total", with_views(
    f"select count(*) as total from tx where Location = '{HANOI}' and (regexp_matches(lower(Transaction_ID), 'e1') "
    "or regexp_matches(lower(User_ID), 'e1') or regexp_matches(lower(Merchant_Category), 'e1'))", "tx"))
def p3(spark, sf):
    return P.page_total(FL.search(FL.apply_filters(fx.tx(spark, sf), FilterParams(location=HANOI)), "E1"))


@q("p4_transaction_projection", with_views(
    "select cast(Transaction_ID as varchar) as transaction_id, cast(User_ID as varchar) as user_id, "
    "cast(trunc(Amount_VND) as bigint) as amount_vnd, strftime(Timestamp, '%Y-%m-%d %H:%M:%S') as timestamp, "
    "Payment_Method as payment_method, Merchant_Category as merchant_category, Location as location, "
    "0 as risk_score, Is_Fraud as is_fraud from tx", "tx"))
def p4(spark, sf):
    return P.project_rows(fx.tx(spark, sf))


@q("p5_label_value", with_views(
    f"select Merchant_Category as label, {_ms()} as value from tx group by Merchant_Category", "tx"))
def p5(spark, sf):
    g = fx.tx(spark, sf).groupBy(CATEGORY).agg(F.sum(F.col(AMOUNT).cast("decimal(28,6)")).cast("double").alias("total"))
    return P.label_value(g, CATEGORY, "total")


# ---------------------------------------------------------------------------
# A1-A9 summary
# ---------------------------------------------------------------------------
def _top(col: str, view: str = "tx") -> str:
    return (f"(select {col} from {view} where {col} is not null group by {col} "
            f"order by {MS} desc, {col} limit 1)")


SUMMARY_SQL = {
    "total_gmv": f"(select coalesce(cast(trunc({MS}) as bigint), 0) from tx)",
    "total_transactions": "(select count(*) from tx)",
    "fraud_rate": "(select coalesce(cast(sum(Is_Fraud) as double) / nullif(count(*), 0) * 100, 0.0) from tx)",
    "top_city": _top("Location"),
    "top_category": _top("Merchant_Category"),
    "peak_hour": "(select cast(hour(Timestamp) as integer) from tx group by 1 order by count(*) desc, 1 limit 1)",
    "active_users_daily_avg": "coalesce((select avg(u) from (select count(distinct User_ID) as u from tx "
                              "group by cast(Timestamp as date))), 0.0)",
    "active_users_monthly_avg": "coalesce((select avg(u) from (select count(distinct User_ID) as u from tx "
                                "group by strftime(Timestamp, '%Y-%m'))), 0.0)",
}


def _summary_item(key: str, col: str):
    @q(key, with_views(f"select {SUMMARY_SQL[col]} as {col}", "tx"))
    def fn(spark, sf):
        return M.summary(fx.tx(spark, sf)).select(col)
    return fn


for _k, _c in [("a1_total_gmv", "total_gmv"), ("a2_total_transactions", "total_transactions"),
               ("a3_fraud_rate", "fraud_rate"), ("a4_top_city", "top_city"),
               ("a5_top_category", "top_category"), ("a6_peak_hour", "peak_hour"),
               ("a7_daily_active_users", "active_users_daily_avg"),
               ("a8_monthly_active_users", "active_users_monthly_avg")]:
    _summary_item(_k, _c)


@q("a_summary", with_views("select " + ", ".join(f"{v} as {k}" for k, v in SUMMARY_SQL.items()), "tx"))
def a_summary(spark, sf):
    return M.summary(fx.tx(spark, sf))


_EMPTY = "__no_such_location__"


@q("a9_empty_summary", with_views(
    "select 0::bigint as total_gmv, 0::bigint as total_transactions, 0.0 as fraud_rate, "
    "null::varchar as top_city, null::varchar as top_category, null::integer as peak_hour, "
    "0.0 as active_users_daily_avg, 0.0 as active_users_monthly_avg "
    f"from (select count(*) c from tx where Location = '{_EMPTY}') where c = 0", "tx"))
def a9(spark, sf):
    return M.summary(FL.apply_filters(fx.tx(spark, sf), FilterParams(location=_EMPTY)))


# ---------------------------------------------------------------------------
# B1-B14 breakdowns
# ---------------------------------------------------------------------------
def _breakdown_sql(col: str, view: str = "tx") -> str:
    return (f"select cast({col} as varchar) as label, {_ms()} as value, "
            f"cast(row_number() over (order by {MS} desc, {col}) as integer) as rank "
            f"from {view} where {col} is not null group by {col}")


@q("b1_payment_share", with_views(_breakdown_sql("Payment_Method"), "tx"))
def b1(spark, sf):
    return M.payment_share(fx.tx(spark, sf))


@q("b2_category_spend", with_views(_breakdown_sql("Merchant_Category"), "tx"))
def b2(spark, sf):
    return M.category_spend(fx.tx(spark, sf))


@q("b3_location_sales", with_views(_breakdown_sql("Location"), "tx"))
def b3(spark, sf):
    return M.location_sales(fx.tx(spark, sf))


@q("b4_distributions", with_views(
    " union all ".join(
        f"select '{name}' as breakdown, * from ({_breakdown_sql(col)})"
        for col, name in M.BREAKDOWN_NAMES.items()), "tx"))
def b4(spark, sf):
    return M.distributions(fx.tx(spark, sf))


@q("b5_monthly_trend", with_views(
    f"select strftime(Timestamp, '%Y-%m') as period, {_ms()} as value from tx_o group by 1", "tx_o"))
def b5(spark, sf):
    return M.trend(fx.tx_o(spark, sf), "month")


@q("b6_quarterly_trend", with_views(
    f"select concat(cast(year(Timestamp) as varchar), 'Q', cast(quarter(Timestamp) as varchar)) as period, "
    f"{_ms()} as value from tx_o group by 1", "tx_o"))
def b6(spark, sf):
    return M.trend(fx.tx_o(spark, sf), "quarter")


@q("b7_amount_by_hour", with_views(
    f"select cast(hour(Timestamp) as integer) as label, {_ms()} as value from tx group by 1", "tx"))
def b7(spark, sf):
    return M.amount_by_hour(fx.tx(spark, sf))


@q("b8_count_by_hour", with_views(
    "select cast(hour(Timestamp) as integer) as label, count(Transaction_ID) as value from tx group by 1", "tx"))
def b8(spark, sf):
    return M.count_by_hour(fx.tx(spark, sf))


@q("b9_count_by_weekday", with_views(
    "select cast(isodow(Timestamp) - 1 as integer) as weekday_no, "
    "['Thứ Hai', 'Thứ Ba', 'Thứ Tư', 'Thứ Năm', 'Thứ Sáu', 'Thứ Bảy', 'Chủ Nhật'][isodow(Timestamp)] as label, "
    "count(Transaction_ID) as value from tx group by 1, 2", "tx"))
def b9(spark, sf):
    return M.count_by_weekday(fx.tx(spark, sf))


@q("b10_payment_category_flows", with_views(
    'select "from", "to", cast(v as double) as value from g where cast(v as double) >= cast((select sum(v) from g) as double) * 0.005', "tx",
    extra=[f'g as (select Payment_Method as "from", Merchant_Category as "to", {MS} as v from tx '
           "where Payment_Method is not null and Merchant_Category is not null group by 1, 2)"]))
def b10(spark, sf):
    return M.category_flows(fx.tx(spark, sf))


@q("b11_user_funnel", with_views(
    "select 1 as step, 'Tất cả người dùng' as label, (select count(*) from u) as value union all "
    "select 2, 'Người dùng ≥ 2 GD', (select count(*) from u where n >= 2) union all "
    "select 3, 'Người dùng ≥ 5 GD (Trung thành)', (select count(*) from u where n >= 5)", "tx_o",
    extra=["u as (select User_ID, count(Transaction_ID) as n from tx_o where User_ID is not null group by 1)"]))
def b11(spark, sf):
    return M.user_funnel(fx.tx_o(spark, sf))


@q("b12_top_categories", with_views(
    f"select * from ({_breakdown_sql('Merchant_Category', 'tx_o')}) where rank <= 5", "tx_o"))
def b12(spark, sf):
    return M.top_categories(fx.tx_o(spark, sf), 5)


@q("b13_location_codes", with_views(
    f"select *, 'L' || cast(rank as varchar) as code from ({_breakdown_sql('Location')})", "tx"))
def b13(spark, sf):
    return M.location_codes(fx.tx(spark, sf))


@q("b14_growth_display", with_views(
    f"select fraud_rate, case when fraud_rate > 0 then greatest(1.0, 8.0 - fraud_rate / 2) else 8.2 end "
    f"as growth_display from (select {SUMMARY_SQL['fraud_rate']} as fraud_rate)", "tx"))
def b14(spark, sf):
    return M.growth_display(M.summary(fx.tx(spark, sf)))


# ---------------------------------------------------------------------------
# I1-I3 insights
# ---------------------------------------------------------------------------
_INSIGHT_BODY = """select cast(row_number() over (order by k) as integer) as seq, text from (
  select 1 as k, 'Không có dữ liệu cho bộ lọc hiện tại.' as text from s where n = 0
  union all select 2, 'Người dùng có xu hướng chi tiêu mạnh vào cuối tuần.' from s where n > 0 and wkend > wkday * 0.5
  union all select 3, 'Khung giờ hoạt động cao nhất là ' || cast(peak as varchar) || ':00 - '
                      || cast(peak + 1 as varchar) || ':00.' from s where n > 0)"""


def _insight_cte(where: str) -> str:
    return (f"s as (select count(*) as n, "
            f"coalesce(sum(case when isodow(Timestamp) >= 6 then cast(Amount_VND as decimal(28,6)) end), 0) as wkend, "
            f"coalesce(sum(case when isodow(Timestamp) < 6 then cast(Amount_VND as decimal(28,6)) end), 0) as wkday, "
            f"(select cast(hour(Timestamp) as integer) from tx where {where} group by 1 order by count(*) desc, 1 limit 1) as peak "
            f"from tx where {where})")


@q("i1_i2_insights", with_views(_INSIGHT_BODY, "tx", extra=[_insight_cte("true")]))
def i12(spark, sf):
    return M.insights(fx.tx(spark, sf))


@q("i3_no_data_insight", with_views(_INSIGHT_BODY, "tx", extra=[_insight_cte(f"Location = '{_EMPTY}'")]))
def i3(spark, sf):
    return M.insights(FL.apply_filters(fx.tx(spark, sf), FilterParams(location=_EMPTY)))


# ---------------------------------------------------------------------------
# G1-G4 geography
# ---------------------------------------------------------------------------
_PROVINCES = ("p(province, lat, lon) as (values ('Hà Nội', 21.0285, 105.8542), ('Hồ Chí Minh', 10.8231, 106.6297), "
              "('TP.HCM', 10.8231, 106.6297), ('Đà Nẵng', 16.0544, 108.2022), ('Cần Thơ', 10.0452, 105.7469), "
              "('Hải Phòng', 20.8449, 106.6881), ('Bình Dương', 10.9804, 106.6519), ('Đồng Nai', 10.9575, 106.8427), "
              "('Khánh Hòa', 12.2462, 109.1944), ('Quảng Ninh', 20.9599, 107.0445))")
_SALES = f"s as (select cast(Location as varchar) as label, {_ms()} as value from tx where Location is not null group by 1)"
_MAXV = "greatest((select max(value) from s), 1.0)"


@q("g1_map_points", with_views(
    "select label, value, cast(lat as double) as lat, cast(lon as double) as lon from s join p on label = province",
    "tx", extra=[_SALES, _PROVINCES]))
def g1(spark, sf):
    return G.map_points(M.location_sales(fx.tx(spark, sf))).select("label", "value", "lat", "lon")


@q("g2_bubble_radius", with_views(
    f"select label, greatest(5.0, value / {_MAXV} * 25.0) as radius from s join p on label = province",
    "tx", extra=[_SALES, _PROVINCES]))
def g2(spark, sf):
    return G.map_points(M.location_sales(fx.tx(spark, sf))).select("label", "radius")


_CLASS_BODY = f"""select province, v as value,
  cast(case when v > {_MAXV} * 0.8 then 4 when v > {_MAXV} * 0.5 then 3 when v > {_MAXV} * 0.2 then 2
       when v > 0 then 1 else 0 end as integer) as fill_class
from (select province,
        case when coalesce(s1.value, 0.0) = 0 then coalesce(s2.value, 0.0) else s1.value end as v
      from p left join s s1 on s1.label = replace(replace(province, 'Thành phố ', ''), 'Tỉnh ', '')
             left join s s2 on s2.label = case replace(replace(province, 'Thành phố ', ''), 'Tỉnh ', '')
                                         when 'Hồ Chí Minh' then 'TP.HCM' when 'TP.HCM' then 'Hồ Chí Minh' end)"""


@q("g3_choropleth_class", with_views(
    "select province, fill_class from c", "tx", extra=[_SALES, _PROVINCES, f"c as ({_CLASS_BODY})"]))
def g3(spark, sf):
    return G.map_classes(M.location_sales(fx.tx(spark, sf))).select("province", "fill_class")


@q("g4_province_match", with_views(
    "select province, value from c", "tx", extra=[_SALES, _PROVINCES, f"c as ({_CLASS_BODY})"]))
def g4(spark, sf):
    return G.map_classes(M.location_sales(fx.tx(spark, sf))).select("province", "value")


# ---------------------------------------------------------------------------
# U1-U10 customers
# ---------------------------------------------------------------------------
def _rfm_sql(view: str) -> str:
    return (f"rfm as (select User_ID, cast(((epoch_us((select max(Timestamp) + interval 1 day from {view})) "
            f"- epoch_us(max(Timestamp))) // 86400000000) as bigint) as Recency, "
            f"count(Transaction_ID) as Frequency, {_ms()} as Monetary from {view} "
            f"where User_ID is not null group by User_ID)")


@q("u1_rfm", with_views("select * from rfm", "tx_o", extra=[_rfm_sql("tx_o")]))
def u1(spark, sf):
    return U.rfm(fx.tx_o(spark, sf))


@q("u1_rfm_events", with_views("select * from rfm", "tx", extra=[_rfm_sql("tx")]))
def u1e(spark, sf):
    return U.rfm(fx.tx(spark, sf))


# Scaled values depend on floating mean / std aggregates whose summation order
# differs between engines (last-bit differences), so both sides present them
# rounded to 6 decimals (last-bit differences then cannot straddle a rounding
# boundary in practice; at 9 decimals one value in ~10^5 did at sf0.1).
def _scaled_sql(c: str) -> str:
    return (f"round(case when (select stddev_pop({c}) from rfm) = 0 then 0.0 else "
            f"({c} - (select avg({c}) from rfm)) / (select stddev_pop({c}) from rfm) end, 6) as {c}_scaled")


@q("u2_rfm_scaled", with_views(
    "select User_ID, " + ", ".join(_scaled_sql(c) for c in U.RFM_COLS) + " from rfm",
    "tx_o", extra=[_rfm_sql("tx_o")]))
def u2(spark, sf):
    out = U.rfm_scaled(U.rfm(fx.tx_o(spark, sf)))
    return out.select(USER_ID, *[F.round(f"{c}_scaled", 6).alias(f"{c}_scaled") for c in U.RFM_COLS])


def _segments(spark, sf):
    _, clustered = U.fit_segments(U.rfm(fx.tx_o(spark, sf)))
    return U.name_segments(clustered)


@q("u3_kmeans_segments")
def u3(spark, sf):
    _, clustered = U.fit_segments(U.rfm(fx.tx_o(spark, sf)))
    return clustered


@q("u4_named_segments")
def u4(spark, sf):
    return _segments(spark, sf)


@q("u5_segment_totals")
def u5(spark, sf):
    return U.segment_totals(_segments(spark, sf))


_PREF = ("pref as (select User_ID, Payment_Method as preferred_payment_method from ("
         "select User_ID, Payment_Method, row_number() over (partition by User_ID order by count(*) desc, "
         "Payment_Method) as rn from {v} where User_ID is not null and Payment_Method is not null "
         "group by User_ID, Payment_Method) where rn = 1)")


@q("u6_top_users", with_views(
    "select cast(User_ID as varchar) as user_id, cast(trunc(Monetary) as bigint) as total_spend, "
    "Frequency as transaction_count, preferred_payment_method from "
    "(select * from rfm order by Monetary desc, User_ID limit 10) t left join pref using (User_ID)",
    "tx_o", extra=[_rfm_sql("tx_o"), _PREF.format(v="tx_o")]))
def u6(spark, sf):
    d = fx.tx_o(spark, sf)
    return U.top_users(U.rfm(d), d, 10)


@q("u7_preferred_payment", with_views("select * from pref", "tx", extra=[_PREF.format(v="tx")]))
def u7(spark, sf):
    return U.preferred_payment(fx.tx(spark, sf))


@q("u8_user_analytics_segments")
def u8(spark, sf):
    d = FL.apply_filters(fx.tx_o(spark, sf), FilterParams(location=HANOI))
    return U.user_analytics(d)["segments"]


@q("u9_segment_profile")
def u9(spark, sf):
    return U.segment_profile(_segments(spark, sf))


@q("u10_segment_export")
def u10(spark, sf):
    return _segments(spark, sf).select(USER_ID, "Segment_Name", "Recency", "Frequency", "Monetary")


# ---------------------------------------------------------------------------
# E1-E4 features
# ---------------------------------------------------------------------------
@q("e1_time_features", with_views(
    "select Transaction_ID, cast(hour(Timestamp) as integer) as hour, cast(isodow(Timestamp) - 1 as integer) "
    "as day_of_week, cast(month(Timestamp) as integer) as month, cast(isodow(Timestamp) >= 6 as integer) "
    "as is_weekend from tx", "tx"))
def e1(spark, sf):
    return E.time_features(fx.tx(spark, sf)).select(TX_ID, "hour", "day_of_week", "month", "is_weekend")


@q("e2_amount_scaled", with_views(
    "select Transaction_ID, round((Amount_VND - (select avg(Amount_VND) from tx)) / "
    "(select case when stddev_pop(Amount_VND) = 0 then 1.0 else stddev_pop(Amount_VND) end from tx), 6) "
    "as amount_scaled from tx", "tx"))
def e2(spark, sf):
    out = E.scaled_column(fx.tx(spark, sf), AMOUNT, "amount_scaled")
    return out.select(TX_ID, F.round("amount_scaled", 6).alias("amount_scaled"))


@q("e3_one_hot_payment", with_views(
    "select Transaction_ID, "
    + ", ".join(f"case when Payment_Method = '{v}' then 1.0 else 0.0 end as \"Payment_Method_{v}\""
                for v in ["Bank Transfer", "Credit Card", "QR", "Ví điện tử"]) + " from tx", "tx"))
def e3(spark, sf):
    d = fx.tx(spark, sf)
    vocab = E.fit_categories(d, [PAYMENT])
    oh = E.one_hot(d, vocab)
    return oh.select(TX_ID, *[F.col(f"`{PAYMENT}_{v}`") for v in vocab[PAYMENT]])


@q("e4_preprocess_pipeline", with_views(
    "select Transaction_ID, Amount_VND, cast(hour(Timestamp) as integer) as hour, "
    "cast(isodow(Timestamp) - 1 as integer) as day_of_week, cast(month(Timestamp) as integer) as month, "
    "cast(isodow(Timestamp) >= 6 as integer) as is_weekend, round((Amount_VND - m) / s, 6) as amount_scaled "
    "from c, st", "tx_o",
    extra=["b as (select quantile_cont(Amount_VND, 0.25) as q1, quantile_cont(Amount_VND, 0.75) as q3 from tx_o "
           "where Transaction_ID is not null and User_ID is not null and Timestamp is not null and Amount_VND is not null)",
           "c as (select Transaction_ID, Timestamp, least(greatest(Amount_VND, 0.0), (select q3 + 3.0 * (q3 - q1) from b)) "
           "as Amount_VND from tx_o where Transaction_ID is not null and User_ID is not null "
           "and Timestamp is not null and Amount_VND is not null)",
           "st as (select avg(Amount_VND) as m, case when stddev_pop(Amount_VND) = 0 then 1.0 "
           "else stddev_pop(Amount_VND) end as s from c)"]))
def e4(spark, sf):
    out = E.Preprocessor().process(fx.tx_o(spark, sf))
    return out.select(TX_ID, AMOUNT, "hour", "day_of_week", "month", "is_weekend",
                      F.round("amount_scaled", 6).alias("amount_scaled"))


# ---------------------------------------------------------------------------
# M1-M13 fraud models
# ---------------------------------------------------------------------------
@q("m1_fraud_features", with_views(
    "select Transaction_ID, Amount_VND, Hour, Is_Weekend, Payment_Method, Merchant_Category, Location, Is_Fraud "
    "from tx_fraud", "tx_fraud"))
def m1(spark, sf):
    return FR.fraud_features(fx.tx_fraud(spark, sf))


@q("m3_hash_split", with_views(f"select Transaction_ID, {hash_bucket()} < 20 as is_test from tx_fraud", "tx_fraud"))
def m3(spark, sf):
    return FR.split_by_hash(fx.tx_fraud(spark, sf)).select(TX_ID, "is_test")


def _rule_predictions(spark, sf) -> DataFrame:
    """Held-out rows scored by the planted rule (amount ≥ 100 and hour < 6)."""
    d = FR.split_by_hash(fx.tx_fraud(spark, sf)).where(F.col("is_test"))
    return d.withColumn("prediction", ((F.col(AMOUNT) >= 100) & (F.col(HOUR) < 6)).cast("int"))


_RULE_PRED = (f"pr as (select Is_Fraud as label, cast(Amount_VND >= 100 and Hour < 6 as integer) as prediction "
              f"from tx_fraud where {hash_bucket()} < 20)")
_METRICS_BODY = """select coalesce(sum(tp) / sum(support), 0.0) as accuracy,
  coalesce(sum(support * p) / sum(support), 0.0) as precision,
  coalesce(sum(support * r) / sum(support), 0.0) as recall,
  coalesce(sum(support * case when p + r > 0 then 2 * p * r / (p + r) else 0.0 end) / sum(support), 0.0) as f1_score
from (select support, tp,
        case when predicted > 0 then tp / predicted else 0.0 end as p,
        case when support > 0 then tp / support else 0.0 end as r
      from (select cls,
              (select coalesce(sum(n), 0) from cc where label = cls) as support,
              (select coalesce(sum(n), 0) from cc where prediction = cls) as predicted,
              (select coalesce(sum(n), 0) from cc where label = cls and prediction = cls) as tp
            from (select label as cls from cc union select prediction from cc)))"""


@q("m6_classification_metrics", with_views(
    _METRICS_BODY, "tx_fraud",
    extra=[_RULE_PRED, "cc as (select label, prediction, count(*) as n from pr group by 1, 2)"]))
def m6(spark, sf):
    return FR.classification_metrics(_rule_predictions(spark, sf))


@q("m7_confusion_matrix", with_views(
    "select t.label, t.prediction, count(pr.label) as count from "
    "(values (0, 0), (0, 1), (1, 0), (1, 1)) t(label, prediction) "
    "left join pr on pr.label = t.label and pr.prediction = t.prediction group by 1, 2", "tx_fraud",
    extra=[_RULE_PRED]))
def m7(spark, sf):
    return FR.confusion(_rule_predictions(spark, sf))


@q("m8_class_counts", with_views(
    "select count(*) as total_samples, count(*) filter (where Is_Fraud = 1) as fraud_samples, "
    "count(*) filter (where Is_Fraud = 0) as normal_samples from tx_fraud", "tx_fraud"))
def m8(spark, sf):
    return FR.class_counts(fx.tx_fraud(spark, sf))


@q("m4_decision_tree_metrics")
def m4(spark, sf):
    d = fx.tx_fraud(spark, sf)
    return FR.evaluate(FR.fit_fraud_model(d, "decision_tree"), d)


@q("m5_random_forest_metrics")
def m5(spark, sf):
    d = fx.tx_fraud(spark, sf)
    return FR.evaluate(FR.fit_fraud_model(d, "random_forest"), d)


@q("m9_score_table")
def m9(spark, sf):
    d = fx.tx_fraud(spark, sf)
    m = FR.fit_fraud_model(d, "decision_tree")
    return FR.score(m, d, null_is_absent=False).select(TX_ID, "is_fraud_pred", "probability", "probability_pct", "verdict",
                                 "unseen_category")


@q("m10_input_defaults", with_views(
    "select Transaction_ID, coalesce(Amount_VND, 0.0) as Amount_VND, coalesce(Hour, 12) as Hour, "
    "coalesce(Is_Weekend, 0) as Is_Weekend, coalesce(Payment_Method, 'Ví điện tử') as Payment_Method, "
    "coalesce(Merchant_Category, 'Ăn uống') as Merchant_Category, coalesce(Location, 'Hà Nội') as Location "
    "from tx_fraud", "tx_fraud"))
def m10(spark, sf):
    return FR.with_input_defaults(fx.tx_fraud(spark, sf)).select(TX_ID, *FRAUD_INPUT_DEFAULTS)


@q("m11_explain_tree")
def m11(spark, sf):
    d = fx.tx_fraud(spark, sf)
    m = FR.fit_fraud_model(d, "decision_tree")
    return explain(m, FR.with_absent_defaults(d)).select(TX_ID, "rules", "path_prediction")


@q("m12_explain_forest")
def m12(spark, sf):
    d = fx.tx_fraud(spark, sf)
    m = FR.fit_fraud_model(d, "random_forest")
    return explain(m, FR.with_absent_defaults(d)).select(TX_ID, "rules", "path_prediction")


@q("m13_compare_models")
def m13(spark, sf):
    d = fx.tx_fraud(spark, sf)
    rows = [FR.evaluate(FR.fit_fraud_model(d, k), d) for k in FR.KINDS]
    return FR.compare_models(rows[0].unionByName(rows[1]))


# ---------------------------------------------------------------------------
# T1 forecast
# ---------------------------------------------------------------------------
@q("t1_baseline_forecast", with_views(
    "select period, value, case when lag(value, 2) over w is null then value "
    "else cast(floor((lag(value, 1) over w + lag(value, 2) over w) / 2 + 0.5) as double) end as forecast "
    "from t window w as (order by period)", "tx_o",
    extra=[f"t as (select strftime(Timestamp, '%Y-%m') as period, {_ms()} as value from tx_o group by 1)"]))
def t1(spark, sf):
    return baseline_forecast(M.trend(fx.tx_o(spark, sf), "month"))
