"""Random small tables: Spark operators against brute-force pandas computations
written directly from the reference's semantics."""

import datetime as dt
import math

import pandas as pd
from hypothesis import Phase, given, settings
from hypothesis import strategies as st

from ledgerlens.operators import customers as U
from ledgerlens.operators import metrics as M

SCHEMA = ("Transaction_ID string, User_ID string, Amount_VND double, Timestamp timestamp_ntz, "
          "Payment_Method string, Merchant_Category string, Location string, Is_Fraud int")
BASE = dt.datetime(2026, 1, 1)

row = st.tuples(
    st.sampled_from(["U1", "U2", "U3", "U4", None]),
    st.integers(-500, 100_000).map(lambda c: c / 100),
    st.integers(0, 24 * 70 - 1),                       # hours over ~10 weeks
    st.sampled_from(["QR", "Ví điện tử", None]),
    st.sampled_from(["Mua sắm", "Ăn uống", "Siêu thị"]),
    st.sampled_from(["Hà Nội", "TP.HCM", "Cần Thơ", None]),
    st.integers(0, 1),
)


def _frames(spark, items):
    rows = [(f"T{i:04d}", u, a, BASE + dt.timedelta(hours=h), p, c, l, f)
            for i, (u, a, h, p, c, l, f) in enumerate(items)]
    pdf = pd.DataFrame(rows, columns=["Transaction_ID", "User_ID", "Amount_VND", "Timestamp",
                                      "Payment_Method", "Merchant_Category", "Location", "Is_Fraud"])
    return spark.createDataFrame(rows, SCHEMA), pdf


def _money(x):
    return round(float(x), 2)


@settings(max_examples=12, deadline=None, phases=[Phase.explicit, Phase.generate])
@given(st.lists(row, min_size=1, max_size=40))
def test_summary_matches_bruteforce(spark, items):
    df, pdf = _frames(spark, items)
    r = M.summary(df).first()
    assert r.total_gmv == int(round(pdf.Amount_VND.sum(), 2))
    assert r.total_transactions == len(pdf)
    assert math.isclose(r.fraud_rate, pdf.Is_Fraud.sum() / len(pdf) * 100)
    by_loc = pdf.groupby("Location").Amount_VND.sum().round(2)
    if len(by_loc):
        best = sorted(by_loc.items(), key=lambda kv: (-kv[1], kv[0]))[0][0]
        assert r.top_city == best
    else:
        assert r.top_city is None
    hours = pdf.Timestamp.dt.hour.value_counts()
    assert r.peak_hour == min(h for h, n in hours.items() if n == hours.max())
    daily = pdf.groupby(pdf.Timestamp.dt.date).User_ID.nunique().mean()
    monthly = pdf.groupby(pdf.Timestamp.dt.to_period("M")).User_ID.nunique().mean()
    assert math.isclose(r.active_users_daily_avg, daily)
    assert math.isclose(r.active_users_monthly_avg, monthly)


@settings(max_examples=10, deadline=None, phases=[Phase.explicit, Phase.generate])
@given(st.lists(row, min_size=1, max_size=40))
def test_breakdowns_flows_funnel_match_bruteforce(spark, items):
    df, pdf = _frames(spark, items)
    got = {(x.breakdown, x.label): x.value for x in M.distributions(df).collect()}
    for col, name in M.BREAKDOWN_NAMES.items():
        for label, v in pdf.groupby(col).Amount_VND.sum().items():
            assert math.isclose(got[(name, label)], _money(v), abs_tol=1e-6)
        assert sum(1 for b, _ in got if b == name) == pdf[col].nunique()
    g = pdf.groupby(["Payment_Method", "Merchant_Category"]).Amount_VND.sum().round(2)
    keep = {k: v for k, v in g.items() if v >= round(g.sum(), 2) * 0.005 - 1e-9}
    flows = {(x["from"], x["to"]): x.value for x in M.category_flows(df).collect()}
    assert set(flows) == set(keep)
    counts = pdf.groupby("User_ID").Transaction_ID.count()
    funnel = [x.value for x in M.user_funnel(df).orderBy("step").collect()]
    assert funnel == [len(counts), int((counts >= 2).sum()), int((counts >= 5).sum())]


@settings(max_examples=10, deadline=None, phases=[Phase.explicit, Phase.generate])
@given(st.lists(row, min_size=1, max_size=40))
def test_rfm_matches_bruteforce(spark, items):
    df, pdf = _frames(spark, items)
    ref = pdf.Timestamp.max() + pd.Timedelta(days=1)
    want = pdf.groupby("User_ID").agg(last=("Timestamp", "max"), f=("Transaction_ID", "count"),
                                      m=("Amount_VND", "sum"))
    got = {x.User_ID: x for x in U.rfm(df).collect()}
    assert set(got) == set(want.index)
    for uid, w in want.iterrows():
        assert got[uid].Recency == (ref - w["last"]).days
        assert got[uid].Frequency == w["f"]
        assert math.isclose(got[uid].Monetary, _money(w["m"]), abs_tol=1e-6)


@settings(max_examples=10, deadline=None, phases=[Phase.explicit, Phase.generate])
@given(st.lists(row, min_size=1, max_size=40))
def test_time_breakdowns_insights_mode_match_bruteforce(spark, items):
    from ledgerlens.operators.forecast import baseline_forecast
    from ledgerlens.schema import INSIGHT_WEEKEND, WEEKDAY_LABELS

    df, pdf = _frames(spark, items)
    wd = {x.weekday_no: (x.label, x.value) for x in M.count_by_weekday(df).collect()}
    for k, n in pdf.groupby(pdf.Timestamp.dt.dayofweek).Transaction_ID.count().items():
        assert wd[k] == (WEEKDAY_LABELS[k], n)
    hr = {x.label: x.value for x in M.amount_by_hour(df).collect()}
    for k, v in pdf.groupby(pdf.Timestamp.dt.hour).Amount_VND.sum().items():
        assert math.isclose(hr[k], _money(v), abs_tol=1e-6)
    trend = pdf.groupby(pdf.Timestamp.dt.to_period("M")).Amount_VND.sum().round(2)
    vals = list(trend.values)
    want_fc = [v if i < 2 else math.floor((vals[i - 1] + vals[i - 2]) / 2 + 0.5) for i, v in enumerate(vals)]
    got = baseline_forecast(M.trend(df, "month")).orderBy("period").collect()
    assert [x.period for x in got] == [str(p) for p in trend.index]
    assert all(math.isclose(x.forecast, w, abs_tol=1e-6) for x, w in zip(got, want_fc))
    texts = [x.text for x in M.insights(df).orderBy("seq").collect()]
    wk = pdf[pdf.Timestamp.dt.dayofweek >= 5].Amount_VND.sum()
    wdy = pdf[pdf.Timestamp.dt.dayofweek < 5].Amount_VND.sum()
    assert (INSIGHT_WEEKEND in texts) == (round(wk, 2) > round(wdy, 2) * 0.5)
    sub = pdf.dropna(subset=["User_ID", "Payment_Method"])
    cnt = sub.groupby(["User_ID", "Payment_Method"]).size().reset_index(name="n")
    want = {u: sorted(g.itertuples(), key=lambda r: (-r.n, r.Payment_Method))[0].Payment_Method
            for u, g in cnt.groupby("User_ID")}
    got = {x.User_ID: x.preferred_payment_method for x in U.preferred_payment(df).collect()}
    assert got == want


@settings(max_examples=10, deadline=None, phases=[Phase.explicit, Phase.generate])
@given(st.lists(st.tuples(st.integers(0, 2), st.integers(0, 2)), min_size=1, max_size=50))
def test_weighted_metrics_match_bruteforce(spark, pairs):
    from ledgerlens.operators.fraud import classification_metrics

    df = spark.createDataFrame(pairs, "Is_Fraud int, prediction int")
    m = classification_metrics(df).first()
    labels = sorted({y for y, _ in pairs} | {p for _, p in pairs})
    n = len(pairs)
    prec = rec = f1 = 0.0
    for c in labels:
        tp = sum(1 for y, p in pairs if y == c and p == c)
        sup = sum(1 for y, _ in pairs if y == c)
        pred = sum(1 for _, p in pairs if p == c)
        pc = tp / pred if pred else 0.0
        rc = tp / sup if sup else 0.0
        fc = 2 * pc * rc / (pc + rc) if pc + rc else 0.0
        prec += sup * pc / n
        rec += sup * rc / n
        f1 += sup * fc / n
    assert math.isclose(m.accuracy, sum(1 for y, p in pairs if y == p) / n)
    assert math.isclose(m.precision, prec, abs_tol=1e-12)
    assert math.isclose(m.recall, rec, abs_tol=1e-12)
    assert math.isclose(m.f1_score, f1, abs_tol=1e-12)
