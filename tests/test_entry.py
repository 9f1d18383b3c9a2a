import duckdb

import __spark_entry__ as E

from paths import SF001

FAST = ["b4_distributions", "a_summary", "b10_payment_category_flows", "u1_rfm", "c11_iqr_clip",
        "t1_baseline_forecast", "m6_classification_metrics", "g3_choropleth_class", "p2_page_three_desc"]


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.columns == ["label", "value", "rank"] and df.count() > 0


def test_catalog_shape():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q) and len(q) >= 80


def _norm(v):
    if isinstance(v, float):
        return None if v != v else round(v, 9)
    return None if v is None else str(v)


def test_fast_oracle_pairs_sf0001(spark):
    con = duckdb.connect()
    for t in ["region", "nation", "customer", "orders", "events"]:
        con.execute(f"create view {t} as select * from read_parquet('{SF001}/{t}.parquet')")
    for name in FAST:
        sp = E.queries()[name](spark, SF001).toPandas()
        db = con.execute(E.oracle_sql()[name]).df()
        assert sorted(sp.columns) == sorted(db.columns), name
        cols = sorted(sp.columns)
        a = sorted(tuple(_norm(r[c]) for c in cols) for r in sp.to_dict("records"))
        b = sorted(tuple(_norm(r[c]) for c in cols) for r in db.to_dict("records"))
        assert a == b, name
