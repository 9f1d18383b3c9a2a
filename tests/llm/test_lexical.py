import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from ledgerlens.llm import lexical as X
from ledgerlens.llm.queries import ORACLE

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(t):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(docs, items, k=10):
    bag = [(i, Counter(terms(t))) for i, t in docs]
    nd, nt = sum(1 for _, b in bag if b), sum(sum(b.values()) for _, b in bag)
    df = Counter(g for _, b in bag for g in b)
    out = []
    for item, text in items:
        scored = []
        for i, b in bag:
            if b:
                m = 100 - 90 + (90 * sum(b.values()) * nd) // nt
                score = sum(math.floor(1000 * math.log((2 * nd + 2) / (2 * df[g] + 1))) * ((10**9 * b[g]) // (1000 * b[g] + 8 * m))
                            for g in set(terms(text)) if b[g])
                if score > 0:
                    scored.append((-score, i is None, i))
        scored.sort(key=lambda x: (x[0], x[1], x[2] or 0))
        out += [(item, r + 1, i, -s) for r, (s, _, i) in enumerate(scored[:k])]
    return sorted(out, key=str)


def got(df):
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect()), key=str)


def tables(seed=3, n=400):
    rng = random.Random(seed)
    words = [f"t{i}" for i in range(60)] + ["Über", "日本語", "x9"]
    weights = [1 / (i + 1) for i in range(len(words))]

    def text(a, b):
        return "".join(w + rng.choice([" ", ", ", "\n", "-"]) for w in rng.choices(words, weights, k=rng.randint(a, b)))

    docs = [(i, text(1, 40)) for i in range(n)]
    same = text(5, 5)
    docs += [(1000 - i, same) for i in range(200)]                     # copies, unsorted ids
    docs += [(2000 + i, f"{same} other{i} words{i}") for i in range(50)]     # equal bags, other words
    items = [(i, text(3, 12)) for i in range(30)] + [(None, "t1 T2"), (5, same), (5, same), (77, "never seen"), (78, None), (79, "—")]
    return docs, items


def frames(spark, docs, items):
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")


@pytest.mark.parametrize("block", [(X.ITEM_BLOCK, X.BLOCK_TERMS), (7, X.BLOCK_TERMS), (100, 20)])
def test_like_brute_force(spark, block):
    docs, items = tables()
    assert got(X.search(*frames(spark, docs, items), block_items=block[0], block_terms=block[1])) == brute(docs, items)


def test_other_k_and_small_products(spark, monkeypatch):
    monkeypatch.setattr(X, "SCORE_ITEMS", 3)
    monkeypatch.setattr(X, "SCORE_ROWS", 5)
    monkeypatch.setattr(X, "EXACT", 0)               # whole-number products
    docs, items = tables(4, 120)
    d, i = frames(spark, docs, items)
    assert got(X.search(d, i, 3)) == brute(docs, items, 3)


def test_edges(spark, edges, edge_rows, nothing):
    items = [(1, "same words same one"), (2, "a text w1 W2 w3"), (None, "wörds 日本語"), (3, ""), (4, None)]
    clash = edges.withColumns({c: F.lit("x") for c in ("cid", "score", "rank", "m", "h", "terms", "tfs", "n", "first")})
    frame = spark.createDataFrame([(*r, "x", 1) for r in items], "item_id long, text string, doc_id string, score int")
    assert got(X.search(clash, frame)) == brute(edge_rows, items)
    assert X.search(nothing, frame).count() == 0
    assert X.search(edges, spark.createDataFrame([], "item_id long, text string")).count() == 0
    assert X.search(spark.createDataFrame([(1, None), (2, " ")], "doc_id long, text string"), frame).count() == 0


def test_scored_once_per_class(spark):
    docs, items = tables()
    d, i = frames(spark, docs, items)
    block = next(X.item_blocks(i, 100, 1 << 18))
    bagged = X.bags(d, block.vocabulary)
    n = bagged.agg(F.count("*"), F.sum("n")).first()
    classes = X.classes_of(bagged, *n).groupBy("h", "m", "terms", "tfs").count()
    assert classes.agg(F.max("count")).first()[0] >= 200 and classes.count() < len(docs) - 200


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aZ09_-/:@[`{\x7f\x00 éß日\n", max_size=15)), max_size=8))
def test_terms(texts):
    w = X.terms(pa.array(texts, pa.string()))
    assert w.count.tolist() == [len(terms(t)) for t in texts]
    flat = [g for t in texts for g in terms(t)]
    assert len(set(flat)) == len(np.unique(w.hash)) and [bytes(w.data[a:b]).decode() for a, b in zip(w.start, w.end)] == flat


def test_oracle(spark):
    docs, items = tables(5, 150)
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.execute("CREATE TABLE benchmark (item_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", docs)
    con.executemany("INSERT INTO benchmark VALUES (?, ?)", items)
    assert sorted(con.execute(ORACLE["op12_lexical_search"]).fetchall(), key=str) == brute(docs, items)
