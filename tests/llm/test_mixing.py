import hashlib
import re

import duckdb
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from ledgerlens.llm import mixing as M
from ledgerlens.llm.queries import ORACLE

SCHEMA = "doc_id long, text string, source string"


def size(t):
    return len(re.findall("[^\x20\x09-\x0D]+", t or ""))


def brute(rows, weights=M.WEIGHTS, share=M.SHARE, cap=M.MAX_EPOCHS):
    """(doc_id, source, size, target, taken), by sorting everything."""
    sources = sorted({r[2] for r in rows}, key=lambda s: (s is None, (s or "").encode()))
    total = {s: sum(size(r[1]) for r in rows if r[2] == s) for s in sources}
    weight = {s: weights[i % len(weights)] for i, s in enumerate(sources)}
    budget, clamped, target = share * sum(total.values()), set(), {}
    while True:
        free = [s for s in sources if s not in clamped]
        level = (budget - cap * sum(total[s] for s in clamped)) / sum(weight[s] for s in free) if free else 0
        over = {s for s in free if level * weight[s] > cap * total[s]}
        if not over:
            break
        clamped |= over
    target = {s: cap * total[s] if s in clamped else level * weight[s] for s in sources}

    def h(r):
        text = f"{M.SEED}:{'null' if r[0] is None else r[0]}:{r[1] or ''}"
        return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)

    out = []
    for s in sources:
        words = round(target[s])
        whole = words // total[s] if total[s] else 0
        rest = words - whole * total[s]
        for r in sorted((r for r in rows if r[2] == s), key=h):
            part = min(size(r[1]), rest)
            rest -= part
            out.append((r[0], s, size(r[1]), target[s], whole * size(r[1]) + part))
    return sorted(out, key=str)


def got(mixed):
    return sorted(((r.row.doc_id, r.row.source, r["size"], r.target, r.taken) for r in mixed.collect()), key=str)


def corpus(rng_words=7):
    rows = [(i, " ".join(["w"] * (1 + i * 13 % rng_words)), f"s{i % 3}") for i in range(60)]
    rows += [(100 + i, "hot " * (1 + i % 50), "hot") for i in range(300)]
    return rows + [(900, None, "empty"), (None, "no id here", None), (None, "no id here", None), (901, " \t\n", None),
                   (902, "É a b \x1c x", "É"), (7, "again again", "s1"), (7, "again again", "s1"), (903, "b" * 9 + " " + "c " * 4000, "long")]


@pytest.mark.parametrize("bin_bits, end_rows", [(M.BIN_BITS, M.END_ROWS), (2, 3), (7, 1)])
def test_like_brute_force(spark, bin_bits, end_rows):
    rows = corpus()
    df = spark.createDataFrame(rows, SCHEMA)
    assert got(M.mix(df, bin_bits=bin_bits, end_rows=end_rows)) == brute(rows)


def test_caps_and_other_weights(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, SCHEMA)
    assert got(M.mix(df, share=5.0)) == brute(rows, share=5.0)              # every source at its cap
    assert got(M.mix(df, weights=(1, 9), share=0.4, max_epochs=1.5)) == brute(rows, (1, 9), 0.4, 1.5)


def test_any_partitioning_agrees(spark):
    df = spark.createDataFrame(corpus(), SCHEMA)
    assert got(M.mix(df.repartition(7))) == got(M.mix(df.coalesce(1)))


def test_edges_and_clashing_names(spark, edges, edge_rows, nothing):
    clash = edges.withColumns({c: F.lit("x") for c in ("size", "target", "sid", "h", "uid", "taken", "weight")})
    assert got(M.mix(clash)) == brute([(i, t, None) for i, t in edge_rows])
    assert M.mix(nothing).count() == 0
    blank = spark.createDataFrame([(1, None, "a"), (2, "", "b")], SCHEMA)
    assert [(r["size"], r.target, r.taken) for r in M.mix(blank).collect()] == [(0, 0.0, 0)] * 2


def test_repetitions_add_up(spark):
    mixed = M.mix(spark.createDataFrame(corpus(), SCHEMA)).cache()
    made = M.repetitions(mixed)
    assert made.agg(F.sum("n_words")).first()[0] == mixed.agg(F.sum("taken")).first()[0]
    assert made.groupBy("row", "epoch").count().filter("count > 2").count() == 0 and made.filter("n_words < 1").count() == 0


def test_main_path_is_native(edges):
    assert not re.search("Python|Arrow|Pandas", M.mix(edges)._jdf.queryExecution().toString())


@settings(max_examples=25, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet=" \t\n\x0b\x0c\r\x1cab É", max_size=12)), min_size=1, max_size=30))
def test_word_counts(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    assert [r.n for r in df.select(M.n_words(F.col("text")).alias("n")).collect()] == [size(t) for t in texts]


def test_oracle(spark):
    rows = corpus()
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", rows)
    want = sorted(((r[0], r[1], r[3], r[4]) for r in con.execute(ORACLE["op11_mixing"]).fetchall()), key=str)
    assert [(d, n, t, k) for d, _, n, t, k in brute(rows)] and want == sorted(
        ((d, n, t, k) for d, _, n, t, k in brute(rows)), key=str)
