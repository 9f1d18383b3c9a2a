import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa

from ledgerlens.llm import lm_score as M
from ledgerlens.llm.common import Words

SCHEMA = "doc_id long, text string, code string, n string"


def corpus(n, seed=1):
    """Words that follow each other in fixed pairs."""
    rng = random.Random(seed)
    return [(i, " ".join(f"a{x} b{x}" for x in (rng.randrange(8) for _ in range(20))), "c", "n") for i in range(n)]


def test_scores_sum_the_networks_conditionals(spark):
    df = spark.createDataFrame(corpus(60), SCHEMA)
    model = M.fit(df)
    table = M.log_probabilities(model.weights).reshape(M.CLASSES, M.CLASSES, M.CLASSES)
    assert np.allclose(np.exp(table.astype(float)).sum(axis=1), 1, atol=1e-3)          # over the token, given both sides
    for r in M.score(df, model).collect()[:5]:
        w = Words(pa.array([corpus(60)[r.doc_id][1]]), True)
        ids = [M.EDGE, *model.classes(w).tolist(), M.EDGE]
        want = sum(float(table[a, b, c]) for a, b, c in zip(ids, ids[1:], ids[2:]))
        assert r.n_tokens == 40 and abs(r.log_likelihood - want) < 1e-3 and abs(r.mean_log_likelihood - want / 40) < 1e-4


def test_real_order_scores_above_shuffled(spark):
    df = spark.createDataFrame(corpus(200), SCHEMA)
    model, rng = M.fit(df), random.Random(5)
    held = corpus(60, seed=9)
    mixed = [(i, " ".join(rng.sample(t.split(), 40)), "c", "n") for i, t, *_ in held]
    a, b = (M.score(spark.createDataFrame(x, SCHEMA), model).agg({"mean_log_likelihood": "avg"}).first()[0] for x in (held, mixed))
    assert a > b + 0.5


def test_triple_counts_cover_the_corpus(spark):
    df = spark.createDataFrame(corpus(30), SCHEMA)
    assert M.triple_counts(df, M.vocabulary(df)).agg({"n": "sum"}).first()[0] == 30 * 40


def test_edges(edges, edge_rows, nothing):
    got = M.score(edges, M.fit(edges)).collect()
    assert len(got) == len(edge_rows)
    assert all((r.n_tokens == 0) == (r.mean_log_likelihood is None) and r.log_likelihood <= 0 for r in got)
    assert M.score(nothing, M.fit(nothing)).count() == 0


def long_tail(n, seed=2):
    """Frequent words, and about as many rare ones of the same lengths as there are documents."""
    rng = random.Random(seed)
    return [(i, " ".join(rng.choice([f"f{rng.randrange(120):03d}", f"r{rng.randrange(90):03d}", f"q{rng.randrange(9 * n):05d}"]) for _ in range(30)), "c", "n")
            for i in range(n)]


def test_every_word_is_predicted_itself(spark, monkeypatch):
    """log P(class | neighbours) + log P(word | class), with heavy words and joined ones."""
    rows = long_tail(80)
    rows += rows[:2] + [(None, "r001 never", "c", "n")]           # repeated rows, a null id
    df, count = spark.createDataFrame(rows, SCHEMA), Counter(x for r in rows for x in r[1].split())
    for heavy in (M.HEAVY, 20):
        monkeypatch.setattr(M, "HEAVY", heavy)
        model = M.fit(df)
        table = M.log_probabilities(model.weights).reshape(M.CLASSES, M.CLASSES, M.CLASSES)
        frequent = {x for x, _ in sorted(count.items(), key=lambda c: (-c[1], c[0]))[:M.WORDS]}
        size = Counter()
        for x, n in count.items():
            size[len(x)] += 0 if x in frequent else n
        want = []
        for i, text, *_ in rows:
            ids = [M.EDGE, *model.classes(Words(pa.array([text]), True)).tolist(), M.EDGE]
            near = sum(float(table[a, b, c]) for a, b, c in zip(ids, ids[1:], ids[2:]))
            want.append((str(i), near + sum(math.log(count[x] / (size[len(x)] + 1)) for x in text.split() if x not in frequent)))
        got = sorted((str(r.doc_id), r.log_likelihood) for r in M.score(df, model).collect())
        assert [i for i, _ in got] == sorted(i for i, _ in want)
        assert all(abs(a[1] - b[1]) < 1e-3 for a, b in zip(got, sorted(want)))


def test_unknown_words_of_the_same_lengths_lower_the_score(spark):
    rows = long_tail(80)
    model = M.fit(spark.createDataFrame(rows, SCHEMA))
    strange = [(i, " ".join("z" + x[1:] if x[0] == "r" else x for x in t.split()), c, n) for i, t, c, n in rows]
    a, b = (M.score(spark.createDataFrame(x, SCHEMA), model).agg({"mean_log_likelihood": "avg"}).first()[0] for x in (rows, strange))
    assert a > b + 0.2


def test_all_words_are_counted(spark):
    rows = long_tail(80)
    table = M.fit(spark.createDataFrame(rows, SCHEMA)).table
    assert {r.w: r.n for r in table.collect()} == Counter(x for r in rows for x in r[1].split())
