import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from ledgerlens.llm import suffix_dedup as D
from ledgerlens.llm.common import utf8

SCHEMA = "doc_id long, text string, spans string"       # an extra column with a clashing name


def brute(rows):
    """Per distinct (id, text): removed bytes, runs, hash of the rest."""
    order = sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0, D_KEY[r[1]]))
    first, out = {}, {}
    for doc in order:
        data = (doc[1] or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - 99):
            w = data[i: i + 100]
            if w in first:
                gone[i: i + 100] = b"\1" * 100
            else:
                first[w] = 1
        kept = bytes(b for b, g in zip(data, gone) if not g)
        runs = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out[doc] = (len(data), sum(gone), runs, hashlib.sha256(kept).hexdigest())
    return out


D_KEY = {}


def compare(spark, rows):
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], SCHEMA)
    D_KEY.update({r.text: r.k for r in df.select("text", D.row_key().alias("k")).collect()})
    got = sorted(map(tuple, D.remove_repeats(df).drop("spans").collect()), key=str)
    want = brute(rows)
    assert got == sorted(((i, *want[(i, t)]) for i, t in rows), key=str)


def words(rng, n, vocab=40):
    return " ".join("w%dé" % rng.randrange(vocab) if rng.random() < 0.1 else "w%d" % rng.randrange(vocab) for _ in range(n))


def test_against_brute_force(spark):
    rng = random.Random(5)
    passages = [words(rng, 45) for _ in range(6)] + ["a" * 250, "ab" * 120]
    rows = []
    for i in range(60):
        parts = [words(rng, rng.randrange(1, 40)) for _ in range(rng.randrange(1, 4))]
        for _ in range(rng.randrange(0, 3)):
            p = rng.choice(passages)
            a = rng.randrange(0, 60)
            parts.insert(rng.randrange(len(parts) + 1), p[a: a + rng.randrange(80, 260)])
        rows.append((rng.randrange(0, 10_000), " ".join(parts)))
    copies = [(i + 20_000, t) for i, t in rows[:8]]
    same = passages[0] + "tail one that differs"
    edges = [(None, None), (None, passages[1]), (3, ""), (4, None), (5, "short"), (6, "short"), (rows[0][0], same),
             (rows[1][0], same + "!"), (-7, passages[2]), (-7, passages[2]), (30_000, words(rng, 400) * 3),
             (30_001, "x" * 99), (30_002, "x" * 100), (30_003, "x" * 101)]
    compare(spark, rows + copies + edges)


def test_hot_anchors_are_settled_by_their_windows(spark, monkeypatch):
    monkeypatch.setattr(D, "HOT", 10)
    rng = random.Random(9)
    line = words(rng, 40)
    compare(spark, [(i, words(rng, 12) + line + words(rng, 9)) for i in range(40)])


def test_empty_table(spark):
    assert D.remove_repeats(spark.createDataFrame([], SCHEMA)).collect() == []


def test_loser_tree_merges_with_common_prefixes():
    rng = random.Random(2)
    for k in (1, 2, 3, 5, 8):
        runs = [sorted(bytes(rng.choices(b"ab", k=rng.randrange(1, 12))) for _ in range(rng.randrange(1, 30))) for _ in range(k)]
        lcps = [[0] + [len(D_common(a, b)) for a, b in zip(r, r[1:])] for r in runs]
        run, place, lcp = D.merge(lcps, runs)
        out = [runs[r][p] for r, p in zip(run, place)]
        assert out == sorted(x for r in runs for x in r)
        assert lcp[1:] == [len(D_common(a, b)) for a, b in zip(out, out[1:])]


def D_common(a, b):
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    return a[:n]


def test_equal_windows_have_equal_anchors():
    rng = random.Random(3)
    shared = words(rng, 60)
    a, b = "x" * 37 + shared, words(rng, 11) + shared
    data, off = utf8(pa.array([a, b]))
    pos, row, _ = D.anchors(data, off)
    offset = [pos[row == 0] - 37, pos[row == 1] - off[1] - (len(b.encode()) - len(shared.encode()))]
    inside = [set(x[(x >= 100) & (x < len(shared.encode()) - 100)]) for x in offset]
    assert inside[0] == inside[1] and inside[0]


@pytest.mark.parametrize("n", [1, 7])
def test_runs_survive_front_coding(n):
    rng = np.random.default_rng(n)
    data = rng.integers(97, 99, 4000, dtype=np.uint8)
    off = np.array([0, 1500, 1500, 4000])
    pos, row, _ = D.anchors(data, off)
    c = D.Contexts.cut(data, off, pos, row, np.array([5, 6, 7]), np.array([1, 2, 3]))
    c = c.take(c.suffix_order())
    _, strings, back = D.decode_run(D.encode_run(c))
    assert strings == sorted(strings)
    assert all((getattr(c, f) == getattr(back, f)).all() for f in c.FIELDS)
