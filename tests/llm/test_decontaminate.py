import random

import numpy as np

from ledgerlens.llm import decontaminate as D

BENCH = "item_id long, text string, extra string"


def words(rng, n):
    return ["t%d" % rng.randrange(900) for _ in range(n)]


def sw(a, b):
    """Plain Smith-Waterman score in tenths of a word."""
    h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    best = 0
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (10 if a[i - 1] == b[j - 1] else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
            best = max(best, h[i][j])
    return best


def test_alignment_matches_the_plain_recurrence():
    rng = np.random.default_rng(1)
    regions, items = rng.integers(5, 12, (40, 30)).astype(np.uint64), rng.integers(5, 12, (40, 12)).astype(np.uint64)
    got = D.align(regions, items)
    assert got.tolist() == [sw(list(i), list(r)) for r, i in zip(regions, items)]


def corpus(rng):
    items = [(i, " ".join(words(rng, rng.randrange(15, 50)))) for i in range(12)]
    docs, leaked = [], {}
    for d in range(120):
        w = words(rng, rng.randrange(5, 200))
        if d % 3 == 0:
            i, t = items[d % 12]
            x = t.split()
            if d % 2:                                    # an edited copy: one word in ten replaced, one dropped
                for j in range(4, len(x), 10):
                    x[j] = "edit%d" % d
                del x[2]
            at = rng.randrange(len(w) + 1)
            w[at:at] = [y.upper() + "," for y in x]
            leaked[d] = i
        docs.append((d, " ".join(w)))
    return docs, items, leaked


def test_leaks_are_found_and_clean_documents_left_alone(spark):
    docs, items, leaked = corpus(random.Random(3))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame([(*x, "e") for x in items], BENCH)
    got = {r.c0: r for r in D.scan(df, bench).collect()}
    assert {d: r.item_id for d, r in got.items() if r.n_items} == leaked
    verbatim = [d for d in leaked if d % 2 == 0]
    assert all(got[d].similarity == 1.0 for d in verbatim)
    assert D.remove_contaminated(df, bench).count() == len(docs) - len(leaked)


def test_brute_force_similarity(spark):
    """No document whose best alignment with an item reaches the threshold is missed."""
    docs, items, _ = corpus(random.Random(8))
    docs = docs[:40]
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(*x, "e") for x in items], BENCH)
    norm = lambda t: t.lower().replace(",", "").split()
    want = {d for d, t in docs if any(sw(norm(x), norm(t)) >= 8 * len(norm(x)) for _, x in items)}
    assert {r.c0 for r in D.scan(df, bench).filter("n_items > 0").collect()} == want


def test_blocks_of_items_give_the_same(spark, monkeypatch):
    docs, items, _ = corpus(random.Random(5))
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(*x, "e") for x in items], BENCH)
    one = sorted(D.scan(df, bench).collect())
    monkeypatch.setattr(D, "BLOCK_ITEMS", 5)
    assert sorted(D.scan(df, bench).collect()) == one


def test_edges(spark, edges, edge_rows, nothing):
    text = dict(edge_rows)[6]
    bench = spark.createDataFrame([(3, text, "a"), (2, text, "b"), (None, text, "c"), (4, None, "d"), (5, "", "e"), (6, "one", "f")], BENCH)
    got = D.scan(edges, bench).collect()
    assert len(got) == len(edge_rows)
    hit = [r for r in got if r.n_items]
    assert {r.c1 for r in hit} == {text} or all(r.c0 == 6 for r in hit)
    assert all(r.item_id == 2 for r in hit)              # ties go to the smallest id
    kept = D.remove_contaminated(edges, bench)
    assert kept.columns == edges.columns and kept.count() == len(edge_rows) - len(hit)
    assert D.scan(nothing, bench).count() == 0
    none = spark.createDataFrame([], BENCH)
    assert D.scan(edges, none).filter("n_items > 0").count() == 0


def test_edited_copies_are_found_in_any_number_of_documents(spark):
    """Words 4 and 8 of 11 replaced (0.8, a leak): most seeds of the item occur nowhere,
    so those that are left are more common than its median of 0."""
    rng = random.Random(6)
    item = ["i%d" % k for k in range(11)]
    edited = " ".join([*item[:3], "x", *item[4:7], "y", *item[8:]])
    bench = spark.createDataFrame([(1, " ".join(item), "e")], BENCH)
    for n, copies, exact in ((1, 1, 0), (100, 1, 0), (100, 40, 1), (3000, 30, 0)):
        docs = [(d, " ".join([*words(rng, 6), *([edited] if d < copies else []), *([" ".join(item)] if copies <= d < copies + exact else [])]))
                for d in range(n)]
        got = D.scan(spark.createDataFrame(docs, "doc_id long, text string"), bench).filter("n_items > 0").collect()
        assert {r.c0: r.similarity for r in got} == {d: 0.8 if d < copies else 1.0 for d in range(copies + exact)}


def test_common_seeds_of_clean_documents_cost_no_alignment(spark):
    item = ["i%d" % k for k in range(30)]
    docs = [(d, " ".join([*item[:4], "z%d" % d])) for d in range(50)]
    bench = spark.createDataFrame([(1, " ".join(item), "e")], BENCH)
    assert D.scan(spark.createDataFrame(docs, "doc_id long, text string"), bench).filter("n_items > 0 or similarity > 0").count() == 0


def test_inserted_blocks_do_not_split_a_copy(spark):
    """Words inserted in one or more places, up to what the gap cost lets pass, and beyond it."""
    rng = random.Random(9)
    items = [(i, words(rng, rng.randrange(12, 60))) for i in range(6)]
    docs = [(0, [*words(rng, 30), *items[0][1][:6], *words(rng, 40), *items[0][1][6:]])]
    for d in range(1, 80):
        x = list(items[d % 6][1])
        for _ in range(rng.randrange(1, 4)):
            at = rng.randrange(2, len(x) - 1)
            x[at:at] = words(rng, rng.randrange(0, 2 * len(items[d % 6][1])))
        if d % 3 == 0:
            x[rng.randrange(len(x))] = "edit"
        docs.append((d, [*words(rng, rng.randrange(60)), *x, *words(rng, rng.randrange(60))]))
    item50 = ["u%d" % k for k in range(50)]
    docs.append((80, [*item50[:25], *("v%d" % k for k in range(40)), *item50[25:]]))
    items.append((50, item50))
    df = spark.createDataFrame([(d, " ".join(t)) for d, t in docs], "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(x), "e") for i, x in items], BENCH)
    got = {r.c0: r for r in D.scan(df, bench).collect()}
    want = {d: max(sw(x, t) / (10 * len(x)) for _, x in items) for d, t in docs}
    assert {d for d, r in got.items() if r.n_items} == {d for d, s in want.items() if s >= 0.8}
    assert all(abs(got[d].similarity - s) < 1e-12 for d, s in want.items() if s >= 0.8)
    assert abs(got[80].similarity - 0.92) < 1e-12 and got[80].item_id == 50
    assert sum(s < 0.8 for s in want.values()) > 5


def test_short_unspaced_and_nameless_items(spark):
    """Short items are leaks as whole lines only; unspaced scripts are compared by character."""
    zh = "\u4eca\u5929\u5929\u6c14\u5f88\u597d\u6211\u4eec\u53bb\u516c\u56ed\u6563\u6b65\u5427"
    edited = zh[:5] + "\u8bd7" + zh[6:]                                # one character of fifteen replaced: 0.92 or so
    other = "\u5b66\u4e60\u8ba9\u4eba\u8fdb\u6b65"
    nameless = " ".join("n%d" % k for k in range(9))
    big = 2 ** 60 + 1
    bench = spark.createDataFrame([(1, "What is it?", "e"), (2, zh, "e"), (None, nameless, "e"), (3, "...", "e"),
                                   (big, "Say: yes", "e"), (-4, " ".join("m%d" % k for k in range(9)), "e")], BENCH)
    docs = [(0, "first line\n  what IS it\nlast line"), (1, "nobody knows what is it about"), (2, "x" + other + zh + other),
            (3, edited), (4, other * 4), (5, "k " + nameless), (6, "..."), (7, "say yes"), (8, "say yes\nwhat is it"),
            (9, None), (10, ""), (11, " ".join("m%d" % k for k in range(9)))]
    got = {r.c0: (r.item_id, r.n_items) for r in D.scan(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()}
    assert got == {0: (1, 1), 1: (None, 0), 2: (2, 1), 3: (2, 1), 4: (None, 0), 5: (None, 1), 6: (None, 0), 7: (big, 1),
                   8: (1, 2), 9: (None, 0), 10: (None, 0), 11: (-4, 1)}


def test_short_items_in_several_blocks(spark, monkeypatch):
    bench = spark.createDataFrame([(i, "word%d and more" % i, "e") for i in range(30)], BENCH)
    docs = spark.createDataFrame([(d, "\n".join("word%d and more" % i for i in range(d))) for d in range(30)], "doc_id long, text string")
    one = sorted(D.scan(docs, bench).collect())
    monkeypatch.setattr(D, "BLOCK_ITEMS", 7)
    assert sorted(D.scan(docs, bench).collect()) == one
    assert [(r.n_items, r.item_id) for r in one] == [(d, 0 if d else None) for d in range(30)]
