import random
import re
from itertools import combinations
from math import comb

import numpy as np
import pytest

from ledgerlens.llm import jaccard_join as J

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, k):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i: i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute(rows, k, percent):
    sets = [shingles(t, k) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, b in combinations(range(len(rows)), 2):
        o = len(sets[a] & sets[b])
        if o and 100 * o >= percent * len(sets[a] | sets[b]):
            root[find(a)] = find(b)
    out = []
    for i, (doc, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        out.append((doc, len(sets[i]), min(ids) if ids and sets[i] else doc))
    return sorted(out, key=str)


def near_copies(seed, n, lengths):
    """Chains and stars of edited copies, of short and long texts."""
    rng, rows = random.Random(seed), []
    for _ in range(n):
        base = ["v%d" % rng.randrange(3000) for _ in range(rng.choice(lengths))]
        for _ in range(rng.randrange(1, 7)):
            w = list(base)
            for _ in range(rng.randrange(0, 3)):
                w[rng.randrange(len(w))] = "e%d" % rng.randrange(50)
            if rng.random() < 0.3:
                w = w[: -rng.randrange(1, 4)] or w
            rows.append((rng.randrange(100_000), " ".join(w)))
            if rng.random() < 0.5:
                base = w
    return rows


@pytest.mark.parametrize("k,percent,lengths", [(4, 85, [5, 9, 14, 20, 26]), (4, 85, [60, 120]), (5, 80, [7, 12, 30, 90])])
def test_components_match_brute_force(spark, k, percent, lengths):
    rows = near_copies(k * percent + len(lengths), 40, lengths)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in J.similarity_components(df, k, percent).collect()), key=str)
    assert got == brute(rows, k, percent)
    assert any(r[0] != r[2] for r in got)


def test_edges(edges, edge_rows, nothing):
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in J.similarity_components(edges).collect()), key=str)
    assert got == brute(edge_rows, 4, 85)
    assert J.similarity_components(nothing).count() == 0
    assert J.keep_one_per_component(nothing, 4, 85).count() == 0


def test_one_row_of_each_component_stays(edges, edge_rows):
    kept = J.keep_one_per_component(edges, 4, 85)
    assert kept.columns == edges.columns
    want = brute(edge_rows, 4, 85)
    wordless = sum(n == 0 for _, n, _ in want)
    # ids 4 and 5 share a text, id 6 has one text thrice
    assert kept.count() == len(edge_rows) - 3 and kept.filter("text rlike '[^ \t-\r]'").count() == len(edge_rows) - 3 - wordless


def test_need_prefix_and_subsets_agree():
    for a in range(1, 40):
        least = min(J.need(a, b) for b in range(1, 80) if 100 * min(a, b) >= 85 * max(a, b))
        assert J.prefix(a) == a - least + 1
        for b in range(a, 100 * a // 85 + 1):
            o = J.need(a, b)
            assert 100 * o >= 85 * (a + b - o) and 100 * (o - 1) < 85 * (a + b - o + 1)
            assert o in J.subset_sizes(a, 60) and o in J.subset_sizes(b, 60)


def test_parities_never_exceed_the_difference():
    rng = np.random.default_rng(3)
    for n in (1, 5, 70, 400, 3000):
        a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        for m in (0, 1, n // 2, n):
            b = np.unique(np.concatenate([a[m:], rng.integers(0, 1 << 63, max(1, m // 3)).astype(np.uint64)]))
            assert J.parity_distance(J.parity(a), J.parity(b)) <= len(np.setxor1d(a, b))
            assert int(np.bitwise_count((J.folds(a) ^ J.folds(b)).view(np.uint64)).sum()) <= len(np.setxor1d(a, b))


def test_boundary_follows_the_cost():
    assert J.light_boundary({}) == 0
    few = J.light_boundary({n: 10 for n in range(1, 60)})
    assert 0 < few < J.MAX_LIGHT
    assert all(comb(n, c) < 10_000 for n in range(1, few + 1) for c in J.subset_sizes(n, few))


def test_a_large_near_copy_group_stays_linear(spark, monkeypatch):
    base = ["b%d" % i for i in range(120)]
    rows = []
    for i in range(300):
        w = list(base)
        w[i % 120] = f"e{i}"
        rows.append((i, " ".join(w)))
    rows.append((1000, " ".join(base)))
    sizes, real = {}, J.materialize

    def counted(df, name):
        out = real(df, name)
        sizes[name] = sizes.get(name, 0) + out.count()
        return out
    monkeypatch.setattr(J, "materialize", counted)
    got = J.similarity_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.component_id for r in got} == {0}
    assert sizes["jaccard-star"] + sizes.get("jaccard-cross", 0) < 20 * len(rows)      # not 45,000 pairs


def test_long_texts_with_common_passages_match_brute_force(spark):
    rng = random.Random(8)
    passage = ["p%d" % i for i in range(60)]
    rows = near_copies(3, 6, [2200, 2600])
    for i in range(60):         # unrelated texts around one passage, over a small vocabulary
        rows.append((200_000 + i, " ".join(["s%d" % rng.randrange(40) for _ in range(rng.choice([150, 900]))] + passage)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in J.similarity_components(df).collect()), key=str)
    assert got == brute(rows, 4, 85)


def test_a_section_of_linked_sets_is_as_similar_and_cut_alike():
    assert J.cuts(J.SECTION) == [1, 2] and J.cuts(100) == [1] and J.cuts(J.SECTION + 1) == [2]
    rng = np.random.default_rng(7)
    for n in (300, 437, 512, 900, 5000):
        a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        for lost, new in ((n // 20, n // 20), (0, n * 15 // 85), (n * 15 // 100, 0)):
            b = np.unique(np.concatenate([a[lost:], rng.integers(0, 1 << 63, new).astype(np.uint64)]))
            cut = J.cuts(max(len(a), len(b)))[0]
            assert cut in J.cuts(len(a)) and cut in J.cuts(len(b))
            parts = [(a[(a >> np.uint64(20)) % np.uint64(cut) == j], b[(b >> np.uint64(20)) % np.uint64(cut) == j])
                     for j in range(cut)]
            assert any(100 * len(np.intersect1d(x, y)) >= 85 * len(np.union1d(x, y)) for x, y in parts)


def test_unrelated_long_texts_of_one_list_are_not_paired(spark, monkeypatch):
    """Long texts that share their rarest passage only: the bound inside the join holds."""
    rng = random.Random(11)
    passage = ["p%d" % i for i in range(80)]
    rows = [(i, " ".join(["w%d" % rng.randrange(9) for _ in range(2500)] + passage)) for i in range(40)]
    rows += [(100 + i, t + " end") for i, (_, t) in enumerate(rows[:5])]
    sizes, real = {}, J.prune

    def counted(pairs, packed, percent):
        sizes[len(sizes)] = pairs.count()
        return real(pairs, packed, percent)
    monkeypatch.setattr(J, "prune", counted)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in J.similarity_components(df).collect()), key=str)
    assert got == brute(rows, 4, 85)
    assert sizes[1] < 2 * len(rows)     # across components, of about 900 pairs
