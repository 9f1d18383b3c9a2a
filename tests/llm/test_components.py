import random

import numpy as np
import pytest

from ledgerlens.llm.common import materialize
from ledgerlens.llm.components import components, local_stars


def graph(seed, n=600):
    """A long chain, random links and a star."""
    r = random.Random(seed)
    links = [(i, i + 1) for i in range(100)] + [(r.randrange(200, n), r.randrange(200, n)) for _ in range(260)]
    links += [(150, x) for x in range(120, 149)] + [(7, 7)]
    r.shuffle(links)
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, b in links:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return links, {v: find(v) for a, b in links if a != b for v in (a, b)}


@pytest.mark.parametrize("seed,parts", [(1, 1), (2, 9)])
def test_roots_are_the_least_vertices(spark, seed, parts):
    links, want = graph(seed)
    table = materialize(spark.createDataFrame(links, "a long, b long").repartition(parts), "test-links")
    got = components(table).collect()
    assert {r.v: r.root for r in got} == want and len(got) == len(want)


def test_no_links(spark):
    assert components(materialize(spark.createDataFrame([], "a long, b long"), "test-none")).count() == 0


def test_local_contraction():
    links, want = graph(3)
    v, root = local_stars(*(np.array(x) for x in zip(*links)))
    assert dict(zip(v.tolist(), root.tolist())) == {k: r for k, r in want.items() if k != r}
