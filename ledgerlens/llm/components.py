"""Connected components of a large link table, as joins and aggregates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import map_arrow, materialize


def local_stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(vertex, least vertex of its component) for every other vertex of the links."""
    names, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    root = list(range(len(names)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for x, y in zip(at[: len(a)].tolist(), at[len(a):].tolist()):
        x, y = find(x), find(y)
        if x != y:
            root[max(x, y)] = min(x, y)
    final = np.array([find(x) for x in range(len(names))], np.int64)
    other = final != np.arange(len(names))
    return names[other], names[final[other]]


def contracted(links: DataFrame) -> DataFrame:
    """The links of each partition (a bounded piece of a written table) as stars: the same
    components from no more links than vertices, before anything is exchanged."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(np.asarray(b.column(0)), np.asarray(b.column(1))) for b in batches]
        if parts:
            v, root = local_stars(*(np.concatenate(x) for x in zip(*parts)))
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()), pa.array(root, pa.int64())], ["a", "b"])

    return map_arrow(links.select("a", "b"), run, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """``(v, root)`` for every vertex of the written link table ``(a, b)``; the root is the
    component's smallest vertex. Every partition first contracts its own links; then large
    and small stars alternate: each vertex hands its least neighbour to its other
    neighbours, until nothing changes. Rounds are written to the shared folder; no vertex
    list is ever gathered in one place."""
    def least(edges: DataFrame) -> DataFrame:
        return edges.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))

    def state(edges: DataFrame) -> tuple:
        return edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    edges = materialize(contracted(links), "links")          # a > b in every row
    before, now = None, state(edges)
    while now[0] and now != before:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = both.join(least(both), "a").filter("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = contracted(materialize(large, "large-star"))
        small = large.join(least(large), "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            small.select("a", F.col("m").alias("b")))
        edges = materialize(small.filter("a <> b").distinct(), "small-star")
        before, now = now, state(edges)
    return edges.select(F.col("a").alias("v"), F.col("b").alias("root")).unionByName(
        edges.select(F.col("b").alias("v"), F.col("b").alias("root"))).distinct()
