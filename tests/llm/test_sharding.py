import random
import zlib

import pytest

from ledgerlens.llm import sharding as S
from ledgerlens.llm.common import materialize


def slots(df, n):
    return S.number_slots(materialize(S.shard(df, n, bin_bytes=4000).select("row.doc_id", "row.text", "size", "shard", "bin", "rank"), "t")).collect()


def check(rows, out, n, spread):
    assert sorted(((r.doc_id, r.text) for r in out), key=str) == sorted(rows, key=str)
    assert all(r.size == len((r.text or "").encode()) + 8 for r in out)
    held = [0] * n
    for s in range(n):
        mine = [r for r in out if r.shard == s]
        held[s] = sum(r.size for r in mine)
        assert sorted(r.slot for r in mine) == list(range(len(mine)))
    assert max(held) - min(held) <= spread


def test_sizes_are_near_equal(spark):
    rng = random.Random(4)
    rows = [(i, "x" * rng.randrange(0, 300) + str(i)) for i in range(4000)]
    check(rows, slots(spark.createDataFrame(rows, "doc_id long, text string"), 24), 24, 700)


@pytest.mark.parametrize("ids", ["distinct", "null"])
def test_a_hot_text_is_spread(spark, ids):
    rows = [(i if ids == "distinct" else None, "hot text " * 5) for i in range(1500)] + [(i, f"own {i} " * 6) for i in range(3000)]
    check(rows, slots(spark.createDataFrame(rows, "doc_id long, text string"), 8), 8, 400)


def test_edges(edges, edge_rows, nothing):
    out = slots(edges, 4)
    assert sorted(((r.doc_id, r.text) for r in out), key=str) == sorted(edge_rows, key=str)
    assert {r.shard for r in out} <= set(range(4))
    assert slots(nothing, 4) == []


def test_equal_texts_stand_together(spark):
    rows = [(i, f"text {i % 50}") for i in range(1000)]
    out = slots(spark.createDataFrame(rows, "doc_id long, text string"), 5)
    split = {t for t in {r.text for r in out} if len({r.shard for r in out if r.text == t}) > 1}
    assert len(split) <= 4                               # at most one text per boundary


def test_written_shards_hold_the_rows(spark, edges, tmp_path):
    S.write_shards(edges, str(tmp_path / "s"), 3)
    assert spark.read.parquet(str(tmp_path / "s")).count() == edges.count()


def test_checksum_is_unsigned(spark):
    from pyspark.sql import functions as F
    t = "a text whose checksum has its first bit set"
    got = spark.createDataFrame([(t,)], "t string").select(F.crc32(F.col("t").cast("binary"))).first()[0]
    assert got == zlib.crc32(t.encode())
