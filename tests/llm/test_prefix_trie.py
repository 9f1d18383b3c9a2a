import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import prefix_trie as T
from ledgerlens.llm.queries import ORACLE

SCHEMA = "conv_id long, turn long, role string, text string"


def sequences(rows):
    talks = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            talks[c].append((turn is not None, turn or 0, role or "", text or ""))
    talks = {c: [x[2:] for x in sorted(v, key=lambda x: (x[0], x[1], x[2].encode(), x[3].encode()))] for c, v in talks.items()}
    out = {}
    for c, own in talks.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (abs(c) % 100) * (1 if c >= 0 else -1)
        out[c] = talks.get(base, [])[:h] + own[h:]
    return out


def brute(rows):
    members, ends = defaultdict(list), defaultdict(list)
    for c, s in sequences(rows).items():
        for d in range(len(s) + 1):
            members[tuple(s[:d])].append(c)
        ends[tuple(s)].append(c)
    kids = defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in kids[p]) if kids[p] else 1
        saved[p] = sum(saved[k] for k in kids[p]) + ((len(members[p]) - 1) * len(p[-1][1]) if p else 0)
    return sorted(((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids[p]), leaves[p], saved[p],
                    hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest()) for p, m in members.items()), key=str)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def talks(seed=5):
    rng = random.Random(seed)
    rows = []
    for c in [*range(0, 40), *range(100, 130), *range(205, 215), -100, -103, -150]:
        for turn in range(rng.randint(1, 9)):
            rows.append((c, turn, rng.choice(["user", "assistant", None]), rng.choice(["yes", "no", "", None, "É日本\U0001f600"])))
    same = [("user", "hello"), ("assistant", "hello there"), ("user", "thanks")]
    rows += [(1000 + i, t, r, x) for i in range(250) for t, (r, x) in enumerate(same * 2)]       # equal conversations
    rows += [(5000, t, "user", f"long {t}") for t in range(300)]                                  # one long chain
    rows += [(5001, t, "user", f"long {t}") for t in range(200)]
    rows += [(6000 + i, t, "user", f"step {t}") for i in range(30) for t in range(i + 1)]          # ends at every depth
    rows += [(7000, None, "user", "b"), (7000, None, "user", "a"), (7000, 1, "x", "t"), (7000, 1, "x", "t"), (None, 1, "user", "lost")]
    return rows


@pytest.mark.parametrize("bits", [T.BLOCK_BITS, 1])
def test_like_brute_force(spark, bits):
    rows = talks()
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert got(T.trie(df, bits)) == brute(rows)


def test_contraction_of_any_tree(spark, tmpdir_path):
    rng = random.Random(9)
    parent = [None] + [rng.choice([i, i, i, rng.randrange(i + 1)]) for i in range(600)]      # chains with branches
    depth, total = [0] * len(parent), [(i % 7, 1 << (i % 20)) for i in range(len(parent))]
    kids = [0] * len(parent)
    for i, p in enumerate(parent):
        if p is not None:
            depth[i] = depth[p] + 1
            kids[p] += 1
    rows = [(i, p, i, depth[i], kids[i], *total[i]) for i, p in enumerate(parent)]           # every node a path of its own
    for i in range(len(parent) - 1, 0, -1):
        total[parent[i]] = tuple(a + b for a, b in zip(total[parent[i]], total[i]))
    tree = spark.createDataFrame(rows, "id long, parent long, path long, depth long, kids long, leaves long, saved long")
    tree.write.parquet(f"{tmpdir_path}/tree")
    out = T.subtree_totals(spark.read.parquet(f"{tmpdir_path}/tree"))
    assert {r.id: (r.leaves, r.saved) for r in out.collect()} == dict(enumerate(total))


def test_empty_and_clashing_names(spark):
    nothing = spark.createDataFrame([], SCHEMA)
    assert T.trie(nothing).count() == 0
    lost = spark.createDataFrame([(None, 1, "user", "x")], SCHEMA)
    assert T.trie(lost).count() == 0
    rows = [(0, 0, "u", "a"), (0, 1, "u", "b"), (3, 0, "u", "a"), (11, 2, None, None), (44, 0, "u", "x" * 100000)]
    clash = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("x") for c in ("conv", "pos", "id", "parent", "path", "a", "g", "rank", "_at")})
    assert got(T.trie(clash)) == brute(rows)


def test_oracle(spark):
    rows = [r for r in talks() if r[0] is None or r[0] < 1010]
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    assert sorted(con.execute(ORACLE["op13_prefix_trie"]).fetchall(), key=str) == brute(rows)
