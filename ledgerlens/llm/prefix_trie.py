"""Conversation prefix trie by parallel tree contraction.

Conversations are rebuilt (a shared opening from another conversation, then their own turns)
and merged into a trie: a node is a distinct sequence of leading turns. Nodes are made by
grouping (conversation, depth) rows on a 128-bit hash of the sequence, which is the xor of
hashes of (place, turn) and so a running xor over blocks of a conversation: no conversation
is ever ordered in one task.

Subtree totals come from tree contraction in join rounds. Every living node keeps what it
has gathered (``leaves``, ``saved``), what waits on its edge to the parent (``up_leaves``,
``up_saved``) and its number of living children. A round

* compresses unary chains: nodes of one path (all nodes with the same least member lie on one
  root-to-leaf path) in the same block of depths are merged into the next living node below
  them, and links between paths or blocks by coin flips (a node goes if it draws 1 and its
  parent 0), so every chain shrinks by a constant factor;
* rakes leaves: a node without living children has its total, which goes to its parent.

Half of the nodes of any tree are leaves or in chains, so rounds are logarithmic. Then the
contracted nodes are re-expanded from the last round to the first: a node's total is its
target's total plus the stored difference.

The digest of a node's ended conversations streams their ids in numeric order: ids are sorted
and packed into pieces in parallel, and only a node's pieces meet in one task, one at a time.

Defined results: a null role or text is empty; null turns come first; equal turns of a
conversation are ordered by role, then text; repeated rows are turns of their own; rows
without a conv_id belong to no conversation; an empty table has no nodes, not even a root;
extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerlens.llm.common import map_arrow, materialize, scratch
from ledgerlens.operators.rank import numbered

FAMILY, OPENINGS = 100, 6       # conversations that share an opening, and its lengths (below 6)
BLOCK_BITS = 10                 # depths of one window: 2**10 in the first round, four times more in each later one
TIE_CHARS = 32                  # of a text in the range key; whole texts order ties inside a partition


def _opening(conv: Column) -> Column:
    return F.pmod(F.crc32(conv.cast("string").cast("binary")), F.lit(OPENINGS))


def turn_table(talks: DataFrame) -> DataFrame:
    """``conv, g, t1, t2, chars``: every turn with its place in the order of all turns and a
    128-bit hash of (role, text). A large conversation spreads over range partitions."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    rows = talks.filter("conv_id is not null").select(F.col("conv_id").alias("conv"), "turn", role.alias("role"), text.alias("text"))
    order = [F.col("conv"), F.col("turn").asc_nulls_first(), F.col("role")]
    spread = rows.repartitionByRange(*order, F.substring("text", 1, TIE_CHARS)).sortWithinPartitions(*order, "text")
    narrow = spread.select("conv", F.xxhash64("role", "text", F.length("role")).alias("t1"),
                           F.xxhash64(F.lit("turn"), "text", "role", F.length("text")).alias("t2"),
                           F.length("text").cast("long").alias("chars"))
    return numbered(narrow, scratch(talks.sparkSession, "trie-turns"), name="g")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conversations, turns): ``conv, n_turns`` of every rebuilt conversation, and its turns
    ``conv, pos`` (from 1), ``t1, t2, chars, n_turns``."""
    own = materialize(turns.groupBy("conv").agg(F.min("g").alias("g0"), F.count("*").alias("n")), "trie-convs")
    c, head = F.col("conv"), _opening(F.col("conv"))
    base = own.select(c.alias("base"), F.col("n").alias("base_n"))
    convs = own.withColumn("base", c - c % FAMILY).join(base, "base", "left").select(
        "conv", "g0", "n", "base", head.alias("h"), F.least(head, F.coalesce("base_n", F.lit(0))).alias("b"))
    convs = convs.withColumn("n_turns", F.col("b") + F.greatest(F.col("n") - F.col("h"), F.lit(0)))
    convs = materialize(convs, "trie-rebuilt")

    placed = turns.join(convs, "conv").withColumn("own", F.col("g") - F.col("g0") + 1)
    tail = placed.filter("own > h").select("conv", (F.col("b") + F.col("own") - F.col("h")).alias("pos"),
                                           "t1", "t2", "chars", "n_turns")
    opening = (turns.join(own, "conv").withColumn("pos", F.col("g") - F.col("g0") + 1)
               .filter((F.col("pos") < OPENINGS) & (F.col("conv") % FAMILY == 0))
               .select(F.col("conv").alias("base"), "pos", "t1", "t2", "chars"))
    shared = opening.join(convs.filter("b > 0").select("conv", "base", "b", "n_turns"), "base").filter("pos <= b")
    both = materialize(tail.unionByName(shared.select(*tail.columns)), "trie-sequences")
    return convs.select("conv", "n_turns"), both


def prefixes(turns: DataFrame, block_bits: int = BLOCK_BITS) -> DataFrame:
    """Adds the hash ``a, b`` of the sequence up to each turn and ``pa, pb`` of that before it,
    and whether the turn is its conversation's ``last``."""
    x = F.xxhash64("t1", "t2", "pos"), F.xxhash64(F.lit("place"), "t2", "pos", "t1")
    rows = turns.withColumns({"x": x[0], "y": x[1], "block": F.shiftright(F.col("pos") - 1, block_bits)})
    inside = Window.partitionBy("conv", "block").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    summed = rows.withColumns({"a": F.bit_xor("x").over(inside), "b": F.bit_xor("y").over(inside)})
    before = Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.filter(F.col("n_turns") > (1 << block_bits)).groupBy("conv", "block").agg(F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y"))
    blocks = blocks.select("conv", "block", F.bit_xor("x").over(before).alias("bx"), F.bit_xor("y").over(before).alias("by"))
    summed = summed.join(blocks.filter("block > 0"), ["conv", "block"], "left")
    a = F.col("a").bitwiseXOR(F.coalesce("bx", F.lit(0)))
    b = F.col("b").bitwiseXOR(F.coalesce("by", F.lit(0)))
    return summed.select("conv", "pos", "chars", (F.col("pos") == F.col("n_turns")).alias("last"), a.alias("a"), b.alias("b"),
                         a.bitwiseXOR(F.col("x")).alias("pa"), b.bitwiseXOR(F.col("y")).alias("pb"))


def node_table(convs: DataFrame, rows: DataFrame) -> DataFrame:
    """One row per node: its hash and its parent's, ``conv_id`` (least member), ``depth``,
    members, ended conversations, their least, and the last text's code points."""
    ended = F.when(F.col("last"), F.col("conv"))
    inner = rows.groupBy("a", "b").agg(
        F.min("pa").alias("pa"), F.min("pb").alias("pb"), F.min("conv").alias("conv_id"), F.min("pos").cast("long").alias("depth"),
        F.count("*").alias("n_convs"), F.count(ended).alias("n_ends"), F.min(ended).alias("end"), F.min("chars").alias("chars"))
    none, bare = F.lit(0).cast("long"), F.when(F.col("n_turns") == 0, F.col("conv"))
    root = convs.agg(F.min("conv").alias("conv_id"), F.count("*").alias("n_convs"), F.count(bare).alias("n_ends"),
                     F.min(bare).alias("end")).filter("n_convs > 0")
    root = root.select(none.alias("a"), none.alias("b"), F.lit(None).cast("long").alias("pa"), F.lit(None).cast("long").alias("pb"),
                       "conv_id", none.alias("depth"), "n_convs", "n_ends", "end", none.alias("chars"))
    nodes = materialize(inner.unionByName(root).withColumn("id", F.monotonically_increasing_id()), "trie-nodes")
    up = nodes.select(F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("id").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    kids = nodes.groupBy(F.col("pa").alias("a"), F.col("pb").alias("b")).agg(F.count("*").alias("n_children"))
    joined = nodes.join(up, ["pa", "pb"], "left").join(kids.filter("a is not null"), ["a", "b"], "left")
    return materialize(joined.drop("pa", "pb").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "trie-tree")


def end_digests(rows: DataFrame, convs: DataFrame, nodes: DataFrame) -> DataFrame:
    """``id, sha`` of the nodes in which several conversations end."""
    many = nodes.filter("n_ends > 1").select("id", "a", "b")
    zero = F.lit(0).cast("long")
    ends = rows.filter("last").select("a", "b", "conv").unionByName(
        convs.filter("n_turns = 0").select(zero.alias("a"), zero.alias("b"), "conv"))
    ends = ends.join(many, ["a", "b"]).select("id", "conv").repartitionByRange("id", "conv").sortWithinPartitions("id", "conv")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, conv = np.asarray(b.column(0)), np.asarray(b.column(1))
            edges = np.unique(np.concatenate([[0], np.flatnonzero(np.diff(ids)) + 1, [len(ids)]]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[edges[:-1]]), pa.array(conv[edges[:-1]]),
                 pa.array([",".join(map(str, conv[i:j].tolist())) for i, j in zip(edges, edges[1:])], pa.string())],
                ["id", "first", "piece"])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, sha = None, None
        for b in batches:
            ids, out = [], []
            for i, piece in zip(b.column(0).to_pylist(), b.column(2)):
                if i == here:
                    sha.update(b"," + piece.as_py().encode())
                    continue
                if here is not None:
                    ids.append(here)
                    out.append(sha.hexdigest())
                here, sha = i, hashlib.sha256(piece.as_py().encode())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.string())], ["id", "sha"])
        if here is not None:
            yield pa.RecordBatch.from_arrays([pa.array([here], pa.int64()), pa.array([sha.hexdigest()])], ["id", "sha"])

    pieces = map_arrow(ends, pack, "id long, first long, piece string")
    return map_arrow(pieces.repartition("id").sortWithinPartitions("id", "first"), digest, "id long, sha string")


# --- tree contraction -------------------------------------------------------

ALIVE = ["id", "parent", "path", "depth", "kids", "leaves", "saved", "up_leaves", "up_saved"]


def _compress_paths(alive: DataFrame, bits: int) -> tuple[DataFrame, DataFrame]:
    """(living, merged): in each block of a path, chain nodes join the next node below."""
    place = Window.partitionBy("path", "block").orderBy(F.desc("depth"))
    rows = alive.withColumn("block", F.shiftright("depth", bits)).withColumn(
        "goes", (F.col("kids") == 1) & (F.col("parent").isNotNull()) & F.lag("id").over(place).isNotNull())
    rows = rows.withColumn("run", F.sum(F.when(F.col("goes"), 0).otherwise(1)).over(place))
    run = Window.partitionBy("path", "block", "run").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("path", "block", "run").orderBy(F.desc("depth")).rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing)
    below = Window.partitionBy("path", "block", "run").orderBy(F.desc("depth"))
    gained = {}
    for c in ("leaves", "saved"):       # a merged node's total: its own, and what waited on the edge below
        gained[f"d_{c}"] = F.when(F.col("goes"), F.col(c) + F.lag(f"up_{c}").over(below)).otherwise(0)
    rows = rows.withColumns(gained)
    merged = rows.withColumns({"target": F.first("id").over(run), "s_leaves": F.sum("d_leaves").over(run),
                               "s_saved": F.sum("d_saved").over(run), "top": F.last("parent").over(whole),
                               "w_leaves": F.sum("d_leaves").over(whole) + F.last("up_leaves").over(whole),
                               "w_saved": F.sum("d_saved").over(whole) + F.last("up_saved").over(whole)})
    both = materialize(merged.select(
        "id", F.col("top").alias("parent"), "path", "depth", "kids", "leaves", "saved", F.col("w_leaves").alias("up_leaves"),
        F.col("w_saved").alias("up_saved"), "goes", "target", "s_leaves", "s_saved"), "trie-compressed")
    return both.filter("not goes").select(*ALIVE), both.filter("goes").select("id", "target", "s_leaves", "s_saved")


def _compress_links(alive: DataFrame, round_: int) -> tuple[DataFrame, DataFrame]:
    """(living, merged): chain nodes that draw 1 and whose parent draws 0 join their child."""
    coin = lambda c: F.pmod(F.xxhash64(F.lit(round_), c), F.lit(2))
    goes = alive.filter("kids = 1 and parent is not null").filter((coin("id") == 1) & (coin("parent") == 0)).select(
        F.col("id").alias("v"), F.col("parent").alias("top"), *[F.col(c).alias(f"v_{c}") for c in ALIVE[5:]])
    goes = materialize(goes, "trie-links")
    kept = alive.join(goes.select(F.col("v").alias("id")), "id", "left_anti")
    moved = kept.join(goes, kept["parent"] == goes["v"], "left")
    merged = moved.filter("v is not null").select(
        F.col("v").alias("id"), F.col("id").alias("target"), (F.col("v_leaves") + F.col("up_leaves")).alias("s_leaves"),
        (F.col("v_saved") + F.col("up_saved")).alias("s_saved"))
    new = {f"up_{c}": F.col(f"up_{c}") + F.when(F.col("v").isNotNull(), F.col(f"v_{c}") + F.col(f"v_up_{c}")).otherwise(0)
           for c in ("leaves", "saved")}
    living = moved.withColumns({**new, "parent": F.when(F.col("v").isNotNull(), F.col("top")).otherwise(F.col("parent"))})
    return materialize(living.select(*ALIVE), "trie-spliced"), materialize(merged, "trie-merged")


def _rake(alive: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(living, raked totals): nodes without living children give their total upwards."""
    leaves = alive.filter("kids = 0")
    gains = leaves.filter("parent is not null").groupBy(F.col("parent").alias("id")).agg(
        F.count("*").alias("n"), F.sum(F.col("leaves") + F.col("up_leaves")).alias("l"), F.sum(F.col("saved") + F.col("up_saved")).alias("s"))
    got = lambda c: F.coalesce(F.col(c), F.lit(0))
    living = alive.filter("kids > 0").join(gains, "id", "left").withColumns(
        {"kids": F.col("kids") - got("n"), "leaves": F.col("leaves") + got("l"), "saved": F.col("saved") + got("s")})
    return materialize(living.select(*ALIVE), "trie-raked"), leaves.select("id", "leaves", "saved")


def subtree_totals(nodes: DataFrame, block_bits: int = BLOCK_BITS) -> DataFrame:
    """``id, leaves, saved``: the sums of ``leaves`` and ``saved`` over every node's subtree.
    ``nodes`` is a written table ``id, parent, path, depth, kids, leaves, saved``; ``path`` names
    a path that the node lies on, contiguous in depth."""
    none = F.lit(0).cast("long")
    alive = nodes.select(*ALIVE[:7], none.alias("up_leaves"), none.alias("up_saved"))
    steps: list[tuple[list[DataFrame], DataFrame]] = []         # per round: merged nodes, raked totals
    bits = block_bits
    while alive.head(1):
        alive, merged = _compress_paths(alive, bits)
        links = [merged]
        if alive.filter("kids = 1 and parent is not null").head(1):
            alive, spliced = _compress_links(alive, len(steps))
            links.append(spliced)
        alive, raked = _rake(alive)
        steps.append((links, raked))
        bits = min(bits + 2, 62)
    found: DataFrame | None = None
    for links, raked in reversed(steps):                        # re-expansion, last round first
        found = raked if found is None else found.unionByName(raked)
        for merged in reversed(links):
            back = merged.join(found.withColumnRenamed("id", "target"), "target").select(
                "id", (F.col("leaves") + F.col("s_leaves")).alias("leaves"), (F.col("saved") + F.col("s_saved")).alias("saved"))
            found = found.unionByName(materialize(back, "trie-expanded"))
    return nodes.select("id", "leaves", "saved") if found is None else found


def trie(talks: DataFrame, block_bits: int = BLOCK_BITS) -> DataFrame:
    """One row per node: ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256``."""
    convs, turns = rebuilt(turn_table(talks))
    rows = materialize(prefixes(turns, block_bits), "trie-prefixes")
    nodes = node_table(convs, rows)
    tree = nodes.select("id", "parent", F.col("conv_id").alias("path"), "depth", F.col("n_children").alias("kids"),
                        F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long").alias("leaves"),
                        ((F.col("n_convs") - 1) * F.col("chars")).alias("saved"))
    totals = subtree_totals(tree, block_bits)
    shas = end_digests(rows, convs, nodes)
    sha = F.coalesce("sha", F.sha2(F.coalesce(F.col("end").cast("string"), F.lit("")), 256))
    return nodes.join(totals, "id").join(shas, "id", "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.col("leaves").alias("n_leaves"),
        F.col("saved").alias("saved_tokens"), sha.alias("ends_sha256"))
