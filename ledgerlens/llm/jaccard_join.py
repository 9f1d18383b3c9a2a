"""Exact n-gram Jaccard self-join as a size-aware heavy-light join.

Equal shingle sets are one class. Two classes link when their Jaccard similarity is at
least ``PERCENT`` / 100, which fixes the least overlap ``need(a, b)`` of two set sizes.

* light sets (size up to a boundary) enumerate all their subsets of every size that
  ``need`` asks for; two light sets link only if they share such a subset;
* heavy sets are found on inverted lists: a global order of the shingles (rare first)
  makes any linked pair share one of the first ``prefix(n)`` shingles of both sets, at
  positions that still leave room for the needed overlap, so only those are listed.

Sets of more than ``SECTION`` shingles are listed by sections: the shingle space is cut by
hash into 2, 4, 8, ... parts of that size at most on average, the number depending on the set's
size. As a ratio of sums lies between its terms' ratios, linked sets have a section whose parts
are as similar as the sets must be, so each part is listed and tried like a set of its own, and
a bound of fixed size stays sharp for sets of any size. A set whose larger partners are cut
finer is listed in both cuts.

The boundary minimises the rows of both parts over the corpus's size histogram. The order
ranks shingles by a fixed-size table of corpus counts, so very common shingles come last.

Lists are not expanded into all pairs. Each list's first member (the one with the fewest
rarer shingles) is compared with all others; verified links are contracted into
components, and only lists that still hold two components are compared across components.
No link between components is lost, so the components are exact. Candidate pairs are first
tried on small parity bitmaps (256 bits a section inside the join, n/2 bits after it), whose
distance never exceeds the sets' difference; the sets of the rest are fetched and compared in
full.

Defined results: a text without words (or null) has size 0 and no links; with fewer words
than the shingle length the whole sequence is the only shingle; null ids belong to
components like others, but name one only where all ids of it are null; repeated rows and
repeated ids are rows of their own; an empty table gives an empty result; extra columns
are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import Words, map_arrow, materialize, mix, slices
from ledgerlens.llm.components import components

SHINGLE, PERCENT = 4, 85
COUNTERS, BLOCK = 1 << 20, 1 << 14      # the table of shingle counts, and its slice per row
LIST_COST = 4                           # a listed shingle's cost in enumerated subsets
MAX_LIGHT = 24                          # above it the subsets of one set alone exceed thousands
SIEVE_BITS = 22
SECTION = 256                           # a section's greatest mean size; its parities have as many bits
LAST = (1 << 63) - 1                    # stands for a null id in joins


def need(a, b, percent: int = PERCENT):
    """Least overlap of linked sets of sizes a and b: ceil(p (a + b) / (100 + p))."""
    return -(-percent * (a + b) // (100 + percent))


def prefix(n, percent: int = PERCENT):
    """Listed shingles of a set of size n; its least overlap is ceil(p n / 100)."""
    return n + (-percent * n // 100) + 1


def subset_sizes(n: int, most: int, percent: int = PERCENT) -> list[int]:
    """Overlaps that ``need`` asks of a set of size n with any partner up to ``most``."""
    partners = range(-(-percent * n // 100), min(most, 100 * n // percent) + 1)
    return sorted({need(n, m, percent) for m in partners if m > 0})


def light_boundary(sizes: dict[int, int], percent: int = PERCENT) -> int:
    """The light sets' greatest size: the one of least total cost."""
    def cost(most: int) -> int:
        return sum(k * (sum(math.comb(n, c) for c in subset_sizes(n, most, percent)) if n <= most
                        else LIST_COST * prefix(n, percent)) for n, k in sizes.items())
    return min(range(MAX_LIGHT + 1), key=cost)


def cuts(n: int, percent: int = PERCENT) -> list[int]:
    """Numbers of sections (powers of two) that a set of size n is listed in: its own and
    those of its larger partners."""
    own, largest = (max(0, (-(-m // SECTION) - 1).bit_length()) for m in (n, 100 * n // percent))
    return [1 << e for e in range(own, largest + 1)]


def _doc():
    return F.coalesce("doc_id", F.lit(LAST)).cast("long").alias("doc")


class Sets:
    """Sorted distinct shingle hashes of the rows of a slice."""

    def __init__(self, column: pa.Array, k: int):
        w = Words(column, True)
        h, at = w.shingles(k)
        row = w.row[at]
        short = np.flatnonzero((w.count > 0) & (w.count < k))
        if len(short):      # the whole sequence as one shingle
            whole = np.array([int.from_bytes(hashlib.blake2b(w.hash[w.first[i]: w.first[i + 1]].tobytes(), digest_size=8)
                                             .digest(), "little") for i in short], np.uint64)
            h, row = np.concatenate([h, whole]), np.concatenate([row, short])
        order = np.lexsort((h, row))
        h, row = h[order], row[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
        self.hash, self.row = h[new], row[new]
        self.first = np.searchsorted(self.row, np.arange(len(column) + 1))
        self.size = np.diff(self.first)

    def of(self, i: int) -> np.ndarray:
        return self.hash[self.first[i]: self.first[i + 1]]

    def signatures(self) -> list[bytes | None]:
        """128-bit identity of each set; None for empty sets."""
        return [hashlib.blake2b(self.of(i).tobytes(), digest_size=16).digest() if n else None
                for i, n in enumerate(self.size)]


def describe(docs: DataFrame, k: int) -> DataFrame:
    """Per row ``doc_id, n, sig``; per task additionally slices of the shingle counters
    (``block, counts``), all in one pass over the texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "row_key", "n", "sig", "block", "counts"]
        total = np.zeros(COUNTERS, np.int64)
        for b in slices(batches):
            s = Sets(b.column(2), k)
            if len(s.hash):
                total += np.bincount((s.hash >> np.uint64(44)).astype(np.int64), minlength=COUNTERS)
            m = b.num_rows
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(s.size.astype(np.int64)), pa.array(s.signatures(), pa.binary()),
                 pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary())], names)
        at = [i for i in range(0, COUNTERS, BLOCK) if total[i: i + BLOCK].any()]
        m = len(at)
        yield pa.RecordBatch.from_arrays(
            [pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.binary()),
             pa.array(at, pa.int32()), pa.array([total[i: i + BLOCK].astype(np.int32).tobytes() for i in at], pa.binary())], names)

    rows = docs.select("doc_id", F.xxhash64("text", F.length("text")).alias("row_key"), "text")
    return map_arrow(rows, run, "doc_id long, row_key long, n long, sig binary, block int, counts binary")


def order_classes(described: DataFrame) -> np.ndarray:
    """Commonness class of each counter: 0 up to twice the mean, then one per doubling.
    The counters are summed per slice on the executors; ``COUNTERS`` bytes in all reach
    the driver."""
    def add(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BLOCK, np.int64)
        for b in batches:
            for c in b.column("counts"):
                total += np.frombuffer(c.as_py(), np.int32)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([total.tobytes()])],
                                         ["block", "counts"])

    rows = (described.filter("block is not null").select("block", "counts").groupBy("block")
            .applyInArrow(add, "block int, counts binary").collect())
    total = np.zeros(COUNTERS, np.int64)
    for r in rows:
        total[r.block: r.block + BLOCK] = np.frombuffer(r.counts, np.int64)
    mean = max(8.0, total.mean())
    return np.clip(np.floor(np.log2(np.maximum(total / mean, 1))), 0, 15).astype(np.uint8)


def parity(s: np.ndarray) -> bytes:
    """Parities of the set's counts in n/2 (a power of two, 64 at least) residues."""
    size = 1 << max(6, (len(s) - 1).bit_length() - 1)
    return np.packbits((np.bincount((s & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1).astype(np.uint8)).tobytes()


FOLDS = ("f0", "f1", "f2", "f3")


def folds(s: np.ndarray) -> np.ndarray:
    """Parities in 256 residues as four integers, for use inside a join condition."""
    return np.packbits((np.bincount((s & np.uint64(255)).astype(np.int64), minlength=256) & 1).astype(np.uint8)).view(np.int64)


def parity_distance(x: bytes, y: bytes) -> int:
    """Residues whose parities differ: no more than the sets' symmetric difference. Halves
    are folded until both have the same residues."""
    p, q = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    while len(p) > len(q):
        p = p[: len(p) // 2] ^ p[len(p) // 2:]
    while len(q) > len(p):
        q = q[: len(q) // 2] ^ q[len(q) // 2:]
    return int(np.bitwise_count(p ^ q).sum())


def candidate_keys(docs: DataFrame, k: int, classes: np.ndarray, light: int, percent: int) -> DataFrame:
    """Per row ``doc_id, sig``, its packed candidate keys, the set's parities, and per
    section ``sec, size, number of keys`` (``runs``) with its 256 parities (``folds``). Keys are
    listed shingles of heavy sets and of light sets that a heavy one may link to, by
    section (``sec`` is the number of sections plus the section's own), then subset hashes of
    light sets (``sec`` 0)."""
    floor = -(-percent * (light + 1) // 100)        # least size that links to a heavy set

    def subsets(s: np.ndarray) -> np.ndarray:
        out = []
        for c in subset_sizes(len(s), light, percent):
            picks = s[np.array(list(combinations(range(len(s)), c)), np.int64).reshape(-1, c)]
            key = np.full(len(picks), c, np.uint64)
            for j in range(c):
                key = mix(key * np.uint64(0xD6E8FEB86659FD93) + picks[:, j])
            out.append(key)
        return np.concatenate(out) if out else np.zeros(0, np.uint64)

    def packed(ranked: np.ndarray) -> tuple[bytes, bytes, bytes]:
        """Keys, runs and folds of one set, whose shingles come in the global order."""
        n, keys, runs, bits = len(ranked), [], [], []
        for cut in cuts(n, percent) if n >= max(floor, 1) else []:
            # bits apart from those that choose the class and the parity's residue
            part = ((ranked >> np.uint64(20)) & np.uint64(cut - 1)).astype(np.int64)
            by = ranked[np.argsort(part, kind="stable")]
            ends = np.cumsum(np.bincount(part, minlength=cut))
            for j, end in enumerate(ends.tolist()):
                section = by[ends[j - 1] if j else 0: end]
                if len(section):
                    listed = section[: prefix(len(section), percent)]
                    keys.append(listed if cut == 1 else mix(listed + np.uint64(cut)))
                    runs.append((cut + j, len(section), len(listed)))
                    bits.append(folds(section))
        if 0 < n <= light:
            keys.append(subsets(np.sort(ranked)))
            runs.append((0, n, len(keys[-1])))
            bits.append(folds(ranked))
        return (b"".join(x.tobytes() for x in keys), np.array(runs, np.int32).tobytes(),
                b"".join(x.tobytes() for x in bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            s = Sets(b.column(1), k)
            rank = classes[(s.hash >> np.uint64(44)).astype(np.int64)]
            ranked = s.hash[np.lexsort((s.hash, rank, s.row))]
            parts = [packed(ranked[s.first[i]: s.first[i + 1]]) for i in range(b.num_rows)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(s.signatures(), pa.binary()),
                 *(pa.array([p[j] for p in parts], pa.binary()) for j in range(3)),
                 pa.array([parity(s.of(i)) for i in range(b.num_rows)], pa.binary())],
                ["doc", "sig", "keys", "runs", "folds", "bits"])

    return map_arrow(docs.select(_doc(), "text"), run,
                     "doc long, sig binary, keys binary, runs binary, folds binary, bits binary")


def unpack(packed: DataFrame) -> DataFrame:
    """``cid, keys, runs`` as one row per key: ``key, cid, sec, n, pos``, where n is the
    section's size and pos the key's place in its list (-1 for subsets)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a in range(0, b.num_rows, 512):
                p = b.slice(a, 512)
                keys = np.concatenate([np.frombuffer(x.as_py(), np.uint64) for x in p.column(1)])
                runs = [np.frombuffer(x.as_py(), np.int32).reshape(-1, 3) for x in p.column(2)]
                sec, n, count = np.concatenate(runs).T
                cid = np.repeat(np.repeat(np.asarray(p.column(0)), [len(r) for r in runs]), count)
                pos = np.arange(len(keys)) - np.repeat(np.cumsum(count) - count, count)
                sec, n = np.repeat(sec, count), np.repeat(n, count)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys >> np.uint64(16)).cast(pa.int64()), pa.array(cid), pa.array(sec), pa.array(n),
                     pa.array(np.where(sec == 0, -1, pos).astype(np.int32))], ["key", "cid", "sec", "n", "pos"])

    return map_arrow(packed.select("cid", "keys", "runs"), run, "key long, cid long, sec int, n int, pos int")


def section_parities(packed: DataFrame) -> DataFrame:
    """``cid, sec`` and the section's 256 parities as ``FOLDS``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            runs = [np.frombuffer(x.as_py(), np.int32).reshape(-1, 3) for x in b.column(1)]
            if runs:
                bits = np.concatenate([np.frombuffer(x.as_py(), np.int64).reshape(-1, 4) for x in b.column(2)])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(np.asarray(b.column(0)), [len(r) for r in runs])),
                     pa.array(np.concatenate(runs)[:, 0]), *(pa.array(bits[:, j]) for j in range(4))], ["cid", "sec", *FOLDS])

    return map_arrow(packed.select("cid", "runs", "folds"), run, "cid long, sec int, f0 long, f1 long, f2 long, f3 long")


def _least(percent: int) -> str:
    return f"cast(ceil({percent} * (x.n + y.n) / {100 + percent}.0) as int)"


def _possible(percent: int, light: int) -> str:
    """Whether list entries x and y can be a link by size and position. Keys differ between
    cuts, so both entries of a pair are whole sets (``sec`` 0 or 1) or both are sections."""
    least = _least(percent)
    return (f"x.cid <> y.cid and 100 * least(x.n, y.n) >= {percent} * greatest(x.n, y.n) and "
            f"(x.pos < 0 or ((x.sec > 1 or greatest(x.n, y.n) > {light}) and x.n - x.pos >= {least} and y.n - y.pos >= {least}))")


def shingle_sets(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """``cid, items`` (packed sorted hashes) of the wanted classes ``(cid, doc, sig)``.
    A fixed-size sieve of their ids keeps most other texts out of the exchange."""
    slot = F.pmod(F.xxhash64("doc"), F.lit(1 << SIEVE_BITS))
    word, bit = F.shiftright(slot, 6), slot.bitwiseAND(F.lit(63)).cast("int")
    # at most 2 ** (SIEVE_BITS - 6) rows of two numbers, made on the executors
    sieve = wanted.groupBy(word.alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit)).alias("mask"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p in slices(iter([b])):
                s = Sets(p.column(1), k)
                yield pa.RecordBatch.from_arrays(
                    [p.column(0), pa.array(s.signatures(), pa.binary()),
                     pa.array([s.of(i).tobytes() for i in range(p.num_rows)], pa.binary())], ["doc", "sig", "items"])

    rows = docs.select(_doc(), "text").withColumn("word", word).join(F.broadcast(sieve), "word")
    rows = rows.filter(F.call_function("shiftrightunsigned", F.col("mask"), bit).bitwiseAND(F.lit(1)) == 1).select("doc", "text")
    sets = map_arrow(rows, run, "doc long, sig binary, items binary")
    return sets.join(wanted, ["doc", "sig"]).dropDuplicates(["doc", "sig"]).select("cid", "items")


def prune(pairs: DataFrame, packed: DataFrame, percent: int) -> DataFrame:
    """The pairs whose parities do not already rule out a link."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            a, c, m, n, x, y = (b.column(i) for i in range(6))
            keep = [parity_distance(p, q) <= i + j - 2 * need(i, j, percent)
                    for i, j, p, q in zip(m.to_pylist(), n.to_pylist(), x.to_pylist(), y.to_pylist())]
            yield pa.RecordBatch.from_arrays([a, c], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    side = lambda c, n, bits: packed.select(F.col("cid").alias(c), F.col("n").alias(n), F.col("bits").alias(bits))
    both = pairs.join(side("a", "m", "x"), "a").join(side("b", "n", "y"), "b")
    return map_arrow(both.select("a", "b", "m", "n", "x", "y"), run, "a long, b long")


def verify(pairs: DataFrame, docs: DataFrame, classes: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs ``(a, b)`` whose sets really are similar enough. Only the sets of classes in
    some pair are fetched."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("cid")).distinct()
    sets = materialize(shingle_sets(docs, classes.join(ids, "cid").select("cid", "doc", "sig"), k), "jaccard-sets")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column(2), b.column(3)):
                p, q = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                at = np.minimum(np.searchsorted(q, p), len(q) - 1)
                both = int((q[at] == p).sum())
                keep.append(100 * both >= percent * (len(p) + len(q) - both))
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    with_a = pairs.join(sets.select(F.col("cid").alias("a"), F.col("items").alias("p")), "a")
    both = with_a.join(sets.select(F.col("cid").alias("b"), F.col("items").alias("q")), "b")
    return map_arrow(both.select("a", "b", "p", "q"), run, "a long, b long")


def linked_classes(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """(rows, classes): per input row ``doc_id, row_key, n, sig``, and per distinct
    non-empty set ``cid, sig, root`` where classes of one component share the root."""
    described = materialize(describe(docs, k), "jaccard-rows")
    rows = described.filter("block is null").select("doc_id", "row_key", "n", "sig")
    grouped = rows.filter("n > 0").groupBy("sig").agg(F.min(_doc()).alias("doc"), F.first("n").alias("n"))
    classes = materialize(grouped.select(F.monotonically_increasing_id().alias("cid"), "*"), "jaccard-classes")
    sizes = {r.n: r["count"] for r in classes.groupBy("n").count().collect()}    # one row per distinct size
    light = light_boundary(sizes, percent)
    keyed = candidate_keys(docs, k, order_classes(described), light, percent).filter("octet_length(keys) > 0")
    packed = materialize(keyed.join(classes, ["doc", "sig"]).dropDuplicates(["doc", "sig"])
                         .select("cid", "n", "bits", "keys", "runs", "folds"), "jaccard-keys")

    entries = unpack(packed)
    shared = entries.groupBy("key").agg(F.count("*").alias("c")).filter("c > 1").select("key")
    lists = materialize(entries.join(shared, "key", "left_semi"), "jaccard-lists")
    possible = _possible(percent, light)
    heads = lists.groupBy("key").agg(F.min(F.struct("pos", "n", "cid", "sec")).alias("y")).select("key", "y.*")
    star = (lists.alias("x").join(heads.alias("y"), "key").filter(possible)
            .select(F.least("x.cid", "y.cid").alias("a"), F.greatest("x.cid", "y.cid").alias("b")).distinct())
    star = materialize(star, "jaccard-star")

    links = materialize(verify(materialize(prune(star, packed, percent), "jaccard-likely"), docs, classes, k, percent),
                        "jaccard-links")
    roots = materialize(components(links), "jaccard-roots")

    # lists that still hold two components: every possible pair across components
    labelled = lists.join(roots.withColumnRenamed("v", "cid"), "cid", "left").select(
        "key", "cid", "sec", "n", "pos", F.coalesce("root", "cid").alias("root"))
    labelled = materialize(labelled, "jaccard-labelled")
    mixed = labelled.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi").select("key")
    left = materialize(labelled.join(mixed, "key", "left_semi").join(section_parities(packed), ["cid", "sec"]), "jaccard-mixed")
    apart = " + ".join(f"bit_count(x.{f} ^ y.{f})" for f in FOLDS)      # at most the sections' difference
    cross = (left.alias("x").join(left.alias("y"), "key").filter("x.root < y.root and " + possible)
             .filter(f"{apart} <= x.n + y.n - 2 * {_least(percent)}")
             .select(F.least("x.cid", "y.cid").alias("a"), F.greatest("x.cid", "y.cid").alias("b")).distinct()
             .join(star, ["a", "b"], "left_anti"))
    cross = materialize(prune(cross, packed, percent), "jaccard-cross")
    more = materialize(verify(cross, docs, classes, k, percent), "jaccard-more") if cross.head(1) else None
    if more is not None and more.head(1):
        roots = components(links.unionByName(more))
    found = classes.join(roots.withColumnRenamed("v", "cid"), "cid", "left")
    return rows, found.select("cid", "sig", F.coalesce("root", "cid").alias("root"))


def similarity_components(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """``doc_id, row_key, n_shingles, component_id`` per input row; ``component_id`` is the
    smallest id of the row's component. ``first_key`` tells the row that represents
    the component: least (id, text hash), ids before nulls."""
    rows, classes = linked_classes(docs, k, percent)
    placed = rows.join(classes.select("sig", "root"), "sig", "left")
    order = F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "row_key")
    least = placed.filter("root is not null").groupBy("root").agg(F.min(order).alias("first"))
    return placed.join(least, "root", "left").select(
        "doc_id", "row_key", F.col("n").alias("n_shingles"),
        F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("component_id"),
        F.when(F.col("root").isNull(), F.col("row_key")).otherwise(F.col("first.row_key")).alias("first_key"))


def keep_one_per_component(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """The input rows that represent their component, all columns unchanged. Of equal
    rows (same id and text) that represent one, one stays; texts without words stay."""
    names = docs.columns
    found = similarity_components(docs, k, percent)
    first = (found.filter("n_shingles > 0 and row_key = first_key and doc_id <=> component_id")
             .select("doc_id", "row_key").distinct())
    keyed = docs.toDF(*[f"c{i}" for i in range(len(names))]).withColumns({
        "row_key": F.xxhash64(f"c{names.index('text')}", F.length(f"c{names.index('text')}"))})
    key, text = F.col(f"c{names.index('doc_id')}"), F.col(f"c{names.index('text')}")
    worded = F.coalesce(text, F.lit("")).rlike("[^\\x20\\x09-\\x0D]")
    same = key.eqNullSafe(first["doc_id"]) & (keyed["row_key"] == first["row_key"])
    kept = keyed.filter(worded).join(first, same, "left_semi").dropDuplicates([f"c{names.index('doc_id')}", "row_key"])
    return kept.unionByName(keyed.filter(~worded)).drop("row_key").toDF(*names)
