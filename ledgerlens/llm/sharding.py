"""Sharding by histogram sort.

Documents are ordered by (text hash, id hash, row hash), which keeps equal texts next
to each other. Splitters of the wanted byte quantiles are found by counting: each
round sums the exact bytes of a few thousand candidate ranges over all partitions,
then only the ranges that hold an unresolved splitter are cut finer. A boundary
inside one hash value (a large group of equal texts) is resolved on the next key
column. When every splitter is within tolerance, the rows are exchanged once.

Law: ``bytes``, sizes near equal. Defined results: a null text has no bytes and
checksum 0; null ids and repeated rows are rows like others and are spread by the row
hash; an empty table gives an empty result; input columns travel in a struct, so
none can clash.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerlens.llm.common import materialize

KEYS = ("k1", "k2", "k3")
KEY_BITS = 63
PROBE_BITS = 10                 # candidate ranges per unresolved splitter and round: 2**10
TOLERANCE = 0.001               # of one shard's bytes
BIN_BYTES = 16 << 20            # rows of a shard are numbered in bins of about this size


def _hash63(*cols: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(*cols), 1)


def keyed(docs: DataFrame) -> DataFrame:
    """``row`` (struct of the input), its size and the three sort keys."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    text, size = F.col("text"), (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long")
    return docs.select(row, size.alias("size"), _hash63(text, F.length(text)).alias("k1"),
                       _hash63(F.col("doc_id")).alias("k2"),
                       _hash63(F.col("doc_id"), F.monotonically_increasing_id()).alias("k3"))


@dataclass(frozen=True)
class Range:
    """Rows whose first keys equal ``fixed`` and whose next key is in [lo, lo + 2**bits)."""
    fixed: tuple[int, ...]
    lo: int
    bits: int

    def where(self) -> Column:
        k = F.col(KEYS[len(self.fixed)])
        cond = (k >= F.lit(self.lo)) & (k <= F.lit(self.lo + (1 << self.bits) - 1))
        for name, v in zip(KEYS, self.fixed):
            cond &= F.col(name) == F.lit(v)
        return cond

    def part(self) -> Column:
        shift = max(0, self.bits - PROBE_BITS)
        return F.shiftright(F.col(KEYS[len(self.fixed)]) - F.lit(self.lo), shift)


def _histogram(keys: DataFrame, ranges: list[Range]) -> dict[int, list]:
    """Per range its non-empty candidate parts in key order: exact bytes, rows, and the
    least and greatest key. At most ``len(ranges) * 2**PROBE_BITS`` rows reach the driver."""
    which, part, key = F.lit(None).cast("int"), F.lit(None).cast("long"), F.lit(None).cast("long")
    for i, r in enumerate(ranges):
        which = F.when(r.where(), F.lit(i)).otherwise(which)
        part = F.when(r.where(), r.part()).otherwise(part)
        key = F.when(r.where(), F.col(KEYS[len(r.fixed)])).otherwise(key)
    got = (keys.select(which.alias("r"), part.alias("p"), key.alias("k"), "size").filter("r is not null")
           .groupBy("r", "p").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"),
                                  F.min("k").alias("least"), F.max("k").alias("most")).collect())
    parts: dict[int, list] = {}
    for x in sorted(got):
        parts.setdefault(x.r, []).append(x)
    return parts


def find_splitters(keys: DataFrame, n_shards: int, tolerance: float = TOLERANCE) -> list[tuple[int, ...]]:
    """The ``n_shards - 1`` lower key bounds of shards 1, 2, ... (a bound may name only
    the first keys)."""
    total = keys.agg(F.sum("size")).first()[0] or 0
    slack = tolerance * total / n_shards
    open_: dict[int, tuple[Range, int]] = {t: (Range((), 0, KEY_BITS), 0) for t in range(1, n_shards)}
    found: dict[int, tuple[int, ...]] = {}
    while open_ and total:
        ranges = list(dict.fromkeys(r for r, _ in open_.values()))
        parts = _histogram(keys, ranges)
        for t, (r, before) in list(open_.items()):
            want = total * t / n_shards
            for x in parts[ranges.index(r)]:
                if before + x.bytes >= want:
                    break
                before += x.bytes
            low, high = want - before, before + x.bytes - want
            if min(low, high) <= slack or x.n == 1 or x.least == x.most and len(r.fixed) + 1 == len(KEYS):
                found[t] = (*r.fixed, x.least if low <= high else x.most + 1)
                del open_[t]
            elif x.least == x.most:
                open_[t] = (Range((*r.fixed, x.least), 0, KEY_BITS), before)
            else:
                open_[t] = (Range(r.fixed, x.least, (x.most - x.least).bit_length()), before)
    return [found.get(t, ()) for t in range(1, n_shards)]


def _at_or_above(bound: tuple[int, ...]) -> Column:
    """Whether the row's keys are at or above ``bound`` in lexicographic order."""
    cond = F.lit(True)
    for name, v in reversed(list(zip(KEYS, bound))):
        k, v = F.col(name), F.lit(min(v, (1 << 63) - 1)).cast("long")
        cond = (k > v) | ((k == v) & cond)
    return cond


def assign(rows: DataFrame, splitters: list[tuple[int, ...]]) -> Column:
    return sum((F.when(_at_or_above(b), 1).otherwise(0) for b in splitters if b), F.lit(0)).cast("int")


def shard(docs: DataFrame, n_shards: int = 24, tolerance: float = TOLERANCE,
          bin_bytes: int = BIN_BYTES) -> DataFrame:
    """``row, size, shard, bin, rank``: every input row in its shard after one exchange.
    A shard is numbered in bins by row hash, so no task holds a whole large shard."""
    rows = keyed(docs)
    keys = materialize(rows.select("size", *KEYS), "shard-keys")
    splitters = find_splitters(keys, n_shards, tolerance)
    total = keys.agg(F.sum("size")).first()[0] or 0
    bins = max(1, -(-total // n_shards // bin_bytes))
    placed = rows.withColumn("shard", assign(rows, splitters)).withColumn(
        "bin", F.pmod(F.col("k3"), F.lit(bins)).cast("int"))
    order = Window.partitionBy("shard", "bin").orderBy(*KEYS)
    return placed.select("row", "size", "shard", "bin", (F.row_number().over(order) - 1).cast("long").alias("rank"))


def number_slots(digest: DataFrame) -> DataFrame:
    """Turns ``shard, bin, rank`` of a materialised digest into a gapless ``slot``:
    the bins' row counts (a few numbers per bin) are summed up within each shard."""
    sizes = digest.groupBy("shard", "bin").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("shard", "bin", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    return (digest.join(offsets, ["shard", "bin"]).withColumn("slot", F.col("first") + F.col("rank"))
            .drop("first", "bin", "rank"))


def write_shards(docs: DataFrame, path: str, n_shards: int = 24) -> None:
    """The shards as Parquet folders ``shard=0 ..`` with the input's columns."""
    placed = shard(docs, n_shards)
    placed.select("row.*", F.col("shard").alias("_shard")).write.partitionBy("_shard").parquet(path)
