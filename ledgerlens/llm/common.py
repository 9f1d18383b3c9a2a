"""Shared helpers of the training-data operators: table reading, shared scratch
tables, Arrow batch slicing and vectorised word hashing on UTF-8 buffers."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder that every executor reaches: under ``spark.checkpoint.dir``
    of the session, or under the session's warehouse where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/llm_scratch/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts the
    lineage and survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once per row and hand it to ``body`` as a bound variable
    (a plain reference inside a lambda would be evaluated for every element)."""
    return F.transform(F.array(value), body)[0]


# --- Arrow batches -----------------------------------------------------------

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


BATCH_ROWS = 2000        # rows of one Arrow batch, which is held in memory on both sides


def map_arrow(df: DataFrame, fn: Callable, schema: str) -> DataFrame:
    """``mapInArrow`` whose Python workers find this package also where it is not
    installed but only on the driver's path (a cluster ships it with --py-files)."""
    conf = df.sparkSession.conf
    if int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))    # whole texts are large rows
    env = df.sparkSession.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, ROOT])
    return df.mapInArrow(fn, schema)


def slices(batches: Iterator[pa.RecordBatch], column: str = "text",
           max_bytes: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches so that one slice holds about ``max_bytes`` of ``column``; a
    single larger text makes a slice of its own."""
    for b in batches:
        if b.num_rows == 0:
            continue
        n = np.asarray(pc.binary_length(b.column(column)).fill_null(0)).astype(np.int64)
        total, start = np.concatenate([[0], np.cumsum(n)]), 0
        while start < b.num_rows:
            stop = int(np.searchsorted(total, total[start] + max_bytes, side="right")) - 1
            stop = min(max(stop, start + 1), b.num_rows)
            yield b.slice(start, stop - start)
            start = stop


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The column's bytes as one buffer and each row's offsets; nulls are empty."""
    column = column.fill_null("").cast(pa.large_string())
    off = np.frombuffer(column.buffers()[1], np.int64)[column.offset: column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data[off[0]: off[-1]], (off - off[0]).astype(np.int64)


# --- words -------------------------------------------------------------------

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A"): ord("Z") + 1] += 32

PUNCTUATION = np.zeros(256, bool)             # ASCII signs
PUNCTUATION[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = True

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE = 0x9E3779B97F4A7C15 | 5
_INV = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


BYTE_CODE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_POW: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i mod 2**64 for i < n, kept for the next call."""
    if len(_POW["up"]) < n:
        m = 1 << (n - 1).bit_length()
        for key, base in (("up", _BASE), ("down", _INV)):
            x = np.full(m, base, np.uint64)
            x[0] = 1
            _POW[key] = np.cumprod(x)
    return _POW["up"][:n], _POW["down"][:n]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Running polynomial sums; the hash of bytes a..b-1 is (s[b]-s[a])*base**-a."""
    up, _ = powers(len(data) + 1)
    s = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_CODE[data] * up[: len(data)], out=s[1:])
    return s


class Words:
    """ASCII-space separated words of a slice of texts: their byte bounds,
    owning row and 64-bit hash (A-Z folded when ``lower``)."""

    def __init__(self, column: pa.Array, lower: bool, drop: np.ndarray | None = None):
        data, off = utf8(column)
        if drop is not None:                  # bytes to leave out before words are taken
            keep = ~drop[data]
            data, off = data[keep], np.concatenate([[0], np.cumsum(keep)])[off]
        self.data, self.offsets, n = data, off, len(data)
        solid = np.zeros(n + 1, bool)
        solid[:n] = ~SPACE[data]
        head = np.zeros(n + 1, bool)
        head[off] = True                      # a word never crosses two rows
        starts = solid.copy()
        starts[1:] &= ~solid[:-1] | head[1:]
        last = solid[:n].copy()
        last &= ~solid[1:] | head[1:]
        self.start, self.end = np.flatnonzero(starts), np.flatnonzero(last) + 1
        self.first = np.searchsorted(self.start, off)      # each row's first word, and the end
        self.count = np.diff(self.first)
        self.row = np.repeat(np.arange(len(off) - 1), self.count)
        s = prefix_hash(LOWER[data] if lower else data)
        down = powers(n + 1)[1]
        self.hash = mix((s[self.end] - s[self.start]) * down[self.start]
                        + (self.end - self.start).astype(np.uint64))

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all k-word windows inside one row, and their first word's index."""
        m = len(self.hash) - k + 1
        if m <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        h = np.zeros(m, np.uint64)
        for j in range(k):
            h = mix(h * np.uint64(0xD6E8FEB86659FD93) + self.hash[j: j + m])
        at = np.flatnonzero(self.row[:m] == self.row[k - 1:])
        return h[at], at
