"""Removal of repeated 100-byte strings by a common-prefix-aware distributed merge sort.

A byte goes if a ``LENGTH``-byte string that covers it also starts earlier (smaller id, or
earlier in the same text). Sorting every suffix is not needed: each ``LENGTH``-byte window
is owned by its least hashed ``GRAM``-byte string (its anchor), a choice that depends on the
window's bytes alone, so equal windows have equal anchors at equal offsets.

1. Every task lists its texts' anchors, at most two owners per anchor hash; one exchange
   finds the hashes that more than one place holds (a sieve of bounded size names them).
2. Every task sorts the suffixes that start at such anchors, front-codes them (bytes after
   the prefix shared with the previous one) and sends them as sorted runs.
3. Every receiving task merges its runs with a loser tree that keeps each candidate's
   common prefix with the last output, so known prefixes are never compared again. The
   merged common prefixes and a rolling hash of the bytes before the anchors give,
   per offset, the classes of equal windows; all but a class's first window go.
4. The spans return to the texts that have some; other texts are settled by their hash.

An anchor held by more than ``HOT`` places is not merged in one task: its windows are
hashed one by one, reduced to the first one in each task, and settled by one exchange.

Defined results: a null text is empty; equal texts with a larger id are removed whole (from
``LENGTH`` bytes on); null ids come after all others; rows that repeat id and text are one
document and get equal answers; rows that share only the id are ordered by text hash; an
empty table gives an empty result; only id and text are read. Equality of texts, anchors and
bytes before an anchor is decided by 64-bit hashes (128 bits for whole texts).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import BYTE_CODE, map_arrow, materialize, mix, powers, prefix_hash, slices, utf8

LENGTH, GRAM = 100, 24
LEFT = LENGTH - GRAM                   # bytes before an anchor that a window can hold
TASK_BYTES = 16 << 20                  # texts' bytes behind one part of the anchor exchange
RUN_BYTES = 3 << 20                    # contexts of one merge task
FLUSH = 40_000                         # contexts sorted as one run
HELD = 300_000                         # anchors reduced and sent together
HOT = 100_000                          # places of one anchor that one merge task takes
SLICE = 256 << 10                      # texts' bytes hashed at once
SIEVE_BITS, PROBES = (16, 27), 4
LAST = (1 << 63) - 1                   # stands for a null id in the order


def row_key() -> Column:
    return F.xxhash64("text", F.length("text"))


def anchors(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(position, row, hash) of the anchors of all windows that lie inside one row."""
    n, w = len(data), LENGTH - GRAM + 1
    if n < LENGTH:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    s, down = prefix_hash(data), powers(n + 1)[1]
    grams = mix((s[GRAM:] - s[:-GRAM]) * down[: n - GRAM + 1])
    inside = np.zeros(n - LENGTH + 1, bool)
    for a, b in zip(off[:-1], off[1:]):
        inside[a: max(a, b - LENGTH + 1)] = True
    marked, step, low = np.zeros(n, bool), 1 << 23, np.uint64((1 << 24) - 1)
    for c in range(0, len(inside), step):              # positions of a piece fit in 24 bits
        part = grams[c: c + step + w - 1]
        cur, width = (part & ~low) | np.arange(len(part), dtype=np.uint64), 1
        while width * 2 <= w:
            cur, width = np.minimum(cur[:-width], cur[width:]), width * 2
        m = len(part) - w + 1
        least = np.minimum(cur[:m], cur[w - width: w - width + m])[inside[c: c + step]]
        marked[(least & low).astype(np.int64) + c] = True
    pos = np.flatnonzero(marked)
    return pos, np.searchsorted(off, pos, side="right") - 1, grams[pos]


def _pack(part: np.ndarray, arrays: list[np.ndarray], names: list[str], parts: int) -> pa.RecordBatch:
    """Arrays sorted by part as one row of packed columns per part."""
    cut = np.searchsorted(part, np.arange(parts + 1))
    have = np.flatnonzero(np.diff(cut))
    cols = [pa.array(have.astype(np.int32))]
    cols += [pa.array([x[cut[i]: cut[i + 1]].tobytes() for i in have], pa.binary()) for x in arrays]
    return pa.RecordBatch.from_arrays(cols, ["part", *names])


# --- 1. anchors in more than one place -----------------------------------------

def shared_anchors(docs: DataFrame, parts: int) -> DataFrame:
    """``h, n``: anchor hashes of more than one place, and how many places hold them."""
    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[tuple] = []

        def reduced(rows):
            h, t, n = (np.concatenate(x) for x in zip(*rows))
            order = np.lexsort((t, h))
            h, t, n = h[order], t[order], n[order]
            first = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
            last = np.append(first[1:], len(h)) - 1
            total = np.add.reduceat(n, first)
            two = t[first] != t[last]
            return (np.concatenate([h[first], h[first][two]]), np.concatenate([t[first], t[last][two]]),
                    np.concatenate([total, np.zeros(two.sum(), np.int64)]))

        def emit(rows):
            h, t, n = reduced(rows)
            order = np.argsort(h)
            h, t, n = h[order], t[order], n[order]
            part = ((h >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
            return _pack(part, [h, t, n.astype(np.int32)], ["h", "t", "n"], parts)

        held = 0
        for b in slices(batches, max_bytes=SLICE):
            pos, row, h = anchors(*utf8(b.column(1)))
            if not len(pos):
                continue
            text = np.asarray(b.column(0))[row]
            order = np.lexsort((h, row))
            h, row, text = h[order], row[order], text[order]
            again = np.append(False, (h[1:] == h[:-1]) & (row[1:] == row[:-1]))
            kept.append((h, np.where(again, ~text, text), np.ones(len(h), np.int64)))   # a text's second place counts as another
            held += len(h)
            if held > HELD:
                yield emit(kept)
                kept, held = [], 0
        if kept:
            yield emit(kept)

    def settle(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [[np.frombuffer(x.as_py(), kind) for x in b.column(c)]
                for b in batches for c, kind in (("h", np.uint64), ("t", np.int64), ("n", np.int32))]
        h, t, n = (np.concatenate([x for part in rows[i::3] for x in part]) for i in range(3))
        order = np.argsort(h)
        h, t, n = h[order], t[order], n[order]
        first = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
        many = np.minimum.reduceat(t, first) != np.maximum.reduceat(t, first)
        yield pa.RecordBatch.from_arrays([pa.array(h[first][many].view(np.int64)),
                                          pa.array(np.add.reduceat(n.astype(np.int64), first)[many])], ["h", "n"])

    packed = map_arrow(docs.select(row_key().alias("key"), "text"), collect, "part int, h binary, t binary, n binary")
    return materialize(packed.groupBy("part").applyInArrow(settle, "h long, n long"), "suffix-shared")


def probe(h: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    for i in range(PROBES):
        yield (mix(h + np.uint64(i + 1)) >> np.uint64(64 - bits)).astype(np.int64)


def sieve(shared: DataFrame, count: int) -> np.ndarray:
    """A Bloom filter of the shared anchors, at most 2**27 bits. It is put together from slices
    on the executors; false hits only send a context that meets no equal one."""
    bits = int(np.clip(int(10 * count).bit_length(), *SIEVE_BITS))
    size = min(1 << bits, 1 << 17)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = np.zeros(1 << bits, bool)
        for b in batches:
            for at in probe(np.asarray(b.column(0)).view(np.uint64), bits):
                mine[at] = True
        for i in np.flatnonzero(mine.reshape(-1, size).any(axis=1)):
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([np.packbits(mine[i * size: (i + 1) * size]).tobytes()])],
                                             ["slice", "bits"])

    def unite(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = np.zeros(size // 8, np.uint8)
        for b in batches:
            for x in b.column("bits"):
                whole |= np.frombuffer(x.as_py(), np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([whole.tobytes()])], ["slice", "bits"])

    out = np.zeros((1 << bits) // 8, np.uint8)
    rows = (map_arrow(shared.select("h"), fill, "slice int, bits binary").groupBy("slice")
            .applyInArrow(unite, "slice int, bits binary").collect())
    for r in rows:
        out[r.slice * size // 8: (r.slice + 1) * size // 8] = np.frombuffer(r.bits, np.uint8)
    return out


def in_sieve(filter_: np.ndarray, h: np.ndarray) -> np.ndarray:
    bits, hit = (len(filter_) * 8).bit_length() - 1, np.ones(len(h), bool)
    for at in probe(h, bits):
        hit &= (filter_[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)
    return hit


# --- 2. front-coded sorted runs ---------------------------------------------------

class Contexts:
    """Suffixes at anchors (``right``, up to LENGTH bytes), the bytes before them (``left``,
    nearest first, up to LEFT) and where they stand."""
    FIELDS = ("right", "rlen", "left", "llen", "doc", "key", "start")

    def __init__(self, *columns: np.ndarray):
        for name, c in zip(self.FIELDS, columns):
            setattr(self, name, c)

    def __len__(self) -> int:
        return len(self.doc)

    def take(self, at) -> Contexts:
        return Contexts(*(getattr(self, f)[at] for f in self.FIELDS))

    @classmethod
    def concat(cls, many: list[Contexts]) -> Contexts:
        return cls(*(np.concatenate([getattr(c, f) for c in many]) for f in cls.FIELDS))

    @classmethod
    def cut(cls, data, off, pos, row, doc, key) -> Contexts:
        padded = np.concatenate([np.zeros(LEFT, np.uint8), data, np.zeros(LENGTH, np.uint8)])
        rlen = np.minimum(LENGTH, off[row + 1] - pos)
        llen = np.minimum(LEFT, pos - off[row])
        view = np.lib.stride_tricks.sliding_window_view
        right = np.where(np.arange(LENGTH) < rlen[:, None], view(padded, LENGTH)[pos + LEFT], 0).astype(np.uint8)
        left = np.where(np.arange(LEFT) < llen[:, None], view(padded, LEFT)[pos][:, ::-1], 0).astype(np.uint8)
        return cls(right, rlen.astype(np.uint8), left, llen.astype(np.uint8), doc[row], key[row], pos - off[row])

    def suffix_order(self) -> np.ndarray:
        words = np.zeros((len(self), -(-LENGTH // 8) * 8), np.uint8)
        words[:, :LENGTH] = self.right
        return np.lexsort((self.rlen, *words.view(">u8").T[::-1]))


def common_prefix(c: Contexts) -> np.ndarray:
    """Of each suffix with the one before it (0 for the first)."""
    differ = c.right[1:] != c.right[:-1]
    at = np.where(differ.any(axis=1), differ.argmax(axis=1), LENGTH)
    return np.append(0, np.minimum(at, np.minimum(c.rlen[1:], c.rlen[:-1]))).astype(np.uint8)[: len(c)]


RUN_COLUMNS = "lcp binary, rlen binary, rest binary, llen binary, lefts binary, doc binary, key binary, start binary"


def encode_run(c: Contexts) -> list[bytes]:
    lcp, k = common_prefix(c), np.arange(LENGTH)
    return [lcp.tobytes(), c.rlen.tobytes(), c.right[(k >= lcp[:, None]) & (k < c.rlen[:, None])].tobytes(),
            c.llen.tobytes(), c.left[np.arange(LEFT) < c.llen[:, None]].tobytes(),
            c.doc.tobytes(), c.key.tobytes(), c.start.tobytes()]


def decode_run(cols: list[bytes]) -> tuple[np.ndarray, list[bytes], Contexts]:
    """Common prefixes, suffixes as bytes, and the contexts of one run."""
    lcp, rlen, llen = (np.frombuffer(cols[i], np.uint8) for i in (0, 1, 3))
    size = rlen.astype(np.int64) - lcp
    end, prev, suffixes = np.cumsum(size).tolist(), b"", []
    for shared, a, b in zip(lcp.tolist(), [0, *end[:-1]], end):
        prev = prev[:shared] + cols[2][a:b]
        suffixes.append(prev)
    m = len(lcp)
    right, left = np.zeros((m, LENGTH), np.uint8), np.zeros((m, LEFT), np.uint8)
    right[np.arange(LENGTH) < rlen[:, None]] = np.frombuffer(b"".join(suffixes), np.uint8)
    left[np.arange(LEFT) < llen[:, None]] = np.frombuffer(cols[4], np.uint8)
    where = (np.frombuffer(x, np.int64) for x in cols[5:])
    return lcp, suffixes, Contexts(right, rlen, left, llen, *where)


def runs(docs: DataFrame, filter_: np.ndarray, hot: np.ndarray, parts: int) -> DataFrame:
    """One row per sorted run and part. Of equal contexts in a task only the first goes out;
    the others' whole reach is already known to repeat and is sent as a span
    (``part`` null)."""
    names = ["part", "doc", "key", "lo", "hi", *[x.split()[0] for x in RUN_COLUMNS.replace("doc ", "docs ").replace("key ", "keys ").split(", ")]]

    def spans(c: Contexts) -> pa.RecordBatch:
        n = len(c)
        lo, hi = c.start - c.llen, c.start + c.rlen
        return pa.RecordBatch.from_arrays([pa.nulls(n, pa.int32()), pa.array(c.doc), pa.array(c.key), pa.array(lo), pa.array(hi),
                                           *[pa.nulls(n, pa.binary())] * 8], names)

    def emit(held: list) -> Iterator[pa.RecordBatch]:
        c, h = Contexts.concat([x for x, _ in held]), np.concatenate([y for _, y in held])
        order = np.lexsort((c.start, c.key, c.doc))
        c, h = c.take(order), h[order]
        whole = np.concatenate([c.right, c.left, c.rlen[:, None], c.llen[:, None]], axis=1)
        _, first, which = np.unique(np.ascontiguousarray(whole).view(f"V{whole.shape[1]}").ravel(), return_index=True, return_inverse=True)
        lead = c.take(first)
        later = (c.doc != lead.doc[which]) | (c.key != lead.key[which]) | (c.start != lead.start[which])
        full = later & (c.llen.astype(int) + c.rlen >= LENGTH)
        if full.any():
            yield spans(c.take(full))
        c, h = lead, h[first]
        part = ((h >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
        for p in np.unique(part):
            mine = c.take(part == p)
            mine = mine.take(mine.suffix_order())
            yield pa.RecordBatch.from_arrays(
                [pa.array([p], pa.int32()), *[pa.nulls(1, pa.int64())] * 4, *[pa.array([x], pa.binary()) for x in encode_run(mine)]], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in slices(batches, max_bytes=SLICE):
            data, off = utf8(b.column(2))
            pos, row, h = anchors(data, off)
            ok = in_sieve(filter_, h)
            if len(hot):
                ok &= ~np.isin(h, hot)
            if not ok.any():
                continue
            doc, key = np.asarray(b.column(0)), np.asarray(b.column(1))
            held.append((Contexts.cut(data, off, pos[ok], row[ok], doc, key), h[ok]))
            size += int(ok.sum())
            if size > FLUSH:
                yield from emit(held)
                held, size = [], 0
        if held:
            yield from emit(held)

    rows = docs.select(F.coalesce("doc_id", F.lit(LAST)).cast("long").alias("doc"), row_key().alias("key"), "text")
    schema = "part int, doc long, key long, lo long, hi long, " + RUN_COLUMNS.replace("doc ", "docs ").replace("key ", "keys ")
    return map_arrow(rows, run, schema)


# --- 3. merging with common prefixes ------------------------------------------------

def _mismatch(a: bytes, b: bytes, known: int) -> int:
    """Length of the common prefix, the first ``known`` bytes of which are known."""
    x, y = a[known:], b[known:]
    if x == y:
        return len(a)
    n = min(len(x), len(y))
    x, y = x[:n], y[:n]
    if x == y:
        return known + n
    return known + n - ((int.from_bytes(x, "big") ^ int.from_bytes(y, "big")).bit_length() + 7 >> 3)


def merge(lcps: list[list[int]], strings: list[list[bytes]]) -> tuple[list[int], list[int], list[int]]:
    """Loser-tree merge of sorted runs given their common prefixes. Returns, per output,
    its run, its place in the run, and its common prefix with the output before.

    A player is (suffix, common prefix with the last output). Of two players the one
    with the longer common prefix is smaller without looking at any byte; only for
    equal ones the bytes behind it are compared, and the loser keeps the new length."""
    k = 1 << max(0, (len(strings) - 1).bit_length())
    place = [0] * len(strings)
    end = b"\xff" * (LENGTH + 1)                     # greater than any suffix
    head = [(s[0] if s else end) for s in strings] + [end] * (k - len(strings))
    shared = [0] * k
    tree = [0] * k                                   # tree[i]: the loser at node i

    def play(a: int, b: int) -> tuple[int, int]:
        """(winner, loser); ties go to the first run."""
        if shared[a] != shared[b]:
            return (a, b) if shared[a] > shared[b] else (b, a)
        x, y = head[a], head[b]
        at = _mismatch(x, y, shared[a])
        if x[at: at + 1] < y[at: at + 1] or x[at: at + 1] == y[at: at + 1] and a < b:
            shared[b] = at
            return a, b
        shared[a] = at
        return b, a

    winners = list(range(k)) if k > 1 else [0]
    level = winners
    base = k
    while len(level) > 1:
        base //= 2
        nxt = []
        for i in range(0, len(level), 2):
            w, l = play(level[i], level[i + 1])
            tree[base + i // 2] = l
            nxt.append(w)
        level = nxt
    win = level[0]
    out_run, out_place, out_lcp = [], [], []
    total = sum(map(len, strings))
    for _ in range(total):
        p = place[win]
        out_run.append(win)
        out_place.append(p)
        out_lcp.append(shared[win])
        place[win] = p = p + 1
        if p < len(strings[win]):
            head[win], shared[win] = strings[win][p], lcps[win][p]
        else:
            head[win], shared[win] = end, 0
        node = (win + k) >> 1
        while node:
            l = tree[node]
            if shared[l] > shared[win]:
                win, tree[node] = l, win
            elif shared[l] == shared[win]:
                win, tree[node] = play(win, l) if win < l else play(l, win)
            node >>= 1
    return out_run, out_place, out_lcp


def repeated_spans(c: Contexts, lcp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index, lo, hi) of the contexts, in merged order, some of whose windows are not their
    class's first. Two windows around one anchor overlap, so their union is one span."""
    n = len(c)
    _, rank = np.unique(np.stack([c.doc, c.key, c.start], axis=1), axis=0, return_inverse=True)
    rank = rank.ravel()
    low, high = np.full(n, LENGTH), np.full(n, -1)
    hashed = np.zeros(n, np.uint64)
    for r in range(LEFT + 1):
        if r:
            hashed = mix(hashed * np.uint64(0xD6E8FEB86659FD93) + BYTE_CODE[c.left[:, r - 1]])
        same = lcp >= LENGTH - r
        some = same.copy()
        some[:-1] |= same[1:]
        some &= (c.llen >= r) & (c.rlen >= LENGTH - r)
        at = np.flatnonzero(some)
        if not len(at):
            continue
        group = np.cumsum(~same)[at]
        order = np.lexsort((rank[at], hashed[at], group))
        at = at[order]
        new = np.append(True, (group[order][1:] != group[order][:-1]) | (hashed[at][1:] != hashed[at][:-1]))
        first = rank[at][np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))]
        later = at[rank[at] > first]
        low[later] = np.minimum(low[later], r)
        high[later] = np.maximum(high[later], r)
    got = np.flatnonzero(high >= 0)
    return got, c.start[got] - high[got], c.start[got] - low[got] + LENGTH


def merged_spans(packed: DataFrame) -> DataFrame:
    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = []
        for b in batches:
            cols = [b.column(x.split()[0]) for x in RUN_COLUMNS.replace("doc ", "docs ").replace("key ", "keys ").split(", ")]
            parts += [decode_run([x[i].as_py() for x in cols]) for i in range(b.num_rows)]
        run_, place, lcp = merge([p[0].tolist() for p in parts], [p[1] for p in parts])
        first = np.concatenate([[0], np.cumsum([len(p[2]) for p in parts])])
        found = [p[2] for p in parts]
        del parts                                       # the suffixes as bytes are no longer needed
        c = Contexts.concat(found)
        del found
        c = c.take(first[np.array(run_, np.int64)] + np.array(place, np.int64))
        at, lo, hi = repeated_spans(c, np.array(lcp, np.uint8))
        yield pa.RecordBatch.from_arrays([pa.array(c.doc[at]), pa.array(c.key[at]), pa.array(lo), pa.array(hi)],
                                         ["doc", "key", "lo", "hi"])

    return packed.groupBy("part").applyInArrow(run, "doc long, key long, lo long, hi long")


def hot_spans(docs: DataFrame, hot: np.ndarray) -> DataFrame:
    """Windows around hot anchors, settled by their own hash: a task sends each distinct
    window once (its first place; later places are spans at once), so an exchange
    meets a window at most once per task."""
    from pyspark.sql.window import Window

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            data, off = utf8(b.column(2))
            pos, row, h = anchors(data, off)
            ok = np.isin(h, hot)
            pos, row = pos[ok], row[ok]
            if not len(pos):
                continue
            start = (pos[:, None] - np.arange(LEFT + 1)).ravel()
            row = np.repeat(row, LEFT + 1)
            ok = (start >= off[row]) & (start + LENGTH <= off[row + 1])
            start, row = start[ok], row[ok]
            s, down = prefix_hash(data), powers(len(data) + 1)[1]
            w = mix((s[start + LENGTH] - s[start]) * down[start])
            doc, key = np.asarray(b.column(0))[row], np.asarray(b.column(1))[row]
            at = start - off[row]
            order = np.lexsort((at, key, doc, w))
            w, doc, key, at = w[order], doc[order], key[order], at[order]
            new = np.append(True, w[1:] != w[:-1])
            lead = np.maximum.accumulate(np.where(new, np.arange(len(w)), 0))
            later = (doc != doc[lead]) | (key != key[lead]) | (at != at[lead])
            keep = new | later
            yield pa.RecordBatch.from_arrays(
                [pa.array(w.view(np.int64)[keep]), pa.array(later[keep]), pa.array(doc[keep]), pa.array(key[keep]), pa.array(at[keep])],
                ["w", "later", "doc", "key", "lo"])

    rows = docs.select(F.coalesce("doc_id", F.lit(LAST)).cast("long").alias("doc"), row_key().alias("key"), "text")
    found = map_arrow(rows, run, "w long, later boolean, doc long, key long, lo long")
    place = F.struct("doc", "key", "lo")
    leads = found.filter("not later").withColumn("least", F.min(place).over(Window.partitionBy("w")))
    again = found.filter("later").unionByName(leads.filter(place > F.col("least")).drop("least"))
    return again.select("doc", "key", "lo", (F.col("lo") + LENGTH).alias("hi"))


# --- 4. results ---------------------------------------------------------------------

def find_spans(docs: DataFrame, total_bytes: int) -> DataFrame:
    """``doc, key, lo, hi``: byte ranges to remove (they may overlap; exact copies of whole
    texts are only partly covered)."""
    shared = shared_anchors(docs, max(8, -(-total_bytes // TASK_BYTES)))
    count, places = shared.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    hot = np.array(sorted(r.h for r in shared.filter(F.col("n") > HOT).select("h").collect()), np.int64).view(np.uint64)
    filter_ = sieve(shared, count)
    out = materialize(runs(docs, filter_, hot, max(8, -(-places * 200 // RUN_BYTES))), "suffix-runs")
    spans = out.filter("part is null").select("doc", "key", "lo", "hi")
    spans = spans.unionByName(merged_spans(out.filter("part is not null").drop("doc", "key", "lo", "hi")))
    if len(hot):
        spans = spans.unionByName(hot_spans(docs, hot))
    return spans


def union_spans(spans: list) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for lo, hi in spans:
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return out


def remove_repeats(docs: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans`` per input row; ``spans`` are
    the maximal removed byte ranges."""
    whole = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    order = F.coalesce("doc_id", F.lit(LAST)).cast("long")
    facts = materialize(docs.select("doc_id", order.alias("doc"), row_key().alias("key"),
                                    F.octet_length(whole).cast("long").alias("n_bytes"), F.xxhash64(F.lit(1), "text").alias("key2"),
                                    F.sha2(whole, 256).alias("sha")), "suffix-facts")
    total = facts.agg(F.sum("n_bytes")).first()[0] or 0
    firsts = facts.groupBy("key", "key2", "n_bytes").agg(F.min("doc").alias("first_doc"))
    facts = facts.join(firsts, ["key", "key2", "n_bytes"]).withColumn(
        "copy", (F.col("doc") > F.col("first_doc")) & (F.col("n_bytes") >= LENGTH)).drop("first_doc", "key2")
    spans = materialize(find_spans(docs, total).groupBy("doc", "key").agg(
        F.sort_array(F.collect_set(F.struct("lo", "hi"))).alias("spans")), "suffix-spans")
    spans = spans.join(facts.filter("copy").select("doc", "key").distinct(), ["doc", "key"], "left_anti")

    bits = 20
    slot = lambda: F.pmod(F.xxhash64("doc", "key"), F.lit(1 << bits)).cast("int")
    wanted = np.zeros(1 << bits, bool)
    wanted[[r[0] for r in spans.select(slot().alias("s")).distinct().collect()]] = True

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(wanted[np.asarray(b.column(3))])).select(["doc", "key", "text"])

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            rows = []
            for doc, key, text, found in zip(*(c.to_pylist() for c in b.columns)):
                data, cut = text.encode(), union_spans([(s["lo"], s["hi"]) for s in found])
                keep, at = [], 0
                for lo, hi in cut:
                    keep.append(data[at:lo])
                    at = hi
                rows.append({"doc": doc, "key": key, "removed": sum(hi - lo for lo, hi in cut),
                             "sha_kept": hashlib.sha256(b"".join([*keep, data[at:]])).hexdigest(),
                             "cut": [{"lo": lo, "hi": hi} for lo, hi in cut]})
            span = pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("doc", pa.int64()), ("key", pa.int64()), ("removed", pa.int64()),
                                                              ("sha_kept", pa.string()), ("cut", span)]))

    texts = map_arrow(docs.select(order.alias("doc"), row_key().alias("key"), "text").withColumn("slot", slot()), pick,
                      "doc long, key long, text string")
    cut = map_arrow(texts.join(spans, ["doc", "key"]).select("doc", "key", "text", "spans"), settle,
                    "doc long, key long, removed long, sha_kept string, cut array<struct<lo:long,hi:long>>").dropDuplicates(["doc", "key"])
    empty = hashlib.sha256(b"").hexdigest()
    return facts.join(cut, ["doc", "key"], "left").select(
        "doc_id", "n_bytes", F.when(F.col("copy"), F.col("n_bytes")).otherwise(F.coalesce("removed", F.lit(0))).alias("n_removed"),
        F.when(F.col("copy"), 1).otherwise(F.greatest(F.size("cut"), F.lit(0))).cast("long").alias("n_spans"),
        F.when(F.col("copy"), F.lit(empty)).otherwise(F.coalesce("sha_kept", "sha")).alias("kept_sha256"),
        F.when(F.col("copy"), F.array(F.struct(F.lit(0).cast("long").alias("lo"), F.col("n_bytes").alias("hi")))).otherwise(
            F.coalesce("cut", F.array())).alias("spans"))
