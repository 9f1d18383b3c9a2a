"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

Words are compared without ASCII signs and case; in scripts written without spaces every
character is a word. Every ``SEED``-word window of a test
item is a seed. A first pass counts in how many documents each seed occurs; seeds far
more common than their item's others and than the corpus at large are common, the others
rare. In the second pass every seed found in a document names a region around it: the
item's length and, on each side, as many words more as the gap cost lets a leak insert
(``(1 - THRESHOLD) * MATCH / -GAP`` times the item's length where the document holds all its
words). Regions of one item that meet are joined, and each is aligned with the item (match
+1, mismatch and gap -0.1).
Alignment score / item words is the similarity; ``THRESHOLD`` or more is a leak. A document
that shares only common seeds with an item is spared the alignment where it holds too few
of the item's words for a leak, whatever their order: rarity saves work, it decides nothing.

Test items are the stated query set: they are handled in blocks of about ``BLOCK_ITEMS``,
each shipped to all tasks; the corpus is scanned, never shuffled.

Items of two words to ``MIN_ITEM_WORDS - 1`` also occur in ordinary speech: they are leaks
where a whole line of the document consists of their words.

Defined results: a null or empty text is clean; items of one word or none (null ones too) say
nothing and are not searched; repeated rows are judged alike; ties between items go to the smallest id; an item
with a null id is searched like others, counts in ``n_items`` and comes last in ties, its
``item_id`` staying null; an empty corpus gives an empty result, an empty benchmark a clean
one; input columns are carried by position, so none can clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.llm.common import PUNCTUATION, Words, map_arrow, mix, slices, utf8

SEED = 3
THRESHOLD = 0.8
MATCH, MISS, GAP = 10, -1, -1       # in tenths of a word
MIN_ITEM_WORDS = 5
BLOCK_ITEMS = 10_000
COMMON_SHARE = 0.001                # a seed in no more of the documents is rare anyway
COMMON_TIMES = 8                    # times its item's median
SIEVE_BITS = 18
PAIRS, CELLS = 2048, 1 << 18        # alignments computed at once, and words of their regions
HITS = 1 << 20                      # seed hits held at once
NO_ID = np.iinfo(np.int64).max      # stands for a null item id: the last in ties

# Thai and Lao, Myanmar, Khmer, kana, Han: scripts written without spaces
_UNSPACED = (r"([\x{0E00}-\x{0EFF}\x{1000}-\x{109F}\x{1780}-\x{17FF}\x{3040}-\x{30FF}"
             r"\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{20000}-\x{3FFFF}])")
_LEAD = np.zeros(256, bool)         # first bytes of their characters
_LEAD[[0xE0, 0xE1, *range(0xE3, 0xEA), 0xF0]] = True


def item_words(column: pa.Array) -> Words:
    """The words that are compared, of texts and items alike."""
    if _LEAD[utf8(column)[0]].any():
        column = pc.replace_substring_regex(column, _UNSPACED, r" \1 ")
    return Words(column, True, PUNCTUATION)


def short_hash(w: Words) -> np.ndarray:
    """One hash of all words of each row of two to ``MIN_ITEM_WORDS - 1``, 0 for other rows."""
    out = np.zeros(len(w.count), np.uint64)
    for k in range(2, MIN_ITEM_WORDS):
        h, at = w.shingles(k)
        whole = w.count[w.row[at]] == k
        out[w.row[at[whole]]] = mix(h[whole] + np.uint64(k))
    return out


@dataclass(frozen=True)
class Block:
    """Word hashes of some items (flat, with bounds), their seeds sorted by hash, and the
    short items sorted by the hash of all their words. Items are in the order of their ids."""
    item_id: np.ndarray
    words: np.ndarray
    first: np.ndarray
    seed: np.ndarray
    seed_item: np.ndarray
    seed_pos: np.ndarray
    rare: np.ndarray
    short: np.ndarray
    short_item: np.ndarray

    @classmethod
    def of(cls, rows: list) -> Block:
        rows = sorted(((NO_ID if r.item_id is None else r.item_id, r.text) for r in rows if r.text))
        w = item_words(pa.array([text for _, text in rows], pa.string()))
        long_enough = w.count >= MIN_ITEM_WORDS
        h, at = w.shingles(SEED)
        item, pos = w.row[at], at - w.first[w.row[at]]
        ok = long_enough[item]
        order = np.argsort(h[ok], kind="stable")
        whole = short_hash(w)
        brief = np.flatnonzero(whole)[np.argsort(whole[whole > 0], kind="stable")]
        return cls(np.array([i for i, _ in rows], np.int64), w.hash, w.first,
                   h[ok][order], item[ok][order], pos[ok][order], np.ones(len(order), bool), whole[brief], brief)

    def with_rarity(self, df: dict[int, int], n_docs: int) -> Block:
        """The seeds that are rare in the corpus or for their item marked as such."""
        count = np.array([df.get(int(np.int64(x)), 0) for x in self.seed.view(np.int64)], np.int64)
        median = np.zeros(len(self.item_id))
        for i in np.unique(self.seed_item):
            median[i] = np.median(count[self.seed_item == i])
        return replace(self, rare=count <= np.maximum(COMMON_SHARE * n_docs, COMMON_TIMES * median[self.seed_item]))


def _hits(w: Words, block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word index, seed range start and stop (in the block's seed list) of each hit."""
    h, at = w.shingles(SEED)
    maybe = np.zeros(1 << SIEVE_BITS, bool)           # a sieve, so that few windows are searched
    maybe[block.seed >> np.uint64(64 - SIEVE_BITS)] = True
    some = np.flatnonzero(maybe[h >> np.uint64(64 - SIEVE_BITS)])
    lo, hi = (np.searchsorted(block.seed, h[some], side) for side in ("left", "right"))
    found = hi > lo
    return at[some][found], lo[found], hi[found]


def align(regions: np.ndarray, items: np.ndarray) -> np.ndarray:
    """Best local alignment score of each pair of word-hash rows (0 pads items, 1 pads
    regions; pads match nothing). Gaps along a row are closed by a running maximum."""
    n, width = regions.shape
    step = np.arange(width + 1, dtype=np.int32) * -GAP
    prev, best = np.zeros((n, width + 1), np.int32), np.zeros(n, np.int32)
    for i in range(items.shape[1]):
        score = np.where(regions == items[:, i: i + 1], MATCH, MISS).astype(np.int32)
        cur = np.zeros_like(prev)
        np.maximum(prev[:, :-1] + score, prev[:, 1:] + GAP, out=cur[:, 1:])
        np.maximum(cur, 0, out=cur)
        cur = np.maximum.accumulate(cur + step, axis=1) - step
        best = np.maximum(best, cur.max(axis=1))
        prev = cur
    return best


def words_held(w: Words, block: Block, row: np.ndarray, item: np.ndarray) -> np.ndarray:
    """How many words of the item occur anywhere in the row, per pair."""
    held = np.unique(mix(w.hash + mix(w.row.astype(np.uint64))))
    size, out = np.diff(block.first)[item], np.zeros(len(row), np.int64)
    for a in range(0, len(row), PAIRS):
        n = size[a: a + PAIRS]
        pair = np.repeat(np.arange(len(n)), n)
        k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        want = mix(block.words[block.first[item[a: a + PAIRS]][pair] + k] + mix(row[a: a + PAIRS].astype(np.uint64))[pair])
        found = held[np.minimum(np.searchsorted(held, want), len(held) - 1)] == want
        out[a: a + PAIRS] = np.bincount(pair, found, minlength=len(n))
    return out


def _regions(w: Words, block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, item, first word, end) of the regions to align, from the diagonals of all seed
    hits; the diagonal is where the item's first word would stand in the document. Pairs of
    a row and an item without a rare seed stay where the row holds words enough for a leak."""
    at, lo, hi = _hits(w, block)
    n = hi - lo
    total, parts, a = np.cumsum(n), [], 0
    while a < len(n):
        b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + HITS, side="right")))
        m = n[a:b]
        which = np.repeat(lo[a:b] - (np.cumsum(m) - m), m) + np.arange(m.sum())
        pos = np.repeat(at[a:b], m)
        diagonal = (pos - w.first[w.row[pos]] - block.seed_pos[which]) >> 3
        parts.append(np.unique(np.stack([w.row[pos], block.seed_item[which], diagonal, block.rare[which]]), axis=1))
        a = b
    if not parts:
        return (np.zeros(0, np.int64),) * 4
    row, item, diagonal, rare = np.unique(np.concatenate(parts, axis=1), axis=1)
    first = np.append(True, (row[1:] != row[:-1]) | (item[1:] != item[:-1]))
    pair, start = np.cumsum(first) - 1, np.flatnonzero(first)
    m = np.diff(block.first)[item[start]]
    # words a leak can insert: each costs -GAP of what its matches bring above the threshold
    room = np.floor((MATCH * words_held(w, block, row[start], item[start]) - THRESHOLD * MATCH * m) / -GAP + 1e-9)
    ok = (np.maximum.reduceat(rare, start) > 0) | (room >= 0)
    pad = np.maximum(m // 4 + 2, room.astype(np.int64))
    keep = ok[pair]
    row, item, diagonal, pair = row[keep], item[keep], diagonal[keep] << 3, pair[keep]
    begin = np.maximum(diagonal - pad[pair], 0)
    stop = np.minimum(diagonal + 8 + m[pair] + pad[pair], w.count[row])
    head = np.flatnonzero(np.append(True, (pair[1:] != pair[:-1]) | (begin[1:] > stop[:-1]))[: len(row)])
    return row[head], item[head], begin[head], stop[np.append(head[1:], len(row))[: len(head)] - 1]


def short_leaks(column: pa.Array, block: Block) -> np.ndarray:
    """(row, item) pairs, one column each, where a line consists of a short item's words."""
    if not len(block.short):
        return np.zeros((2, 0), np.int64)
    lines = pc.split_pattern(column.fill_null(""), "\n")
    row, h = np.asarray(pc.list_parent_indices(lines)), short_hash(item_words(pc.list_flatten(lines)))
    lo, hi = (np.searchsorted(block.short, h, side) for side in ("left", "right"))
    n = np.where(h > 0, hi - lo, 0)
    which = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
    return np.unique(np.stack([np.repeat(row, n), block.short_item[which]]), axis=1)


def scan_slice(column: pa.Array, block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per row: the most similar leaked item's id (``NO_ID``: none, or a null id), the best
    similarity, and the number of leaked items."""
    w = item_words(column)
    row, item, begin, stop = _regions(w, block)
    size, width = np.diff(block.first)[item], stop - begin
    order = np.lexsort((width, size // 8))            # pairs of like shape together
    similar = np.zeros(len(row))
    padded_words = np.append(w.hash, np.uint64(1))
    padded_items = np.append(block.words, np.uint64(0))
    a = 0
    while a < len(order):
        p = order[a: a + PAIRS]
        cells = np.maximum.accumulate(width[p]) * np.arange(1, len(p) + 1)
        p = p[:max(1, int(np.searchsorted(cells, CELLS, side="right")))]
        a += len(p)
        m = size[p]
        k = np.arange(int(m.max()))
        items = padded_items[np.where(k < m[:, None], block.first[item[p]][:, None] + k, len(block.words))]
        k = np.arange(max(1, int(width[p].max())))
        regions = padded_words[np.where(k < width[p][:, None], (w.first[row[p]] + begin[p])[:, None] + k, len(w.hash))]
        similar[p] = align(regions, items) / (MATCH * m)
    n = len(w.count)
    brief = short_leaks(column, block)
    row, item = np.concatenate([row, brief[0]]), np.concatenate([item, brief[1]])
    similar = np.concatenate([similar, np.ones(brief.shape[1])])
    leak = np.flatnonzero(similar >= THRESHOLD)
    best_item, best, count = np.full(n, -1, np.int64), np.zeros(n), np.zeros(n, np.int64)
    np.maximum.at(best, row, similar)
    for i in leak[np.lexsort((-item[leak], similar[leak], row[leak]))]:
        best_item[row[i]] = item[i]                    # the last one written per row: most similar, smallest id
    pairs = np.unique(np.stack([row[leak], item[leak]]), axis=1) if len(leak) else np.zeros((2, 0), np.int64)
    np.add.at(count, pairs[0], 1)
    return np.append(block.item_id, NO_ID)[best_item], best, count


def seed_frequencies(docs: DataFrame, block: Block) -> tuple[dict[int, int], int]:
    """Documents per seed, and documents in all; partial counts per task, so at most one
    row per seed of the block reaches the driver."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(len(block.seed), np.int64), 0
        for b in slices(batches):
            w = item_words(b.column(0))
            at, lo, _ = _hits(w, block)
            if len(at):
                pairs = np.unique(np.stack([w.row[at], lo]), axis=1)
                total += np.bincount(pairs[1], minlength=len(total))
            n += b.num_rows
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(block.seed[seen].view(np.int64), 0)), pa.array(np.append(total[seen], 0)),
             pa.array(np.append(np.zeros(len(seen), np.int64), n))], ["seed", "df", "docs"])

    rows = (map_arrow(docs.select("text"), count, "seed long, df long, docs long")
            .groupBy("seed").agg(F.sum("df").alias("df"), F.sum("docs").alias("docs")).collect())
    return {r.seed: r.df for r in rows}, sum(r.docs for r in rows)


def _blocks(benchmark: DataFrame) -> Iterator[list]:
    items = benchmark.select(F.col("item_id").cast("long"), "text")
    n = -(-items.count() // BLOCK_ITEMS)
    for i in range(n):
        yield items.filter(F.pmod(F.xxhash64("item_id"), F.lit(n)) == i).collect()


def scan(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The input columns as ``c0, c1, ...`` plus ``item_id`` (most similar leaked item or
    null), ``similarity`` (best alignment found, 0 without a seed) and ``n_items``."""
    names = docs.columns
    text = names.index("text")
    fields = [T.StructField(f"c{i}", f.dataType) for i, f in enumerate(docs.schema.fields)]
    out = T.StructType([*fields, T.StructField("item_id", T.LongType()), T.StructField("similarity", T.DoubleType()),
                        T.StructField("n_items", T.LongType())])
    df = docs.toDF(*[f"c{i}" for i in range(len(names))]).withColumns(
        {"item_id": F.lit(None).cast("long"), "similarity": F.lit(0.0), "n_items": F.lit(0).cast("long")})
    for rows in _blocks(benchmark):
        block = Block.of(rows)
        block = block.with_rarity(*seed_frequencies(docs, block))

        def run(batches: Iterator[pa.RecordBatch], block: Block = block) -> Iterator[pa.RecordBatch]:
            for b in slices(batches, f"c{text}"):
                item, best, count = scan_slice(b.column(text), block)
                k = len(names)
                was_item, was_best, was_count = (np.asarray(c) for c in (b.column(k).fill_null(NO_ID), b.column(k + 1), b.column(k + 2)))
                new = (count > 0) & ((was_count == 0) | (best > was_best) | ((best == was_best) & (item < was_item)))
                item = np.where(new, item, was_item)
                cols = [*b.columns[:k], pa.array(item, pa.int64(), mask=item == NO_ID),
                        pa.array(np.maximum(best, was_best)), pa.array(count + was_count)]
                yield pa.RecordBatch.from_arrays(cols, schema=pa.schema(
                    [(f.name, c.type) for f, c in zip(out.fields, cols)]))

        df = map_arrow(df, run, out)
    return df


def remove_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The input rows without a leaked item, all columns unchanged."""
    clean = scan(docs, benchmark).filter("n_items = 0")
    return clean.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])
