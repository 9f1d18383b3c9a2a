"""Ranked lexical search by bag deduplication.

Every item (a query) ranks all documents by a score over the item's terms. A document
matters to it only through its term counts over the items' vocabulary and its length class
``m``, so documents are first restricted to that vocabulary: one pass over the texts keeps a
bag ``(terms, tfs)`` and the number of all terms. Equal bags with equal ``m`` form one class
(grouped by their hash together with the bag itself, so no two different bags meet). Classes
are scored once, in blocks of classes against blocks of items as integer matrix products,
and each task keeps its best ``k`` classes per item. A class can only hold a result if fewer
than ``k`` classes are ahead of it by (score, least doc_id), so the best ``k`` classes per item
suffice; their members are expanded by ascending doc_id, ``k`` of each class at most.

Items are taken in blocks of ``ITEM_BLOCK`` items or ``BLOCK_TERMS`` terms, one pass over
the documents each; only a block's vocabulary and weights travel to the tasks. Nothing else
is limited: all documents, whole texts, all their terms count.

Terms are runs of ASCII letters and digits and of all characters beyond ASCII, A-Z folded;
they are compared by 64-bit hashes. A term's weight is ``floor(1000 ln((2N+2)/(2df+1)))``, a
document's ``m = 10 + (90 n N) div L``, its score the sum of ``w * ((10**9 tf) div (1000 tf + 8 m))``.

Defined results: a null, empty or termless text is no document (it counts neither in N nor
anywhere); an item without terms, or whose terms no document holds, has no results; a null
item_id is an item like others, and repeated items give repeated results; repeated rows are
documents of their own; equal scores go by ascending doc_id, a null doc_id after all others;
empty tables give an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerlens.llm.common import LOWER, PUNCTUATION, Words, map_arrow, materialize, slices, utf8

TOP = 10
ITEM_BLOCK, BLOCK_TERMS = 4096, 1 << 18         # items of one pass over the documents, and their terms
SCORE_ITEMS, SCORE_ROWS = 128, 256              # of one matrix product
EXACT = 1 << 53                                 # integers below it are exact in a double
LAST = (1 << 63) - 1                            # stands for a null id in an order

TERM_BYTES = LOWER.copy()                       # separators become spaces, A-Z is folded
TERM_BYTES[:0x30] = 0x20
TERM_BYTES[PUNCTUATION] = 0x20
TERM_BYTES[0x7F] = 0x20


def terms(column: pa.Array) -> Words:
    """The terms of each row as words of the folded text."""
    data, off = utf8(column)
    folded = pa.LargeStringArray.from_buffers(len(column), pa.py_buffer(off), pa.py_buffer(TERM_BYTES[data]))
    return Words(folded, False)


def counted(row: np.ndarray, code: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, codes (ascending within a row) and how often each pair occurs."""
    pair, n = np.unique(row.astype(np.int64) * width + code, return_counts=True)
    return pair // width, pair % width, n


def lists(values: np.ndarray, row: np.ndarray, n_rows: int, kind: pa.DataType) -> pa.ListArray:
    """One list per row of ``values`` sorted by ``row``."""
    off = np.searchsorted(row, np.arange(n_rows + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(off), pa.array(values, kind))


@dataclass
class ItemBlock:
    """Items with their term codes in the block's sorted vocabulary, as flat arrays."""
    ids: list[int | None]
    vocabulary: np.ndarray          # sorted term hashes
    codes: np.ndarray               # all items' codes, one after another
    first: np.ndarray               # where each item's codes start, and the end


def item_blocks(items: DataFrame, block_items: int, block_terms: int) -> Iterator[ItemBlock]:
    """The items' distinct term hashes, fetched a partition at a time and handed out in
    blocks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            w = terms(b.column(1))
            for i in range(b.num_rows):
                h = np.unique(w.hash[w.first[i]: w.first[i + 1]])
                if len(h):
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(i, 1), pa.array([h.tobytes()], pa.binary())],
                                                     ["item_id", "terms"])

    def block(ids: list, hashes: list[np.ndarray]) -> ItemBlock:
        vocabulary, codes = np.unique(np.concatenate(hashes), return_inverse=True)
        return ItemBlock(ids, vocabulary, codes, np.concatenate([[0], np.cumsum([len(h) for h in hashes])]))

    ids, hashes = [], []
    for r in map_arrow(items.select("item_id", "text"), run, "item_id long, terms binary").toLocalIterator():
        h = np.frombuffer(r.terms, np.uint64)
        if ids and (len(ids) >= block_items or sum(map(len, hashes)) + len(h) > block_terms):
            yield block(ids, hashes)
            ids, hashes = [], []
        ids.append(r.item_id)
        hashes.append(h)
    if ids:
        yield block(ids, hashes)


def bags(docs: DataFrame, vocabulary: np.ndarray) -> DataFrame:
    """Per document with a term ``doc_id, n`` (all its terms) and its bag over the vocabulary:
    ascending term codes and their counts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            w = terms(b.column(1))
            at = np.minimum(np.searchsorted(vocabulary, w.hash), len(vocabulary) - 1)
            hit = vocabulary[at] == w.hash
            row, code, n = counted(w.row[hit], at[hit], len(vocabulary))
            out = pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(w.count.astype(np.int64)), lists(code, row, b.num_rows, pa.int32()),
                 lists(n, row, b.num_rows, pa.int32())], ["doc_id", "n", "terms", "tfs"])
            yield out.filter(pa.array(w.count > 0))

    return map_arrow(docs.select("doc_id", "text"), run, "doc_id long, n long, terms array<int>, tfs array<int>")


def term_weights(bagged: DataFrame, n_docs: int, size: int) -> np.ndarray:
    """The weight of each of the block's terms; a term that no document holds is met by no bag
    and keeps 0. One row per term reaches the driver."""
    df = bagged.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("df"))
    w = F.floor(1000 * F.log((2.0 * F.lit(n_docs) + 2) / (2.0 * F.col("df") + 1))).cast("long")
    out = np.zeros(size, np.int64)
    for r in df.select("t", w.alias("w")).toLocalIterator():
        out[r.t] = r.w
    return out


def classes_of(bagged: DataFrame, n_docs: int, n_terms: int) -> DataFrame:
    """The bags with their class key: ``m`` and a hash of the bag."""
    m = F.expr(f"cast(10 + (cast(90 * n as decimal(20, 0)) * cast({n_docs} as decimal(18, 0))) div {n_terms} as long)")
    return bagged.filter("size(terms) > 0").select("doc_id", m.alias("m"), F.xxhash64("terms", "tfs").alias("h"), "terms", "tfs")


def best_classes(classes: DataFrame, block: ItemBlock, weights: np.ndarray, k: int) -> DataFrame:
    """Per task and item the ``k`` best classes ``item, score, first, cid``."""
    parts = []                      # items of one matrix product: their vocabulary and weights
    for a in range(0, len(block.ids), SCORE_ITEMS):
        z = min(a + SCORE_ITEMS, len(block.ids))
        codes = block.codes[block.first[a]: block.first[z]]
        used, col = np.unique(codes, return_inverse=True)
        item = np.repeat(np.arange(z - a), np.diff(block.first[a: z + 1]))
        exact = np.bincount(item, weights[codes].astype(np.float64), z - a).max() * 1e6 < EXACT
        parts.append((a, used.astype(np.int32), col.astype(np.int32), item.astype(np.int32), exact))
    width = len(block.vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, list] = {}              # item -> score, first, cid of its k best
        floor = np.ones(len(block.ids), np.int64)       # least score that still matters to an item

        def offer(at: int, score: np.ndarray, first: np.ndarray, cid: np.ndarray) -> None:
            if at in best:
                score, first, cid = (np.concatenate(x) for x in zip(best[at], (score, first, cid)))
            if len(score) > k:
                top = np.lexsort((cid, first, -score))[:k]
                score, first, cid = score[top], first[top], cid[top]
            best[at] = [score, first, cid]
            if len(score) == k:
                floor[at] = score.min()

        for whole in batches:
            for s in range(0, whole.num_rows, SCORE_ROWS):
                b = whole.slice(s, SCORE_ROWS)
                cid, first, m = (np.asarray(b.column(i)) for i in range(3))
                count = np.asarray(pc.list_value_length(b.column(3)))
                row, term = np.repeat(np.arange(b.num_rows), count), np.asarray(b.column(3).flatten())
                tf = np.asarray(b.column(4).flatten()).astype(np.int64)
                impact = 10**9 * tf // (1000 * tf + 8 * m[row])
                for a, used, col, item, exact in parts:
                    kind = np.float64 if exact else np.int64
                    place = np.full(width, -1, np.int32)
                    place[used] = np.arange(len(used))
                    mine = place[term] >= 0
                    x = np.zeros((b.num_rows, len(used)), kind)
                    x[row[mine], place[term[mine]]] = impact[mine]
                    y = np.zeros((len(used), int(item[-1]) + 1), kind)
                    y[col, item] = weights[used[col]]
                    scores = (x @ y).astype(np.int64)
                    good = scores >= floor[a: a + scores.shape[1]]
                    for j in np.flatnonzero(good.any(axis=0)):
                        mine = good[:, j]
                        offer(a + j, scores[mine, j], first[mine], cid[mine])
        for at, (score, first, cid) in best.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(score), at, np.int32)), pa.array(score), pa.array(first), pa.array(cid)],
                ["item", "score", "first", "cid"])

    return map_arrow(classes.select("cid", "first", "m", "terms", "tfs"), run, "item int, score long, first long, cid long")


def rank_block(docs: DataFrame, block: ItemBlock, k: int) -> DataFrame:
    """``item_id, rank, doc_id, score`` of one block of items."""
    spark = docs.sparkSession
    bagged = materialize(bags(docs, block.vocabulary), "lexical-bags")
    corpus = bagged.agg(F.count("*").alias("n_docs"), F.sum("n").alias("n_terms")).first()
    if not corpus.n_docs:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    weights = term_weights(bagged, corpus.n_docs, len(block.vocabulary))
    members = classes_of(bagged, corpus.n_docs, corpus.n_terms)
    order = F.coalesce("doc_id", F.lit(LAST))
    grouped = members.groupBy("h", "m", "terms", "tfs").agg(F.min(order).alias("first"))
    classes = materialize(grouped.select(F.monotonically_increasing_id().alias("cid"), "*"), "lexical-classes")

    ahead = Window.partitionBy("item").orderBy(F.desc("score"), "first", "cid")
    found = best_classes(classes, block, weights, k).withColumn("r", F.row_number().over(ahead)).filter(F.col("r") <= k)
    found = materialize(found.drop("r"), "lexical-best")
    key = ["h", "m", "terms", "tfs"]
    wanted = classes.join(found.select("cid").distinct(), "cid", "left_semi").select("cid", *key)
    inside = Window.partitionBy("cid").orderBy(F.col("doc_id").asc_nulls_last())
    expanded = members.join(wanted, key).select("cid", "doc_id").withColumn("r", F.row_number().over(inside)).filter(F.col("r") <= k)
    ranks = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last()))
    ids = spark.createDataFrame(list(enumerate(block.ids)), "item int, item_id long")
    ranked = found.join(expanded.drop("r"), "cid").withColumn("rank", ranks.cast("int")).filter(F.col("rank") <= k)
    return ranked.join(ids, "item").select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = TOP, block_items: int = ITEM_BLOCK,
           block_terms: int = BLOCK_TERMS) -> DataFrame:
    """``item_id, rank, doc_id, score``: each item's ``k`` best documents with a score above 0."""
    spark: SparkSession = docs.sparkSession
    blocks = [rank_block(docs, b, k) for b in item_blocks(items, block_items, block_terms)]
    if not blocks:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    return reduce(DataFrame.unionByName, blocks)
