"""Masked pseudo-likelihood scores.

A small bidirectional window network predicts every token from its left and right
neighbour: ``softmax(tanh(L[left] + R[right] + b) W + c)``. Tokens are words (A-Z folded)
mapped to the ``WORDS`` most frequent words of the corpus, a class per byte length for the
others, and a class for the text's edge. With this window the counts of all (left,
token, right) triples are a sufficient statistic of the whole corpus: every task counts
its triples, the counts are summed by one shuffle, and the network is trained in numpy on
them (at most ``CLASSES**3`` numbers, whatever the corpus).

A word outside the most frequent ones is predicted in two factors: its length class by the
network, and the word given the class by ``n(word) / (N(class) + 1)``, where the count left
over is that of a word never seen. The counts of all words of the corpus form a table that
grows with it. Its ``HEAVY`` most frequent words are shipped to all tasks; tokens of the
others are joined with the table by word hash. Logarithms from the join are summed as whole
numbers of ``1 / UNIT``, so no order of summation shows. A document's score is the sum of
its tokens' conditional log-probabilities.

Defined results: a null, empty or blank text has no tokens, log-likelihood 0 and a null
mean; repeated rows count and score like others; null ids are kept; an empty table gives an
empty result; ties in word frequency go to the smaller word. Only id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import Words, map_arrow, materialize, slices

WORDS, LENGTHS = 111, 16          # frequent words; length classes of all others
EDGE = WORDS + LENGTHS            # class of the text's start and end
CLASSES = EDGE + 1                # 128
HIDDEN, STEPS, RATE = 32, 300, 0.02
HEAVY = 1 << 17                   # words whose counts are shipped to all tasks
UNIT = 10 ** 9
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Model:
    """Vocabulary hashes (sorted, with their classes) and the network's weights; tokens per
    length class, hashes (sorted) and counts of the heavy words, the count from which on a
    word may be among them, and the table of all words."""
    words: bytes
    ids: bytes
    weights: tuple[bytes, ...]
    class_tokens: bytes = bytes(8 * LENGTHS)
    heavy: bytes = b""
    heavy_n: bytes = b""
    heavy_from: int = 0
    table: DataFrame | None = None

    def classes(self, w: Words) -> np.ndarray:
        known, ids = np.frombuffer(self.words, np.uint64), np.frombuffer(self.ids, np.int64)
        other = WORDS + np.minimum(w.end - w.start, LENGTHS) - 1
        if not len(known):
            return other
        at = np.minimum(np.searchsorted(known, w.hash), len(known) - 1)
        return np.where(known[at] == w.hash, ids[at], other)

    def within_class(self, w: Words, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per token, log P(word | class) as far as the heavy words tell it, and whether the
        logarithm of the word's count is still to be added from the table."""
        tokens = np.frombuffer(self.class_tokens, np.int64)
        heavy, n = np.frombuffer(self.heavy, np.uint64), np.frombuffer(self.heavy_n, np.int64)
        other = np.flatnonzero(ids >= WORDS)
        value, open_ = np.zeros(len(ids)), np.zeros(len(ids), bool)
        value[other] = -np.log(tokens + 1.0)[ids[other] - WORDS]
        if len(heavy):
            h = w.hash[other]
            at = np.minimum(np.searchsorted(heavy, h), len(heavy) - 1)
            known = heavy[at] == h
            value[other[known]] += np.log(n[at[known]])
            open_[other[~known]] = True
        return value, open_


def word_counts(docs: DataFrame) -> DataFrame:
    """(w, n): every word of the corpus and how often it occurs."""
    folded = F.translate(F.coalesce("text", F.lit("")), UPPER, LOWER)
    return (docs.select(F.explode(F.split(folded, "[\\x20\\x09-\\x0D]+")).alias("w")).filter("w != ''")
            .groupBy("w").agg(F.count("*").alias("n")))


def word_table(docs: DataFrame) -> DataFrame:
    """(w, n, h, length): the counted words with their hash and length class, written once."""
    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "w"):
            w = Words(b.column(0), True)
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(w.hash.view(np.int64)), pa.array(np.minimum(w.end - w.start, LENGTHS).astype(np.int32) - 1, pa.int32())],
                ["w", "n", "h", "length"])

    return materialize(map_arrow(word_counts(docs), hashed, "w string, n long, h long, length int"), "words")


def vocabulary(docs: DataFrame, n: int = WORDS) -> Model:
    """The ``n`` most frequent words, counted over all texts."""
    return _most_frequent(word_counts(docs), n)


def _most_frequent(counts: DataFrame, n: int = WORDS) -> Model:
    rows = counts.select("w", "n").orderBy(F.desc("n"), "w").limit(n).collect()
    w = Words(pa.array([r.w for r in rows], pa.string()), True)
    order = np.argsort(w.hash)
    return Model(w.hash[order].tobytes(), order.astype(np.int64).tobytes(), ())


def triples(w: Words, ids: np.ndarray) -> np.ndarray:
    """Packed (left, token, right) classes of every token."""
    first, last = np.zeros(len(ids), bool), np.zeros(len(ids), bool)
    some = w.count > 0
    first[w.first[:-1][some]], last[w.first[1:][some] - 1] = True, True
    left = np.where(first, EDGE, np.concatenate([[EDGE], ids[:-1]]))
    right = np.where(last, EDGE, np.concatenate([ids[1:], [EDGE]]))
    return (left * CLASSES + ids) * CLASSES + right


def triple_counts(docs: DataFrame, vocab: Model) -> DataFrame:
    """(code, n) over the corpus: one row per triple and task, then one shuffle."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CLASSES ** 3, np.int64)
        for b in slices(batches):
            w = Words(b.column(0), True)
            if len(w.hash):
                codes, n = np.unique(triples(w, vocab.classes(w)), return_counts=True)
                total[codes] += n
        seen = np.flatnonzero(total)
        for a in range(0, len(seen), 1 << 16):
            s = seen[a: a + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(s.astype(np.int32)), pa.array(total[s])], ["code", "n"])

    return (map_arrow(docs.select("text"), count, "code int, n long")
            .groupBy("code").agg(F.sum("n").alias("n")))


def train(counts: np.ndarray, seed: int = 7, steps: int = STEPS) -> tuple[np.ndarray, ...]:
    """Weights from dense counts[left, token, right], by Adam over all seen contexts."""
    by_context = counts.transpose(0, 2, 1).reshape(-1, CLASSES)
    seen = np.flatnonzero(by_context.sum(axis=1))
    target = by_context[seen].astype(np.float32)
    left, right = seen // CLASSES, seen % CLASSES
    weight = target.sum(axis=1, keepdims=True)
    all_ = max(1.0, float(weight.sum()))
    rng = np.random.default_rng(seed)
    p = [rng.normal(0, 0.3, (CLASSES, HIDDEN)).astype(np.float32), rng.normal(0, 0.3, (CLASSES, HIDDEN)).astype(np.float32),
         np.zeros(HIDDEN, np.float32), rng.normal(0, 0.1, (HIDDEN, CLASSES)).astype(np.float32),
         np.log((target.sum(axis=0) + 1) / (all_ + CLASSES)).astype(np.float32)]
    m, v = [np.zeros_like(x) for x in p], [np.zeros_like(x) for x in p]
    for t in range(1, steps + 1):
        h = np.tanh(p[0][left] + p[1][right] + p[2])
        z = h @ p[3] + p[4]
        z -= z.max(axis=1, keepdims=True)
        e = np.exp(z)
        dz = (e / e.sum(axis=1, keepdims=True) * weight - target) / all_
        dh = (dz @ p[3].T) * (1 - h * h)
        grads = [np.zeros_like(p[0]), np.zeros_like(p[1]), dh.sum(axis=0), h.T @ dz, dz.sum(axis=0)]
        np.add.at(grads[0], left, dh)
        np.add.at(grads[1], right, dh)
        for i, g in enumerate(grads):
            m[i] += 0.1 * (g - m[i])
            v[i] += 0.01 * (g * g - v[i])
            p[i] -= RATE * (m[i] / (1 - 0.9 ** t)) / (np.sqrt(v[i] / (1 - 0.99 ** t)) + 1e-8)
    return tuple(p)


def fit(docs: DataFrame) -> Model:
    table = word_table(docs)
    vocab = _most_frequent(table)
    got = triple_counts(docs, vocab).toPandas()
    counts = np.zeros(CLASSES ** 3, np.int64)
    counts[got["code"].to_numpy(np.int64)] = got["n"].to_numpy(np.int64)
    weights = train(counts.reshape(CLASSES, CLASSES, CLASSES))
    rest = table.filter(~F.col("h").isin(np.frombuffer(vocab.words, np.int64).tolist()))
    tokens = np.zeros(LENGTHS, np.int64)
    for r in rest.groupBy("length").agg(F.sum("n").alias("n")).collect():
        tokens[r.length] = r.n
    top = rest.select("h", "n").orderBy(F.desc("n"), "h").limit(HEAVY).toPandas()
    heavy, n = top["h"].to_numpy(np.int64).view(np.uint64), top["n"].to_numpy(np.int64)
    order = np.argsort(heavy)
    return Model(vocab.words, vocab.ids, tuple(x.tobytes() for x in weights), tokens.tobytes(), heavy[order].tobytes(),
                 n[order].tobytes(), int(n.min()) if len(n) else 0, table)


@lru_cache(maxsize=1)
def log_probabilities(weights: tuple[bytes, ...]) -> np.ndarray:
    """The network's output for every context, indexed like the packed triples."""
    e, r, b, w, c = (np.frombuffer(x, np.float32) for x in weights)
    h = np.tanh(e.reshape(CLASSES, 1, HIDDEN) + r.reshape(1, CLASSES, HIDDEN) + b).reshape(-1, HIDDEN)
    z = h @ w.reshape(HIDDEN, CLASSES) + c
    z -= z.max(axis=1, keepdims=True)
    z -= np.log(np.exp(z).sum(axis=1, keepdims=True))
    return np.ascontiguousarray(z.reshape(CLASSES, CLASSES, CLASSES).transpose(0, 2, 1)).ravel()


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, n_tokens, log_likelihood, mean_log_likelihood`` per input row."""
    shipped = replace(model, table=None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = log_probabilities(shipped.weights)
        for b in slices(batches):
            w = Words(b.column(1), True)
            value, rare, cut = np.zeros(0), np.zeros(0, np.int64), np.zeros(b.num_rows + 1, np.int64)
            if len(w.hash):
                ids = shipped.classes(w)
                value, open_ = shipped.within_class(w, ids)
                value += table[triples(w, ids)]
                rare, cut = w.hash[open_].view(np.int64), np.concatenate([[0], np.cumsum(open_)])[w.first]
            total = np.bincount(w.row, value, minlength=b.num_rows) if len(value) else np.zeros(b.num_rows)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(w.count.astype(np.int64)), pa.array(total),
                 pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.array(rare, pa.int64()))],
                ["doc_id", "n_tokens", "told", "rare"])

    rows = materialize(map_arrow(docs.select("doc_id", "text"), run, "doc_id long, n_tokens long, told double, rare array<long>")
                       .withColumn("rid", F.monotonically_increasing_id()), "lm-scores")
    total = F.col("told")
    if model.table is not None:
        # a word that occurs once, or never, adds log 1; all words above heavy_from are told already
        log_n = (model.table.filter(F.col("n").between(2, model.heavy_from))
                 .select("h", F.round(F.log("n") * UNIT).cast("long").alias("log_n")))
        added = (rows.select("rid", F.explode("rare").alias("h")).join(log_n, "h")
                 .groupBy("rid").agg(F.sum("log_n").alias("added")))
        rows = rows.drop("rare").join(added, "rid", "left")
        total = F.col("told") + F.coalesce(F.col("added"), F.lit(0)) / UNIT
    return rows.select("doc_id", "n_tokens", total.alias("log_likelihood"),
                       F.when(F.col("n_tokens") > 0, total / F.col("n_tokens")).alias("mean_log_likelihood"))
