"""Language identification by cross-parsing entropy.

For every language a suffix automaton is built over a bounded, documented sample of
its labelled text. A document is cross-parsed against each automaton: the longest
prefix of the rest that occurs in the language's text is one phrase, then parsing goes
on behind it. The language that needs the fewest phrases wins; each text is normalised
first (A-Z folded, every run of other ASCII than letters taken as one space).

The automata are flattened into one dense transition table, and all blocks of a batch
walk it in lockstep, one gather per byte and language. A parse starts anew every
``BLOCK`` normalised bytes, so that long texts split into equal lanes; whole texts are
parsed.

Defined results: a null text or one without a letter is ``und`` with score 0; ties go to
the language that sorts first; null labels are never learned; with nothing to learn every
document is ``und``; null ids and repeated rows are predicted like others. ``held_out``
treats a null id as the text ``''``. Only id, text and label are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerlens.llm.common import map_arrow, slices, utf8

SAMPLE_DOCS = 64          # labelled documents learned per language, fewer where there are over ten languages
ALL_SAMPLE_DOCS = 640     # bound for all languages together; each gets at least 4
SAMPLE_CHARS = 400        # code points taken of each
MAX_LANGUAGES = 160       # the most frequent labels are learned
BLOCK = 256               # bytes parsed without a restart
LANES = 1 << 14           # blocks that walk in lockstep

# byte -> normalised byte: ASCII letters folded, other ASCII to space, the rest as it is
_NORMAL = np.arange(256, dtype=np.uint8)
_NORMAL[:128] = 32
_NORMAL[ord("a"): ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
_NORMAL[ord("A"): ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)


def held_out():
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(4)) == 2


def learning_sample(docs: DataFrame, chars: int = SAMPLE_CHARS) -> tuple[tuple[str, str], ...]:
    """(language, sample text) pairs from rows that are not held out. The rows are picked
    by id hash in a pass without texts; at most ``SAMPLE_DOCS`` ids per language and
    ``MAX_LANGUAGES`` languages are named, and only their texts reach the driver."""
    open_ = docs.filter(~held_out() & F.col("lang").isNotNull() & F.col("doc_id").isNotNull())
    langs = [r[0] for r in open_.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MAX_LANGUAGES).collect()]
    n_docs = max(4, min(SAMPLE_DOCS, ALL_SAMPLE_DOCS // max(1, len(langs))))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    ids = (open_.filter(F.col("lang").isin(langs)).select("lang", "doc_id")
           .withColumn("r", F.row_number().over(order)).filter(F.col("r") <= n_docs).select("lang", "doc_id").distinct())
    rows = (open_.select("lang", "doc_id", F.substring("text", 1, chars).alias("t"))
            .join(F.broadcast(ids), ["lang", "doc_id"]).groupBy("lang", "doc_id").agg(F.min("t").alias("t")).collect())
    texts: dict[str, list] = {}
    for r in sorted(rows, key=lambda r: (r.lang, r.doc_id)):
        texts.setdefault(r.lang, []).append(r.t or "")
    return tuple((lang, "\n".join(t)) for lang, t in sorted(texts.items()))


def normalise(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Normalised bytes and row offsets; runs of spaces shrink to one."""
    data = _NORMAL[data]
    keep = np.ones(len(data), bool)
    keep[1:] = (data[1:] != 32) | (data[:-1] != 32)
    return data[keep], np.concatenate([[0], np.cumsum(keep)])[off]


def suffix_automaton(text: bytes) -> list[dict[int, int]]:
    """Transitions of the minimal automaton of all substrings of ``text``."""
    go, link, length, last = [{}], [-1], [0], 0
    for c in text:
        cur = len(go)
        go.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in go[p]:
            go[p][c] = cur
            p = link[p]
        if p >= 0:
            q = go[p][c]
            if length[q] == length[p] + 1:
                link[cur] = q
            else:
                clone = len(go)
                go.append(dict(go[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                link[q] = link[cur] = clone
                while p >= 0 and go[p].get(c) == q:
                    go[p][c] = clone
                    p = link[p]
        last = cur
    return go


@lru_cache(maxsize=2)
def tables(sample: tuple[tuple[str, str], ...]) -> tuple[np.ndarray, int, list[tuple[str, np.ndarray, int]]]:
    """Byte classes, their number, and per language a flat table and its root:
    ``table[state + class]`` is ``2 * next state + 1 if a phrase ends before the byte``.
    States are multiplied by the number of classes. Class 0 (a byte in no sample) is a
    phrase of its own; class 1 pads the lanes and changes nothing."""
    normal = [(lang, normalise(np.frombuffer(t.encode(), np.uint8), np.zeros(1, np.int64))[0].tobytes()) for lang, t in sample]
    seen = sorted(set(b"".join(t for _, t in normal)))
    classes = np.zeros(256, np.uint8)
    classes[seen] = np.arange(2, len(seen) + 2)
    width, out = len(seen) + 2, []
    for lang, text in normal:
        go = suffix_automaton(text)
        t = np.zeros((len(go), width), np.int32)
        root = np.zeros(width, np.int32)
        for c, s in go[0].items():
            root[classes[c]] = s
        t[:] = root * (2 * width) + 1
        t[:, 1] = np.arange(len(go)) * (2 * width)
        for s, row in enumerate(go):
            for c, to in row.items():
                t[s, classes[c]] = to * (2 * width)
        t[0, 0] = 1
        t[0, 2:] |= 1          # the first byte of a parse opens a phrase
        out.append((lang, t.ravel(), 0))
    return classes, width, out


def phrase_counts(data: np.ndarray, off: np.ndarray, sample) -> tuple[np.ndarray, np.ndarray]:
    """Phrases per row and language (rows x languages) and normalised bytes per row."""
    classes, _, langs = tables(sample)
    data, off = normalise(data, off)
    size = np.diff(off)
    blocks = -(-size // BLOCK)
    row = np.repeat(np.arange(len(size)), blocks)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    start = off[:-1][row] + nth * BLOCK
    n = np.minimum(BLOCK, off[1:][row] - start)
    codes = np.concatenate([classes[data], np.ones(BLOCK, np.uint8)])
    total = np.zeros((len(size), len(langs)), np.int64)
    order = np.argsort(-n, kind="stable")             # lanes of like length walk together
    for at in range(0, len(order), LANES):
        lanes = order[at: at + LANES]
        longest = int(n[lanes[0]])
        grid = codes[start[lanes][None, :] + np.arange(longest)[:, None]]
        grid[np.arange(longest)[:, None] >= n[lanes][None, :]] = 1
        for j, (_, table, _) in enumerate(langs):
            state, count = np.zeros(len(lanes), np.int32), np.zeros(len(lanes), np.int32)
            for step in range(longest):
                got = table[state + grid[step]]
                count += got & 1
                state = got >> 1
            total[:, j] += np.bincount(row[lanes], count, minlength=len(size)).astype(np.int64)
    return total, size


def predict(docs: DataFrame, sample: tuple[tuple[str, str], ...]) -> DataFrame:
    """``doc_id, held_out, lang_pred, score, n_phrases, n_normal_bytes`` per input row.
    ``score`` is the winner's lead: 1 - (its phrases / the runner-up's)."""
    names = np.array([lang for lang, _ in sample] or ["und"], object)
    kept = docs.select("doc_id", "text", held_out().alias("held_out"),
                       F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letters"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            data, off = utf8(b.column(1))
            if sample:
                counts, size = phrase_counts(data, off, sample)
            else:
                counts, size = np.zeros((b.num_rows, 1), np.int64), np.zeros(b.num_rows, np.int64)
            best = counts.argmin(axis=1)
            ranked = np.sort(counts, axis=1)
            lead = 1 - ranked[:, 0] / np.maximum(ranked[:, 1], 1) if counts.shape[1] > 1 else np.ones(len(best))
            known = np.asarray(b.column(3)) & bool(sample)
            lang = np.where(known, names[best], "und")
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(2), pa.array(lang, pa.string()), pa.array(np.where(known, lead, 0.0), pa.float64()),
                 pa.array(counts[np.arange(len(best)), best]), pa.array(size)],
                ["doc_id", "held_out", "lang_pred", "score", "n_phrases", "n_normal_bytes"])

    return map_arrow(kept, run, "doc_id long, held_out boolean, lang_pred string, score double, "
                                 "n_phrases long, n_normal_bytes long")


def identify(docs: DataFrame) -> DataFrame:
    return predict(docs, learning_sample(docs))
