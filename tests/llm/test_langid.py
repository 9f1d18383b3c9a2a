import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from ledgerlens.llm import langid as L

SYLLABLES = {"aa": ["ba", "ko", "tu", "ri"], "bb": ["sch", "ung", "ein", "ver"], "cc": ["é", "eau", "oi", "tion"]}
SCHEMA = "doc_id long, text string, lang string, source string"


def speak(rng, lang, n):
    return " ".join("".join(rng.choices(SYLLABLES[lang], k=rng.randrange(1, 4))) for _ in range(n))


def greedy_phrases(text, corpus):
    """Longest-match phrases by plain substring search, restarted every block."""
    n = 0
    for a in range(0, len(text), L.BLOCK):
        t, i = text[a: a + L.BLOCK], 0
        while i < len(t):
            k = 1
            while i + k < len(t) and t[i: i + k + 1] in corpus:
                k += 1
            i, n = i + k, n + 1
    return n


def norm(text):
    raw = np.frombuffer(text.encode(), np.uint8)
    return L.normalise(raw, np.array([0, len(raw)]))[0].tobytes()


def test_phrase_counts_match_plain_parsing():
    rng = random.Random(1)
    sample = tuple((lang, speak(rng, lang, 60)) for lang in SYLLABLES)
    texts = [speak(rng, rng.choice(list(SYLLABLES)), rng.randrange(1, 300)) + rng.choice(["", " 12 ?", " ZZZ"]) for _ in range(40)] + ["", "?"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    off = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])])
    counts, _ = L.phrase_counts(data, off, sample)
    want = [[greedy_phrases(norm(t), norm(s)) for _, s in sample] for t in texts]
    assert counts.tolist() == want


def test_held_out_accuracy(spark):
    rng = random.Random(2)
    rows = [(i, speak(rng, x := rng.choice(list(SYLLABLES)), 30), x, "s") for i in range(400)]
    got = {r.doc_id: r for r in L.identify(spark.createDataFrame(rows, SCHEMA)).collect()}
    held = [(got[i], lang) for i, _, lang, _ in rows if got[i].held_out]
    assert {i for i in got if got[i].held_out} == {i for i in got if zlib.crc32(str(i).encode()) % 4 == 2}
    assert sum(r.lang_pred == lang for r, lang in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in got.values())


def test_label_and_source_are_no_inputs(spark):
    rng = random.Random(3)
    rows = [(i, speak(rng, x := rng.choice(list(SYLLABLES)), 20), x, "s") for i in range(200)]
    out = [i for i in range(200) if zlib.crc32(str(i).encode()) % 4 == 2]
    swapped = [(i, t, "aa" if i in out else lang, "other") for i, t, lang, _ in rows]
    a, b = (sorted(L.identify(spark.createDataFrame(x, SCHEMA)).collect()) for x in (rows, swapped))
    assert a == b


def test_edges(edges, edge_rows, nothing):
    got = L.identify(edges).collect()
    assert len(got) == len(edge_rows)
    assert all(r.lang_pred == "und" and r.score == 0 for r in got if r.n_normal_bytes == 0)
    und = [r for r in got if r.lang_pred == "und"]
    assert len(und) == sum(1 for _, t in edge_rows if not any(c.isalpha() for c in t or ""))
    assert L.identify(nothing).count() == 0
    assert {r.lang_pred for r in L.identify(edges.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
