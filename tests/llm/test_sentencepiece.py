import random

import numpy as np
import pyarrow as pa
import pytest

from ledgerlens.llm import sentencepiece_scan as S

VOCAB = S.Vocabulary.load()
TRIE = S.trie_of(VOCAB)


def brute(text):
    """Viterbi over the whole text, character by character."""
    if not text:
        return []
    pieces = {p: (s, i) for p, s, i in VOCAB.pieces}
    unknown = min(s for _, s, _ in VOCAB.pieces) - 10
    codes = S.code_points((" " + text).encode())
    t = "".join(chr(c) if c < 0x110000 else "\U0010ffff" for c in codes)
    best = [None] * (len(t) + 1)
    best[0] = (0, 0, None)
    for i in range(len(t)):
        for d in range(1, min(16, len(t) - i) + 1):
            if t[i: i + d] in pieces:
                score, ident = pieces[t[i: i + d]]
            elif d == 1:
                score, ident = unknown, -2
            else:
                continue
            if best[i + d] is None or best[i][0] + score > best[i + d][0]:
                best[i + d] = (best[i][0] + score, i, ident)
    out, j = [], len(t)
    while j:
        _, i, ident = best[j]
        raw = ("▁" if codes[i] == 0x110000 else chr(codes[i])).encode()
        out += [VOCAB.byte_ids[x] for x in reversed(raw)] if ident == -2 else [ident]
        j = i
    return out[::-1]


TEXTS = ["Hello world, this is  a test", "", None, "a▁b   c\n\n x", "日本語テキスト grüße 😀😀", "x" * 300, " lead  and trail  ", "   ", "\x00\t",
         "theofandinthe" * 30]


def test_slices_match_brute_force_and_come_back():
    got = S.encode_slice(TRIE, pa.array(TEXTS))
    assert got.to_pylist() == [None if t is None else brute(t) for t in TEXTS]
    assert S.decode_slice(TRIE, got).to_pylist() == TEXTS


def test_same_best_path_as_the_library():
    from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2
    m = sentencepiece_model_pb2.ModelProto()
    with open(S.MODEL, "rb") as f:
        m.ParseFromString(f.read())
    m.trainer_spec.model_type = 1                          # read the scores as a unigram model
    sp = SentencePieceProcessor(model_proto=m.SerializeToString())
    texts = ["the thing", "of the reason", "Zu und die", "que osllra con", "with another one"]
    assert S.encode_slice(TRIE, pa.array(texts)).to_pylist() == [sp.nbest_encode(t, nbest_size=5)[0] for t in texts]


@pytest.mark.parametrize("chunk", [20, 50, 4096])
def test_chunks_give_the_whole_texts_path(spark, chunk):
    rng = random.Random(chunk)
    words = ["the", "ofthe", "ünder", "tion\n", "  ", "antidisestablishment", "x", "日本", "▁", "https"]
    texts = ["".join(rng.choice(words) + rng.choice(["", " "]) for _ in range(rng.randrange(10, 120))) for _ in range(12)] + ["inthe" * 60]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts + texts[:2])], "doc_id long, text string")
    got = {r.c0: r for r in S.decode(S.encode(df, VOCAB, giant=30, chunk=chunk), VOCAB).collect()}
    assert len(got) == len(texts) + 2
    for i, t in enumerate(texts + texts[:2]):
        assert got[i].ids == brute(t) and got[i].decoded == t


def test_transfer_matrices_are_associative():
    core = ["the reason of", " another thi", "ng in the mid"]
    m = S.transfer_matrices(TRIE, core, [" another thing i", "ng in the middle", ""])
    assert (S.max_plus(S.max_plus(m[0], m[1]), m[2]) == S.max_plus(m[0], S.max_plus(m[1], m[2]))).all()
    whole = S.transfer_matrices(TRIE, ["".join(core)], [""])[0]
    assert S.max_plus(S.max_plus(m[0], m[1]), m[2])[0, 0] == whole[0, 0]


def test_edges(edges, edge_rows, nothing):
    back = S.decode(S.encode(edges, VOCAB, giant=3000), VOCAB).collect()
    assert len(back) == len(edge_rows) and all(r.decoded == r.c1 for r in back)
    assert sorted((r.ids for r in back if r.c1 and len(r.c1) < 100), key=str) == sorted((brute(t) for _, t in edge_rows if t and len(t) < 100), key=str)
    assert S.encode(nothing, VOCAB).count() == 0


def test_hash_table_holds_every_child():
    ids = [i for _, _, i in VOCAB.pieces]
    text = pa.array([p.replace("▁", " ") for p, _, _ in VOCAB.pieces[500:900]])
    flat = S.encode_slice(TRIE, text).flatten()
    assert len(flat) and set(np.asarray(flat)) <= {*ids, *VOCAB.byte_ids}


def test_one_pass_round_trip_equals_encode_and_decode(spark, edges, nothing):
    for giant, chunk in ((S.GIANT, S.CHUNK), (300, 64)):
        back = S.decode(S.encode(edges, giant=giant, chunk=chunk))
        at = edges.columns.index("text")
        want = sorted(((r.c0, r.ids, r.decoded == r[f"c{at}"]) for r in back.collect()), key=str)
        got = sorted(((r.c0, r.ids, r.round_trip) for r in S.round_trip(edges, giant=giant, chunk=chunk).collect()), key=str)
        assert got == want
    assert S.round_trip(nothing).count() == 0
