"""SentencePiece encoding and decoding as a max-plus scan.

The vocabulary file's pieces and scores define the encoding: spaces become U+2581, one is put
in front, and the segmentation into pieces with the greatest score sum is taken (of equal
ones, going back from the end, the longest last piece). A character outside all pieces
costs ``least score - 10`` and is written as its UTF-8 byte pieces, as is a literal U+2581,
so decoding gives every text back. Scores are kept as integers, sums are exact.

No piece has U+2581 behind another character, so a text falls apart into units (spaces and
what follows) that are segmented once per distinct unit of a batch, all in lockstep.

Texts over ``GIANT`` bytes are cut into chunks of ``CHUNK`` code points, anywhere:

1. a chunk's transfer matrix holds the best score from every entry state to every exit state
   (the state at a cut is how many characters the piece across it reaches over);
2. max-plus products of the matrices give every chunk's entry scores;
3. each chunk maps its exit states to entry states, and the maps are composed from the
   text's end; 4. each chunk is backtraced from its exit state alone.

Defined results: a null text has null ids and decodes to null; an empty one has none;
repeated rows and null ids are encoded like others; an empty table gives an empty result;
input columns are carried by position, so none can clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.llm.common import map_arrow, materialize, slices, utf8

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
GIANT, CHUNK = 1 << 16, 1 << 12
NEVER = -(1 << 61)
SPACE = 0x2581
ROWS = 1 << 17                  # characters whose pieces are looked up at once


@dataclass(frozen=True)
class Vocabulary:
    """Pieces with integer scores; byte pieces by value."""
    key: str
    pieces: tuple[tuple[str, int, int], ...]       # (piece, score, id)
    byte_ids: tuple[int, ...]
    surface: tuple[bytes, ...]                     # bytes of every id when decoded

    @classmethod
    def load(cls, path: str = MODEL) -> Vocabulary:
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=path)
        n, byte_ids, pieces, surface = sp.get_piece_size(), [0] * 256, [], []
        scores = [sp.get_score(i) for i in range(n)]
        scale = 1 if all(x == int(x) for x in scores) else 1024
        for i in range(n):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                byte_ids[int(piece[3:5], 16)] = i
                surface.append(bytes([int(piece[3:5], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                surface.append(b"")
            else:
                pieces.append((piece, round(scores[i] * scale), i))
                surface.append(piece.replace("▁", " ").encode())
        return cls(f"{path}:{n}", tuple(pieces), tuple(byte_ids), tuple(surface))


class Trie:
    """Pieces by code points. Children sit in one open-addressed hash table that is looked
    up for many (node, character) pairs at once."""

    def __init__(self, vocab: Vocabulary):
        child: dict[tuple[int, int], int] = {}
        piece, score = [-1, -1], [NEVER, NEVER]    # node 0: no match, node 1: the root
        for text, points, ident in vocab.pieces:
            node = 1
            for c in text:
                nxt = child.get((node, ord(c)))
                if nxt is None:
                    nxt = child[(node, ord(c))] = len(piece)
                    piece.append(-1)
                    score.append(NEVER)
                node = nxt
            piece[node], score[node] = ident, points
        self.unknown = len(piece)
        piece.append(-2)
        score.append(min(p[1] for p in vocab.pieces) - 10)
        self.piece, self.score = np.array(piece, np.int32), np.array(score, np.int64)
        self.depth = max(len(p[0]) for p in vocab.pieces)
        self.bits = (2 * len(child)).bit_length()
        self.keys, self.to, self.reach = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, np.int32), 0
        keys = np.array([n << 21 | c for n, c in child], np.int64)
        to, at, tries = np.array(list(child.values()), np.int32), self._slot(keys), 0
        while len(keys):
            free = self.keys[at] < 0
            _, first = np.unique(at, return_index=True)
            take = np.zeros(len(at), bool)
            take[first] = True
            take &= free
            self.keys[at[take]], self.to[at[take]] = keys[take], to[take]
            keys, to, at = keys[~take], to[~take], (at[~take] + 1) & ((1 << self.bits) - 1)
            tries += 1
        self.reach = tries
        self.byte_ids = np.array(vocab.byte_ids, np.int32)
        self.surface = np.frombuffer(b"".join(vocab.surface), np.uint8)
        self.surface_len = np.array([len(x) for x in vocab.surface], np.int64)
        self.surface_at = np.concatenate([[0], np.cumsum(self.surface_len)])

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def step(self, node: np.ndarray, char: np.ndarray) -> np.ndarray:
        keys = node.astype(np.int64) << 21 | char
        at, out = self._slot(keys), np.zeros(len(keys), np.int32)
        todo = np.arange(len(keys))
        for _ in range(self.reach):
            held = self.keys[at]
            hit = held == keys
            out[todo[hit]] = self.to[at[hit]]
            more = ~hit & (held >= 0)
            if not more.any():
                break
            todo, keys, at = todo[more], keys[more], (at[more] + 1) & ((1 << self.bits) - 1)
        return out

    def lattice(self, codes: np.ndarray) -> np.ndarray:
        """[i, d]: node of the piece codes[i : i+d+1], 0 if there is none. Characters below
        0 end every piece; one without a piece of its own is the unknown node."""
        out = np.zeros((len(codes), self.depth), np.int32)
        padded = np.concatenate([codes, np.full(self.depth, -1, codes.dtype)])
        live, node = np.flatnonzero(codes >= 0), None
        for d in range(self.depth):
            char = padded[live + d]
            ok = char >= 0
            live, char = live[ok], char[ok]
            node = self.step(np.ones(len(live), np.int32) if node is None else node[ok], char)
            ok = node > 0
            live, node = live[ok], node[ok]
            if not len(live):
                break
            out[live, d] = np.where(self.piece[node] >= 0, node, 0)
        out[(out[:, 0] == 0) & (codes >= 0), 0] = self.unknown
        return out


_TRIES: dict[str, Trie] = {}


def trie_of(vocab: Vocabulary) -> Trie:
    if vocab.key not in _TRIES:
        _TRIES[vocab.key] = Trie(vocab)
    return _TRIES[vocab.key]


def code_points(data: bytes) -> np.ndarray:
    """Characters with spaces as U+2581; a literal U+2581 as a number no piece has."""
    c = np.frombuffer(data.decode().encode("utf-32-le"), np.uint32).astype(np.int32)
    return np.where(c == 0x20, SPACE, np.where(c == SPACE, 0x110000, c))


def forward(trie: Trie, lattice: np.ndarray, start: np.ndarray, size: np.ndarray, entry: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best score and last piece's length at every position of each lane. Lanes lie at
    ``start`` in the lattice, longest first; ``entry[lane, a]`` is the score of standing at
    ``a`` before any piece of the lane. Pieces may reach up to ``depth - 1`` over the end."""
    depth, longest = trie.depth, int(size.max(initial=0))
    best = np.full((len(start), longest + depth + 1), NEVER, np.int64)
    best[:, : entry.shape[1]] = entry
    back, lens = np.zeros(best.shape, np.uint8), np.arange(1, depth + 1, dtype=np.uint8)
    lanes = np.searchsorted(-size, -np.arange(longest), side="left")     # lanes longer than t
    for t in range(longest):
        m = lanes[t]
        got = best[:m, t, None] + trie.score[lattice[start[:m] + t]]
        place = best[:m, t + 1: t + 1 + depth]
        better = got > place
        np.copyto(place, got, where=better)
        np.copyto(back[:m, t + 1: t + 1 + depth], lens, where=better)
    return best, back


def backtrace(back: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(lane, start, length) of the pieces on each lane's best path to ``end`` in order, and
    where each path begins."""
    lane, pos, found = np.arange(len(end)), end.copy(), []
    origin = end.copy()
    while len(lane):
        n = back[lane, pos].astype(np.int64)
        done = n == 0
        origin[lane[done]] = pos[done]
        lane, pos, n = lane[~done], pos[~done], n[~done]
        pos = pos - n
        found.append((lane, pos, n))
    lane, pos, n = (np.concatenate([f[i] for f in found]) if found else np.zeros(0, np.int64) for i in range(3))
    order = np.lexsort((pos, lane))
    return lane[order], pos[order], n[order], origin


def spell(trie: Trie, codes: np.ndarray, nodes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the pieces ``nodes`` standing at ``at``, unknown characters as bytes; and the
    number of ids of each piece."""
    unknown = np.flatnonzero(nodes == trie.unknown)
    count = np.ones(len(nodes), np.int64)
    if not len(unknown):
        return trie.piece[nodes], count
    c = codes[at[unknown]]
    chars = np.where(c == 0x110000, SPACE, c)
    raw = np.frombuffer("".join(map(chr, chars.tolist())).encode(), np.uint8)
    count[unknown] = 1 + (chars > 0x7F) + (chars > 0x7FF) + (chars > 0xFFFF)
    ids = np.repeat(trie.piece[nodes], count)
    ids[np.repeat(nodes == trie.unknown, count)] = trie.byte_ids[raw]
    return ids, count


def encode_units(trie: Trie, data: bytes, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all units, one after the other, and each unit's bounds in them."""
    raw = np.frombuffer(data, np.uint8)
    chars = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])[offsets]
    codes, size = code_points(data), np.diff(chars)
    lanes = np.argsort(-size, kind="stable")
    ids, counts = [None] * len(lanes), np.zeros(len(lanes), np.int64)
    cut = np.searchsorted(np.cumsum(size[lanes] + 1), np.arange(ROWS, int(size.sum()) + len(size) + ROWS, ROWS), side="right")
    out_ids, out_lane = [], []
    for a, b in zip(np.concatenate([[0], cut[:-1]]), cut):
        mine = lanes[a:b]
        if b <= a:
            continue
        n = size[mine]
        first = np.concatenate([[0], np.cumsum(n + 1)])[:-1]
        flat = np.full(int((n + 1).sum()), -1, np.int32)
        pick = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        flat[np.repeat(first, n) + pick] = codes[np.repeat(chars[mine], n) + pick]
        lattice = trie.lattice(flat)
        _, back = forward(trie, lattice, first, n, np.zeros((len(mine), 1), np.int64))
        lane, pos, length, _ = backtrace(back, n)
        at = first[lane] + pos
        got, count = spell(trie, flat, lattice[at, length - 1], at)
        out_ids.append(got)
        out_lane.append(np.repeat(mine[lane], count))
    if not out_ids:
        return np.zeros(0, np.int32), np.zeros(len(size) + 1, np.int64)
    flat_ids, lane = np.concatenate(out_ids), np.concatenate(out_lane)
    counts = np.bincount(lane, minlength=len(size))
    order = np.argsort(lane, kind="stable")
    return flat_ids[order], np.concatenate([[0], np.cumsum(counts)])


def encode_slice(trie: Trie, column: pa.Array) -> pa.Array:
    """The texts' ids as a list column."""
    data, off = utf8(column)
    some = np.diff(off) > 0
    data = np.insert(data, off[:-1][some], 0x20)
    off = off + np.concatenate([[0], np.cumsum(some)])
    n = len(data)
    begin = np.zeros(n, bool)
    begin[1:] = (data[1:] == 0x20) & (data[:-1] != 0x20)
    begin[off[:-1][some]] = True
    starts = np.flatnonzero(begin)
    bounds = np.append(starts, n)
    units = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds.tobytes()), pa.py_buffer(data.tobytes())])
    coded = units.dictionary_encode()
    which = np.asarray(coded.indices).astype(np.int64)
    distinct, at = utf8(coded.dictionary.cast(pa.large_string()))
    ids, first = encode_units(trie, distinct.tobytes(), at)
    count = np.diff(first)[which]
    end = np.concatenate([[0], np.cumsum(count)])
    flat = ids[np.repeat(first[which] - end[:-1], count) + np.arange(end[-1])] if len(which) else ids
    offsets = end[np.searchsorted(starts, off)]
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat, pa.int32()),
                                    mask=column.is_null() if column.null_count else None)


def decode_slice(trie: Trie, column: pa.ListArray) -> pa.Array:
    """The texts of a list column of ids."""
    flat = np.asarray(column.flatten())
    count = np.asarray(column.value_lengths().fill_null(0)).astype(np.int64)
    n = trie.surface_len[flat]
    end = np.concatenate([[0], np.cumsum(n)])
    raw = trie.surface[np.repeat(trie.surface_at[flat] - end[:-1], n) + np.arange(end[-1])]
    off = end[np.concatenate([[0], np.cumsum(count)])]
    some = np.diff(off) > 0
    raw = np.delete(raw, off[:-1][some])                   # the space put in front
    off = off - np.concatenate([[0], np.cumsum(some)])
    text = pa.LargeStringArray.from_buffers(len(column), pa.py_buffer(off.astype(np.int64).tobytes()), pa.py_buffer(raw.tobytes()))
    text = text.cast(pa.string())
    return pc.if_else(column.is_valid(), text, pa.scalar(None, pa.string())) if column.null_count else text


# --- giant texts ----------------------------------------------------------------------

def chunk_rows(giants: DataFrame, chunk: int, reach: int) -> DataFrame:
    """``k1, k2, part, parts, core, ahead``: each text's chunks, every one with the characters a
    piece from it may reach into, dealt over the cluster."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                text = "\x20" + b.column(2)[i].as_py()
                parts = -(-len(text) // chunk)
                for a in range(0, parts, 256):
                    p = range(a, min(a + 256, parts))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([b.column(0)[i].as_py()] * len(p), pa.int64()), pa.array([b.column(1)[i].as_py()] * len(p), pa.int64()),
                         pa.array(p, pa.int32()), pa.array([parts] * len(p), pa.int32()),
                         pa.array([text[x * chunk: (x + 1) * chunk] for x in p], pa.string()),
                         pa.array([text[(x + 1) * chunk: (x + 1) * chunk + reach] for x in p], pa.string())],
                        ["k1", "k2", "part", "parts", "core", "ahead"])

    rows = map_arrow(giants, run, "k1 long, k2 long, part int, parts int, core string, ahead string")
    return materialize(rows.distinct().repartition("k1", "k2", "part"), "sp-chunks")


def _lanes(trie: Trie, core: list[str], ahead: list[str]):
    """Lattice over the chunks' characters (pieces start in the cores only), starts, sizes,
    and the chunks' order, longest first."""
    order = np.argsort([-len(c) for c in core], kind="stable")
    size = np.array([len(core[i]) for i in order], np.int64)
    codes = [np.append(code_points((core[i] + ahead[i]).encode()), -1) for i in order]
    start = np.concatenate([[0], np.cumsum([len(c) for c in codes])])[:-1]
    flat = np.concatenate(codes).astype(np.int32)
    return flat, trie.lattice(flat), start, size, order


def transfer_matrices(trie: Trie, core: list[str], ahead: list[str]) -> np.ndarray:
    """[chunk, entry, exit]: best scores, from ``entry`` characters behind the chunk's start
    to ``exit`` characters behind its end."""
    d = trie.depth
    _, lattice, start, size, order = _lanes(trie, core, ahead)
    entry = np.where(np.eye(d, dtype=bool), 0, NEVER)
    best, _ = forward(trie, lattice, np.repeat(start, d), np.repeat(size, d), np.tile(entry, (len(order), 1)))
    out = np.empty((len(order), d, d), np.int64)
    at = np.repeat(size, d)[:, None] + np.arange(d)
    out[order] = np.maximum(np.take_along_axis(best, at, axis=1), NEVER).reshape(-1, d, d)
    return out


def max_plus(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Associative product of transfer matrices."""
    return np.maximum((a[:, :, None] + b[None, :, :]).max(axis=1), NEVER)


def giant_ids(giants: DataFrame, vocab: Vocabulary, chunk: int = CHUNK) -> DataFrame:
    """``k1, k2, ids`` of giant texts ``(k1, k2, text)``."""
    depth = max(len(p[0]) for p in vocab.pieces)
    chunks = chunk_rows(giants, chunk, depth - 1)
    key = ["k1", "k2"]

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = trie_of(vocab)
        for b in batches:
            for a in range(0, b.num_rows, 32):
                p = b.slice(a, 32)
                m = transfer_matrices(trie, p.column("core").to_pylist(), p.column("ahead").to_pylist())
                yield pa.RecordBatch.from_arrays([*(p.column(c) for c in ("k1", "k2", "part")),
                                                  pa.array([x.tobytes() for x in m], pa.binary())], ["k1", "k2", "part", "m"])

    def entries(group: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = {p: x for b in batches for p, x in zip(b.column("part").to_pylist(), b.column("m").to_pylist())}
        v, out = np.where(np.arange(depth) == 0, 0, NEVER)[None, :], []
        for p in sorted(m):
            out.append(v.tobytes())
            v = max_plus(v, np.frombuffer(m[p], np.int64).reshape(depth, depth))
        yield pa.RecordBatch.from_arrays([*(pa.array([g.as_py()] * len(m), pa.int64()) for g in group),
                                          pa.array(sorted(m), pa.int32()), pa.array(out, pa.binary())], ["k1", "k2", "part", "v"])

    def run_chunks(p: pa.RecordBatch):
        trie = trie_of(vocab)
        flat, lattice, start, size, order = _lanes(trie, p.column("core").to_pylist(), p.column("ahead").to_pylist())
        v = np.stack([np.frombuffer(p.column("v")[int(i)].as_py(), np.int64) for i in order])
        best, back = forward(trie, lattice, start, size, v)
        return trie, flat, lattice, start, size, order, best, back

    def arrivals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a in range(0, b.num_rows, 128):
                p = b.slice(a, 128)
                _, _, _, _, size, order, best, back = run_chunks(p)
                out = np.empty((len(order), depth), np.uint8)
                for x in range(depth):
                    end = np.where(best[np.arange(len(size)), size + x] > NEVER, size + x, 0)
                    out[order, x] = backtrace(back, end)[3]
                yield pa.RecordBatch.from_arrays([*(p.column(c) for c in ("k1", "k2", "part")),
                                                  pa.array([x.tobytes() for x in out], pa.binary())], ["k1", "k2", "part", "m"])

    def exits(group: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = {p: x for b in batches for p, x in zip(b.column("part").to_pylist(), b.column("m").to_pylist())}
        state, out = 0, []
        for p in sorted(m, reverse=True):
            out.append(state)
            state = m[p][state]
        yield pa.RecordBatch.from_arrays([*(pa.array([g.as_py()] * len(m), pa.int64()) for g in group),
                                          pa.array(sorted(m), pa.int32()), pa.array(out[::-1], pa.int32())], ["k1", "k2", "part", "leave"])

    def ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a in range(0, b.num_rows, 128):
                p = b.slice(a, 128)
                trie, flat, lattice, start, size, order, _, back = run_chunks(p)
                leave = np.asarray(p.column("leave"))[order]
                lane, pos, n, _ = backtrace(back, size + leave)
                at = start[lane] + pos
                got, count = spell(trie, flat, lattice[at, n - 1], at)
                owner = np.repeat(order[lane], count)
                by = np.argsort(owner, kind="stable")
                off = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(order)))])
                lists = pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(got[by], pa.int32()))
                yield pa.RecordBatch.from_arrays([*(p.column(c) for c in ("k1", "k2", "part")), lists], ["k1", "k2", "part", "ids"])

    m = map_arrow(chunks, matrices, "k1 long, k2 long, part int, m binary")
    v = materialize(m.groupBy(*key).applyInArrow(entries, "k1 long, k2 long, part int, v binary"), "sp-entries")
    entered = chunks.join(v, [*key, "part"])
    maps = map_arrow(entered, arrivals, "k1 long, k2 long, part int, m binary")
    leave = materialize(maps.groupBy(*key).applyInArrow(exits, "k1 long, k2 long, part int, leave int"), "sp-exits")
    pieces = map_arrow(entered.join(leave, [*key, "part"]), ids, "k1 long, k2 long, part int, ids array<int>")
    return pieces.groupBy(*key).agg(F.flatten(F.transform(
        F.sort_array(F.collect_list(F.struct("part", "ids"))), lambda x: x["ids"])).alias("ids"))


# --- tables -----------------------------------------------------------------------------

def encode(docs: DataFrame, vocab: Vocabulary | None = None, giant: int = GIANT, chunk: int = CHUNK) -> DataFrame:
    """The input columns as ``c0, c1, ...`` plus ``ids array<int>``."""
    vocab = vocab or Vocabulary.load()
    names, text = docs.columns, docs.columns.index("text")
    df = docs.toDF(*[f"c{i}" for i in range(len(names))])
    col, long_text = F.col(f"c{text}"), F.coalesce(F.octet_length(F.col(f"c{text}")), F.lit(0)) > giant
    out = T.StructType([*df.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType(), False))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = trie_of(vocab)
        for b in slices(batches, f"c{text}", 4 << 20):
            cols = [*b.columns, encode_slice(trie, b.column(text))]
            yield pa.RecordBatch.from_arrays(cols, [f.name for f in out.fields])

    short = map_arrow(df.filter(~long_text), run, out)
    giants = df.filter(long_text).withColumns({"k1": F.xxhash64(col, F.length(col)), "k2": F.xxhash64(F.lit("sp"), col)})
    found = giant_ids(giants.select("k1", "k2", col.alias("text")).distinct(), vocab, chunk)
    return short.unionByName(giants.join(found, ["k1", "k2"]).drop("k1", "k2"))


def decode(encoded: DataFrame, vocab: Vocabulary | None = None, column: str = "ids") -> DataFrame:
    """``encoded`` plus ``decoded``, the text of the id column."""
    vocab = vocab or Vocabulary.load()
    out = T.StructType([*encoded.schema.fields, T.StructField("decoded", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = trie_of(vocab)
        for b in batches:
            for a in range(0, b.num_rows, 1024):
                p = b.slice(a, 1024)
                yield pa.RecordBatch.from_arrays([*p.columns, decode_slice(trie, p.column(column))], [f.name for f in out.fields])

    return map_arrow(encoded, run, out)


def round_trip(docs: DataFrame, vocab: Vocabulary | None = None, giant: int = GIANT, chunk: int = CHUNK) -> DataFrame:
    """``encode`` plus ``round_trip``: whether decoding the ids gives the text again. A text is
    encoded, decoded and compared in one pass, so no decoded text leaves its task."""
    vocab = vocab or Vocabulary.load()
    names, text = docs.columns, docs.columns.index("text")
    df = docs.toDF(*[f"c{i}" for i in range(len(names))])
    col = F.col(f"c{text}")
    long_text = F.coalesce(F.octet_length(col), F.lit(0)) > giant
    out = T.StructType([*df.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType(), False)),
                        T.StructField("round_trip", T.BooleanType())])
    columns = [f.name for f in out.fields]

    def checked(b: pa.RecordBatch, ids: pa.Array, trie: Trie) -> pa.RecordBatch:
        back, given = decode_slice(trie, ids), b.column(text)
        both_null = pc.and_(pc.is_null(back), pc.is_null(given))
        same = pc.or_(pc.fill_null(pc.equal(back.cast(pa.string()), given.cast(pa.string())), False), both_null)
        return pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(names))), ids, same], columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = trie_of(vocab)
        for b in slices(batches, f"c{text}"):
            yield checked(b, encode_slice(trie, b.column(text)), trie)

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = trie_of(vocab)
        for b in batches:
            for i in range(b.num_rows):         # giant texts one by one
                yield checked(b.slice(i, 1), b.column("ids").slice(i, 1), trie)

    short = map_arrow(df.filter(~long_text), run, out)
    giants = df.filter(long_text).withColumns({"k1": F.xxhash64(col, F.length(col)), "k2": F.xxhash64(F.lit("sp"), col)})
    found = giant_ids(giants.select("k1", "k2", col.alias("text")).distinct(), vocab, chunk)
    return short.unionByName(map_arrow(giants.join(found, ["k1", "k2"]).drop("k1", "k2"), check, out))
