"""Byte-level BPE: boundaries by transition-function scans over code point classes, cached pair merging, and decoding.

The published split pattern 's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+ is a
finite automaton over nine symbols: the code point's class, and for white space and apostrophes what follows. Every
symbol is a function from states to states. The functions that compositions give are few, so that they are numbered
and composed through a table; a blocked scan of that associative operation gives the state before every character,
and state and symbol tell whether a token starts there.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, map_batches, slices

L, N, O, K1, K2, SPL, WSL, WSM, END = range(9)
FRESH, IN_L, IN_N, IN_O, AFTER_SPACE, ONE_LEFT, TWO_LEFT, IN_WS = range(8)
SENTINEL = 0x110000
BLOCK = 64
#: Code points with the property White_Space (fixed values of the Unicode standard).
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


def _step(state: int, symbol: int) -> tuple[int, bool]:
    """Next state, and whether a token starts at this symbol."""
    if symbol == L:
        if state in (ONE_LEFT, TWO_LEFT):
            return (FRESH if state == ONE_LEFT else ONE_LEFT), False
        return IN_L, state not in (IN_L, AFTER_SPACE)
    if symbol == N:
        return IN_N, state not in (IN_N, AFTER_SPACE)
    if symbol in (O, K1, K2):
        if state in (IN_O, AFTER_SPACE):
            return IN_O, False
        return {O: IN_O, K1: ONE_LEFT, K2: TWO_LEFT}[symbol], True
    if symbol == SPL:
        return AFTER_SPACE, True
    if symbol == WSM:
        return IN_WS, state != IN_WS
    return FRESH, True


def _monoid() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the functions that the symbols generate: composition table, values at each state, and each symbol's number."""
    basic = [tuple(_step(q, s)[0] for q in range(8)) for s in range(9)]
    found = {tuple(range(8)): 0}
    todo = list(found)
    for f in todo:
        for g in basic:
            if (h := tuple(g[q] for q in f)) not in found:
                found[h] = len(found)
                todo.append(h)
    n = len(found)
    then = np.zeros((n, n), np.uint8)
    for f, i in found.items():
        for g, j in found.items():
            then[i, j] = found[tuple(g[q] for q in f)]
    return then, np.array(list(found), np.uint8), np.array([found[f] for f in basic], np.uint8)


THEN, VALUE, NUMBER = _monoid()
STARTS = np.array([[_step(q, s)[1] for s in range(9)] for q in range(8)])


def scan(f: np.ndarray) -> np.ndarray:
    """Inclusive scan of function numbers under composition, by blocks and then over the blocks' totals."""
    if len(f) <= BLOCK:
        out = f.copy()
        for i in range(1, len(f)):
            out[i] = THEN[out[i - 1], f[i]]
        return out
    rows = -(-len(f) // BLOCK)
    grid = np.zeros(rows * BLOCK, np.uint8)
    grid[: len(f)] = f
    grid = np.ascontiguousarray(grid.reshape(rows, BLOCK).T)
    flat, n = THEN.ravel(), np.uint16(len(THEN))
    for i in range(1, BLOCK):
        np.take(flat, grid[i - 1] * n + grid[i], out=grid[i])
    before = np.zeros(rows, np.uint8)
    before[1:] = scan(grid[-1])[:-1]
    np.take(flat, before * n + grid, out=grid)
    return grid.T.reshape(-1)[: len(f)]


@lru_cache(1)
def classes() -> np.ndarray:
    """Symbol of every code point, white space as WSL; the sentinel is last."""
    of = {"L": L, "N": N}
    out = np.fromiter((of.get(unicodedata.category(c)[0], O) for c in map(chr, range(SENTINEL))), np.uint8, SENTINEL)
    out[WHITE_SPACE] = WSL
    return np.append(out, np.uint8(END))


def token_starts(points: np.ndarray) -> np.ndarray:
    """Of code points, texts each ended by the sentinel: whether a token starts there (a sentinel always does)."""
    symbols = classes()[points]
    nxt = np.append(points[1:], SENTINEL).astype(np.int32)
    after = np.append(symbols[1:], np.uint8(END))
    white = symbols == WSL
    symbols[white & ((after == WSL) | (after == END))] = WSM
    symbols[white & (points == 0x20) & (symbols == WSL)] = SPL
    at = np.flatnonzero(points == 0x27)
    if len(at):
        one, two = nxt[at], np.append(nxt[1:], SENTINEL)[at]
        symbols[at[np.isin(one, [ord(c) for c in "stmd"])]] = K1
        pairs = (((one == ord("r")) | (one == ord("v"))) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
        symbols[at[pairs]] = K2
    states = VALUE[scan(NUMBER[symbols]), FRESH]
    before = np.empty_like(states)
    before[:1], before[1:] = FRESH, states[:-1]
    return STARTS[before, symbols]


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a piece: adjacent parts of the least rank are merged first, the leftmost of equals, until none can be."""
    if (whole := ranks.get(piece)) is not None:
        return [whole]
    if len(piece) > 256:
        return _merge_long(piece, ranks)
    parts = [piece[i : i + 1] for i in range(len(piece))]
    none = sys.maxsize
    pair = [ranks.get(piece[i : i + 2], none) for i in range(len(piece) - 1)]
    while pair and (least := min(pair)) != none:
        i = pair.index(least)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
        del pair[i]
        if i < len(pair):
            pair[i] = ranks.get(parts[i] + parts[i + 1], none)
        if i:
            pair[i - 1] = ranks.get(parts[i - 1] + parts[i], none)
    return [ranks[p] for p in parts]


def _merge_long(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same for long pieces, with a heap of pairs over linked parts: n log n."""
    n = len(piece)
    end, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n  # a part is named by its first byte
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, e = heapq.heappop(heap)
        if not alive[i] or (j := end[i]) >= n or end[j] != e:
            continue  # a part of this pair has grown since
        alive[j], end[i] = False, e
        if e < n:
            before[e] = i
            if (r := ranks.get(piece[i : end[e]])) is not None:
                heapq.heappush(heap, (r, i, end[e]))
        if (p := before[i]) >= 0 and (r := ranks.get(piece[p:e])) is not None:
            heapq.heappush(heap, (r, p, e))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


class _Cache(dict):
    """Piece to its ids as little-endian 32-bit integers; keeps the newest entries, `most` to twice as many."""

    def __init__(self, ranks: dict[bytes, int], most: int = 100_000):
        super().__init__()
        self.ranks, self.most, self.old = ranks, most, {}

    def __missing__(self, piece: bytes) -> bytes:
        if (ids := self.old.get(piece)) is None:
            ids = np.array(merge(piece, self.ranks), "<u4").tobytes()
        if len(piece) <= 64:
            if len(self) >= self.most:
                self.old = dict(self)
                self.clear()
            self[piece] = ids
        return ids


class Tokenizer:
    """Encodes and decodes with the ranks of one file (lines of base64 bytes and rank)."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.cache = _Cache(self.ranks)
        words = sorted(self.ranks.items(), key=lambda x: x[1])
        self.sizes = np.zeros(words[-1][1] + 1, np.int64)
        for w, r in words:
            self.sizes[r] = len(w)
        self.ends = np.cumsum(self.sizes)
        self.data = np.frombuffer(b"".join(w for w, _ in words), np.uint8)

    def encode(self, texts: list[bytes]) -> Iterator[bytes]:
        """Ids of each UTF-8 text as little-endian 32-bit integers; none for an empty text. Bytes that aren't UTF-8 are
        taken as the replacement character. Of equal ranks the leftmost pair is merged first."""
        joined = b"\n".join(texts) + b"\n"
        points = np.frombuffer(joined.decode("utf-8", "replace").encode("utf-32-le", "replace"), "<i4").copy()
        width = 1 + (points >= 0x80).astype(np.int8) + (points >= 0x800) + (points >= 0x10000)
        at = np.cumsum(width, dtype=np.int64) - width
        size = len(joined)
        ends = np.cumsum([len(x) + 1 for x in texts]) - 1  # bytes of the separators
        if at[-1] + 1 != size:  # not UTF-8: as the decoder reads it
            yield from self.encode([x.decode("utf-8", "replace").encode() for x in texts])
            return
        points[np.searchsorted(at, ends)] = SENTINEL
        cuts = at[token_starts(points)]
        first = np.searchsorted(cuts, ends).tolist()  # of each text's separator among the tokens
        cuts = [*cuts.tolist(), size]
        ids = self.cache
        start = 0
        for stop in first:
            yield b"".join([ids[joined[a:b]] for a, b in zip(cuts[start:stop], cuts[start + 1 : stop + 1])])
            start = stop + 1

    def offsets(self, ids: np.ndarray) -> np.ndarray:
        """Byte offset of each id's bytes in the text, and the text's size at the end."""
        return np.concatenate([[0], np.cumsum(self.sizes[ids])])

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes that the ids stand for."""
        size, to = self.sizes[ids], self.offsets(ids)
        return self.data[np.repeat(self.ends[ids] - size - to[:-1], size) + np.arange(to[-1])].tobytes()


@lru_cache(4)
def tokenizer(path: str) -> Tokenizer:
    return Tokenizer(path)


def _each(b: pa.RecordBatch, path: str) -> Iterator[tuple[pa.Array, list[bytes]]]:
    """Slices of a batch of (key, text): keys, and each text's ids."""
    text, t = as_bytes(b.column(1)), tokenizer(path)
    for i, j in slices(text, 2_000_000):
        yield b.column(0).slice(i, j - i), list(t.encode([x or b"" for x in text.slice(i, j - i).to_pylist()]))


def encode(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids array<int>, offsets array<int>): token ids of whole texts and the byte offset of each; null as empty."""

    def run(b: pa.RecordBatch):
        t = tokenizer(path)
        for keys, blobs in _each(b, path):
            ids = [np.frombuffer(x, "<u4") for x in blobs]
            yield pa.RecordBatch.from_arrays(
                [keys, pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32())), pa.array([t.offsets(x)[:-1].astype(np.int32) for x in ids], pa.list_(pa.int32()))],
                ["doc_id", "ids", "offsets"],
            )

    return map_batches(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, "doc_id long, ids array<int>, offsets array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, text binary) from (doc_id, ids); null ids give null."""

    def run(b: pa.RecordBatch):
        t = tokenizer(path)
        texts = [None if x is None else t.decode(np.asarray(x, np.int64)) for x in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.binary())], ["doc_id", "text"])

    return map_batches(encoded.select("doc_id", "ids"), run, "doc_id long, text binary")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of encoding whole texts and decoding the ids again.

    Null texts count as empty: no tokens. Repeated rows stay repeated; other columns are ignored; a text's time grows
    with n log n at worst, and texts are handled in slices of about 2 MB besides single longer ones.
    """

    def run(b: pa.RecordBatch):
        t = tokenizer(path)
        for keys, blobs in _each(b, path):
            out = [(len(x) // 4, hashlib.sha256(x).hexdigest(), hashlib.sha256(t.decode(np.frombuffer(x, "<u4"))).hexdigest()) for x in blobs]
            yield pa.RecordBatch.from_arrays([keys, *(pa.array(c) for c in zip(*out))], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return map_batches(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
