"""Byte-level BPE encoding and decoding (operator 9).

Pre-tokens are found without a regular expression. Every code point becomes a symbol (its class,
with one or two characters of look-ahead folded in); a symbol is a transition function over eight
states, and because composing functions is associative, the state in front of every character
comes from a scan of function compositions over the whole Arrow batch at once. The monoid that the
symbols generate is small, so a composition is one table look-up. The slices between boundaries
feed a cached pair merger that handles all words it has not met yet as matrices.

Nulls are empty texts; an empty text has no ids. Repeated rows each get their own row. Columns
other than the id and the text are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, ready, texts, tidy

# ---- fixed values: White_Space code points ------------------------------------------------
WHITE_SPACE = [
    *range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
]
# -------------------------------------------------------------------------------------------

LETTER, NUMBER, OTHER, SPACE = range(4)
#: Symbols: separator of texts, the classes, and the cases that need look-ahead.
SEP, SYM_L, SYM_N, SYM_O, SPACE_IN, BLANK_LAST, SPACE_LAST, APOS_1, APOS_2 = range(9)
#: States: next character starts a token; after a lone blank that joins; in a run; owing 1 or 2 letters.
FREE, BLANK, IN_L, IN_N, IN_O, IN_S, OWES_1, OWES_2 = range(8)
BLOCK = 128
#: Words up to this many bytes are merged as matrix rows, longer ones with a heap.
MATRIX_MAX = 40
CACHE_MAX = 400_000


@lru_cache(1)
def class_table() -> np.ndarray:
    """Class of every code point."""
    import unicodedata

    kinds = {"L": LETTER, "N": NUMBER}
    table = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), np.uint8, 0x110000)
    table[WHITE_SPACE] = SPACE
    return table


@lru_cache(1)
def automaton() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(next state, is boundary) by (symbol, state); the monoid's functions; its composition table."""
    step = np.zeros((9, 8), np.uint8)
    cut = np.ones((9, 8), bool)
    for sym, run in ((SYM_L, IN_L), (SYM_N, IN_N), (SYM_O, IN_O), (SPACE_IN, IN_S)):
        step[sym, :] = run
        cut[sym, run] = False
        if sym != SPACE_IN:
            cut[sym, BLANK] = False
    step[SYM_L, OWES_1], step[SYM_L, OWES_2] = FREE, OWES_1
    cut[SYM_L, [OWES_1, OWES_2]] = False
    step[BLANK_LAST, :], step[SPACE_LAST, :], step[SEP, :] = BLANK, FREE, FREE
    for sym, owes in ((APOS_1, OWES_1), (APOS_2, OWES_2)):
        step[sym, :] = owes
        step[sym, [IN_O, BLANK]] = IN_O
        cut[sym, [IN_O, BLANK]] = False
    found = {tuple(range(8)): 0}  # the identity, then the symbols, then their products
    for row in step:
        found.setdefault(tuple(map(int, row)), len(found))
    todo = list(found)
    while todo:
        f = todo.pop()
        for row in step:
            h = tuple(int(row[s]) for s in f)
            if h not in found:
                found[h] = len(found)
                todo.append(h)
    functions = np.array(list(found), np.uint8)
    ids = {f: i for i, f in enumerate(map(tuple, functions.tolist()))}
    composed = np.array([[ids[tuple(g[s] for s in f)] for g in functions.tolist()] for f in functions.tolist()], np.uint16)
    of_symbol = np.array([ids[tuple(map(int, row))] for row in step], np.uint16)
    return cut, functions, composed, of_symbol


def symbols(points: np.ndarray, separators: np.ndarray) -> np.ndarray:
    """Symbols of code points; ``separators`` are the places between texts."""
    kind = class_table()[points]
    kind[separators] = SPACE  # a text's trailing white space is one run
    after = np.append(kind[1:], SPACE)
    sym = kind + np.uint8(SYM_L)
    space = kind == SPACE
    last = space & (after != SPACE)
    sym[last] = SPACE_LAST
    sym[last & (points == 0x20)] = BLANK_LAST
    at = np.flatnonzero(points == 0x27)
    if len(at):
        padded = np.concatenate([points, np.zeros(2, points.dtype)])
        one, two = padded[at + 1], padded[at + 2]
        sym[at[np.isin(one, np.array([ord(c) for c in "stmd"]))]] = APOS_1
        for a, b in ("re", "ve", "ll"):
            sym[at[(one == ord(a)) & (two == ord(b))]] = APOS_2
    sym[separators] = SEP
    return sym


def boundaries(points: np.ndarray, separators: np.ndarray) -> np.ndarray:
    """True where a pre-token starts, by blocked prefix scan over transition functions."""
    cut, functions, composed, of_symbol = automaton()
    n = len(points)
    sym = symbols(points, separators)
    rows = -(-n // BLOCK)
    padded = np.full(rows * BLOCK, SEP, np.uint8)
    padded[:n] = sym
    by_column = np.ascontiguousarray(padded.reshape(rows, BLOCK).T)
    width = len(functions)
    flat = composed.reshape(-1)
    before = np.empty((BLOCK, rows), np.uint16)  # function from the block's start to in front of a character
    acc = np.zeros(rows, np.uint16)
    for j in range(BLOCK):
        before[j] = acc
        acc = flat[acc.astype(np.int32) * width + of_symbol[by_column[j]]]
    total, shift = acc, 1  # inclusive scan over the blocks by doubling
    while shift < rows:
        ahead = total.copy()
        ahead[shift:] = flat[total[:-shift].astype(np.int32) * width + total[shift:]]
        total, shift = ahead, shift * 2
    enter = np.empty(rows, np.uint8)
    enter[0] = FREE
    enter[1:] = functions[total[:-1], FREE]
    state = functions.reshape(-1)[before.astype(np.int32) * 8 + enter]
    starts = cut.reshape(-1)[by_column.astype(np.int32) * 8 + state]
    return np.ascontiguousarray(starts.T).reshape(-1)[:n]


def pretokens(strings: list[str]) -> list[list[str]]:
    """The pre-tokens of each text, in order; joined they give the text."""
    joined = "\0".join(strings)
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    if not len(points):
        return [[] for _ in strings]
    ends = np.cumsum(np.fromiter(map(len, strings), np.int64, len(strings)) + 1) - 1
    starts_at = np.flatnonzero(boundaries(points, ends[:-1])).astype(np.int64)
    # separators start tokens of their own; drop these by working text by text
    out, lo = [], np.searchsorted(starts_at, np.concatenate([[0], ends[:-1] + 1])).tolist()
    hi = np.searchsorted(starts_at, ends).tolist()
    begin = 0
    for text, a, b in zip(strings, lo, hi, strict=True):
        cuts = (starts_at[a:b] - begin).tolist()
        cuts.append(len(text))
        out.append([text[i:j] for i, j in zip(cuts, cuts[1:])])
        begin += len(text) + 1
    return out


class Merger:
    """Pair merging under a table of ranks, with a bounded cache from pre-tokens to packed ids."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.pieces = [b""] * (max(self.ranks.values()) + 1)
        for piece, rank in self.ranks.items():
            self.pieces[rank] = piece
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        pairs = {
            (a << 20) | b: rank
            for piece, rank in self.ranks.items()
            for i in range(1, len(piece))
            if (a := self.ranks.get(piece[:i])) is not None and (b := self.ranks.get(piece[i:])) is not None
        }
        self._build(np.fromiter(pairs, np.int64, len(pairs)), np.fromiter(pairs.values(), np.int32, len(pairs)))
        self.cache: dict[str, bytes] = {}

    #: A pair without a merge.
    NONE = np.int32(2**31 - 1)
    _BITS = 21

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self._BITS)).astype(np.int64)

    def _build(self, keys: np.ndarray, ranks: np.ndarray) -> None:
        """Open addressing: place each key in the first free slot at or after its own."""
        size = 1 << self._BITS
        self.keys = np.full(size, -1, np.int64)
        self.values = np.full(size, self.NONE, np.int32)
        at, todo = self._slot(keys), np.arange(len(keys))
        while len(todo):
            free = self.keys[at[todo]] < 0
            _, first = np.unique(at[todo[free]], return_index=True)
            won = todo[free][first]
            self.keys[at[won]], self.values[at[won]] = keys[won], ranks[won]
            left = np.ones(len(keys), bool)
            left[won] = False
            todo = todo[left[todo]]
            at[todo] = (at[todo] + 1) & (size - 1)

    def pair_ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of joining tokens a and b; NONE if there is none or either is padding (-1)."""
        keys = (a.astype(np.int64) << 20) | b
        keys[(a < 0) | (b < 0)] = -2
        at = self._slot(keys)
        out = np.where(self.keys[at] == keys, self.values[at], self.NONE)
        open_ = np.flatnonzero((self.keys[at] != keys) & (self.keys[at] >= 0) & (keys >= 0))
        while len(open_):
            at[open_] = (at[open_] + 1) & (len(self.keys) - 1)
            k = self.keys[at[open_]]
            hit = k == keys[open_]
            out[open_[hit]] = self.values[at[open_[hit]]]
            open_ = open_[~hit & (k >= 0)]
        return out

    def merge_rows(self, rows: np.ndarray) -> list[bytes]:
        """Packed ids of words of one length, given as a matrix of byte values: each round joins
        the leftmost pair of least rank in every word that still has one."""
        n, width = rows.shape
        tok = self.byte_ids[rows]
        out: list[bytes] = [b""] * n
        size = np.full(n, width)
        live = np.arange(n)
        rank = self.pair_ranks(tok[:, :-1].reshape(-1), tok[:, 1:].reshape(-1)).reshape(n, width - 1) if width > 1 else np.full((n, 1), self.NONE)
        while True:
            best = rank.argmin(1)
            value = rank[np.arange(len(live)), best]
            done = value == self.NONE
            if done.any():
                packed = tok[done].astype("<u4")
                for i, row, m in zip(live[done].tolist(), packed, size[done].tolist(), strict=True):
                    out[i] = row[:m].tobytes()
                keep = ~done
                tok, rank, live, size, best, value = tok[keep], rank[keep], live[keep], size[keep], best[keep], value[keep]
            if not len(live):
                return out
            r = np.arange(len(live))
            cols = np.arange(tok.shape[1] - 1)
            tok[r, best] = value
            moved = np.take_along_axis(tok, cols + (cols > best[:, None]), 1)
            tok = np.concatenate([moved, np.full((len(live), 1), -1, np.int32)], 1)
            size -= 1
            if rank.shape[1] > 1:
                cols = np.arange(rank.shape[1] - 1)
                moved = np.take_along_axis(rank, cols + (cols >= best[:, None]), 1)
                rank = np.concatenate([moved, np.full((len(live), 1), self.NONE, np.int32)], 1)
            else:
                rank[:] = self.NONE
            rank[r, best] = self.pair_ranks(tok[r, best], tok[r, best + 1])
            left = np.flatnonzero(best > 0)
            rank[left, best[left] - 1] = self.pair_ranks(tok[left, best[left] - 1], tok[left, best[left]])

    def merge_long(self, word: bytes) -> bytes:
        """One long word by a heap of candidate pairs over a linked list."""
        tok = self.byte_ids[np.frombuffer(word, np.uint8)].tolist()
        n, get, pieces = len(tok), self.ranks.get, self.pieces
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, tok[i], tok[i + 1]) for i in range(n - 1) if (r := get(pieces[tok[i]] + pieces[tok[i + 1]])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = nxt[i]
            if j >= n or tok[i] != a or tok[j] != b:
                continue
            tok[i], tok[j], nxt[i] = r, -1, nxt[j]
            if nxt[j] < n:
                prv[nxt[j]] = i
                if (x := get(pieces[r] + pieces[tok[nxt[j]]])) is not None:
                    heapq.heappush(heap, (x, i, r, tok[nxt[j]]))
            if prv[i] >= 0 and (x := get(pieces[tok[prv[i]]] + pieces[r])) is not None:
                heapq.heappush(heap, (x, prv[i], tok[prv[i]], r))
        return np.array([t for t in tok if t >= 0], "<u4").tobytes()

    def learn(self, words: set[str]) -> None:
        by_length: dict[int, list[tuple[str, bytes]]] = {}
        for w in words:
            raw = w.encode()
            by_length.setdefault(len(raw), []).append((w, raw))
        for length, group in by_length.items():
            if length > MATRIX_MAX:
                self.cache.update((w, self.merge_long(raw)) for w, raw in group)
                continue
            for k in range(0, len(group), 20_000):
                part = group[k : k + 20_000]
                rows = np.frombuffer(b"".join(raw for _, raw in part), np.uint8).reshape(len(part), length)
                self.cache.update(zip((w for w, _ in part), self.merge_rows(rows), strict=True))

    def encode(self, strings: list[str]) -> list[bytes]:
        """Ids of each text, packed as little-endian unsigned 32-bit integers."""
        split = pretokens(strings)
        if len(self.cache) > CACHE_MAX:
            self.cache.clear()
        self.learn(set().union(*split) - self.cache.keys())
        get = self.cache.__getitem__
        return [b"".join(map(get, tokens)) for tokens in split]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.pieces.__getitem__, np.frombuffer(ids, "<u4").tolist()))

    def offsets(self, ids: bytes) -> np.ndarray:
        """Byte offset of every token, and the end: where each id's bytes lie in the text."""
        lengths = np.fromiter(map(len, map(self.pieces.__getitem__, np.frombuffer(ids, "<u4").tolist())), np.int64)
        return np.concatenate([[0], np.cumsum(lengths)])


@lru_cache(2)
def merger(path: str) -> Merger:
    return Merger(path)


#: Characters that one scan takes together.
SCAN_CHARS = 1_000_000


def groups(strings: list[str], limit: int = SCAN_CHARS) -> Iterator[tuple[int, list[str]]]:
    """Neighbouring texts of about ``limit`` characters together, with the place of the first."""
    first, part, size = 0, [], 0
    for i, s in enumerate(strings):
        part.append(s)
        size += len(s)
        if size >= limit:
            yield first, part
            first, part, size = i + 1, [], 0
    if part:
        yield first, part


def encode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>, offsets array<long>): ids of every whole text and the byte offset of
    each token, with the end. ``vocabulary`` is a rank file's path on every machine."""
    schema = pa.schema([("id", pa.int64()), ("ids", pa.list_(pa.int32())), ("offsets", pa.list_(pa.int64()))])

    def run(batches):
        m = merger(vocabulary)
        for b in batches:
            ids, strings = b.column(0), texts(b.column(1))
            for first, part in groups(strings):
                coded = m.encode(part)
                yield batch(schema, ids.slice(first, len(part)), [np.frombuffer(x, "<i4") for x in coded], [m.offsets(x) for x in coded])

    return ready(docs).select(F.col(id_col).cast("long"), text_col).mapInArrow(tidy(run), "id long, ids array<int>, offsets array<long>").withColumnRenamed("id", id_col)


def decode(coded: DataFrame, vocabulary: str, id_col: str = "doc_id") -> DataFrame:
    """(id, content binary): the bytes that ids stand for."""
    schema = pa.schema([("id", pa.int64()), ("content", pa.binary())])

    def run(batches):
        m = merger(vocabulary)
        for b in batches:
            yield batch(schema, b.column(0), [m.decode(np.asarray(x or [], "<u4").tobytes()) for x in b.column(1).to_pylist()])

    return ready(coded).select(F.col(id_col).cast("long"), "ids").mapInArrow(tidy(run), "id long, content binary").withColumnRenamed("id", id_col)


def digests(docs: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): each text encoded and its ids decoded again."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def run(batches):
        m = merger(vocabulary)
        for b in batches:
            ids, strings = b.column(0), texts(b.column(1))
            for first, part in groups(strings):
                coded = m.encode(part)
                yield batch(
                    schema,
                    ids.slice(first, len(part)),
                    [len(x) // 4 for x in coded],
                    [hashlib.sha256(x).hexdigest() for x in coded],
                    [hashlib.sha256(m.decode(x)).hexdigest() for x in coded],
                )

    return ready(docs).select(F.col("doc_id").cast("long"), "text").mapInArrow(tidy(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
