"""Substring deduplication over fixed windows of words (operator 3).

Every window of ``WINDOW`` consecutive words of a document has a Rabin-Karp hash: words hash to 64 bits,
and a window is their polynomial modulo 2^64 with an odd base, taken from one prefix sum by the base's
inverse. As such a polynomial can be made to collide, 32 bits of a second hash travel with it: other 64 bits of
the words, joined by halves through a mixing function. Spark exchanges and ranges the entries; counting within a range is numpy. A task sorts its window hashes in blocks. Windows that also start in a document of smaller id within the block are
settled there and leave as word intervals, so a passage that very many documents share costs one row per
block; of every other hash the block sends one entry, the hash with its smallest document. Entries travel
as byte planes of sorted runs. The reducer of a range of hashes counts them and returns, for every document
but the smallest, the hashes that repeat. Documents meet their lists once, recompute their
hashes, and merge all repeated windows into maximal removal intervals.

Two windows are taken as equal when both hashes are equal, 96 bits; the chance that any two of n different
windows agree is about n^2 / 2^97 (below 0.002 for the 10^13 windows of 100 TB).

Null and empty texts have no words. Documents shorter than the window lose nothing. Rows that share a
doc_id, whether their texts are equal or not, never remove each other's words, as only smaller ids count, and each loses the words of its own windows: what
a block settles carries a hash of its text. Rows without an id neither lose words nor cause a loss. An empty table gives an
empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Pieces, batch, by_bucket, byte_texts, met, mix64, parted, planes, ready, shuffle_parts, tidy, unplanes, with_bucket, words_of

WINDOW = 50
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
#: Windows that a task sorts at once, words that the cache of word hashes holds.
BLOCK_WINDOWS, CACHE_MAX = 1_000_000, 200_000
#: Ranges of the hash per shuffle partition: a reducer holds all entries of its range.
RANGES = 4

_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        grown = np.full(max(n, 1 << 15), base, np.uint64)
        grown[0] = 1
        have = _powers[base] = np.multiply.accumulate(grown)
    return have[:n]


class WordHashes(dict):
    """128-bit hashes of words, kept in a bounded cache."""

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= CACHE_MAX:
            self.clear()
        got = self[word] = xxhash.xxh3_128_digest(word)
        return got

    def of(self, words: list[bytes]) -> np.ndarray:
        """Two 64-bit hashes of each word."""
        return np.frombuffer(b"".join(map(self.__getitem__, words)), "<u8").reshape(-1, 2)


def window_hashes(word_hashes: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Rabin-Karp hash and second hash of every window, empty for fewer words than one window has."""
    n = len(word_hashes)
    if n < window:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint32)
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum(word_hashes[:, 0] * _power(INVERSE, n), out=prefix[1:])
    return mix64((prefix[window:] - prefix[:-window]) * _power(BASE, n - window + 1)), second_hashes(word_hashes[:, 1], window)


def second_hashes(word_hashes: np.ndarray, window: int) -> np.ndarray:
    """32 bits of every window: runs of 1, 2, 4 ... words, each mixed from two of half its length, and those that make up a window."""
    n, size, at, run, out = len(word_hashes) - window + 1, 1, 0, np.ascontiguousarray(word_hashes), None
    while size <= window:
        if window & size:
            part = run[at : at + n]
            out = part if out is None else mix64(out * np.uint64(BASE) ^ part)
            at += size
        if 2 * size <= window:
            run = mix64(run[:-size] * np.uint64(BASE) ^ run[size:])
        size *= 2
    return (out >> np.uint64(32)).astype(np.uint32)


def by_hash(hashes: np.ndarray, seconds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(stable order by both hashes, which places in it begin a new pair)."""
    order = np.argsort(hashes, kind="stable")

    def begins():
        h, s = hashes[order], seconds[order]
        same, new = np.zeros(len(h), bool), np.ones(len(h), bool)
        same[1:] = h[1:] == h[:-1]
        new[1:] = ~same[1:] | (s[1:] != s[:-1])
        return same, new

    same, new = begins()
    if (same & new).any():  # equal hashes, other seconds: these have to be in order too
        order = np.lexsort((seconds, hashes))
        _, new = begins()
    return order, new


def covered(starts: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal (from, to) intervals that windows at sorted ``starts`` cover."""
    if not len(starts):
        return starts, starts
    gap = np.flatnonzero(np.diff(starts) > window) + 1
    first = np.concatenate([[0], gap])
    last = np.concatenate([gap, [len(starts)]]) - 1
    return starts[first], starts[last] + window


def mark_of(text: bytes) -> int:
    """What tells rows that share an id apart."""
    return xxhash.xxh3_64_intdigest(text)


def squeezed(values: np.ndarray, press: zstandard.ZstdCompressor) -> bytes:
    """Byte planes as a zstandard frame: few bits of a sorted hash or of a document's id are news."""
    return press.compress(planes(values))


def _candidates(docs: DataFrame, window: int, parts: int, doc_buckets: int) -> DataFrame:
    """(part, settled, a, b): a run of a block's entries for one range of hashes (a: hashes, b: documents), or, if
    settled, what a block settles for a bucket of documents (a: documents, b: first and last covered word, mark of the text). c: second hashes."""
    schema = pa.schema([("part", pa.int32()), ("settled", pa.bool_()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary())])

    def block(ids: list[int], marks: list[int], hashes: list[tuple[np.ndarray, np.ndarray]], press: zstandard.ZstdCompressor):
        order = sorted(range(len(ids)), key=ids.__getitem__)
        ids_sorted, marks_sorted = np.array([ids[k] for k in order], np.int64), np.array([marks[k] for k in order], np.uint64).view(np.int64)
        sizes = np.array([len(hashes[k][0]) for k in order])
        flat, second = (np.concatenate([hashes[k][x] for k in order]) for x in (0, 1))
        begin = np.cumsum(sizes) - sizes
        row = np.repeat(np.arange(len(order)), sizes)
        at, new = by_hash(flat, second)
        flat_s, second_s, doc_s = flat[at], second[at], ids_sorted[row[at]]
        least = doc_s[np.maximum.accumulate(np.where(new, np.arange(len(flat)), 0))]
        lost = np.sort(at[doc_s > least])
        rows = []
        if len(lost):
            # windows of one document whose starts are no further apart than a window cover one interval
            gap = (np.diff(lost) > window) | (np.diff(row[lost]) != 0)
            first, last = lost[np.concatenate([[True], gap])], lost[np.concatenate([gap, [True]])]
            doc = ids_sorted[row[first]]
            spans = by_bucket(doc, doc_buckets, first - begin[row[first]], last - begin[row[first]] + window, marks_sorted[row[first]])
            rows += [(k, True, planes(i), planes(np.concatenate([a, b, m])), None) for k, i, a, b, m in spans]
        h, d, s = flat_s[new], doc_s[new], second_s[new]
        bounds = np.searchsorted(h, (np.arange(1, parts, dtype=np.uint64) * np.uint64((1 << 64) // parts)))
        edges = [0, *bounds.tolist(), len(h)]
        rows += [(p, False, squeezed(h[a:b], press), squeezed(d[a:b], press), planes(s[a:b])) for p, (a, b) in enumerate(zip(edges, edges[1:])) if b > a]
        return batch(schema, *zip(*rows, strict=True))

    def run(batches):
        known, press = WordHashes(), zstandard.ZstdCompressor(level=1, write_content_size=True)
        ids, marks, hashes, size = [], [], [], 0
        for b in batches:
            for i, text in zip(b.column(0).to_pylist(), byte_texts(b.column(1)), strict=True):
                got = window_hashes(known.of(words_of(text)), window)
                if len(got[0]) and i is not None:
                    ids.append(i)
                    marks.append(mark_of(text))
                    hashes.append(got)
                    size += len(got[0])
                if size >= BLOCK_WINDOWS:
                    yield block(ids, marks, hashes, press)
                    ids, marks, hashes, size = [], [], [], 0
        if ids:
            yield block(ids, marks, hashes, press)

    return ready(docs).select(F.col("doc_id").cast("long"), "text").mapInArrow(tidy(run), "part int, settled boolean, a binary, b binary, c binary")


def _repeated(candidates: DataFrame, parts: int, doc_buckets: int) -> DataFrame:
    """(_bucket, _ids, _spans, _hashes, _seconds): what documents lose, packed by bucket of documents."""
    schema = pa.schema([("_bucket", pa.int32()), ("_ids", pa.binary()), ("_spans", pa.binary()), ("_hashes", pa.binary()), ("_seconds", pa.binary())])

    def run(batches):
        runs: dict[int, list] = {}
        press = zstandard.ZstdDecompressor()
        for b in batches:
            settled = []
            for part, done, x, y, z in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if done:
                    settled.append((part, x, y, None, None))
                else:
                    runs.setdefault(part, []).append((x, y, z))
            if settled:
                yield batch(schema, *zip(*settled, strict=True))
        while runs:
            _, entries = runs.popitem()
            h = np.concatenate([unplanes(expand(e[0], press), np.uint64) for e in entries])
            d = np.concatenate([unplanes(expand(e[1], press), np.int64) for e in entries])
            s = np.concatenate([unplanes(e[2], np.uint32) for e in entries])
            del entries
            at, new = by_hash(h, s)
            h, d, s = h[at], d[at], s[at]
            first = np.flatnonzero(new)
            if len(first) == len(h):
                continue
            least = np.minimum.reduceat(d, first)[np.cumsum(new) - 1]
            lost = d > least
            rows = [(k, planes(i), None, planes(x), planes(y)) for k, i, x, y in by_bucket(d[lost], doc_buckets, h[lost], s[lost])]
            if rows:
                yield batch(schema, *zip(*rows, strict=True))

    return candidates.repartitionById(parts, F.col("part")).mapInArrow(tidy(run), "_bucket int, _ids binary, _spans binary, _hashes binary, _seconds binary")


def removals(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Every row of ``docs`` (doc_id, text compressed) in one partition with what it loses, as ``met`` gives them."""
    doc_buckets = shuffle_parts(docs.sparkSession)
    parts = RANGES * doc_buckets
    lost = _repeated(_candidates(docs, window, parts, doc_buckets), parts, doc_buckets)
    return met(with_bucket(compressed(docs), doc_buckets), lost, doc_buckets)


def compressed(docs: DataFrame) -> DataFrame:
    """(doc_id, text): texts as zstandard frames, to be exchanged at less than half their size."""
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.binary())])

    def run(batches):
        press = zstandard.ZstdCompressor(level=1, write_content_size=True)
        for b in batches:
            yield batch(schema, b.column(0), [press.compress(t) for t in byte_texts(b.column(1))])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(tidy(run), "doc_id long, text binary")


def expand(frame: bytes, press: zstandard.ZstdDecompressor) -> bytes:
    return press.decompress(frame) if frame else b""


def removed_words(text: bytes, spans: tuple | None, hashes: tuple | None, known: WordHashes, window: int = WINDOW) -> tuple[list[bytes], np.ndarray]:
    """The words of a document and its maximal removal intervals, as rows (from, to)."""
    words = words_of(text)
    a, b = np.zeros((2, 0), np.int64)
    if spans:
        own = spans[2] == np.uint64(mark_of(text)).view(np.int64)
        a, b = spans[0][own], spans[1][own]
    if hashes:
        h, s = window_hashes(known.of(words), window)
        lost = np.flatnonzero(np.isin(h, hashes[0]))
        pairs = set(zip(hashes[0].tolist(), hashes[1].tolist(), strict=True))
        lost = lost[[p in pairs for p in zip(h[lost].tolist(), s[lost].tolist(), strict=True)]] if len(lost) else lost
        x, y = covered(lost, window)
        a, b = np.concatenate([a, x]), np.concatenate([b, y])
    if not len(a):
        return words, np.zeros((0, 2), np.int64)
    order = np.argsort(a, kind="stable")
    a, b = a[order], np.maximum.accumulate(b[order])
    first = np.flatnonzero(np.concatenate([[True], a[1:] > b[:-1]]))
    return words, np.stack([a[first], b[np.concatenate([first[1:], [len(a)]]) - 1]], 1)


def _cut(batches, window: int):
    """Per Arrow batch a list of (doc_id, number of words, intervals, kept words)."""
    press, known, spans, hashes = zstandard.ZstdDecompressor(), WordHashes(), Pieces(), Pieces()
    for b in batches:
        rows = []
        docs, packed = parted(b)
        for ids, x, h, s in packed:
            if x is not None:
                spans.add(unplanes(ids, np.int64), *unplanes(x, np.int64).reshape(3, -1))
            else:
                hashes.add(unplanes(ids, np.int64), unplanes(h, np.uint64), unplanes(s, np.uint32))
        for i, text in zip(*(c.to_pylist() for c in docs.columns), strict=True):
            words, gone = removed_words(expand(text, press), spans.of(i), hashes.of(i), known, window)
            n, kept, at = len(words), [], 0
            for start, end in gone.tolist():
                kept += words[at:start]
                at = end
            rows.append((i, n, gone, b" ".join(kept + words[at:] if at else words), n - len(kept) - (n - at)))
        if rows:
            yield rows


def deduplicate(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_removed, intervals array<array<long>>, kept): intervals are the maximal runs of
    removed words as [from, to), kept the other words joined by one space."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("intervals", pa.list_(pa.list_(pa.int64()))), ("kept", pa.string())])

    def run(batches):
        for rows in _cut(batches, window):
            yield batch(schema, *zip(*((i, n, lost, gone.tolist(), kept.decode()) for i, n, gone, kept, lost in rows), strict=True))

    return removals(docs, window).mapInArrow(tidy(run), "doc_id long, n_words long, n_removed long, intervals array<array<long>>, kept string")


def digests(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) for every row of ``docs``."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())])

    def run(batches):
        for rows in _cut(batches, window):
            yield batch(schema, *zip(*((i, n, lost, hashlib.sha256(kept).hexdigest()) for i, n, _, kept, lost in rows), strict=True))

    return removals(docs, window).mapInArrow(tidy(run), "doc_id long, n_words long, n_removed long, kept_sha256 string")
