"""Suffix-array deduplication of repeated byte strings (operator 8).

A string of ``LENGTH`` bytes that repeats holds, in every place where it stands, the same anchor: the
leftmost of its ``ANCHOR``-byte substrings with the least hash. So a sparse suffix array over anchors finds
every repeat, with about one suffix in 27 bytes, and every start of a string belongs to exactly one anchor.

1. Anchors whose substring occurs once in the corpus are dropped: tasks send each distinct hash once per block, in
   sorted runs, and reducers return those that other blocks have too.
2. The remaining suffixes (``LENGTH`` bytes from the anchor on, then the bytes before it in reverse, as
   both sides take part in a string) are sorted in blocks. Suffixes equal in all that within a block are settled there but
   for the first. The order is by the hash of the anchor, then by bytes: anchors spread evenly over ranges of the hash, so
   range borders need no sampling. Blocks send their part of every range as a front-coded run: for each
   suffix the length it shares with the one before, and the rest.
3. A reducer merges the runs with a loser tree that keeps, for every waiting suffix, the prefix it is known to share
   with the last output; a longer known prefix wins without looking at bytes, and equal ones are compared from there on.
   The merge yields the common-prefix array. With that array and the same for the reversed left sides, the
   strings at each distance from the anchor fall into classes, and all but the first of a class are lost.
4. Documents meet their lost ranges once and are cut.

A hash collision cannot make different strings equal, as classes compare bytes. Null texts are empty;
texts shorter than ``LENGTH`` lose nothing; matches never cross documents. Overlapping repeats within a text count.
Rows of one doc_id with equal texts are judged as one document, each is cut alike; with different texts they are documents of their own, in the order
of a hash of their texts (``apart``). Rows without an id are neither cut nor a reason to cut. An empty table gives an empty
result. ``deduplicate`` carries other columns along; a text cut within a character loses that character's other bytes too,
so that it stays valid UTF-8.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Pieces, batch, by_bucket, byte_texts, discard, fresh_name, met, mix64, parted, planes, quoted, ranked, ready, shuffle_parts, stored, tidy, unplanes, with_bucket
from .windows import BASE, INVERSE, _power, compressed, expand

LENGTH, ANCHOR = 100, 48
#: Distances that an anchor may have from the start of a string.
REACH = LENGTH - ANCHOR
#: A suffix as it is sorted: hash of the anchor, right side, reversed left side.
KEY = 8 + LENGTH + REACH
BLOCK_ANCHORS, BLOCK_SUFFIXES, CHUNK = 600_000, 60_000, 1 << 20


def anchors(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, place, least distance, greatest distance) of a text's anchors: the strings that start at
    place - distance are the anchor's own."""
    raw = np.frombuffer(text, np.uint8)
    out = []
    for begin in range(0, max(1, len(raw) - LENGTH + 1), CHUNK):
        part = raw[begin : begin + CHUNK + LENGTH - 1]
        if len(part) < LENGTH:
            break
        out.append(_anchors(part, begin))
    if not out:
        return np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(3))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _anchors(raw: np.ndarray, begin: int) -> tuple[np.ndarray, ...]:
    n = len(raw)
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum((raw + np.uint64(1)) * _power(INVERSE, n), out=prefix[1:])
    hashes = mix64((prefix[ANCHOR:] - prefix[:-ANCHOR]) * _power(BASE, n - ANCHOR + 1))
    least = (hashes & ~np.uint64(0xFFFFFF)) | np.arange(len(hashes), dtype=np.uint64)
    width = 1
    while 2 * width <= REACH + 1:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < REACH + 1:
        rest = REACH + 1 - width
        least = np.minimum(least[:-rest], least[rest:])
    at = (least & np.uint64(0xFFFFFF)).astype(np.int64)
    first = np.concatenate([[0], np.flatnonzero(np.diff(at)) + 1])
    last = np.concatenate([first[1:], [len(at)]]) - 1
    place = at[first]
    # anchors have the least hashes: mixed again, they spread evenly over ranges
    return mix64(hashes[place] + np.uint64(BASE)), place + begin, place - last, place - first


def _pack(place: np.ndarray, near: np.ndarray, far: np.ndarray) -> np.ndarray:
    return (place << 16) | (near << 8) | far


def _unpack(packed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return packed >> 16, (packed >> 8) & 0xFF, packed & 0xFF


def _ranges(hashes: np.ndarray, parts: int) -> list[tuple[int, int, int]]:
    """(part, from, to) of sorted hashes."""
    bounds = np.searchsorted(hashes, np.arange(1, parts, dtype=np.uint64) * np.uint64((1 << 64) // parts)).tolist()
    edges = [0, *bounds, len(hashes)]
    return [(p, a, b) for p, (a, b) in enumerate(zip(edges, edges[1:])) if b > a]


# ---- 1: which anchors repeat --------------------------------------------------------------

_ENTRY = pa.schema([("part", pa.int32()), ("hashes", pa.binary()), ("docs", pa.binary()), ("packed", pa.binary())])
_ENTRY_DDL = "part int, hashes binary, docs binary, packed binary"


def _anchor_runs(docs: DataFrame, parts: int) -> DataFrame:
    """Runs by range of the hash; without hashes, anchors of a bucket of documents that the block itself repeats."""

    def block(ids, found):
        sizes = np.array([len(f[0]) for f in found])
        hashes = np.concatenate([f[0] for f in found])
        packed = np.concatenate([_pack(*f[1:]) for f in found])
        doc = np.repeat(np.array(ids, np.int64), sizes)
        order = np.argsort(hashes, kind="stable")
        hashes, packed, doc = hashes[order], packed[order], doc[order]
        new = np.ones(len(hashes), bool)
        new[1:] = hashes[1:] != hashes[:-1]
        often = ~new
        often[:-1] |= ~new[1:]
        # what the block itself repeats needs no answer; its hash still goes out once, unasked (packed -1)
        rows = [(k, None, planes(i), planes(p)) for k, i, p in by_bucket(doc[often], parts, packed[often])]
        h, d, p = hashes[new], doc[new], np.where(often, -1, packed)[new]
        rows += [(k, planes(h[a:b]), planes(d[a:b]), planes(p[a:b])) for k, a, b in _ranges(h, parts)]
        return batch(_ENTRY, *zip(*rows, strict=True))

    def run(batches):
        ids, found, size = [], [], 0
        for b in batches:
            for i, text in zip(b.column(0).to_pylist(), byte_texts(b.column(1)), strict=True):
                if len(text) < LENGTH or i is None:
                    continue
                got = anchors(text)
                ids.append(i)
                found.append(got)
                size += len(got[0])
                if size >= BLOCK_ANCHORS:
                    yield block(ids, found)
                    ids, found, size = [], [], 0
        if ids:
            yield block(ids, found)

    return ready(docs).select(F.col("doc_id").cast("long"), "text").mapInArrow(tidy(run), _ENTRY_DDL)


def _repeated(runs: DataFrame, parts: int) -> DataFrame:
    """(_bucket, _ids, _packed): the anchors that occur elsewhere too, packed by bucket of documents."""
    schema = pa.schema([("_bucket", pa.int32()), ("_ids", pa.binary()), ("_packed", pa.binary())])

    def run(batches):
        pieces: dict[int, list] = {}
        for b in batches:
            done = []
            for part, *entry in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if entry[0] is not None:
                    pieces.setdefault(part, []).append(entry)
                else:
                    done.append((part, *entry[1:]))
            if done:
                yield batch(schema, *zip(*done, strict=True))
        while pieces:
            _, entries = pieces.popitem()
            h = np.concatenate([unplanes(e[0], np.uint64) for e in entries])
            d = np.concatenate([unplanes(e[1], np.int64) for e in entries])
            p = np.concatenate([unplanes(e[2], np.int64) for e in entries])
            del entries
            order = np.argsort(h, kind="stable")
            h, d, p = h[order], d[order], p[order]
            same = np.zeros(len(h), bool)
            same[1:] = h[1:] == h[:-1]
            same[:-1] |= same[1:]
            same &= p >= 0
            rows = [(k, planes(i), planes(x)) for k, i, x in by_bucket(d[same], parts, p[same])]
            if rows:
                yield batch(schema, *zip(*rows, strict=True))

    return runs.repartitionById(parts, F.col("part")).mapInArrow(tidy(run), "_bucket int, _ids binary, _packed binary")


# ---- 2: sorted, front-coded runs ----------------------------------------------------------


def front_code(keys: np.ndarray) -> tuple[np.ndarray, bytes]:
    """(shared lengths, rests) of sorted keys, a matrix of bytes; the first shares nothing."""
    shared = common(keys)
    return shared, keys[np.arange(keys.shape[1]) >= shared[:, None]].tobytes()


def common(keys: np.ndarray) -> np.ndarray:
    """Length of the prefix that each row shares with the row before (0 for the first)."""
    shared = np.zeros(len(keys), np.uint8)
    differ = keys[1:] != keys[:-1]
    shared[1:] = np.where(differ.any(1), differ.argmax(1), keys.shape[1])
    return shared


def sort_rows(keys: np.ndarray) -> np.ndarray:
    """Order of byte rows, stable."""
    width = keys.shape[1]
    return np.argsort(np.ascontiguousarray(keys).view(f"S{width}").reshape(-1), kind="stable")


def suffix_keys(text: bytes, place: np.ndarray) -> np.ndarray:
    """The sort keys of the suffixes at ``place``; bytes beyond the text are zero."""
    padded = np.zeros(REACH + len(text) + LENGTH, np.uint8)
    padded[REACH : REACH + len(text)] = np.frombuffer(text, np.uint8)
    right = padded[place[:, None] + (REACH + np.arange(LENGTH))]
    left = padded[place[:, None] + (REACH - 1 - np.arange(REACH))]
    powers = _power(BASE, ANCHOR)
    # any hash of the anchor's bytes serves the order; big-endian, so that bytes compare as numbers do
    hashes = mix64(((right[:, :ANCHOR] + np.uint64(1)) * powers).sum(1, dtype=np.uint64))
    return np.concatenate([hashes.astype(">u8").view(np.uint8).reshape(-1, 8), right, left], 1)


_RUN = pa.schema([("part", pa.int32()), ("shared", pa.binary()), ("rests", pa.binary()), ("docs", pa.binary()), ("packed", pa.binary())])
_RUN_DDL = "part int, shared binary, rests binary, docs binary, packed binary"


def _suffix_runs(candidates: DataFrame, parts: int) -> DataFrame:
    """Runs by range of the order; without shared lengths, settled string starts of a bucket of documents (packed: first
    and last of each range)."""

    def block(keys, doc, packed):
        keys, doc, packed = np.concatenate(keys), np.concatenate(doc), np.concatenate(packed)
        place, near, far = _unpack(packed)
        order = np.lexsort((place, doc))
        keys, doc, packed = keys[order], doc[order], packed[order]
        # equal rows of the table give equal suffixes: one is enough
        order = sort_rows(keys)  # stable: of equal keys the first of the corpus leads
        keys, doc, packed = keys[order], doc[order], packed[order]
        shared = common(keys)
        span = packed & 0xFFFF
        equal = np.zeros(len(keys), bool)
        equal[1:] = (shared[1:] == KEY) & (span[1:] == span[:-1])
        own = (doc[1:] == doc[:-1]) & (packed[1:] == packed[:-1])
        settled = equal.copy()
        settled[1:] &= ~own
        place, near, far = _unpack(packed[settled])
        rows = [(k, None, None, planes(i), planes(np.concatenate([a, b]))) for k, i, a, b in by_bucket(doc[settled], parts, place - far, place - near)]
        keys, doc, packed = keys[~equal], doc[~equal], packed[~equal]
        hashes = np.ascontiguousarray(keys[:, :8]).view(">u8").reshape(-1).astype(np.uint64)
        for k, a, b in _ranges(hashes, parts):
            lengths, rests = front_code(keys[a:b])
            rows.append((k, lengths.tobytes(), rests, planes(doc[a:b]), planes(packed[a:b])))
        return batch(_RUN, *zip(*rows, strict=True))

    def run(batches):
        press, pieces = zstandard.ZstdDecompressor(), Pieces()
        keys, doc, packed, size = [], [], [], 0
        for b in batches:
            docs, found = parted(b)
            for ids, spans_ in found:
                pieces.add(unplanes(ids, np.int64), unplanes(spans_, np.int64))
            for i, frame in zip(*(c.to_pylist() for c in docs.columns), strict=True):
                if (mine := pieces.of(i)) is None:
                    continue
                text = expand(frame, press)
                p = np.unique(mine[0])
                for k in range(0, len(p), BLOCK_SUFFIXES):
                    part = p[k : k + BLOCK_SUFFIXES]
                    keys.append(suffix_keys(text, part >> 16))
                    doc.append(np.full(len(part), i, np.int64))
                    packed.append(part)
                    size += len(part)
                    if size >= BLOCK_SUFFIXES:
                        yield block(keys, doc, packed)
                        keys, doc, packed, size = [], [], [], 0
        if size:
            yield block(keys, doc, packed)

    return candidates.mapInArrow(tidy(run), _RUN_DDL)


# ---- 3: merging ---------------------------------------------------------------------------


def decode_run(shared: bytes, rests: bytes) -> list[bytes]:
    out, before, at = [], b"", 0
    for n in shared:
        end = at + KEY - n
        before = before[:n] + rests[at:end]
        out.append(before)
        at = end
    return out


def _first_difference(a: bytes, b: bytes, at: int) -> int:
    """First place from ``at`` on where equally long a and b differ, else their length."""
    size = len(a)
    while at < size:
        x, y = a[at : at + 16], b[at : at + 16]
        if x != y:
            gap = int.from_bytes(x, "big") ^ int.from_bytes(y, "big")
            return at + len(x) - (gap.bit_length() + 7) // 8
        at += 16
    return size


def merge_runs(runs: list[list[bytes]], shared: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Merge sorted runs: (run, place in the run, prefix shared with the output before) in order.

    ``shared`` has the common prefixes within each run. The tree's inner nodes hold losers with the
    prefix each shares with the winner it lost to; along the path of the last output that is the output itself.
    """
    n = len(runs)
    size = 1
    while size < n:
        size *= 2
    done = 1 << 30  # a run that is used up loses against all
    at = [0] * size
    known = [0] * size  # prefix shared with the last output
    length = [len(r) for r in runs] + [0] * (size - n)
    runs = runs + [[]] * (size - n)

    def play(i: int, j: int) -> tuple[int, int]:
        """(winner, loser); the loser's known prefix becomes the one it shares with the winner."""
        if length[j] <= at[j]:
            return i, j
        if length[i] <= at[i]:
            return j, i
        if known[i] != known[j]:
            return (i, j) if known[i] > known[j] else (j, i)
        a, b = runs[i][at[i]], runs[j][at[j]]
        same = _first_difference(a, b, known[i])
        if same < len(a) and a[same] > b[same]:
            known[i] = same
            return j, i
        known[j] = same
        return i, j

    losers = [0] * size
    winners = list(range(size))
    level = size
    while level > 1:
        nxt = []
        for k in range(0, level, 2):
            w, lost = play(winners[k], winners[k + 1])
            losers[(level + k) // 2] = lost
            nxt.append(w)
        winners, level = nxt, level // 2
    top = winners[0]
    total = sum(length)
    out_run, out_at, out_shared = np.empty(total, np.int32), np.empty(total, np.int64), np.empty(total, np.int64)
    for k in range(total):
        out_run[k], out_at[k], out_shared[k] = top, at[top], known[top]
        at[top] += 1
        known[top] = shared[top][at[top]] if at[top] < length[top] else done
        node = (size + top) >> 1
        while node:
            lost = losers[node]
            if length[lost] > at[lost]:
                winner, loser = play(top, lost)
                losers[node], top = loser, winner
            node >>= 1
    if total:
        out_shared[0] = 0
    return out_run, out_at, out_shared


def lost_strings(keys: np.ndarray, shared: np.ndarray, doc: np.ndarray, packed: np.ndarray) -> np.ndarray:
    """Which string starts are lost, as a matrix [suffix, distance], for sorted suffixes with their
    common-prefix array."""
    place, near, far = _unpack(packed)
    left = np.ascontiguousarray(keys[:, 8 + LENGTH :])
    by_left = sort_rows(left)
    shared_left = common(left[by_left])
    rank = np.empty(len(doc), np.int64)
    rank[np.lexsort((place, doc))] = np.arange(len(doc))
    by_rank = np.argsort(rank)
    lost = np.zeros((len(doc), REACH + 1), bool)
    left_class = np.empty(len(doc), np.int64)
    for distance in range(REACH + 1):
        right_class = np.cumsum(shared < 8 + LENGTH - distance)
        left_class[by_left] = np.cumsum(shared_left < distance)
        mine = by_rank[(near[by_rank] <= distance) & (far[by_rank] >= distance)]
        both = right_class[mine] * np.int64(len(doc) + 1) + left_class[mine]
        order = np.argsort(both, kind="stable")  # the earliest of a class comes first
        both = both[order]
        later = np.zeros(len(both), bool)
        later[1:] = both[1:] == both[:-1]
        lost[mine[order[later]], distance] = True
    return lost


def _merged(runs: DataFrame, parts: int) -> DataFrame:
    """(_bucket, _ids, _starts): first and last starts of ranges of lost strings, packed by bucket of documents."""
    schema = pa.schema([("_bucket", pa.int32()), ("_ids", pa.binary()), ("_starts", pa.binary())])

    def finish(entries):
        runs_, shared = [decode_run(e[0], e[1]) for e in entries], [e[0] for e in entries]
        docs, packed = [unplanes(e[2], np.int64) for e in entries], [unplanes(e[3], np.int64) for e in entries]
        which, at, prefix = merge_runs(runs_, shared)
        # an anchor that meets no equal one here is done
        alone = prefix < 8 + ANCHOR
        keep = ~alone
        keep[:-1] |= ~alone[1:]
        if not keep.any():
            return
        which, at, prefix = which[keep], at[keep], prefix[keep]
        base = np.cumsum([0, *map(len, docs)])[which] + at
        doc, spans = np.concatenate(docs)[base], np.concatenate(packed)[base]
        keys = np.frombuffer(b"".join(runs_[r][k] for r, k in zip(which.tolist(), at.tolist(), strict=True)), np.uint8).reshape(-1, KEY)
        # rows of the table that are repeated whole are one document here
        order = np.lexsort((spans, doc))
        twice = np.zeros(len(doc), bool)
        twice[order[1:]] = (doc[order[1:]] == doc[order[:-1]]) & (spans[order[1:]] == spans[order[:-1]])
        lost = lost_strings(keys, prefix, doc, spans)
        lost[twice] = False
        place = spans >> 16
        edge = np.diff(np.pad(lost, ((0, 0), (1, 1))).astype(np.int8), axis=1)
        row, first = np.nonzero(edge == 1)
        _, last = np.nonzero(edge == -1)
        rows = [(k, planes(i), planes(np.concatenate([a, b]))) for k, i, a, b in by_bucket(doc[row], parts, place[row] - (last - 1), place[row] - first)]
        if rows:
            yield batch(schema, *zip(*rows, strict=True))

    def run(batches):
        pieces: dict[int, list] = {}
        for b in batches:
            done = []
            for part, *entry in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if entry[0] is not None:
                    pieces.setdefault(part, []).append(entry)
                else:
                    done.append((part, *entry[2:]))
            if done:
                yield batch(schema, *zip(*done, strict=True))
        while pieces:
            yield from finish(pieces.popitem()[1])

    return runs.repartitionById(parts, F.col("part")).mapInArrow(tidy(run), "_bucket int, _ids binary, _starts binary")


# ---- 4: cutting ---------------------------------------------------------------------------


def lost_starts(docs: DataFrame, parts: int) -> DataFrame:
    """(_bucket, _ids, _starts): ranges of lost string starts, packed by bucket of documents."""
    repeated = stored(_repeated(_anchor_runs(docs, parts), parts), "anchors")
    candidates = met(with_bucket(compressed(docs), parts), repeated, parts)
    lost = stored(_merged(_suffix_runs(candidates, parts), parts), "lost")
    discard(repeated)
    return lost


def spans(starts: tuple[np.ndarray, np.ndarray] | None) -> np.ndarray:
    """Maximal removed runs as rows (from, to), of ranges of lost starts."""
    if starts is None:
        return np.zeros((0, 2), np.int64)
    order = np.argsort(starts[0], kind="stable")
    a, b = starts[0][order], np.maximum.accumulate(starts[1][order] + LENGTH)
    first = np.flatnonzero(np.concatenate([[True], a[1:] > b[:-1]]))
    return np.stack([a[first], b[np.concatenate([first[1:], [len(a)]]) - 1]], 1)


def cut(text: bytes, removed: np.ndarray) -> bytes:
    kept, at = [], 0
    for a, b in removed.tolist():
        kept.append(text[at:a])
        at = b
    kept.append(text[at:])
    return b"".join(kept)


def apart(docs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """``docs``, and None where no two different texts share an id. Else ``docs`` with other ids in the same order, one for every id and
    text, and a table (own, old) of these ids."""
    own, mark, same = (fresh_name(docs, n) for n in ("own", "mark", "same"))
    of_text = F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    known = docs.where("doc_id is not null").select(F.col("doc_id").alias(same), of_text.alias(mark))
    if known.groupBy(same).agg(F.min(mark).alias("a"), F.max(mark).alias("b")).where("a <> b").isEmpty():
        return docs, None
    placed = stored(ranked(known.distinct(), own, same, mark), "apart")
    met_ = docs.withColumn(mark, of_text).join(placed.withColumnRenamed(mark, own + "_mark"), (F.col("doc_id") == F.col(same)) & (F.col(mark) == F.col(own + "_mark")), "left")
    return met_.select(*(F.col(own).alias(c) if c == "doc_id" else F.col(quoted(c)) for c in docs.columns)), placed.select(F.col(own).alias("own"), F.col(same).alias("old"))


def _with_old(result: DataFrame, back: DataFrame | None) -> DataFrame:
    """``result`` with the ids that ``apart`` replaced."""
    if back is None:
        return result
    own, old = fresh_name(result, "own"), fresh_name(result, "old")
    met_ = result.join(back.toDF(own, old), F.col("doc_id") == F.col(own), "left")
    return met_.select(*(F.col(old).alias(c) if c == "doc_id" else F.col(quoted(c)) for c in result.columns))


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) for every row of ``docs``."""
    docs, back = apart(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])

    def run(batches):
        press, pieces = zstandard.ZstdDecompressor(), Pieces()
        for b in batches:
            rows = []
            docs_, found = parted(b)
            for ids, starts in found:
                pieces.add(unplanes(ids, np.int64), *unplanes(starts, np.int64).reshape(2, -1))
            for i, frame in zip(*(c.to_pylist() for c in docs_.columns), strict=True):
                text, removed = expand(frame, press), spans(pieces.of(i))
                rows.append((i, len(text), int((removed[:, 1] - removed[:, 0]).sum()), len(removed), hashlib.sha256(cut(text, removed)).hexdigest()))
            if rows:
                yield batch(schema, *zip(*rows, strict=True))

    parts = shuffle_parts(docs.sparkSession)
    joined = met(with_bucket(compressed(docs), parts), lost_starts(docs, parts), parts)
    return _with_old(joined.mapInArrow(tidy(run), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"), back)


def deduplicate(docs: DataFrame) -> DataFrame:
    """``docs`` with the repeated strings cut out of their texts; all columns stay, n_chars follows the text."""
    names = docs.columns
    docs, back = apart(docs)
    parts = shuffle_parts(docs.sparkSession)
    joined = met(with_bucket(docs, parts), lost_starts(docs, parts), parts)
    at, own = names.index("text"), names.index("doc_id")

    def run(batches):
        pieces = Pieces()
        for b in batches:
            b, found = parted(b)
            for ids, starts in found:
                pieces.add(unplanes(ids, np.int64), *unplanes(starts, np.int64).reshape(2, -1))
            if not b.num_rows:
                continue
            column = b.column(at)
            out = []
            for i, text, valid in zip(b.column(own).to_pylist(), byte_texts(column), column.is_valid().to_pylist(), strict=True):
                removed = spans(pieces.of(i))
                out.append(cut(text, removed).decode("utf-8", "ignore") if valid else None)
            yield pa.RecordBatch.from_arrays([*b.columns[:at], pa.array(out, column.type), *b.columns[at + 1 : len(names)]], names=names)

    cut_docs = _with_old(joined.mapInArrow(tidy(run), docs.schema), back)
    return cut_docs.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in names else cut_docs
