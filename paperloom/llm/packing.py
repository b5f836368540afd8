"""Best-fit packing by minimum bin slack (operator 2).

Tokenising happens once, in an Arrow pass whose small result (one row per piece) is stored.
The packer sees a histogram of lengths, which has at most ``capacity`` rows whatever the corpus
holds: for one bin after the other it takes the largest length left, finds by bitset subset-sum
dynamic programming the fullest combination of the lengths that are available beside it, and
removes it. A combination is repeated for as many bins as its lengths last, so the number of
combinations is bounded by the capacity alone (each use leaves some length with fewer copies than
the combination takes, and a length l is taken at most capacity/l times: at most the sum of
capacity/l combinations). Pieces then find their place by rank within their length; ranks come
from counts per (length, shard), so a length that a third of all pieces share is not gathered in
one task. The plan is broadcast: its size is bounded by the same sum.

Null texts are empty; an empty text is one piece holding the end id. Repeated rows give pieces of
their own. An empty table gives an empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from array import array
from functools import lru_cache
from itertools import chain, filterfalse

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import batch, byte_texts, mix64, ready, shuffle_parts, stored, tidy, unequal
from .windows import BASE, _power

CAPACITY = 4096
END_ID = 1
CACHE_MAX, JOINED = 250_000, 50
_MARK, _BETWEEN = b"\x01", b" \x01 "
_CLOSING, _ALNUM, _BLANK = np.zeros((3, 256), bool)
_CLOSING[list(b".,!?;:|")] = True
_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
_BLANK[[9, 10, 11, 12, 13, 32]] = True


def word_parts(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, bytes) of what is encoded apart: words, less closing punctuation after an ASCII letter
    or digit, which the tokenizer parts too and which is a part of its own. ASCII words become lower case, as
    they do in the tokenizer; so the many spellings of a word are one."""
    solid = ~_BLANK[raw]
    edge = np.diff(np.concatenate([[False], solid]).astype(np.int8))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        return starts, ends, raw
    last = np.maximum.accumulate(np.where(_CLOSING[raw], 0, np.arange(len(raw))))[ends - 1]
    closed = (last < ends - 1) & (last >= starts) & _ALNUM[raw[last]]
    borders = last[closed] + 1
    wide = np.maximum.reduceat(raw, starts) > 127
    upper = (raw >= 65) & (raw <= 90)
    upper[upper] = ~wide[np.searchsorted(starts, np.flatnonzero(upper), "right") - 1]
    return np.sort(np.concatenate([starts, borders])), np.sort(np.concatenate([ends, borders])), raw + np.uint8(32) * upper


class WordTokenizer:
    """ids of texts by a tokenizer file. The tokenizer never joins across ASCII white space, so the distinct
    words of a group of texts are encoded once; their ids stay in a bounded cache of two generations."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.mark = self.tokenizer.encode(_MARK.decode(), add_special_tokens=False).ids
        if len(self.mark) != 1:
            raise ValueError("the tokenizer has no single id for the mark between words")
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def _encode(self, words: list[bytes]) -> list[bytes]:
        """Packed ids of words; ``JOINED`` of them share a call, with a control character between them that
        has an id of its own (words that hold it are encoded alone)."""
        out: list[bytes] = []
        for k in range(0, len(words), 10_000):
            part = words[k : k + 10_000]
            if any(_MARK in w for w in part):
                out += [self._alone(w) for w in part]
                continue
            lines = [_BETWEEN.join(part[i : i + JOINED]).decode() for i in range(0, len(part), JOINED)]
            coded = self.tokenizer.encode_batch_fast(lines, add_special_tokens=False)
            flat = array("I", chain.from_iterable(chain(c.ids, self.mark) for c in coded))
            raw, ends = flat.tobytes(), np.flatnonzero(np.frombuffer(flat, np.uint32) == self.mark[0]) * 4
            begins = np.concatenate([[0], ends[:-1] + 4]).tolist()
            out += [raw[a:b] for a, b in zip(begins, ends.tolist(), strict=True)]
        return out

    def _alone(self, word: bytes) -> bytes:
        return array("I", self.tokenizer.encode(word.decode(), add_special_tokens=False).ids).tobytes()

    def ids_of(self, words: list[bytes]) -> list[bytes]:
        """Packed ids of distinct words."""
        if len(self.young) > CACHE_MAX:
            self.young, self.old = {}, self.young
        missing = list(filterfalse(self.young.__contains__, words))
        aged = [w for w in missing if w in self.old]
        self.young.update((w, self.old[w]) for w in aged)
        new = list(filterfalse(self.young.__contains__, missing)) if aged else missing
        self.young.update(zip(new, self._encode(new), strict=True))
        return list(map(self.young.__getitem__, words))

    def encode(self, strings: list[bytes]) -> list[np.ndarray]:
        """ids of each text as unsigned 32-bit integers."""
        raw = np.frombuffer(b" ".join(strings) + b" ", np.uint8)
        starts, ends, raw = word_parts(raw)
        joined = raw.tobytes()
        if not len(starts):
            return [np.zeros(0, np.uint32)] * len(strings)
        lengths = ends - starts
        first = np.cumsum(lengths) - lengths
        solid = ~_BLANK[raw]
        at = np.arange(first[-1] + lengths[-1]) - np.repeat(first, lengths)
        hashes = np.add.reduceat((raw[solid] + np.uint64(1)) * _power(BASE, int(lengths.max()))[at], first)
        hashes = mix64(hashes * np.uint64(2) + lengths.astype(np.uint64))
        _, where, which = np.unique(hashes, return_index=True, return_inverse=True)
        words = [joined[a:b] for a, b in zip(starts[where].tolist(), ends[where].tolist(), strict=True)]
        # a hash groups words, their bytes decide: those that differ from the first of their hash are words of their own
        more: dict[bytes, int] = {}
        for k in unequal(raw[solid], first, lengths, where[which]).tolist():
            which[k] = more.setdefault(joined[starts[k] : ends[k]], len(words) + len(more))
        words += more
        coded = self.ids_of(words)
        sizes = np.fromiter(map(len, coded), np.int64, len(coded)) // 4
        table = np.frombuffer(b"".join(coded), "<u4")
        begin = np.cumsum(sizes) - sizes
        n = sizes[which]
        done = np.cumsum(n)
        flat = table[np.arange(done[-1]) + np.repeat(begin[which] - (done - n), n)]
        text_ends = np.cumsum(np.fromiter(map(len, strings), np.int64, len(strings)) + 1)
        words_before = np.searchsorted(starts, text_ends)
        cuts = np.concatenate([[0], done])[words_before]
        return np.split(flat, cuts[:-1])


@lru_cache(2)
def word_tokenizer(path: str) -> WordTokenizer:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    return WordTokenizer(path)


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]): each document's ids and the end id, cut
    only where they exceed ``capacity``."""
    fields = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]
    schema = pa.schema(fields + [("ids", pa.binary())] * with_ids)
    end = np.array([end_id], "<u4").tobytes()
    step = 4 * capacity

    def run(batches):
        from .bpe import groups

        t = word_tokenizer(tokenizer)
        for b in batches:
            doc_ids = b.column(0).to_pylist()
            for first, part in groups(list(byte_texts(b.column(1))), 2_000_000):
                rows = []
                for d, ids in zip(doc_ids[first : first + len(part)], t.encode(part), strict=True):
                    coded = ids.tobytes() + end
                    for k, at in enumerate(range(0, len(coded), step)):
                        cut = coded[at : at + step]
                        rows.append((d, k, at // 4, len(cut) // 4, zlib.crc32(cut), cut))
                yield batch(schema, *list(zip(*rows, strict=True))[: len(schema)])
        t.old = {}  # between tasks one generation of words is enough

    ddl = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return ready(docs).select(F.col("doc_id").cast("long"), "text").mapInArrow(tidy(run), ddl)


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[tuple[int, int]], int]]:
    """Combinations [(length, copies), ...] with the number of bins that each fills.

    Ties between equally full combinations go to the one with longer pieces.
    """
    left = {n: c for n, c in histogram.items() if c > 0}
    out = []
    mask = (1 << (capacity + 1)) - 1
    while left:
        first = max(left)
        room = capacity - first
        items: list[tuple[int, int]] = []  # (length, copies in the chunk): binary splitting of multiplicities
        reach = [1]
        for n in sorted((n for n in left if n <= room), reverse=True):
            most = min(left[n] - (n == first), room // n)
            chunk = 1
            while most > 0:
                take = min(chunk, most)
                reach.append((reach[-1] | reach[-1] << n * take) & mask)
                items.append((n, take))
                most -= take
                chunk *= 2
            if reach[-1] >> room & 1:
                break  # the bin can be filled to the brim already
        limited = reach[-1] & ((1 << (room + 1)) - 1)
        total = limited.bit_length() - 1
        combination = {first: 1}
        for k in range(len(items), 0, -1):
            if not reach[k - 1] >> total & 1:
                n, take = items[k - 1]
                combination[n] = combination.get(n, 0) + take
                total -= n * take
        times = min(left[n] // c for n, c in combination.items())
        for n, c in combination.items():
            left[n] -= c * times
            if not left[n]:
                del left[n]
        out.append((sorted(combination.items(), reverse=True), times))
    return out


def ranked(rows: DataFrame, key: str, order: list[str], shards: int) -> DataFrame:
    """``rows`` with ``rank``: a number from 0 within ``key``, gapless. Ranks are local to
    (key, shard) and raised by the counts of the shards before."""
    shard = F.pmod(F.xxhash64(*order), F.lit(shards)).cast("int")
    rows = rows.withColumn("_shard", shard)
    local = Window.partitionBy(key, "_shard").orderBy(*order)
    counts = rows.groupBy(key, "_shard").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(key).orderBy("_shard").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select(key, "_shard", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    numbered = rows.withColumn("_local", F.row_number().over(local) - 1)
    return numbered.join(base, [key, "_shard"]).withColumn("rank", F.col("_base") + F.col("_local")).drop("_shard", "_base", "_local")


def place(rows: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Rows of (doc_id, piece, length, ...) with sequence_id and offset. ``rows`` is read twice and
    should be a stored table."""
    spark = rows.sparkSession
    histogram = {r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most ``capacity`` rows
    used: dict[int, int] = {}
    sequence = 0
    blocks = []  # (length, first rank, end rank, copies in a bin, first sequence, offset of the first copy)
    for combination, times in plan(histogram, capacity):
        offset = 0
        for n, copies in combination:
            begin = used.get(n, 0)
            used[n] = begin + copies * times
            blocks.append((n, begin, used[n], copies, sequence, offset))
            offset += n * copies
        sequence += times
    table = spark.createDataFrame(blocks, "b_length long, b_from long, b_to long, b_copies long, b_sequence long, b_offset long")
    found = ranked(rows, "length", ["doc_id", "piece"], 4 * shuffle_parts(spark)).join(
        F.broadcast(table), (F.col("length") == F.col("b_length")) & (F.col("rank") >= F.col("b_from")) & (F.col("rank") < F.col("b_to"))
    )
    inside: Column = F.col("rank") - F.col("b_from")
    return found.select(
        *rows.columns,
        (F.col("b_sequence") + F.floor(inside / F.col("b_copies"))).alias("sequence_id"),
        (F.col("b_offset") + F.pmod(inside, F.col("b_copies")) * F.col("length")).alias("offset"),
    )


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) for every piece of ``docs``."""
    return place(stored(pieces(docs, tokenizer, capacity, end_id), "pieces"), capacity)
