"""Language-model scores from Brown classes (operator 6).

The corpus is encoded once into chunks of about ``CHUNK_TOKENS`` tokens: a sorted list of the chunk's distinct
words and every token as a place in it. Words of all chunks meet in ranges of the word hash, where they get
their training count; from then on chunks and ranges exchange packed arrays instead of words.

Exchange clustering runs on all training tokens and all words. In every round each chunk is told its words' classes and
counts, for every word, the classes that follow and precede it; ranges sum these counts and exchange words in steps: the words of a step
move to the classes under which their contexts are likeliest, and the range's copy of the table of class transitions
follows before the next step. As ranges don't see each other's moves, the driver compares likelihoods: a round under which the
mutual information of neighbouring classes falls is undone and ends the clustering, so likelihood rises from round to round. Words
that would empty a class still move; an empty class keeps a smoothed row. Only the table of transitions, whose size is
the square of ``CLASSES``, reaches the driver. The model is

    P(w | v) = L * P(class w | class v) * P(w | class w) * (1 - u) + (1 - L) * (c + 1) / (N + V + 1)

with u = 1 / (N + V + 1), the chance of any word that training did not hold, L = ``WEIGHT``, and class transitions smoothed with
``CLASSES`` pseudo-counts of the class frequencies. It sums to 1 over the training words and one unknown word.

A document is its words (A-Z in lower case) and one end. Null texts are empty and have the end only. A null doc_id
counts for training. Without training documents every score is 0 (an unknown token has chance 1). Repeated rows
count and are scored each. An empty table gives an empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, byte_texts, discard, lower_ascii, mix64, planes, ready, shuffle_parts, stored, tidy, unequal, unplanes
from .windows import BASE, _power

CLASSES, ROUNDS, WEIGHT = 48, 3, 0.95
CHUNK_TOKENS, CONTEXT_STEP = 700_000, 100_000
DIVISOR, HELD_OUT = 7, 2
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
#: The class of words that training did not hold, in arrays of classes.
UNKNOWN = 255
_END_HASH = np.uint64(0xE17D00C5)


# ---- encoding -----------------------------------------------------------------------------


def tokenise(documents: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """(distinct words in order of their hash, hashes, token places, tokens per document); the end is
    the empty word."""
    raw = np.frombuffer(lower_ascii(b" ".join(documents) + b" "), np.uint8)
    solid = ~_BLANK[raw]
    edge = np.diff(np.concatenate([[False], solid]).astype(np.int8))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    text_ends = np.cumsum(np.fromiter(map(len, documents), np.int64, len(documents)) + 1)
    words_before = np.searchsorted(starts, text_ends)
    hashes = np.zeros(len(starts) + len(documents), np.uint64)
    end_at = words_before + np.arange(len(documents))
    is_word = np.ones(len(hashes), bool)
    is_word[end_at] = False
    if len(starts):
        lengths = ends - starts
        first = np.cumsum(lengths) - lengths
        at = np.arange(first[-1] + lengths[-1]) - np.repeat(first, lengths)
        sums = np.add.reduceat((raw[solid] + np.uint64(1)) * _power(BASE, int(lengths.max()))[at], first)
        hashes[is_word] = sums * np.uint64(2) + lengths.astype(np.uint64)
    hashes[end_at] = _END_HASH
    found, where, places = np.unique(mix64(hashes), return_index=True, return_inverse=True)
    word_no = np.cumsum(is_word) - 1
    joined = raw.tobytes()
    words = [
        joined[starts[k] : ends[k]] if w else b""
        for k, w in zip(word_no[where].tolist(), is_word[where].tolist(), strict=True)
    ]
    if len(starts):
        # a hash groups words, their bytes decide: those that differ from the first of their hash are words of their own
        like = where[places[is_word]]
        bad = np.union1d(unequal(raw[solid], first, lengths, np.where(is_word[like], word_no[like], np.arange(len(starts)))), np.flatnonzero(~is_word[like]))
        token_of = np.flatnonzero(is_word)
        more: dict[bytes, int] = {}
        for k in bad.tolist():
            word = joined[starts[k] : ends[k]]
            if word not in more:
                found = np.append(found, found[places[token_of[k]]])
            places[token_of[k]] = more.setdefault(word, len(words) + len(more))
        if more:
            words += more
            order = np.argsort(found, kind="stable")
            words, found, places = [words[k] for k in order.tolist()], found[order], np.argsort(order)[places]
    return words, found, places.astype(np.int32), np.diff(end_at, prepend=-1)


_CORPUS = pa.schema(
    [("chunk", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("held", pa.binary()), ("sizes", pa.binary()), ("ids", pa.binary())]
    + [("words", pa.binary()), ("cuts", pa.list_(pa.int64())), ("counts", pa.binary())]
)
_CORPUS_DDL = "chunk long, doc_ids array<long>, held binary, sizes binary, ids binary, words binary, cuts array<long>, counts binary"


def encode(docs: DataFrame, parts: int) -> DataFrame:
    def chunk(number, ids, texts):
        words, hashes, places, sizes = tokenise(texts)
        held = np.array([i is not None and zlib.crc32(str(i).encode()) % DIVISOR == HELD_OUT for i in ids])
        counts = np.bincount(places[~np.repeat(held, sizes)], minlength=len(words))
        cuts = np.searchsorted(hashes, np.arange(1, parts, dtype=np.uint64) * np.uint64((1 << 64) // parts))
        return batch(
            _CORPUS, [number], [ids], [held.tobytes()], [planes(sizes.astype(np.int32))], [planes(places)], [b"\n".join(words)],
            [np.concatenate([[0], cuts, [len(words)]])], [planes(counts.astype(np.int64))],
        )

    def run(batches):
        number = TaskContext.get().partitionId() << 32
        ids, texts, size = [], [], 0
        for b in batches:
            for i, text in zip(b.column(0).to_pylist(), byte_texts(b.column(1)), strict=True):
                ids.append(i)
                texts.append(text)
                size += len(text) + 8
                if size >= 6 * CHUNK_TOKENS:
                    yield chunk(number, ids, texts)
                    number += 1
                    ids, texts, size = [], [], 0
        if ids:
            yield chunk(number, ids, texts)

    return ready(docs).select(F.col("doc_id").cast("long"), "text").mapInArrow(tidy(run), _CORPUS_DDL)


# ---- vocabulary ---------------------------------------------------------------------------

#: chunk null: a range's counts and classes; else where the words of a chunk are in the range.
_VOCAB = pa.schema([("part", pa.int32()), ("chunk", pa.int64()), ("at", pa.binary()), ("counts", pa.binary()), ("classes", pa.binary())])
_VOCAB_DDL = "part int, chunk long, at binary, counts binary, classes binary"


def vocabulary(corpus: DataFrame, parts: int, classes: int, with_words: bool = False) -> DataFrame:
    """Counts and first classes by range, and the places of every chunk's words; and the words of a range, if asked for."""
    out = pa.schema([*_VOCAB, ("words", pa.binary())])
    schema = pa.schema([("part", pa.int32()), ("chunk", pa.int64()), ("words", pa.binary()), ("counts", pa.binary())])

    def split(batches):
        for b in batches:
            for number, words, cuts, counts in zip(*(c.to_pylist() for c in b.columns), strict=True):
                words, counts = words.split(b"\n"), unplanes(counts, np.int64)
                rows = [(p, number, b"\n".join(words[a:z]), planes(counts[a:z])) for p, (a, z) in enumerate(zip(cuts, cuts[1:])) if z > a]
                yield batch(schema, *zip(*rows, strict=True))

    def meet(batches):
        by_part: dict[int, list] = {}
        for b in batches:
            for part, *entry in zip(*(c.to_pylist() for c in b.columns), strict=True):
                by_part.setdefault(part, []).append(entry)
        for part, entries in by_part.items():
            entries.sort(key=lambda e: e[0])
            places: dict[bytes, int] = {}
            at = [np.array([places.setdefault(w, len(places)) for w in words.split(b"\n")], np.int32) for _, words, _ in entries]
            counts = np.zeros(len(places), np.int64)
            for where, (_, _, c) in zip(at, entries, strict=True):
                counts[where] += unplanes(c, np.int64)  # a chunk's words are distinct
            first = (mix64(np.arange(len(counts), dtype=np.uint64) + (np.uint64(part) << np.uint64(40))) % np.uint64(classes)).astype(np.uint8)
            first[counts == 0] = UNKNOWN
            yield batch(out, [part], [None], [None], [planes(counts)], [first.tobytes()], [b"\n".join(places) if with_words else None])
            for where, (number, _, _) in zip(at, entries, strict=True):
                yield batch(out, [part], [number], [planes(where)], [None], [None], [None])

    rows = corpus.select("chunk", "words", "cuts", "counts").mapInArrow(tidy(split), "part int, chunk long, words binary, counts binary")
    return rows.repartitionById(parts, F.col("part")).mapInArrow(tidy(meet), f"{_VOCAB_DDL}, words binary")


def _told(corpus: DataFrame, vocab: DataFrame, links: DataFrame, parts: int, with_counts: bool = False) -> DataFrame:
    """Chunks with the classes of their words and, if asked for, their counts, by range: heard array<struct<part, counts,
    classes>>."""
    schema = pa.schema([("chunk", pa.int64()), ("part", pa.int32()), ("counts", pa.binary()), ("classes", pa.binary())])

    def run(batches):
        for part, (counts, classes, waiting) in _by_range(batches).items():
            counts, classes = unplanes(counts, np.int64), np.frombuffer(classes, np.uint8)
            for number, at in waiting:
                at = unplanes(at, np.int32)
                yield batch(schema, [number], [part], [planes(counts[at]) if with_counts else b""], [classes[at].tobytes()])

    told = vocab.unionByName(links).repartitionById(parts, F.col("part")).mapInArrow(tidy(run), "chunk long, part int, counts binary, classes binary")
    heard = told.groupBy("chunk").agg(F.array_sort(F.collect_list(F.struct("part", "counts", "classes"))).alias("heard"))
    return corpus.select("chunk", "doc_ids", "held", "sizes", "ids", "cuts").join(heard, "chunk")


def _by_range(batches) -> dict[int, tuple]:
    """part -> (counts, classes, [(chunk, at)])"""
    kept: dict[int, list] = {}
    for b in batches:
        for part, number, at, counts, classes in zip(*(c.to_pylist() for c in b.columns[:5]), strict=True):
            entry = kept.setdefault(part, [b"", b"", []])
            if number is None:
                entry[0], entry[1] = counts, classes
            else:
                entry[2].append((number, at))
    return kept


def _word_arrays(heard: list[dict]) -> tuple[np.ndarray, np.ndarray]:
    return (
        np.concatenate([unplanes(h["counts"], np.int64) for h in heard]),
        np.concatenate([np.frombuffer(h["classes"], np.uint8) for h in heard]),
    )


# ---- clustering ---------------------------------------------------------------------------


def _contexts(told: DataFrame, classes: int, with_words: bool) -> DataFrame:
    """Training contexts: (part, chunk, word, code, n) packed for every range of a chunk's words, where code is the class that
    follows, or ``classes`` plus the class before (``classes`` itself at a start); and transitions array<long> per chunk."""
    schema = pa.schema([("part", pa.int32()), ("chunk", pa.int64()), ("word", pa.binary()), ("code", pa.binary()), ("n", pa.binary()), ("transitions", pa.list_(pa.int64()))])
    codes = 2 * classes + 1

    def run(batches):
        for b in batches:
            for number, held, sizes, ids, cuts, heard in zip(*(b.column(k).to_pylist() for k in range(6)), strict=True):
                _, cls = _word_arrays(heard)
                sizes, ids = unplanes(sizes, np.int32), unplanes(ids, np.int32)
                train = ~np.repeat(np.frombuffer(held, bool), sizes)
                first = np.zeros(len(ids), bool)
                first[np.cumsum(sizes) - sizes] = True
                own = cls[ids].astype(np.int64)
                before = np.where(first, classes, np.concatenate([[classes], own[:-1]]))
                ids, own, before, first = ids[train], own[train], before[train], first[train]
                moves = np.bincount(before * classes + own, minlength=(classes + 1) * classes)
                rows = [(None, number, None, None, None, moves)]
                if with_words:
                    rows += words(number, ids, own, before, first, cuts)
                yield batch(schema, *zip(*rows, strict=True))

    def words(number, ids, own, before, first, cuts):
        after = ~first[1:]
        keys = np.concatenate([ids[:-1][after] * np.int64(codes) + own[1:][after], ids * np.int64(codes) + classes + np.where(first, 0, before + 1)])
        step = max(1, 4_000_000 // codes)
        out_w, out_c, out_n = [], [], []
        total = cuts[-1]
        for a in range(0, total, step):
            mine = keys[(keys >= a * codes) & (keys < (a + step) * codes)] - a * codes
            n = np.bincount(mine, minlength=0)
            hit = np.flatnonzero(n)
            out_w.append(hit // codes + a)
            out_c.append((hit % codes).astype(np.uint8))
            out_n.append(n[hit].astype(np.uint32))
        w, c, n = np.concatenate(out_w), np.concatenate(out_c), np.concatenate(out_n)
        bounds = np.searchsorted(w, cuts)
        return [
            (p, number, planes((w[a:z] - cuts[p]).astype(np.int32)), c[a:z].tobytes(), planes(n[a:z]), None)
            for p, (a, z) in enumerate(zip(bounds.tolist(), bounds[1:].tolist()))
            if z > a
        ]

    ddl = "part int, chunk long, word binary, code binary, n binary, transitions array<long>"
    return told.select("chunk", "held", "sizes", "ids", "cuts", "heard").mapInArrow(tidy(run), ddl)


def _transitions(contexts: DataFrame, classes: int) -> np.ndarray:
    """Counts of class after class, the last row for starts. At most (classes + 1) * classes rows are collected."""
    rows = contexts.where("transitions is not null").select(F.posexplode("transitions")).groupBy("pos").agg(F.sum("col").alias("n")).collect()
    table = np.zeros((classes + 1) * classes)
    for r in rows:
        table[r["pos"]] = r["n"]
    return table.reshape(classes + 1, classes)


def smoothed(table: np.ndarray) -> np.ndarray:
    """Transition chances, the last row (for unknown words) being the class frequencies."""
    classes = table.shape[1]
    total = table.sum(0)
    share = (total + 1) / (total.sum() + classes)
    rows = (table + classes * share) / (table.sum(1, keepdims=True) + classes)
    return np.concatenate([rows, share[None]])


def context_weights(table: np.ndarray) -> np.ndarray:
    """log chance of each context code under each class: [code, class]."""
    classes = table.shape[1]
    chance = smoothed(table)
    share = chance[-1]
    follow = np.log(chance[:classes]).T  # [class that follows, own class]
    start = np.log(chance[classes] / share)[None]
    before = np.log(chance[:classes] / share[None])  # [class before, own class]
    return np.concatenate([follow, start, before])


def information(table: np.ndarray) -> float:
    """Mutual information of neighbouring classes times the number of transitions: what the likelihood of the training tokens under
    the unsmoothed model owes to the classes."""
    joint, left, right = table, table.sum(1, keepdims=True), table.sum(0, keepdims=True)
    hit = joint > 0
    return float((joint[hit] * np.log((joint * max(table.sum(), 1.0))[hit] / (left * right)[hit])).sum())


def moved_table(table: np.ndarray, code: np.ndarray, n: np.ndarray, old: np.ndarray, new: np.ndarray) -> np.ndarray:
    """``table`` after words with contexts (code, n) left class ``old`` for ``new``."""
    classes = table.shape[1]
    out = table.copy()
    follows = code < classes
    row = np.where(code == classes, classes, code.astype(np.int64) - classes - 1)
    for cls, sign in ((old, -1.0), (new, 1.0)):
        np.add.at(out, (cls[follows], code[follows]), sign * n[follows])
        np.add.at(out, (row[~follows], cls[~follows]), sign * n[~follows])
    return np.maximum(out, 0)


def _exchange(vocab: DataFrame, links: DataFrame, contexts: DataFrame, table: np.ndarray, parts: int) -> DataFrame:
    """``vocab`` with words moved to the classes under which their contexts are likeliest."""

    def run(batches):
        heard: dict[int, list] = {}
        plain = []
        for b in batches:
            plain.append(b)
            for part, number, word, code, n in zip(*(b.column(k).to_pylist() for k in (0, 1, 5, 6, 7)), strict=True):
                if word is not None:
                    heard.setdefault(part, []).append((number, word, code, n))
        for part, (counts, classes, waiting) in _by_range([b.filter(b.column(5).is_null()) for b in plain]).items():
            places = dict(waiting)
            now = np.frombuffer(classes, np.uint8).copy()
            entries = heard.get(part, [])
            if entries:
                word = np.concatenate([unplanes(places[k], np.int32)[unplanes(w, np.int32)] for k, w, _, _ in entries])
                code = np.concatenate([np.frombuffer(c, np.uint8) for _, _, c, _ in entries])
                n = np.concatenate([unplanes(x, np.uint32) for *_, x in entries])
                order = np.argsort(word, kind="stable")
                word, code, n = word[order], code[order], n[order].astype(np.float32)
                first = np.flatnonzero(np.diff(word, prepend=-1))
                # frequent words come first and have many contexts: steps of about as many contexts each
                edges = np.unique(np.append(np.searchsorted(first, np.arange(0, len(word), CONTEXT_STEP)), len(first))).tolist()
                here = table
                for a, z in zip(edges, edges[1:]):
                    lo, hi = first[a], first[z] if z < len(first) else len(word)
                    weights = context_weights(here).astype(np.float32)
                    score = np.add.reduceat(weights[code[lo:hi]] * n[lo:hi, None], first[a:z] - lo, axis=0)
                    old, new = now[word[first[a:z]]].astype(np.int64), score.argmax(1)
                    now[word[first[a:z]]] = new
                    sizes = np.diff(np.append(first[a:z], hi))
                    change = np.repeat(old != new, sizes)
                    here = moved_table(here, code[lo:hi][change], n[lo:hi][change].astype(np.float64), np.repeat(old, sizes)[change], np.repeat(new, sizes)[change])
            yield batch(_VOCAB, [part], [None], [None], [counts], [now.tobytes()])

    nothing = F.lit(None).cast("binary")
    rows = vocab.unionByName(links).select("*", *(nothing.alias(c) for c in ("word", "code", "n")))
    more = contexts.where("part is not null").select("part", "chunk", *(nothing.alias(c) for c in ("at", "counts", "classes")), "word", "code", "n")
    return rows.unionByName(more).repartitionById(parts, F.col("part")).mapInArrow(tidy(run), _VOCAB_DDL)


# ---- scoring ------------------------------------------------------------------------------


def _scored(told: DataFrame, table: np.ndarray, total: int, distinct: int, weight: float) -> DataFrame:
    classes = table.shape[1]
    chance = smoothed(table)
    in_class = table.sum(0)
    below = total + distinct + 1
    unknown = 1 / below
    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    schema = pa.schema(list(zip(names, [pa.int64(), pa.bool_(), *[pa.int64()] * 3, *[pa.float64()] * 2], strict=True)))

    def run(batches):
        for b in batches:
            for doc_ids, held, sizes, ids, heard in zip(*(c.to_pylist() for c in b.columns), strict=True):
                counts, cls = _word_arrays(heard)
                sizes, ids = unplanes(sizes, np.int32).astype(np.int64), unplanes(ids, np.int32)
                own = np.where(cls == UNKNOWN, classes + 1, cls).astype(np.int64)
                base = (counts + 1) / below
                emit = np.where(counts > 0, counts / np.maximum(np.concatenate([in_class, [1, 1]])[own], 1), 0) * (1 - unknown)
                begins = np.cumsum(sizes) - sizes
                cls_t = own[ids]
                before = np.concatenate([[classes], cls_t[:-1]])
                before[begins] = classes
                known = counts[ids] > 0
                move = np.zeros(len(ids))
                move[known] = chance[before[known], cls_t[known]]
                model = np.where(known, weight * move * emit[ids] + (1 - weight) * base[ids], unknown)
                yield batch(
                    schema,
                    doc_ids,
                    np.frombuffer(held, bool),
                    sizes,
                    np.add.reduceat(known.astype(np.int64), begins),
                    np.full(len(sizes), total),
                    np.add.reduceat(np.log10(base)[ids], begins),
                    np.add.reduceat(np.log10(model), begins),
                )

    ddl = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return told.select("doc_ids", "held", "sizes", "ids", "heard").mapInArrow(tidy(run), ddl)


class Model:
    """A clustered corpus: ``corpus``, ``vocab`` (counts and classes by range), ``links``, the ``table`` of class transitions, the
    number of training tokens and of distinct ones, and the mutual information that each round began with."""

    def __init__(self, docs: DataFrame, classes: int = CLASSES, rounds: int = ROUNDS, with_words: bool = False):
        spark = docs.sparkSession
        self.parts = parts = shuffle_parts(spark)
        self.corpus = stored(encode(docs, parts), "corpus")
        self.stored = stored(vocabulary(self.corpus, parts, classes, with_words), "vocabulary")
        names = [f.name for f in _VOCAB]
        self.links, vocab = self.stored.where("chunk is not null").select(*names), self.stored.where("chunk is null").select(*names)

        def sums(batches):
            for b in batches:
                counts = [unplanes(x, np.int64) for x in b.column(3).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array([int(c.sum()) for c in counts], pa.int64()), pa.array([int((c > 0).sum()) for c in counts], pa.int64())], names=["n", "v"])

        self.total, self.distinct = vocab.mapInArrow(tidy(sums), "n long, v long").agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("v"), F.lit(0))).first()
        self.information: list[float] = []
        before = None  # (vocab, table) of the round before
        for k in range(rounds + 1):
            last = k == rounds
            contexts = _contexts(_told(self.corpus, vocab, self.links, parts), classes, not last)
            contexts = contexts if last else stored(contexts, "contexts")
            table = _transitions(contexts, classes)
            if before and information(table) < self.information[-1]:
                vocab, table = before
                last = True
            else:
                self.information.append(information(table))
            if not last:
                before = vocab, table
                vocab = stored(_exchange(vocab, self.links, contexts, table, parts), "classes")
            if hasattr(contexts, "_stored_at"):
                discard(contexts)
            if last:
                break
        self.vocab, self.table = vocab, table

    def words(self) -> DataFrame:
        """(word, count, class) of every word of the corpus, the end being the empty word; class is null for words that training
        doesn't hold. Needs ``with_words``."""
        names = self.stored.where("words is not null").select(F.col("part").alias("p"), "words")
        rows = self.vocab.join(names, F.col("part") == F.col("p")).select("words", "counts", "classes")
        schema = pa.schema([("word", pa.binary()), ("count", pa.int64()), ("class", pa.int32())])

        def run(batches):
            for b in batches:
                for words, counts, classes in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    cls = [None if c == UNKNOWN else c for c in classes]
                    yield batch(schema, words.split(b"\n"), unplanes(counts, np.int64), cls)

        return rows.mapInArrow(tidy(run), "word binary, count long, class int")


def score(docs: DataFrame, classes: int = CLASSES, rounds: int = ROUNDS, weight: float = WEIGHT) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row of ``docs``."""
    m = Model(docs, classes, rounds)
    return _scored(_told(m.corpus, m.vocab, m.links, m.parts, True), m.table, m.total, m.distinct, weight)
