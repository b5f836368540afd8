"""Supervised subword embeddings as a quality classifier (operator 4).

A text is read as words; a word that ends a run of three words which the text has had before is read as one mark instead,
``DITTO``, so that repeated lines and stuttering count as repetition whatever they say. A
document is the mean of the learned vectors of its features: every word, and every character
3-gram and 4-gram inside a word (with one blank as its border), hashed into ``BUCKETS`` rows; characters are code points. A softmax over
the two labels follows; numpy
stochastic gradient descent trains vectors and output together. Labels come from a bounded sample of ``SAMPLE`` labelled rows, taken by hash order so that it
is spread over the corpus. The model that is sent to the executors has a fixed size: with two labels the
softmax of a mean is a logistic function of the mean of one number per bucket, so scoring gathers these
numbers instead of vectors.

Null and empty texts have no feature and get the score of the bias alone. Texts are used whole. If the
sample holds one label only (or none), every score is that label's share (0.5 without labels). Repeated rows
are scored alike; a document labelled more than once counts once, with its largest label, and of rows that share an id the least
text trains. Columns other than the id and the text never reach the score, and ``accepted`` returns them unchanged. An
empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import batch, byte_texts, fresh_name, planes, quoted, ready, tidy, unplanes

#: Rows of the hashed embedding table, its width, and the most labelled rows that training takes.
BUCKETS, WIDTH, SAMPLE = 1 << 18, 16, 6000
EPOCHS, RATE, SEED = 8, 20.0, 20
_P = np.uint64(0x100000001B3)
#: The word that stands for a repeated one.
DITTO = np.uint64(0x1234567)


def features(text: bytes) -> np.ndarray:
    """Bucket of every feature occurrence of a text: words, and n-grams of 3 and 4 characters."""
    codes = np.frombuffer((" " + text.decode() + " ").encode("utf-32-le"), np.uint32)
    blank = (codes == 32) | ((codes >= 9) & (codes <= 13))
    solid = ~blank
    codes = np.where(blank, 32, codes).astype(np.uint64)
    starts = np.flatnonzero(solid[1:] & blank[:-1]) + 1
    if not len(starts):
        return np.zeros(0, np.int32)
    lengths = np.flatnonzero(solid[:-1] & blank[1:]) + 1 - starts
    at = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    words = np.add.reduceat((codes[solid] + np.uint64(1)) * _powers(int(lengths.max()))[at], np.cumsum(lengths) - lengths)
    if len(words) >= 3:
        runs = (words[:-2] * _P + words[1:-1]) * _P + words[2:]
        fresh = np.ones(len(words), bool)
        fresh[2:] = False
        fresh[2 + np.unique(runs, return_index=True)[1]] = True
        words = np.where(fresh, words, DITTO)
        solid[solid] = np.repeat(fresh, lengths)
        codes[~solid] = 32
    three = (codes[:-2] * _P + codes[1:-1]) * _P + codes[2:]
    four = three[:-1] * _P + codes[3:]
    keys = np.concatenate([three[solid[1:-1]] + np.uint64(3 << 40), four[solid[1:-2] & solid[2:-1]] + np.uint64(5 << 40), words])
    keys = (keys ^ (keys >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (keys >> np.uint64(64 - 18)).astype(np.int32)


_POWERS = np.ones(1, np.uint64)


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        grown = np.full(max(n, 256), np.uint64(0x9E3779B97F4A7C15))
        grown[0] = 1
        _POWERS = np.multiply.accumulate(grown)
    return _POWERS


def train(samples: list[tuple[np.ndarray, np.ndarray, int]]) -> tuple[np.ndarray, float]:
    """(number of each bucket, bias) from samples of (buckets, counts, label)."""
    share = float(np.mean([y for *_, y in samples])) if samples else 0.5
    if share in (0.0, 1.0) or not samples:
        share = min(max(share, 1e-6), 1 - 1e-6)
        return np.zeros(BUCKETS, np.float32), float(np.log(share / (1 - share)))
    rng = np.random.default_rng(SEED)
    vectors = rng.uniform(-1 / WIDTH, 1 / WIDTH, (BUCKETS, WIDTH)).astype(np.float32)
    output = np.zeros((2, WIDTH), np.float32)
    bias = np.array([0.0, np.log(share / (1 - share))], np.float32)
    steps, step = EPOCHS * len(samples), 0
    for _ in range(EPOCHS):
        for k in rng.permutation(len(samples)):
            buckets, counts, label = samples[k]
            rate = np.float32(RATE * (1 - step / steps))
            step += 1
            if not len(buckets):
                continue
            weight = (counts / counts.sum()).astype(np.float32)
            hidden = weight @ vectors[buckets]
            logits = output @ hidden + bias
            chance = np.exp(logits - logits.max())
            chance /= chance.sum()
            error = chance
            error[label] -= 1
            back = error @ output
            output -= rate * np.float32(0.05) * np.outer(error, hidden)
            bias -= rate * np.float32(0.001) * error
            vectors[buckets] -= (rate * weight)[:, None] * back
    return vectors @ (output[1] - output[0]), float(bias[1] - bias[0])


def remainder(id_col: str, divisor: int) -> Column:
    """crc32 of the id as text, modulo ``divisor``."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(divisor))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, float]:
    """Train on at most ``sample`` labelled documents, none with remainder 1 modulo 3."""
    chosen = (
        labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & (remainder("doc_id", 3) != 1))
        .groupBy(F.col("doc_id").cast("long").alias("l_id"))
        .agg(F.max("quality").cast("int").alias("label"))
        .orderBy(F.xxhash64(F.col("l_id"), F.lit(SEED)), "l_id")
        .limit(sample)
    )
    schema = pa.schema([("label", pa.int32()), ("id", pa.int64()), ("buckets", pa.binary()), ("counts", pa.binary())])

    def run(batches):
        press = zstandard.ZstdCompressor(level=1)
        for b in batches:
            rows = []
            for label, i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), byte_texts(b.column(2)), strict=True):
                buckets, counts = np.unique(features(text), return_counts=True)
                rows.append((label, i, press.compress(planes(np.diff(buckets, prepend=0).astype("<i4"))), press.compress(planes(counts.astype("<i4")))))
            yield batch(schema, *zip(*rows, strict=True))

    # the chosen rows are at most ``sample``: a proven bound for the broadcast
    matched = ready(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), F.col("doc_id") == F.col("l_id"))
    matched = matched.groupBy("l_id").agg(F.max("label").alias("label"), F.min("text").alias("text")).select("label", "l_id", "text")
    got = matched.mapInArrow(tidy(run), "label int, id long, buckets binary, counts binary").collect()
    got.sort(key=lambda r: (r["id"], r["buckets"]))
    press = zstandard.ZstdDecompressor()

    def numbers(raw: bytes) -> np.ndarray:
        return unplanes(press.decompress(raw) if raw else b"", np.int32)

    return train([(np.cumsum(numbers(r["buckets"]), dtype=np.int32), numbers(r["counts"]), r["label"]) for r in got])


def scored(docs: DataFrame, model: tuple[np.ndarray, float], name: str = "score") -> DataFrame:
    """``docs`` with the column ``name``: the chance of label 1."""
    numbers = docs.sparkSession.sparkContext.broadcast((model[0].astype(np.float32), model[1]))
    at = docs.columns.index("text")

    def run(batches):
        table, bias = numbers.value
        for b in batches:
            out = np.empty(b.num_rows)
            for k, text in enumerate(byte_texts(b.column(at))):
                found = features(text)
                out[k] = bias + (table[found].mean(dtype=np.float64) if len(found) else 0.0)
            score = pa.array(1 / (1 + np.exp(-np.clip(out, -500, 500))), pa.float64())
            yield pa.RecordBatch.from_arrays([*b.columns, score], names=[*b.schema.names, name])

    return ready(docs).mapInArrow(tidy(run), T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs``."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return scored(rows, fit(docs, labels)).select(
        "doc_id", (remainder("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` predicted as label 1, with their columns."""
    name = fresh_name(docs, "score")
    return scored(docs, fit(docs, labels), name).where(F.col(name) >= 0.5).select(*(quoted(c) for c in docs.columns))
