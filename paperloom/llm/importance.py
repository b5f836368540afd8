"""Target-distribution importance resampling (operator 13).

Features are runs of 1 to ``n`` consecutive words, hashed into ``buckets``. The gain of a bucket is the smoothed log ratio of its share of the
target's features to its share of the documents'; a document's weight is the sum of its features' gains, and the documents with the highest
weight plus Gumbel noise, which a seeded hash of the id decides, are a sample without replacement.

Long texts are no single task's work: texts over ``CHUNK`` bytes are split at word boundaries (``chunks``), each chunk carries the
``n - 1`` words that follow it and owns the features that start before them, and chunks are dealt out. Words are hashed once: what is stored
of a chunk is its buckets, two bytes a feature. Counts are summed over chunks by bucket, weights over chunks by document. Only the bucket
counts (``buckets`` rows, a parameter) reach the driver. Ranks come from a range partition of (score, id), without a global sort in one place.

Null texts have no words, no features and weight 0. Rows are weighed one by one, also where they share an id; a null id hashes as no text and follows the other
ids of its score. Equal (score, id) take consecutive ranks in any order. An empty table gives an empty result, an empty target makes every t and T 0. Other
columns are not read, whatever their names.
"""

from __future__ import annotations

import math
import re
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, byte_texts, ready, ranked, shuffle_parts, stored, tidy

#: Words of the longest feature, buckets (65,536 at most), seed of the noise, percent of the documents that are drawn, words that a drawn document has at least.
LONGEST, BUCKETS, SEED, PERCENT, LEAST_WORDS = 1, 10_000, 2024, 10, 20
#: Bytes of a text beyond which it is split, and of a chunk.
CHUNK = 1 << 15
#: A-Z in lower case; all other ASCII but letters and digits parts words.
_CLEAN = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
_NEXT_WORD = re.compile(rb" *[^ ]*")


def clean(text: bytes) -> bytes:
    """Words in lower case and spaces."""
    return text.translate(_CLEAN)


def chunks(cleaned: bytes, n: int, size: int = CHUNK):
    """(bytes, own): pieces of a cleaned text, of which the first ``own`` bytes are the chunk's and the rest the n - 1 words that follow."""
    start = 0
    while True:
        cut = cleaned.find(b" ", start + size)
        if cut < 0:
            yield cleaned[start:], len(cleaned) - start
            return
        end = cut
        for _ in range(n - 1):
            end = _NEXT_WORD.match(cleaned, end).end()
        yield cleaned[start:end], cut - start
        start = cut


def features(chunk: bytes, own: int, n: int, buckets: int) -> tuple[int, np.ndarray]:
    """How many words a chunk owns, and the bucket of every feature that starts at one of them."""
    words = chunk.split()
    mine = len(words) if own == len(chunk) else len(chunk[:own].split())
    found = [np.fromiter(map(crc32, words[:mine]), np.uint32, mine)]
    if n > 1:
        joined = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])[: len(words)]
        for k in range(2, n + 1):
            m = max(0, min(mine, len(words) - k + 1))
            found.append(np.fromiter((crc32(joined[a:b]) for a, b in zip(starts[:m].tolist(), ends[k - 1 : k - 1 + m].tolist(), strict=True)), np.uint32, m))
    return mine, (np.concatenate(found) % np.uint32(buckets)).astype(np.uint16)


_HASHED = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("n_words", pa.int64()), ("buckets", pa.binary())])
_HASHED_DDL = "row long, doc_id long, n_words long, buckets binary"
_PIECE = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("piece", pa.int32()), ("own", pa.int64()), ("bytes", pa.binary())])
_PIECE_DDL = "row long, doc_id long, piece int, own long, bytes binary"


def hashed(docs: DataFrame, n: int = LONGEST, buckets: int = BUCKETS, size: int = CHUNK) -> DataFrame:
    """(row, doc_id, n_words, buckets) of every chunk of (doc_id, text), stored; buckets packed as 16-bit integers."""
    if not 0 < buckets <= 1 << 16:
        raise ValueError("buckets is from 1 to 65536")

    def whole(batches):
        for b in batches:
            found = [features(t, len(t), n, buckets) for t in map(clean, byte_texts(b.column(2)))]
            yield batch(_HASHED, b.column(0), b.column(1), [m for m, _ in found], [x.tobytes() for _, x in found])

    def split(batches):
        for b in batches:
            for row, doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), byte_texts(b.column(2)), strict=True):
                for k, (piece, own) in enumerate(chunks(clean(text), n, size)):
                    yield batch(_PIECE, [row], [doc_id], [k], [own], [piece])

    def pieces(batches):
        for b in batches:
            found = [features(x, own, n, buckets) for x, own in zip(b.column(4).to_pylist(), b.column(3).to_pylist(), strict=True)]
            yield batch(_HASHED, b.column(0), b.column(1), [m for m, _ in found], [x.tobytes() for _, x in found])

    rows = ready(docs).select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    long = F.octet_length("text") > size
    short = rows.where(~long).mapInArrow(tidy(whole), _HASHED_DDL)
    dealt = rows.where(long).mapInArrow(tidy(split), _PIECE_DDL).repartition(shuffle_parts(docs.sparkSession), "row", "piece")
    return stored(short.unionByName(dealt.mapInArrow(tidy(pieces), _HASHED_DDL)), "hashed")


def bucket_counts(chunked: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Features of all chunks by bucket: summed in each task, then by bucket."""
    schema = pa.schema([("bucket", pa.int32()), ("n", pa.int64())])

    def run(batches):
        total = np.zeros(buckets, np.int64)
        for b in batches:
            for packed in b.column(0):
                total += np.bincount(np.frombuffer(packed.as_buffer(), np.uint16), minlength=buckets)
        at = np.flatnonzero(total)
        if len(at):
            yield batch(schema, at.astype(np.int32), total[at])

    out = np.zeros(buckets, np.int64)
    for bucket, n in chunked.select("buckets").mapInArrow(tidy(run), "bucket int, n long").groupBy("bucket").agg(F.sum("n")).collect():
        out[bucket] = n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of every bucket's smoothed share of the target over that of the source."""
    k, of_source, of_target = len(source), float(source.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1) * (of_source + k) / ((s + 1) * (of_target + k)))) for s, t in zip(source.astype(float), target.astype(float), strict=True)], np.int64)


def weighed(chunked: DataFrame, gain: np.ndarray) -> DataFrame:
    """(doc_id, n_words, n_features, weight) of every row."""
    schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_features", pa.int64()), ("weight", pa.int64())])

    def run(batches):
        for b in batches:
            packed = [np.frombuffer(x.as_buffer(), np.uint16) for x in b.column(3)]
            sizes = pc.divide(pc.binary_length(b.column(3)).cast(pa.int64()), 2)
            yield batch(schema, b.column(0), b.column(1), b.column(2), sizes, [int(gain[x].sum()) for x in packed])

    parts = chunked.select("row", "doc_id", "n_words", "buckets").mapInArrow(tidy(run), "row long, doc_id long, n_words long, n_features long, weight long")
    return parts.groupBy("row", "doc_id").agg(*(F.sum(c).alias(c) for c in ("n_words", "n_features", "weight"))).drop("row")


def resampled(
    docs: DataFrame, target: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED, size: int = CHUNK
) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank) of every row of ``docs``, drawn towards the texts of ``target``: rank is 1, 2, 3 ... by descending
    score for the ``floor(percent * N / 100)`` best of the N rows with ``least_words`` words, else null."""
    chunked = hashed(docs, longest, buckets, size)
    wanted = hashed(target.select(F.lit(None).cast("long").alias("doc_id"), "text"), longest, buckets, size)
    gain = gains(bucket_counts(chunked, buckets), bucket_counts(wanted, buckets))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")
    scored = stored(weighed(chunked, gain).withColumns({"score": F.col("weight") + noise, "able": F.col("n_words") >= least_words}), "scored")
    drawn = percent * scored.where("able").count() // 100
    placed = ranked(scored, "rank", F.desc("able"), F.desc("score"), F.asc_nulls_last("doc_id"))
    return placed.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank"))).drop("able")


def digests(docs: DataFrame, target: DataFrame) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) with the default parameters."""
    return resampled(docs, target).select("doc_id", "n_features", "weight", "score", "rank")
