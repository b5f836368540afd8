"""Exact deduplication on a cuckoo-filter index (operator 5).

``CuckooIndex`` keeps 16-bit tags of 64-bit digests in buckets of four with partial-key cuckoo
hashing, beside the stored keys of every bucket. It inserts and deletes live digests; a look-up
that hits is verified against the content kept for the bucket, so a false hit is never a duplicate;
when a chain of evictions overflows, the table doubles and is refilled from the stored keys.

``classes`` runs the index twice. In every map task it folds the task's own copies, so that at most
one row per text and task is exchanged however large a group is; the rows of a digest then meet in
one shard, whose index folds them for good. ``content`` is what verifies a hit: the SHA-256 of the
text with its length in bytes, 40 bytes instead of a text of any length (two of n different texts agree with a chance below n^2 / 2^257).

Null texts equal empty ones. Of equal texts the row with the largest id stays; a null id is less than
every other, so a row without an id stays where no row of its text has one. In ``duplicates`` rows repeated with one
id, or all without, count each and are kept together; ``deduplicate`` leaves one of them. Rows that share an id, but not the
text, are judged apart. An empty table gives an empty result. Columns other than id and text are
carried by ``deduplicate`` and ignored by ``classes``, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, byte_texts, fresh_name, quoted, ready, shuffle_parts, tidy

SLOTS = 4
MAX_KICKS = 200


class CuckooIndex:
    """A cuckoo filter over 64-bit digests, with the content of every live digest by bucket."""

    def __init__(self, buckets: int = 1024):
        self.mask = buckets - 1
        if buckets & self.mask:
            raise ValueError("the number of buckets is a power of two")
        self.tags = [[] for _ in range(buckets)]
        #: bucket of a digest's first choice -> {content: value}; also the stored keys for resizing
        self.content: list[dict[bytes, list]] = [{} for _ in range(buckets)]
        self.size = 0

    @staticmethod
    def _tag(digest: int) -> int:
        return (digest >> 48) or 1

    def _other(self, bucket: int, tag: int) -> int:
        return bucket ^ (tag * 0x5BD1E995 & self.mask)

    def _hit(self, digest: int) -> bool:
        tag, first = self._tag(digest), digest & self.mask
        return tag in self.tags[first] or tag in self.tags[self._other(first, tag)]

    def get(self, digest: int, content: bytes) -> list | None:
        """The value of a live digest whose content is the same, else None."""
        return self.content[digest & self.mask].get(content) if self._hit(digest) else None

    def insert(self, digest: int, content: bytes, value: list) -> None:
        """Add a digest that is not live yet. Digests that clash with other content may both live."""
        self.content[digest & self.mask][content] = [digest, value]
        self.size += 1
        if not self._place(digest):
            self._resize()

    def delete(self, digest: int, content: bytes) -> bool:
        """Remove a live digest; False if it is not live."""
        home = self.content[digest & self.mask]
        if content not in home:
            return False
        del home[content]
        self.size -= 1
        tag, first = self._tag(digest), digest & self.mask
        bucket = self.tags[first] if tag in self.tags[first] else self.tags[self._other(first, tag)]
        bucket.remove(tag)
        return True

    def _place(self, digest: int) -> bool:
        tag, bucket = self._tag(digest), digest & self.mask
        for b in (bucket, self._other(bucket, tag)):
            if len(self.tags[b]) < SLOTS:
                self.tags[b].append(tag)
                return True
        for kick in range(MAX_KICKS):
            slots = self.tags[bucket]
            victim = (tag + kick) % SLOTS
            slots[victim], tag = tag, slots[victim]
            bucket = self._other(bucket, tag)
            if len(self.tags[bucket]) < SLOTS:
                self.tags[bucket].append(tag)
                return True
        return False

    def _resize(self) -> None:
        """Double until every stored key has its place again."""
        live = [(content, kept) for home in self.content for content, kept in home.items()]
        buckets = len(self.tags)
        while True:
            buckets *= 2
            self.mask = buckets - 1
            self.tags = [[] for _ in range(buckets)]
            if all(self._place(kept[0]) for _, kept in live):
                break
            if buckets > 64 * (len(live) + 1024):
                raise OverflowError("more than eight live digests share one tag and bucket pair")
        self.content = [{} for _ in range(buckets)]
        for content, kept in live:
            self.content[kept[0] & self.mask][content] = kept

    def fold(self, digest: int, content: bytes, keep: int | None, count: int, copies: int = 1) -> None:
        """Count rows: a new digest goes in, a verified hit raises the class it belongs to. Its value is
        [largest id, rows, rows with that id]."""
        kept = self.get(digest, content)
        if kept is None:
            self.insert(digest, content, [keep, count, copies])
            return
        value = kept[1]
        if keep == value[0]:
            value[2] += copies
        elif value[0] is None or keep is not None and keep > value[0]:
            value[0], value[2] = keep, copies
        value[1] += count

    def entries(self):
        for home in self.content:
            for content, (digest, value) in home.items():
                yield digest, content, value


def _fold_table(schema: pa.Schema, index: CuckooIndex) -> pa.RecordBatch:
    rows = list(index.entries())
    return batch(schema, [d - (1 << 64) if d >> 63 else d for d, _, _ in rows], [c for _, c, _ in rows], *([v[k] for _, _, v in rows] for k in range(3)))


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, content): content is the SHA-256 of the whole text and its length in bytes."""
    schema = pa.schema([("id", pa.int64()), ("content", pa.binary())])

    def run(batches):
        for b in batches:
            yield batch(schema, b.column(0), [hashlib.sha256(t).digest() + len(t).to_bytes(8, "big") for t in byte_texts(b.column(1))])

    return ready(docs).select(F.col(quoted(id_col)).cast("long"), quoted(text_col)).mapInArrow(tidy(run), "id long, content binary")


def classes(contents: DataFrame) -> DataFrame:
    """(content, keep_id, group_size, keep_rows) for every distinct content of (id, content); keep_rows have keep_id."""
    schema = pa.schema([("digest", pa.int64()), ("content", pa.binary()), ("keep_id", pa.int64()), ("group_size", pa.int64()), ("keep_rows", pa.int64())])
    ddl = "digest long, content binary, keep_id long, group_size long, keep_rows long"

    def in_task(batches):
        index = CuckooIndex()
        for b in batches:
            for i, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                index.fold(int.from_bytes(content[:8], "big"), content, i, 1)
        if index.size:
            yield _fold_table(schema, index)

    def in_shard(batches):
        index = CuckooIndex()
        for b in batches:
            for digest, content, keep, count, copies in zip(*(c.to_pylist() for c in b.columns), strict=True):
                index.fold(digest & (1 << 64) - 1, content, keep, count, copies)
        if index.size:
            yield _fold_table(schema, index)

    spark = contents.sparkSession
    local = contents.mapInArrow(tidy(in_task), ddl)
    return local.repartition(shuffle_parts(spark), "digest").mapInArrow(tidy(in_shard), ddl).drop("digest")


def duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256), one row per document."""
    contents = digests(docs)
    joined = contents.join(classes(contents), "content")
    return joined.select(
        F.col("id").alias("doc_id"),
        "keep_id",
        "group_size",
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex(F.substring("content", 1, 32))).alias("text_sha256"),
    )


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, one of every text, with all their columns. Of rows that share text and id one whose text isn't null stays, of several such
    the least as JSON."""
    own, content, keep, rows = (fresh_name(docs, n) for n in ("own", "content", "keep", "rows"))
    text = F.coalesce(F.col(quoted(text_col)), F.lit("")).cast("binary")
    key = F.concat(F.unhex(F.sha2(text, 256)), F.unhex(F.lpad(F.hex(F.octet_length(text)), 16, "0")))
    kept = classes(digests(docs, id_col, text_col)).select(F.col("content").alias(content), F.col("keep_id").alias(keep), F.col("keep_rows").alias(rows))
    # copies have ids of their own, so that a common text is no common key
    met = docs.withColumn(own, key).join(kept, (F.col(own) == F.col(content)) & F.col(quoted(id_col)).cast("long").eqNullSafe(F.col(keep)))
    every = F.struct(*(F.col(quoted(c)) for c in docs.columns))
    # a text that isn't null first, then the least row as JSON: a rerun keeps the same
    least = F.min_by(every, F.struct(F.col(quoted(text_col)).isNull(), F.to_json(every)))
    once, often = met.where(F.col(rows) == 1), met.where(F.col(rows) > 1).groupBy(own).agg(least.alias(keep)).select(f"{quoted(keep)}.*")
    return once.select(*(F.col(quoted(c)) for c in docs.columns)).unionByName(often)
