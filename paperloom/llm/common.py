"""Shared helpers: intermediate tables in the cluster's shared folder, text columns as bytes, packed runs."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import shared
from ..shared import BROADCAST_ROWS, discard, fresh_name, quoted, shared_dir, with_small  # noqa: F401  for the operators
from ..ship import ship

#: What separates words in every contract: space and the five controls from tab to carriage return.
WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_SPACES = bytes.maketrans(b"\t\n\x0b\x0c\r", b"     ")


#: Spark's default bound on the bytes of an Arrow batch, and the one used here instead: a task holds several copies of a batch.
_DEFAULT_BATCH, _BATCH = "67108864b", "4m"


def ready(df: DataFrame) -> DataFrame:
    """``df``, with this package sent to the workers and Arrow batches kept small (unless the session sets their size)."""
    spark = df.sparkSession
    ship(spark)
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) == _DEFAULT_BATCH:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", _BATCH)
    return df


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back, as ``shared.stored`` does, with Arrow batches kept small."""
    return shared.stored(ready(df), name)


def trim() -> None:
    """Give memory that is free again back to the system: Python workers live on between tasks and stages."""
    import ctypes

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def tidy(run):
    """``run`` for mapInArrow, with ``trim`` at the end of its task."""

    def wrapped(batches):
        yield from run(batches)
        trim()

    return wrapped


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def byte_texts(column: pa.Array | pa.ChunkedArray) -> Iterator[bytes]:
    """Each text of an Arrow string column as UTF-8 bytes; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    filled = pc.fill_null(column, "")
    return (x.as_buffer().to_pybytes() if x.is_valid else b"" for x in filled.cast(pa.large_binary()))


def texts(column: pa.Array | pa.ChunkedArray) -> list[str]:
    return ["" if x is None else x for x in column.to_pylist()]


def words_of(text: bytes) -> list[bytes]:
    """The words ``[^\\x20\\x09-\\x0D]+`` of UTF-8 bytes (no multi-byte sequence holds those bytes)."""
    return [w for w in text.translate(_SPACES).split(b" ") if w]


def lower_ascii(text: bytes) -> bytes:
    """A-Z in lower case, every other byte unchanged."""
    return text.lower()  # bytes.lower() maps ASCII only


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser over uint64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def unequal(flat: np.ndarray, first: np.ndarray, lengths: np.ndarray, like: np.ndarray) -> np.ndarray:
    """Places of the words that differ from the word at ``like``: words are ``lengths`` (at least 1) bytes of ``flat`` from ``first`` on."""
    if not len(first):
        return np.zeros(0, np.int64)
    same = lengths == lengths[like]
    at = np.arange(len(flat)) - np.repeat(first, lengths)
    differs = flat != flat[np.repeat(np.where(same, first[like], first), lengths) + at]
    return np.flatnonzero(~same | np.logical_or.reduceat(differs, first))


def planes(values: np.ndarray) -> bytes:
    """Integers as byte planes, so that sorted or clustered values compress well in a shuffle."""
    values = np.ascontiguousarray(values)
    return np.ascontiguousarray(values.view(np.uint8).reshape(-1, values.dtype.itemsize).T).tobytes()


def unplanes(data: bytes, dtype) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).view(dtype).reshape(-1)


def batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    """A record batch of ``schema``; without columns an empty one."""
    columns = columns or tuple([] for _ in schema)
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema
    )


# ---- places in an order -------------------------------------------------------------------

def ranked(df: DataFrame, name: str, *order) -> DataFrame:
    """``df``, stored, with the long column ``name``: its rows' places from 1 in ``order``, which equal rows share out in any way. Rows are dealt out
    by ranges of the order, numbered in their task, and moved up by the rows of the ranges before; one row per task is summed in one place."""
    at = fresh_name(df, "at")
    parts = df.repartitionByRange(shuffle_parts(df.sparkSession), *order).sortWithinPartitions(*order)
    rows = stored(parts.withColumn(at, F.monotonically_increasing_id()), "ranked")
    task, within = F.shiftright(at, 33), F.col(at).bitwiseAND(F.lit((1 << 33) - 1))
    sizes = rows.groupBy(task.alias("_task")).agg(F.count("*").alias("_n"))
    before = Window.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_task", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return rows.join(F.broadcast(starts), task == F.col("_task")).withColumn(name, F.col("_start") + within + 1).drop("_task", "_start", at)


# ---- documents and what is known about them, brought together -----------------------------


def buckets(ids: np.ndarray, parts: int) -> np.ndarray:
    """The bucket, from 0 to parts - 1, in which a document meets its pieces."""
    return (mix64(ids.view(np.uint64)) % np.uint64(parts)).astype(np.int32)


def by_bucket(ids: np.ndarray, parts: int, *values: np.ndarray):
    """(bucket, ids, values ...) for every bucket that has any, ids in order."""
    own = buckets(ids, parts)
    order = np.lexsort((ids, own))
    own, ids, values = own[order], ids[order], [v[order] for v in values]
    cut = np.flatnonzero(np.diff(own)) + 1
    for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(own)], strict=True):
        if b > a:
            yield int(own[a]), ids[a:b], *(v[a:b] for v in values)


def with_bucket(docs: DataFrame, parts: int, id_col: str = "doc_id") -> DataFrame:
    """(_bucket, doc): rows of ``docs`` as structs, so that no column of theirs clashes with any other (a null id has bucket 0)."""
    at = docs.columns.index(id_col)

    def run(batches):
        for b in batches:
            own = buckets(np.asarray(pc.fill_null(b.column(at).cast(pa.int64()), 0)), parts)
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.StructArray.from_arrays(b.columns, fields=list(b.schema))], names=["_bucket", "doc"])

    return docs.mapInArrow(run, T.StructType([T.StructField("_bucket", T.IntegerType()), T.StructField("doc", docs.schema)]))


def met(docs: DataFrame, pieces: DataFrame, parts: int) -> DataFrame:
    """(doc, packed ...): documents of ``with_bucket`` and packed pieces (``_bucket`` and binary columns, all null in documents) in one
    partition per bucket, the pieces first; doc is null in these."""
    extra = [c for c in pieces.columns if c != "_bucket"]
    rows = docs.unionByName(pieces, allowMissingColumns=True)
    return rows.repartitionById(parts, F.col("_bucket")).sortWithinPartitions(F.col("doc").isNotNull()).select("doc", *extra)


def parted(b: pa.RecordBatch) -> tuple[pa.RecordBatch, list[tuple]]:
    """The documents of a batch of ``met`` with their own columns, and its packed rows."""
    is_doc = b.column(0).is_valid()
    docs = b.filter(is_doc)
    packed = b.filter(pc.invert(is_doc))
    return pa.RecordBatch.from_struct_array(docs.column(0)), list(zip(*(c.to_pylist() for c in packed.columns[1:]), strict=True))


class Pieces:
    """Packed pieces of a partition, by document."""

    def __init__(self):
        self.found: list[tuple] = []
        self.table: tuple | None = None

    def add(self, *arrays: np.ndarray) -> None:
        self.found.append(arrays)

    def of(self, i: int | None) -> tuple[np.ndarray, ...] | None:
        """The values of a document, or None. After the first call nothing more is added."""
        if self.table is None:
            columns = [np.concatenate(x) for x in zip(*self.found, strict=True)] if self.found else [np.zeros(0, np.int64)]
            order = np.argsort(columns[0], kind="stable")
            self.table = tuple(c[order] for c in columns)
            self.found = []
        if i is None:
            return None
        a, b = np.searchsorted(self.table[0], [i, i + 1])
        return tuple(c[a:b] for c in self.table[1:]) if b > a else None
