"""Files read in place and by range, from any file system that Arrow knows."""

from __future__ import annotations

from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession

#: What may stand in a URL besides letters and digits.
_URL_SAFE = ":/%@?&=+$,;~!*'()#[]-._"


def listed(spark: SparkSession, path: str) -> DataFrame:
    """(path, length) of the files under a path; no content is read. Spark's scan leaves out files without a byte."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")


def opened(path: str):
    """A file for reading by seek: a local path or a URL."""
    from pyarrow import fs

    if ":" not in path:
        return fs.LocalFileSystem().open_input_file(path)
    system, inner = fs.FileSystem.from_uri(quote(path, safe=_URL_SAFE))
    return system.open_input_file(inner)


def read_at(f, offset: int, n: int) -> bytes:
    """``n`` bytes from an offset, fewer only at the end of the file."""
    f.seek(offset)
    return f.read(n)
