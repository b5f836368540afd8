"""Uploaded files: size limits, type by content, plug-ins for what this engine cannot decode itself."""

from __future__ import annotations

import io
import shutil
import zipfile
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scalars as S
from ..options import Options
from ..ship import ship
from .ranges import listed, opened, read_at

# ---- fixed values: leading bytes, limits, messages ------------------------------------------
MAX_UNPACKED_BYTES = 200 << 20
MIN_TEXT_WORDS = 15
LEADING = [("pdf", "255044462D"), ("jpeg", "FFD8FF"), ("png", "89504E470D0A1A0A"), ("tiff", "49492A00"), ("tiff", "4D4D002A")]
UNSUPPORTED = "Unsupported file type (expected JPEG, PNG, TIFF, WEBP, PDF or DOCX)"
TOO_LARGE_UNPACKED = "DOCX is too large when decompressed"
# ---------------------------------------------------------------------------------------------


@F.pandas_udf(T.StringType())
def _zip_kind(content: pd.Series) -> pd.Series:
    """docx, large, or null for any other ZIP file."""

    def kind(raw: bytes) -> str | None:
        try:
            with zipfile.ZipFile(io.BytesIO(raw)) as z:
                if not {"word/document.xml", "[Content_Types].xml"} <= set(z.namelist()):
                    return None
                return "docx" if sum(i.file_size for i in z.infolist()) <= MAX_UNPACKED_BYTES else "large"
        except Exception:  # noqa: BLE001  a damaged archive is an unknown file, whatever the fault
            return None

    return content.map(kind)


def leading_kind(content: Column) -> Column:
    """Kind by leading bytes; 'zip' needs a look inside."""
    head = F.hex(F.substring(content, 1, 12))
    chain = None
    for kind, start in LEADING[:1]:
        chain = F.when(head.startswith(start), kind)
    chain = chain.when(head.startswith("504B0304"), "zip")
    for kind, start in LEADING[1:]:
        chain = chain.when(head.startswith(start), kind)
    return chain.when(head.startswith("52494646") & head.endswith("57454250") & (F.length(head) == 24), "webp")


def sniffed(files: DataFrame) -> DataFrame:
    """``files`` (content, ...) with ``kind`` and ``error``. Only ZIP files meet Python."""
    rows = files.withColumn("_lead", leading_kind(F.col("content")))
    plain = rows.where("_lead is null or _lead <> 'zip'").withColumn("kind", F.col("_lead"))
    zips = rows.where("_lead = 'zip'").withColumn("kind", _zip_kind("content"))
    both = plain.unionByName(zips).drop("_lead")
    error = F.when(F.col("kind") == "large", TOO_LARGE_UNPACKED).when(F.col("kind").isNull(), UNSUPPORTED)
    return both.withColumns({"error": error, "kind": F.when(error.isNull(), F.col("kind"))})


def kind_at(f) -> str | None:
    """The kind of an opened file, or None, by its leading bytes and, of a ZIP file, its directory at the end: nothing else is read, however long the file is. A DOCX that is too
    large unpacked is ``large``. The same as ``sniffed`` says of whole contents."""
    head = read_at(f, 0, 12).hex().upper()
    if head.startswith(LEADING[0][1]):
        return LEADING[0][0]
    if head.startswith("504B0304"):
        try:
            with zipfile.ZipFile(f) as z:
                if not {"word/document.xml", "[Content_Types].xml"} <= set(z.namelist()):
                    return None
                return "docx" if sum(i.file_size for i in z.infolist()) <= MAX_UNPACKED_BYTES else "large"
        except Exception:  # noqa: BLE001  a damaged archive is an unknown file, whatever the fault
            return None
    for kind, start in LEADING[1:]:
        if head.startswith(start):
            return kind
    return "webp" if head.startswith("52494646") and head[16:] == "57454250" else None


def scanned(spark: SparkSession, path: str, options: Options = Options(), opener=opened) -> DataFrame:
    """``uploads`` without contents: (doc_id, filename, length, kind, error_code, error) of the files under a path, whose sizes come from the listing and whose
    kinds from a few bytes read in place. For file systems that Arrow knows; a file that can't be opened has error_code 400 and its fault as error."""
    ship(spark)
    files = listed(spark, path)
    length = F.col("length")
    code = F.when(length > options.max_upload_mb << 20, 413).when(length == 0, 400)
    rows = files.select("path", "length", code.alias("error_code"))

    def run(frames):
        for frame in frames:
            kinds, faults = [], []
            for at, bad in zip(frame["path"], frame["error_code"].notna(), strict=True):
                kind = fault = None
                if not bad:
                    try:
                        with opener(at) as f:
                            kind = kind_at(f)
                    except Exception as e:  # noqa: BLE001  one file's failure is its own row
                        fault = f"Could not open file: {e}"
                kinds.append(kind)
                faults.append(fault)
            out = frame[["path", "length"]].assign(kind=kinds, fault=faults, error_code=frame["error_code"].astype("Int64"))
            yield out

    judged_ = rows.mapInPandas(run, "path string, length long, kind string, fault string, error_code int")
    found, kind = F.col("error_code"), F.col("kind")
    error = (
        F.when(found == 413, "File is too large").when(found == 400, "File is empty").when(F.col("fault").isNotNull(), F.col("fault"))
        .when(kind == "large", TOO_LARGE_UNPACKED).when(kind.isNull(), UNSUPPORTED)
    )
    all_codes = F.coalesce(found, F.when(F.col("fault").isNotNull(), 400), F.when(error.isNotNull(), 415))
    return judged_.select(F.col("path").alias("doc_id"), S.safe_name(F.col("path")).alias("filename"), "length", F.when(error.isNull(), kind).alias("kind"), all_codes.alias("error_code"), error.alias("error"))


def uploads(spark: SparkSession, path: str, max_bytes: int | None = None, options: Options = Options()) -> DataFrame:
    """(doc_id, filename, length, content, kind, error_code, error) of the files under a path. Sizes are judged before any
    content is looked at."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    files = files.select(F.col("path").alias("doc_id"), S.safe_name(F.col("path")).alias("filename"), "length", "content")
    return judged(files, max_bytes, options)


def judged(files: DataFrame, max_bytes: int | None = None, options: Options = Options()) -> DataFrame:
    """``files`` (length, content, ...) with kind, error_code and error; the bound is ``max_upload_mb`` of ``options`` unless given."""
    max_bytes = options.max_upload_mb << 20 if max_bytes is None else max_bytes
    size_code = F.when(F.col("length") > max_bytes, 413).when(F.col("length") == 0, 400)
    rows = files.withColumn("error_code", size_code)
    # sizes and types do not change by trying again
    bad = rows.where("error_code is not null").withColumns(
        {"kind": F.lit(None).cast("string"), "error": F.when(F.col("error_code") == 413, "File is too large").otherwise("File is empty")}
    )
    good = sniffed(rows.where("error_code is null").drop("error_code")).withColumn("error_code", F.when(F.col("error").isNotNull(), 415))
    return bad.unionByName(good)


def batch(files: DataFrame, ordinal: str, max_files: int | None = None, max_bytes: int | None = None, options: Options = Options()) -> DataFrame:
    """``judged`` rows of one batch in the order of ``ordinal``; a batch of more than ``max_batch_files`` files is refused as a whole."""
    max_files = options.max_batch_files if max_files is None else max_files
    if len(files.select(ordinal).head(max_files + 1)) > max_files:
        raise ValueError(f"413: at most {max_files} files a batch")
    return judged(files, max_bytes, options).orderBy(ordinal)


class Unavailable(RuntimeError):
    """A decoder that is not installed here."""


def libreoffice_available() -> bool:
    return shutil.which("soffice") is not None or shutil.which("libreoffice") is not None


#: (content, kind, max_pages) -> iterator of (page_no, width, [(text, x0, y0, x1, y1, conf)], source)
WordReader = Callable[[bytes, str, int], Iterator[tuple[int, int, list[tuple], str]]]


def words_by(files: DataFrame, reader: WordReader | None, max_pages: int | None = None, options: Options = Options()) -> DataFrame:
    """(doc_id, page_no, width, source, word_idx, text, x0, y0, x1, y1, conf, error) of files (doc_id, content, kind) by a plug-in that reads
    text layers or recognises characters. A reader's error is its file's row; other files go on. error_kind is transient for a TimeoutError, for
    which trying again may help, else permanent."""
    max_pages = options.max_pdf_pages if max_pages is None else max_pages
    if reader is None:
        raise Unavailable("reading words from PDF, DOCX or images needs a reader plug-in; none is installed")
    columns = ["doc_id", "page_no", "width", "source", "word_idx", "text", "x0", "y0", "x1", "y1", "conf", "error", "error_kind"]
    ddl = "doc_id string, page_no int, width int, source string, word_idx int, text string, x0 int, y0 int, x1 int, y1 int, conf double, error string, error_kind string"

    def run(frames):
        for frame in frames:
            rows = []
            for doc_id, content, kind in zip(frame["doc_id"], frame["content"], frame["kind"], strict=True):
                try:
                    for page_no, width, words, source in reader(content, kind, max_pages):
                        kept = [w for w in words if w[0].strip() and w[5] >= 0]
                        rows += [(doc_id, page_no, width, source, k, *w, None, None) for k, w in enumerate(kept)] or [(doc_id, page_no, width, source, *[None] * 9)]
                except Exception as e:  # noqa: BLE001  one file's failure is its own row
                    rows.append((doc_id, *[None] * 10, str(e), "transient" if isinstance(e, TimeoutError) else "permanent"))
            yield pd.DataFrame(rows, columns=columns)

    return files.select("doc_id", "content", "kind").mapInPandas(run, ddl)


def recognised(raw: DataFrame) -> DataFrame:
    """Words of a recogniser's table (left, top, width, height, conf): blanks and layout rows (conf below 0) go."""
    return raw.where("trim(text) <> '' and conf >= 0").withColumns(
        {"x0": F.col("left"), "y0": F.col("top"), "x1": F.col("left") + F.col("width"), "y1": F.col("top") + F.col("height")}
    ).drop("left", "top", "width", "height")


def page_source(pages: DataFrame, min_words: int = MIN_TEXT_WORDS, options: Options = Options()) -> DataFrame:
    """Pages (n_words) with ``source``: the text layer if it has enough words, else recognition; pages past the cap go."""
    return pages.where(F.col("page_no") < options.max_pdf_pages).withColumn("source", F.when(F.col("n_words") >= min_words, "text").otherwise("ocr"))


def truth_file(spark: SparkSession, path: str) -> DataFrame:
    """Annotated samples of a JSON file: samples[].json_annotation is JSON in a string."""
    rows = spark.read.option("multiLine", "true").json(path).select(F.explode("samples").alias("s")).select("s.*")
    return rows.where("json_annotation <> ''")
