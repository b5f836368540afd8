"""Page images as a source: frames of PNG and TIFF files, found by seek and decoded in numpy.

``frames`` reads the headers of each file in place (a few hundred bytes a frame), so that a frame's size is known, and refused where it is too large, before
anything of it is read. Frames are rows of their own: Spark deals them out, and a file of many pages is not one task's.
``pixels`` reads the ranges of one frame, decodes them and turns the frame upright. JPEG and WEBP need a library that is not part of this repository; their
frames carry an error. An error is its frame's row, or its file's where no frame could be found; other files go on.
"""

from __future__ import annotations

import json
import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..options import Options
from ..ship import ship
from .ranges import opened, read_at

# ---- fixed values ---------------------------------------------------------------------------
#: Images are refused above this many times ``max_image_pixels``; up to it they are only large.
REFUSED_ABOVE = 2
PNG, TIFF_LITTLE, TIFF_BIG = b"\x89PNG\r\n\x1a\n", b"II*\0", b"MM\0*"
#: Samples of a pixel by PNG colour type: grey, RGB, palette, grey with opacity, RGB with opacity.
PNG_SAMPLES = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
#: Adam7: first column, first row, step across, step down of each pass.
PASSES = [(0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2)]
#: TIFF tags.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, OFFSETS, ORIENTATION, SAMPLES, ROWS, COUNTS, PLANAR, PREDICTOR, PALETTE, TILE_WIDTH = 256, 257, 258, 259, 262, 273, 274, 277, 278, 279, 284, 317, 320, 322
#: Bytes and struct code of the TIFF field types that are read: byte, short, long.
TIFF_TYPES = {1: (1, "B"), 3: (2, "H"), 4: (4, "I")}
DECODE = "Could not decode image: "
# ---------------------------------------------------------------------------------------------

_FRAME = ["path", "frame", "kind", "width", "height", "orientation", "layout", "error"]
_FRAME_DDL = "path string, frame int, kind string, width long, height long, orientation int, layout string, error string"


# ---- headers --------------------------------------------------------------------------------


def png_header(f) -> dict:
    """Size, sample layout, orientation and the ranges of image data; reads chunk heads and skips image data."""
    width, height, bits, colour, _, _, interlace = struct.unpack(">IIBBBBB", read_at(f, 16, 13))
    out = {"width": width, "height": height, "bits": bits, "colour": colour, "interlace": interlace, "spans": [], "orientation": 1}
    at = 33
    while len(head := read_at(f, at, 8)) == 8:
        n, name = struct.unpack(">I4s", head)
        if name == b"IDAT":
            out["spans"].append((at + 8, n))
        elif name in (b"PLTE", b"tRNS") and n <= 1024:
            out[name.decode()] = read_at(f, at + 8, n).hex()
        elif name == b"eXIf" and n < 1 << 16:
            out["orientation"] = _exif_orientation(read_at(f, at + 8, n))
        elif name == b"IEND":
            break
        at += 12 + n
    if colour not in PNG_SAMPLES or not out["spans"]:
        raise ValueError("damaged PNG")
    return out


def _exif_orientation(raw: bytes) -> int:
    try:
        return next(_directories(_Bytes(raw), 1))[ORIENTATION][0]
    except (KeyError, StopIteration, ValueError, struct.error):
        return 1


class _Bytes:
    """Bytes with the two methods of a file that are used here."""

    def __init__(self, raw: bytes):
        self.raw, self.at = raw, 0

    def seek(self, at: int) -> None:
        self.at = at

    def read(self, n: int) -> bytes:
        return self.raw[self.at : self.at + n]


def _directories(f, most: int):
    """The fields, tag to values, of the first ``most`` image directories of a TIFF file."""
    head = read_at(f, 0, 8)
    order = {b"II": "<", b"MM": ">"}[head[:2]]
    (at,), seen = struct.unpack(order + "I", head[4:]), set()
    while at and at not in seen and len(seen) < most:
        seen.add(at)
        (n,) = struct.unpack(order + "H", read_at(f, at, 2))
        raw, tags = read_at(f, at + 2, 12 * n + 4), {}
        for k in range(n):
            tag, kind, count = struct.unpack_from(order + "HHI", raw, 12 * k)
            if kind not in TIFF_TYPES or tag not in _TAGS:
                continue
            size, code = TIFF_TYPES[kind]
            inline = raw[12 * k + 8 : 12 * k + 12]
            values = inline if size * count <= 4 else read_at(f, struct.unpack(order + "I", inline)[0], size * count)
            tags[tag] = struct.unpack_from(f"{order}{count}{code}", values)
        tags["order"] = order
        yield tags
        (at,) = struct.unpack(order + "I", raw[12 * n : 12 * n + 4])


_TAGS = {WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, OFFSETS, ORIENTATION, SAMPLES, ROWS, COUNTS, PLANAR, PREDICTOR, PALETTE, TILE_WIDTH}


def tiff_headers(f, most: int):
    for tags in _directories(f, most):
        one = lambda tag, default: int(tags.get(tag, (default,))[0])  # noqa: B023, E731
        width, height = one(WIDTH, 0), one(HEIGHT, 0)
        yield {
            "width": width, "height": height, "bits": one(BITS, 1), "samples": one(SAMPLES, 1), "compression": one(COMPRESSION, 1), "photometric": one(PHOTOMETRIC, 1),
            "rows": min(one(ROWS, height), height), "planar": one(PLANAR, 1), "predictor": one(PREDICTOR, 1), "palette": list(tags.get(PALETTE, ())), "tiled": TILE_WIDTH in tags,
            "spans": list(zip(tags.get(OFFSETS, ()), tags.get(COUNTS, ()), strict=False)), "order": tags["order"], "orientation": one(ORIENTATION, 1),
        }


def headers(f, max_frames: int = 10) -> list[tuple[str, dict]]:
    """(kind, header) of the first frames of an opened file."""
    head = read_at(f, 0, 12)
    if head.startswith(PNG):
        return [("png", png_header(f))]
    if head.startswith((TIFF_LITTLE, TIFF_BIG)):
        return [("tiff", h) for h in tiff_headers(f, max_frames)]
    if head.startswith(b"\xff\xd8\xff") or head[:4] == b"RIFF" and head[8:12] == b"WEBP":
        raise ValueError("JPEG and WEBP need a decoder plug-in")
    raise ValueError("no image")


def frames(files: DataFrame, max_pixels: int | None = None, max_frames: int | None = None, opener=opened, options: Options = Options()) -> DataFrame:
    """(path, frame, kind, width, height, orientation, layout, error) of image files (path, length); frames from 0. Sizes are judged before anything is decoded. The
    bounds are ``max_image_pixels`` and ``max_pdf_pages`` of ``options`` unless given."""
    max_pixels, max_frames = options.max_image_pixels if max_pixels is None else max_pixels, options.max_pdf_pages if max_frames is None else max_frames
    ship(files.sparkSession)

    def run(batches):
        for b in batches:
            rows = []
            for path in b["path"]:
                try:
                    with opener(path) as f:
                        found = headers(f, max_frames)
                    if not found:
                        raise ValueError("no frame")
                except Exception as e:  # noqa: BLE001  a file's fault is its own row
                    rows.append((path, 0, None, None, None, None, None, f"{DECODE}{e}"))
                    continue
                for k, (kind, h) in enumerate(found):
                    large = h["width"] * h["height"] > REFUSED_ABOVE * max_pixels
                    wrong = "no pixels" if not h["width"] * h["height"] else f"{h['width']} x {h['height']} pixels are too many" if large else None
                    rows.append((path, k, kind, h["width"], h["height"], h["orientation"], None if wrong else json.dumps(h), wrong and DECODE + wrong))
            out = pd.DataFrame(rows, columns=_FRAME)
            yield out.astype({c: "Int64" for c in ("width", "height", "orientation")})

    return files.select("path").mapInPandas(run, _FRAME_DDL)


# ---- pixels ---------------------------------------------------------------------------------


def _unfiltered(raw: np.ndarray, step: int) -> np.ndarray:
    """The bytes of PNG scan lines (a filter type, then bytes, ``step`` bytes a pixel). Whole lines at once where a filter allows it."""
    out = np.zeros((len(raw), raw.shape[1] - 1), np.uint8)
    above = np.zeros(raw.shape[1] - 1, np.uint8)
    for k, line in enumerate(raw):
        kind, row = line[0], line[1:]
        if kind == 1:
            for c in range(step):
                out[k, c::step] = np.cumsum(row[c::step], dtype=np.uint8)
        elif kind == 2:
            out[k] = row + above
        elif kind in (3, 4):
            out[k] = _predicted(row.tolist(), above.tolist(), step, kind == 4)
        else:
            out[k] = row
        above = out[k]
    return out


def _predicted(row: list[int], above: list[int], step: int, paeth: bool) -> list[int]:
    """A line whose bytes depend on the one before in the same line."""
    for i, x in enumerate(row):
        left, up = (row[i - step] if i >= step else 0), above[i]
        if paeth:
            corner = above[i - step] if i >= step else 0
            a, b, c = abs(up - corner), abs(left - corner), abs(left + up - 2 * corner)
            guess = left if a <= b and a <= c else up if b <= c else corner
        else:
            guess = (left + up) >> 1
        row[i] = x + guess & 255
    return row


def _samples(lines: np.ndarray, width: int, samples: int, bits: int, big: bool = True) -> np.ndarray:
    """Rows of bytes as (height, width, samples) of 8 bits; fewer bits are not scaled."""
    if bits == 16:
        lines = lines[:, 0::2] if big else lines[:, 1::2]
    elif bits < 8:
        every = np.unpackbits(lines, axis=1)
        lines = np.packbits(every.reshape(len(lines), -1, bits), axis=2, bitorder="big")[..., 0] >> (8 - bits)
    return lines[:, : width * samples].reshape(len(lines), width, samples)


def png_pixels(h: dict, data: bytes) -> np.ndarray:
    width, height, bits, samples = h["width"], h["height"], h["bits"], PNG_SAMPLES[h["colour"]]
    parts = [p for p in PASSES] if h["interlace"] else [(0, 0, 1, 1)]
    sizes = [(-(-(width - x) // dx), -(-(height - y) // dy)) for x, y, dx, dy in parts]
    strides = [1 + (w * samples * bits + 7) // 8 for w, _ in sizes]
    whole = sum(n * s for (w, n), s in zip(sizes, strides, strict=True) if w > 0 and n > 0)
    raw = np.frombuffer(zlib.decompressobj().decompress(data, whole), np.uint8)
    if len(raw) < whole:
        raise ValueError("truncated PNG")
    out, at = np.zeros((height, width, samples), np.uint8), 0
    for (x, y, dx, dy), (w, n), stride in zip(parts, sizes, strides, strict=True):
        if w > 0 and n > 0:
            lines = _unfiltered(raw[at : at + n * stride].reshape(n, stride), max(1, samples * bits // 8))
            out[y::dy, x::dx] = _samples(lines, w, samples, bits)
            at += n * stride
    if h["colour"] == 3:
        palette = np.frombuffer(bytes.fromhex(h["PLTE"]), np.uint8).reshape(-1, 3)
        alpha = np.frombuffer(bytes.fromhex(h.get("tRNS", "")), np.uint8)
        if len(alpha):
            palette = np.hstack([palette, np.concatenate([alpha, np.full(len(palette), 255, np.uint8)])[: len(palette), None]])
        return palette[np.minimum(out[..., 0], len(palette) - 1)]
    if bits < 8:
        out = out * np.uint8(255 // ((1 << bits) - 1))
    return np.concatenate([np.repeat(out[..., :1], 3, axis=2), out[..., 1:]], axis=2) if h["colour"] == 4 else out


def _packbits(raw: bytes) -> bytes:
    out, at = bytearray(), 0
    while at < len(raw):
        n = raw[at]
        if n < 128:
            out += raw[at + 1 : at + 2 + n]
            at += n + 2
        else:
            out += raw[at + 1 : at + 2] * (257 - n) if n > 128 else b""
            at += 2 if n > 128 else 1
    return bytes(out)


def tiff_pixels(h: dict, strips: list[bytes]) -> np.ndarray:
    width, height, bits, samples = h["width"], h["height"], h["bits"], h["samples"]
    if h["tiled"] or h["planar"] != 1 and samples > 1 or bits not in (1, 2, 4, 8, 16) or h["compression"] not in (1, 8, 32946, 32773) or h["predictor"] not in (1, 2):
        raise ValueError("this kind of TIFF needs a decoder plug-in")
    stride = (width * samples * bits + 7) // 8
    out = np.zeros((height, width, samples), np.uint8)
    for k, raw in enumerate(strips):
        top = k * h["rows"]
        n = min(h["rows"], height - top)
        if n <= 0:
            break
        if h["compression"] in (8, 32946):
            raw = zlib.decompressobj().decompress(raw, n * stride)
        elif h["compression"] == 32773:
            raw = _packbits(raw)
        if len(raw) < n * stride:
            raise ValueError("truncated TIFF")
        lines = np.frombuffer(raw, np.uint8, n * stride).reshape(n, stride)
        if h["predictor"] == 2:
            wide = lines.view((">" if h["order"] == ">" else "<") + "u2") if bits == 16 else lines
            wide = np.cumsum(wide.reshape(n, width, samples), axis=1, dtype=wide.dtype.newbyteorder("=")).reshape(n, -1)
            lines = wide.astype(">u2").view(np.uint8) if bits == 16 else wide
        out[top : top + n] = _samples(np.ascontiguousarray(lines), width, samples, bits, h["order"] == ">" or h["predictor"] == 2)
    if h["photometric"] == 3:
        palette = (np.array(h["palette"], np.uint32).reshape(3, -1).T >> 8).astype(np.uint8)
        return palette[np.minimum(out[..., 0], len(palette) - 1)]
    if bits < 8:
        out = out * np.uint8(255 // ((1 << bits) - 1))
    return 255 - out if h["photometric"] == 0 else out


def upright(pixels: np.ndarray, orientation: int) -> np.ndarray:
    """A frame as it is meant to be seen, by the EXIF orientation from 1 to 8."""
    if orientation in (5, 6, 7, 8):
        pixels = pixels.swapaxes(0, 1)
    if orientation in (2, 3, 6, 7):
        pixels = pixels[:, ::-1]
    if orientation in (3, 4, 7, 8):
        pixels = pixels[::-1]
    return np.ascontiguousarray(pixels)


def decoded(kind: str, h: dict, f) -> np.ndarray:
    """One frame of an opened file: (height, width, channels) of 8 bits."""
    found = [read_at(f, at, n) for at, n in h["spans"]]
    return upright(png_pixels(h, b"".join(found)) if kind == "png" else tiff_pixels(h, found), h["orientation"])


def pixels(found: DataFrame, opener=opened) -> DataFrame:
    """(doc_id, page_no, image: struct(height, width, nChannels, data), error) of ``frames``, the path as doc_id; image is null where there is an error. Frames are dealt out
    evenly, as sizes differ and few rows make much work."""
    ship(found.sparkSession)
    ddl = "doc_id string, page_no int, image struct<height: int, width: int, nChannels: int, data: binary>, error string"

    def run(batches):
        for b in batches:
            for path, frame, kind, layout, error in zip(b["path"], b["frame"], b["kind"], b["layout"], b["error"], strict=True):
                image = None
                if error is None:
                    try:
                        with opener(path) as f:
                            rgb = decoded(kind, json.loads(layout), f)
                        image = {"height": rgb.shape[0], "width": rgb.shape[1], "nChannels": rgb.shape[2], "data": rgb.tobytes()}
                    except Exception as e:  # noqa: BLE001  a frame's fault is its own row
                        error = f"{DECODE}{e}"
                yield pd.DataFrame({"doc_id": [path], "page_no": [frame], "image": [image], "error": [error]})

    parts = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return found.select("path", "frame", "kind", "layout", "error").repartition(parts, F.xxhash64("path", "frame")).mapInPandas(run, ddl)
