"""Frames found by seek and decoded, pages made flat, words turned upright."""

import io
import math
import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from paperloom.operators import layout
from paperloom.sources import flatten, images, ranges, raster


def chunk(name, data):
    return struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))


def png(pixels, colour, bits=8, filters=(0,), passes=((0, 0, 1, 1),), extra=b"", size=None):
    """A PNG file of (height, width, samples), with the scan line filters given in turn."""
    h, w, n = pixels.shape
    raw = b""
    for x, y, dx, dy in passes:
        part = pixels[y::dy, x::dx]
        if not part.size:
            continue
        if bits == 16:
            lines = (part.astype(">u2") * 257).astype(">u2").view(np.uint8).reshape(len(part), -1)
        elif bits < 8:
            every = np.unpackbits(part.reshape(len(part), -1, 1).astype(np.uint8), axis=2)[..., 8 - bits :].reshape(len(part), -1)
            lines = np.packbits(every, axis=1)
        else:
            lines = part.reshape(len(part), -1).astype(np.uint8)
        step, above = max(1, n * bits // 8), np.zeros(lines.shape[1], int)
        for k, line in enumerate(lines.astype(int)):
            left = np.concatenate([np.zeros(step, int), line[:-step]])[: len(line)]
            corner = np.concatenate([np.zeros(step, int), above[:-step]])[: len(line)]
            p = left + above - corner
            paeth = np.where((abs(p - left) <= abs(p - above)) & (abs(p - left) <= abs(p - corner)), left, np.where(abs(p - above) <= abs(p - corner), above, corner))
            kind = filters[k % len(filters)]
            guess = (0, left, above, (left + above) // 2, paeth)[kind]
            raw += bytes([kind]) + ((line - guess) % 256).astype(np.uint8).tobytes()
            above = line
    data = zlib.compress(raw)
    w, h = size or (w, h)
    head = struct.pack(">IIBBBBB", w, h, bits, colour, 0, 0, int(len(passes) > 1))
    cut = len(data) // 2
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + extra + chunk(b"IDAT", data[:cut]) + chunk(b"tEXt", b"between") + chunk(b"IDAT", data[cut:]) + chunk(b"IEND", b"")


def tiff(frames, order="<", compression=1, rows=3, predictor=1, photometric=None, orientation=1, bits=8):
    """A TIFF file of several frames (height, width, samples)."""
    out = bytearray({"<": b"II*\0", ">": b"MM\0*"}[order] + b"\0\0\0\0")
    link = 4
    for pixels in frames:
        h, w, n = pixels.shape
        offsets, counts = [], []
        for top in range(0, h, rows):
            part = pixels[top : top + rows].astype(np.int64)
            if predictor == 2:
                part = np.concatenate([part[:, :1], np.diff(part, axis=1)], axis=1)
            if bits == 1:
                raw = np.packbits(part.reshape(len(part), -1).astype(np.uint8), axis=1).tobytes()
            else:
                raw = (part % (1 << bits)).astype(f"{order}u{bits // 8}").tobytes()
            raw = {1: lambda r: r, 8: zlib.compress, 32773: lambda r: b"".join(bytes([0, b]) for b in r)}[compression](raw)
            offsets.append(len(out))
            counts.append(len(raw))
            out += raw
        fields = [(256, 3, [w]), (257, 3, [h]), (258, 3, [bits] * n), (259, 3, [compression]), (262, 3, [photometric if photometric is not None else 2 if n == 3 else 1]), (273, 4, offsets), (274, 3, [orientation]),
                  (277, 3, [n]), (278, 3, [rows]), (279, 4, counts), (317, 3, [predictor])]
        entries = []
        for tag, kind, values in fields:
            raw = struct.pack(f"{order}{len(values)}{'H' if kind == 3 else 'I'}", *values)
            if len(raw) > 4:
                where = len(out)
                out += raw
                raw = struct.pack(order + "I", where)
            entries.append(struct.pack(order + "HHI", tag, kind, len(values)) + raw.ljust(4, b"\0"))
        out[link : link + 4] = struct.pack(order + "I", len(out))
        out += struct.pack(order + "H", len(entries)) + b"".join(entries) + b"\0\0\0\0"
        link = len(out) - 4
    return bytes(out)


class Counted(io.BytesIO):
    """A file that counts what is read of it."""

    def __init__(self, raw):
        super().__init__(raw)
        self.got = 0

    def read(self, n=-1):
        raw = super().read(n)
        self.got += len(raw)
        return raw


RNG = np.random.default_rng(3)


def decoded(raw):
    return [images.decoded(kind, h, io.BytesIO(raw)) for kind, h in images.headers(io.BytesIO(raw))]


@pytest.mark.parametrize("colour, n", [(0, 1), (2, 3), (6, 4)])
@pytest.mark.parametrize("filters", [(0,), (1, 2), (4, 3, 0), (3,), (4,)])
@pytest.mark.parametrize("passes", [((0, 0, 1, 1),), tuple(images.PASSES)])
def test_png_pixels(colour, n, filters, passes):
    for shape in ((9, 13), (1, 1), (3, 2)):
        want = RNG.integers(0, 256, (*shape, n), dtype=np.uint8)
        for bits in (8, 16):
            assert (decoded(png(want, colour, bits, filters, passes))[0] == want).all()


def test_png_of_few_bits_and_palettes():
    for bits in (1, 2, 4):
        want = RNG.integers(0, 1 << bits, (5, 11, 1), dtype=np.uint8)
        assert (decoded(png(want, 0, bits))[0] == want * (255 // ((1 << bits) - 1))).all()
        palette = RNG.integers(0, 256, (1 << bits, 3), dtype=np.uint8)
        extra = chunk(b"PLTE", palette.tobytes())
        assert (decoded(png(want, 3, bits, extra=extra))[0] == palette[want[..., 0]]).all()
        clear = decoded(png(want, 3, bits, extra=extra + chunk(b"tRNS", b"\x07")))[0]
        assert clear.shape[2] == 4 and (clear[..., 3] == np.where(want[..., 0] == 0, 7, 255)).all()
    grey = RNG.integers(0, 256, (4, 3, 2), dtype=np.uint8)
    got = decoded(png(grey, 4))[0]
    assert (got[..., :3] == grey[..., :1]).all() and (got[..., 3] == grey[..., 1]).all()


@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize("compression, predictor, bits", [(1, 1, 8), (8, 2, 8), (8, 2, 16), (1, 1, 16), (32773, 1, 8), (1, 1, 1)])
def test_tiff_pixels(order, compression, predictor, bits):
    frames = [RNG.integers(0, 1 << bits, (h, w, n)) for h, w, n in ((7, 5, 1), (4, 9, 1 if bits == 1 else 3))]
    got = decoded(tiff(frames, order, compression, 3, predictor, bits=bits))
    for g, want in zip(got, frames, strict=True):
        assert (g == (want * 255 if bits == 1 else want >> (bits - 8))).all()
    assert (decoded(tiff(frames[:1], order, bits=bits, photometric=0))[0] == 255 - got[0]).all()


def test_orientation():
    base = np.arange(6, dtype=np.uint8).reshape(2, 3, 1)
    want = {1: base, 2: base[:, ::-1], 3: base[::-1, ::-1], 4: base[::-1], 5: base.swapaxes(0, 1), 6: np.rot90(base, -1), 7: np.rot90(base, -1)[:, ::-1][::-1, ::-1][:, ::-1][::-1], 8: np.rot90(base, 1)}
    want[7] = base[::-1, ::-1].swapaxes(0, 1)
    for k, w in want.items():
        assert (decoded(tiff([base], orientation=k))[0] == w).all()
    exif = b"II*\0\x08\0\0\0\x01\0" + struct.pack("<HHI", 274, 3, 1) + b"\x06\0\0\0" + b"\0\0\0\0"
    assert (decoded(png(base, 0, extra=chunk(b"eXIf", exif)))[0] == want[6]).all()


def test_headers_are_read_by_seek():
    """A huge frame is known by its header; of a file of ten frames only directories are read."""
    big = Counted(png(RNG.integers(0, 256, (400, 900, 3), dtype=np.uint8), 2))
    (_, h), *_ = images.headers(big)
    assert (h["width"], h["height"]) == (900, 400) and big.got < 300 < len(big.getvalue()) // 1000
    many = Counted(tiff([RNG.integers(0, 256, (300, 300, 3)) for _ in range(12)], rows=300))
    assert len(images.headers(many, 10)) == 10 and many.got < 10 * 400
    for wrong in (b"", b"\x89PNG\r\n\x1a\n", b"II*\0\xff\xff\xff\xff", b"GIF89a", b"\xff\xd8\xff\xe0"):
        with pytest.raises(Exception):  # noqa: B017  whatever the fault, it is the file's row
            images.headers(io.BytesIO(wrong)) or (_ for _ in ()).throw(ValueError)


def test_image_source(spark, tmp_path):
    a, b = RNG.integers(0, 256, (6, 4, 3), dtype=np.uint8), [RNG.integers(0, 256, (5, 5, 1)) for _ in range(12)]
    whole = png(a, 2)
    (tmp_path / "a b.png").write_bytes(whole)
    (tmp_path / "b.tif").write_bytes(tiff(b))
    (tmp_path / "bomb.png").write_bytes(png(a, 2, size=(100_000, 100_000)))
    (tmp_path / "cut.png").write_bytes(png(a, 2, size=(4, 9)))
    (tmp_path / "x.jpg").write_bytes(b"\xff\xd8\xff\xe0 and so on")
    found = images.frames(ranges.listed(spark, str(tmp_path)))
    rows = {(r.path.rsplit("/", 1)[1].replace("%20", " "), r.frame): r for r in found.collect()}
    assert sorted(rows) == [("a b.png", 0), *(("b.tif", k) for k in range(10)), ("bomb.png", 0), ("cut.png", 0), ("x.jpg", 0)]
    assert rows["bomb.png", 0].error == "Could not decode image: 100000 x 100000 pixels are too many" and rows["bomb.png", 0].layout is None
    got = {(r.doc_id.rsplit("/", 1)[1].replace("%20", " "), r.page_no): r for r in images.pixels(found).collect()}
    image = got["a b.png", 0].image
    assert (np.frombuffer(image.data, np.uint8).reshape(image.height, image.width, image.nChannels) == a).all()
    for k in range(10):
        assert bytes(got["b.tif", k].image.data) == b[k].astype(np.uint8).tobytes()
    assert got["cut.png", 0].image is None and got["cut.png", 0].error == "Could not decode image: truncated PNG" and "plug-in" in got["x.jpg", 0].error
    # at the bound is large, above twice the bound is refused
    sizes = {r.path.rsplit("/", 1)[1]: r.error for r in images.frames(ranges.listed(spark, str(tmp_path)).where("path like '%b.png'"), max_pixels=12).collect()}
    assert [e is None for k, e in sorted(sizes.items()) if k.startswith("a")] == [True]
    ready = raster.prepared(images.pixels(found).where("image is not null"))
    assert ready.count() == 11 and not ready.where("width <= 0").count()
    assert images.pixels(images.frames(ranges.listed(spark, str(tmp_path)).limit(0))).count() == 0


# ---- flattening -----------------------------------------------------------------------------


def photograph(size, quad, seed=0):
    """A page of dark bars on a desk, seen through a homography."""
    rng, quad = np.random.default_rng(seed), np.array(quad, float)
    tl, tr, br, bl = quad
    w, h = int(max(np.hypot(*(tr - tl)), np.hypot(*(br - bl)))), int(max(np.hypot(*(bl - tl)), np.hypot(*(br - tr))))
    page = np.full((h, w), 235, np.uint8)
    for _ in range(40):
        y, x = rng.integers(30, h - 60), rng.integers(30, w - 120)
        page[y : y + 14, x : x + 80] = 20
    m = flatten.homography(quad, np.array([[0, 0], [w, 0], [w, h], [0, h]], float))
    y, x = np.mgrid[0 : size[0], 0 : size[1]] + 0.5
    d = m[2, 0] * x + m[2, 1] * y + m[2, 2]
    u, v = (m[0, 0] * x + m[0, 1] * y + m[0, 2]) / d, (m[1, 0] * x + m[1, 1] * y + m[1, 2]) / d
    desk = (70 + 20 * np.sin(x / 37) + rng.normal(0, 4, size)).clip(0, 255)
    on = (u >= 0) & (u < w) & (v >= 0) & (v < h)
    return np.where(on, raster._sample(page, np.clip(v - 0.5, 0, h - 1), np.clip(u - 0.5, 0, w - 1)), desk).astype(np.uint8), page


@pytest.mark.parametrize("size, quad", [((1000, 800), [(100, 80), (650, 120), (690, 900), (60, 870)]), ((1600, 1200), [(203, 155), (1003, 178), (1050, 1440), (150, 1500)]), ((700, 900), [(120, 100), (800, 60), (830, 620), (90, 600)])])
def test_photographed_pages_come_back(size, quad):
    seen, page = photograph(size, quad)
    assert np.abs(flatten.page_corners(seen) - np.array(quad)).max() < 0.5  # of a pixel
    flat = flatten.flatten_page(seen)
    assert abs(flat.shape[0] - page.shape[0]) <= 1 and abs(flat.shape[1] - page.shape[1]) <= 1
    h, w = min(flat.shape[0], page.shape[0]), min(flat.shape[1], page.shape[1])
    assert np.abs(flat[:h, :w].astype(int) - page[:h, :w]).mean() < 3


def test_what_is_no_photograph_stays():
    blank = np.full((500, 400), 200, np.uint8)
    assert flatten.flatten_page(blank) is blank
    scan = np.full((800, 600), 250, np.uint8)
    scan[100:110, 50:500] = 0  # text without an outline
    assert flatten.flatten_page(scan) is scan
    for quad in ([(20, 20), (250, 20), (250, 280), (20, 280)], [(2, 2), (597, 2), (597, 797), (2, 797)]):  # under a quarter, and nearly all
        seen, _ = photograph((800, 600), quad)
        assert flatten.flatten_page(seen) is seen
    small, _ = photograph((330, 330), [(40, 40), (290, 40), (290, 290), (40, 290)])
    assert flatten.flatten_page(small) is small  # a page of under 300 pixels
    tiny = np.zeros((3, 3), np.uint8)
    assert flatten.flatten_page(tiny) is tiny
    assert raster.prepare(photograph((1000, 800), [(100, 80), (650, 120), (690, 900), (60, 870)])[0], flatten.flatten_page).shape[1] == 1500


def test_parts_and_corners():
    mask = np.array([[1, 0, 1, 1], [0, 1, 0, 0], [0, 0, 0, 1], [1, 1, 0, 1]], bool)
    assert flatten.labelled(mask, True)[1] == 3 and flatten.labelled(mask, False)[1] == 5
    rng = random.Random(5)
    for _ in range(30):
        mask = np.array([[rng.random() < 0.45 for _ in range(12)] for _ in range(9)])
        for diagonal in (True, False):
            label, n = flatten.labelled(mask, diagonal)
            todo, parts = {tuple(p) for p in np.argwhere(mask)}, []
            while todo:
                part, edge = set(), [todo.pop()]
                while edge:
                    y, x = edge.pop()
                    part.add((y, x))
                    for q in [(y + a, x + b) for a in (-1, 0, 1) for b in (-1, 0, 1) if diagonal or not a or not b]:
                        if q in todo:
                            todo.discard(q)
                            edge.append(q)
                parts.append(frozenset(part))
            assert n == len(parts) and {frozenset(map(tuple, np.argwhere(label == k))) for k in range(1, n + 1)} == set(parts)
    circle = np.array([[math.cos(t), math.sin(t)] for t in np.linspace(0, 2 * math.pi, 60, endpoint=False)]) * 100
    assert len(flatten.simplified(circle, 2)) > 8
    small, scale = flatten.shrunk(np.arange(2000 * 1000, dtype=np.float64).reshape(2000, 1000) % 251)
    assert small.shape == (800, 400) and scale == 0.4 and abs(small.mean() - (np.arange(2_000_000) % 251).mean()) < 0.2


# ---- words ----------------------------------------------------------------------------------


@pytest.mark.parametrize("degrees", [0, 0.2, 0.4, -1, 3, -7, 11.7, 13])
def test_turned_words_give_the_same_lines(spark, degrees):
    rng = random.Random(8)
    words, k = [], 0
    for line in range(25):
        x = rng.choice([100, 130, 420])
        for _ in range(rng.choice([1, 2, 7, 9])):
            w = rng.randint(12, 150)
            words.append((k, f"w{k}", x, 40 * line, x + w, 40 * line + 24))
            k, x = k + 1, x + w + rng.choice([10, 10, 200])
    a, turned = math.radians(degrees), []
    for k, t, x0, y0, x1, y1 in words:
        x, y, w, h = (x0 + x1) / 2 - 600, (y0 + y1) / 2 - 500, x1 - x0, y1 - y0
        xc, yc = math.cos(a) * x - math.sin(a) * y + 600, math.sin(a) * x + math.cos(a) * y + 500
        wide, high = (w * math.cos(a) + h * abs(math.sin(a))) / 2, (h * math.cos(a) + w * abs(math.sin(a))) / 2
        turned.append(("d", 1, k, t, round(xc - wide), round(yc - high), round(xc + wide), round(yc + high), 90.0))
    schema = "doc_id string, page_no int, word_idx int, text string, x0 int, y0 int, x1 int, y1 int, conf double"
    rows = spark.createDataFrame([*turned, ("one", 1, 0, "alone", 5, 5, 60, 30, 90.0)], schema)
    out = layout.upright(rows)
    assert out.columns == rows.columns and out.dtypes == rows.dtypes
    lines = lambda df: [r.text for r in layout.page_lines(df.where("doc_id = 'd'")).orderBy("line_no").collect()]
    slope = layout.skew(rows).where("doc_id = 'd'").first().slope
    assert abs(math.degrees(math.atan(slope)) - degrees) < 0.1
    straight = [("d", 1, k, t, x0, y0, x1, y1, 90.0) for k, t, x0, y0, x1, y1 in words]
    if abs(degrees) < 12:
        assert lines(out) == lines(spark.createDataFrame(straight, schema))
    if not 0.3 < abs(degrees) < 12:
        assert {tuple(r) for r in out.collect()} == {tuple(r) for r in rows.collect()}
    assert out.where("doc_id = 'one'").select("x0", "y1").first() == (5, 30)
    assert layout.upright(rows.limit(0)).count() == 0
    sizes = out.where("doc_id = 'd'").select(F.max(F.abs(F.col("y1") - F.col("y0") - 24)).alias("off")).first().off
    assert abs(degrees) >= 12 or abs(degrees) <= 0.3 or sizes <= 3
