"""Page images as numpy arrays: the steps that need no imaging library. Flattening a photographed page needs contours
and stays a plug-in."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---- fixed values ---------------------------------------------------------------------------
MIN_WIDTH, UPSCALE_TO, MAX_SCALE, MAX_SIDE = 1500, 1500, 3.0, 4200
CUTOFF_PERCENT, DARK, MIN_DARK = 1, 110, 500
MIN_ANGLE, MAX_ANGLE = 0.3, 12.0
# ---------------------------------------------------------------------------------------------


def brightest(rgb: np.ndarray) -> np.ndarray:
    """The brightest channel: black text stays dark, coloured stamps fade. A fourth channel is opacity over white."""
    if rgb.ndim == 2:
        return rgb
    if rgb.shape[2] == 4:
        alpha = rgb[..., 3:] / 255.0
        rgb = np.rint(rgb[..., :3] * alpha + 255 * (1 - alpha)).astype(np.uint8)
    return rgb.max(axis=2)


def stretch(gray: np.ndarray, cutoff: float = CUTOFF_PERCENT) -> np.ndarray:
    """Contrast so that ``cutoff`` percent of the pixels at either end become black and white."""
    histogram = np.bincount(gray.reshape(-1), minlength=256)
    share = np.cumsum(histogram) / max(gray.size, 1)
    low, high = int(np.searchsorted(share, cutoff / 100, "right")), int(np.searchsorted(share, 1 - cutoff / 100, "left"))
    if high <= low:
        return gray
    return np.clip((gray.astype(np.float64) - low) * 255 / (high - low), 0, 255).astype(np.uint8)


def scale_of(height: int, width: int) -> float:
    if width < MIN_WIDTH:
        return min(UPSCALE_TO / width, MAX_SCALE)
    return MAX_SIDE / max(height, width) if max(height, width) > MAX_SIDE else 1.0


def resize(gray: np.ndarray, scale: float) -> np.ndarray:
    """Bilinear."""
    if scale == 1.0:
        return gray
    h, w = (max(1, round(n * scale)) for n in gray.shape)
    y, x = np.clip((np.arange(h) + 0.5) / scale - 0.5, 0, gray.shape[0] - 1), np.clip((np.arange(w) + 0.5) / scale - 0.5, 0, gray.shape[1] - 1)
    return _sample(gray, y[:, None], x[None, :])


def _sample(gray: np.ndarray, y: np.ndarray, x: np.ndarray) -> np.ndarray:
    y0, x0 = np.floor(y).astype(int), np.floor(x).astype(int)
    y1, x1 = np.minimum(y0 + 1, gray.shape[0] - 1), np.minimum(x0 + 1, gray.shape[1] - 1)
    fy, fx = y - y0, x - x0
    g = gray.astype(np.float64)
    return np.rint((g[y0, x0] * (1 - fx) + g[y0, x1] * fx) * (1 - fy) + (g[y1, x0] * (1 - fx) + g[y1, x1] * fx) * fy).astype(np.uint8)


def skew_angle(gray: np.ndarray) -> float:
    """Degrees that the least rectangle around all dark pixels is turned, within +-45; 0 for too few dark pixels."""
    ys, xs = np.nonzero(gray < DARK)
    if len(xs) < MIN_DARK:
        return 0.0
    points = _hull(np.stack([xs, ys], 1).astype(np.float64))
    best = (np.inf, 0.0)
    for a, b in zip(points, np.roll(points, -1, 0), strict=True):
        angle = np.arctan2(b[1] - a[1], b[0] - a[0])
        c, s = np.cos(angle), np.sin(angle)
        turned = points @ np.array([[c, -s], [s, c]])
        best = min(best, (float(np.prod(np.ptp(turned, axis=0))), np.degrees(angle)))
    return float((best[1] + 45) % 90 - 45)


def _hull(points: np.ndarray) -> np.ndarray:
    points = points[np.lexsort((points[:, 1], points[:, 0]))]
    first, last = {}, {}
    for x, y in points:  # only the ends of a column can be corners
        first.setdefault(x, y)
        last[x] = y
    points = sorted({(x, y) for x, y in first.items()} | {(x, y) for x, y in last.items()})
    halves = []
    for side in (points, points[::-1]):
        half: list = []
        for p in side:
            while len(half) > 1 and (half[-1][0] - half[-2][0]) * (p[1] - half[-2][1]) - (half[-1][1] - half[-2][1]) * (p[0] - half[-2][0]) <= 0:
                half.pop()
            half.append(p)
        halves += half[:-1]
    return np.array(halves)


def deskew(gray: np.ndarray) -> np.ndarray:
    angle = skew_angle(gray)
    if not MIN_ANGLE < abs(angle) < MAX_ANGLE:
        return gray
    h, w = gray.shape
    c, s = np.cos(np.radians(angle)), np.sin(np.radians(angle))
    y, x = np.mgrid[0:h, 0:w] - np.array([h / 2, w / 2])[:, None, None]
    sx, sy = c * x - s * y + w / 2, s * x + c * y + h / 2
    out = _sample(gray, np.clip(sy, 0, h - 1), np.clip(sx, 0, w - 1))
    out[(sx < 0) | (sx > w - 1) | (sy < 0) | (sy > h - 1)] = 255
    return out


def order_corners(corners: np.ndarray) -> np.ndarray:
    """Top left, top right, bottom right, bottom left."""
    total, slope = corners.sum(1), corners[:, 1] - corners[:, 0]
    return corners[[total.argmin(), slope.argmin(), total.argmax(), slope.argmax()]]


def corner_columns(points: Column) -> Column:
    """The same for an array<struct<x, y>> column."""

    def best(key, least: bool) -> Column:
        ranked = F.transform(points, lambda p, i: F.struct((key(p) if least else -key(p)).alias("k"), i.alias("i"), p.alias("p")))
        return F.array_min(ranked)["p"]

    total, slope = (lambda p: p["x"] + p["y"]), (lambda p: p["y"] - p["x"])
    return F.array(best(total, True), best(slope, True), best(total, False), best(slope, False))


def prepare(image: np.ndarray, flatten: Callable[[np.ndarray], np.ndarray] | None = None) -> np.ndarray:
    """Grey, contrast-normal, flattened by the plug-in if there is one, of a usable size, upright."""
    gray = stretch(brightest(image))
    if flatten is not None:
        gray = flatten(gray)
    return deskew(resize(gray, scale_of(*gray.shape)))


def prepared(images: DataFrame, flatten: Callable[[np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """(doc_id, height, width, data) in grey of ``spark.read.format('image')`` rows (doc_id, image)."""
    import pandas as pd

    def run(frames):
        for f in frames:
            out = []
            for doc_id, h, w, n, data in f.itertuples(index=False):
                pixels = np.frombuffer(data, np.uint8).reshape(h, w, n)
                gray = prepare(pixels if n > 1 else pixels[..., 0], flatten)
                out.append((doc_id, *gray.shape, gray.tobytes()))
            yield pd.DataFrame(out, columns=["doc_id", "height", "width", "data"])

    i = F.col("image")
    return images.select("doc_id", i["height"].alias("h"), i["width"].alias("w"), i["nChannels"].alias("n"), i["data"].alias("data")).mapInPandas(
        run, "doc_id string, height int, width int, data binary"
    )
