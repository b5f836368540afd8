"""A photographed page made flat: find the outline of the paper, warp it to a rectangle. In numpy, one frame at a time.

Edges are found on a small copy of the image (blur, gradient, ridges that reach a strong edge, closed over small gaps). The largest outline encloses the page if it takes
up enough of the image and is not all of it. Its hull is simplified to four corners, or else to the least rectangle around it, and each side is then
fitted to the steepest change of brightness along its normals in the full image, so that corners are better known than the small copy could tell.
Images without such an outline stay as they are.
"""

from __future__ import annotations

import numpy as np

from .raster import _hull, _sample, order_corners

# ---- fixed values ---------------------------------------------------------------------------
SMALL, LEAST_SHARE, MOST_SHARE, LEAST_SIDE = 800, 0.25, 0.94, 300
WEAK, STRONG, CLOSE, SIMPLIFY = 40, 120, 25, 0.02
# ---------------------------------------------------------------------------------------------


def shrunk(gray: np.ndarray, most: int = SMALL) -> tuple[np.ndarray, float]:
    """A copy whose longer side is ``most`` at most, each pixel the mean of those it stands for, and its scale."""
    h, w = gray.shape
    if max(h, w) <= most:
        return gray.astype(np.float64), 1.0
    scale = most / max(h, w)
    out = gray.astype(np.float64)
    for axis, n in ((0, max(1, round(h * scale))), (1, max(1, round(w * scale)))):
        # sums up to fractional places, taken apart again
        total = np.concatenate([np.zeros_like(np.take(out, [0], axis)), np.cumsum(out, axis)], axis)
        at = np.linspace(0, out.shape[axis], n + 1)
        low = np.minimum(at.astype(int), out.shape[axis] - 1)
        part = (at - low).reshape(-1, 1) if axis == 0 else (at - low).reshape(1, -1)
        upto = np.take(total, low, axis) * (1 - part) + np.take(total, low + 1, axis) * part
        out = np.diff(upto, axis=axis) * (n / out.shape[axis])
    return out, scale


def _along(a: np.ndarray, kernel: np.ndarray, axis: int) -> np.ndarray:
    """A one-dimensional filter; beyond its border an image goes on like its edge."""
    r = len(kernel) // 2
    wide = np.pad(a, [(r, r) if k == axis else (0, 0) for k in (0, 1)], mode="edge")
    return sum(v * np.take(wide, np.arange(k, k + a.shape[axis]), axis) for k, v in enumerate(kernel) if v)


def _spread(mask: np.ndarray, size: int, most: bool) -> np.ndarray:
    """Any (or every) pixel of the square around each pixel; what lies outside counts for neither."""
    r, out = size // 2, mask
    for axis in (0, 1):
        wide = np.pad(out, [(r + 1, r) if k == axis else (0, 0) for k in (0, 1)], constant_values=not most).astype(np.int32).cumsum(axis)
        n = out.shape[axis]
        inside = np.take(wide, np.arange(size, size + n), axis) - np.take(wide, np.arange(n), axis)
        out = inside > 0 if most else inside == size
    return out


def labelled(mask: np.ndarray, diagonal: bool) -> tuple[np.ndarray, int]:
    """Connected parts, numbered from 1, of a mask: runs of each row, joined with those of the row before."""
    h, w = mask.shape
    edge = np.diff(np.pad(mask.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    rows, starts = np.nonzero(edge == 1)
    ends = np.nonzero(edge == -1)[1]
    parent = np.arange(len(starts))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    first = np.searchsorted(rows, np.arange(h + 1))
    reach = 1 if diagonal else 0
    for y in range(1, h):
        above, own, stop = first[y - 1], first[y], first[y + 1]
        i, j = above, own
        while i < own and j < stop:
            if starts[i] < ends[j] + reach and starts[j] < ends[i] + reach:
                a, b = root(i), root(j)
                if a != b:
                    parent[max(a, b)] = min(a, b)
            if ends[i] < ends[j]:
                i += 1
            else:
                j += 1
    roots = np.array([root(k) for k in range(len(parent))], dtype=np.int64)
    names, number = np.unique(roots, return_inverse=True)
    out = np.zeros((h, w + 1), np.int64)
    np.add.at(out, (rows, starts), number + 1)
    np.add.at(out, (rows, ends), -(number + 1))
    return out.cumsum(1)[:, :w], len(names)


def edges(small: np.ndarray, weak: float = WEAK, strong: float = STRONG) -> np.ndarray:
    """Ridges of the gradient above ``weak`` that touch one above ``strong``."""
    x = np.arange(-3, 4)
    bell = np.exp(-(x**2) / (2 * 1.4**2))
    smooth = _along(_along(small, bell / bell.sum(), 0), bell / bell.sum(), 1)
    rise, mean = np.array([-1.0, 0, 1]), np.array([1.0, 2, 1])
    gx, gy = _along(_along(smooth, rise, 1), mean, 0), _along(_along(smooth, rise, 0), mean, 1)
    steep = np.abs(gx) + np.abs(gy)
    wide = np.pad(steep, 1)
    h, w = steep.shape

    def beside(dy: int, dx: int) -> np.ndarray:
        return wide[1 + dy : 1 + dy + h, 1 + dx : 1 + dx + w]

    flat, upright = np.abs(gy) <= np.tan(np.pi / 8) * np.abs(gx), np.abs(gx) <= np.tan(np.pi / 8) * np.abs(gy)
    falling = gx * gy > 0
    ahead = np.where(flat, beside(0, 1), np.where(upright, beside(1, 0), np.where(falling, beside(1, 1), beside(1, -1))))
    behind = np.where(flat, beside(0, -1), np.where(upright, beside(-1, 0), np.where(falling, beside(-1, -1), beside(-1, 1))))
    ridge = (steep > weak) & (steep > behind) & (steep >= ahead)
    label, n = labelled(ridge, True)
    kept = np.zeros(n + 1, bool)
    kept[np.unique(label[ridge & (steep > strong)])] = True
    kept[0] = False
    return kept[label]


def outline(mask: np.ndarray) -> tuple[np.ndarray, float]:
    """The hull (x, y) of the part that encloses most, and how many pixels it encloses."""
    parts, n = labelled(mask, True)
    best = (0, None)
    for k in sorted(range(1, n + 1), key=lambda k: -np.count_nonzero(parts == k))[:8] if n > 8 else range(1, n + 1):
        ys, xs = np.nonzero(parts == k)
        top, left = ys.min(), xs.min()
        own = np.pad((parts == k)[top : ys.max() + 1, left : xs.max() + 1], 1)
        around, _ = labelled(~own, False)
        inside = int((around != around[0, 0]).sum())
        if inside > best[0]:
            best = (inside, _hull(np.stack([xs, ys], 1).astype(np.float64)))
    return (best[1] if best[1] is not None else np.zeros((0, 2))), float(best[0])


def simplified(points: np.ndarray, tolerance: float) -> np.ndarray:
    """Corners of a closed convex outline so that no point is further than the tolerance from their polygon."""
    start = int(np.argmax(((points - points.mean(0)) ** 2).sum(1)))
    points = np.roll(points, -start, 0)
    far = int(np.argmax(((points - points[0]) ** 2).sum(1)))
    keep, todo = {0, far}, [(0, far), (far, len(points))]
    closed = np.vstack([points, points[:1]])
    while todo:
        a, b = todo.pop()
        if b - a < 2:
            continue
        d = closed[b] - closed[a]
        away = np.abs(d[0] * (closed[a + 1 : b, 1] - closed[a, 1]) - d[1] * (closed[a + 1 : b, 0] - closed[a, 0])) / max(np.hypot(*d), 1e-9)
        if away.max() > tolerance:
            m = a + 1 + int(away.argmax())
            keep.add(m)
            todo += [(a, m), (m, b)]
    return points[sorted(keep)]


def least_rectangle(points: np.ndarray) -> np.ndarray:
    """Corners of the least rectangle around a convex outline."""
    best = (np.inf, None)
    for a, b in zip(points, np.roll(points, -1, 0), strict=True):
        angle = np.arctan2(b[1] - a[1], b[0] - a[0])
        turn = np.array([[np.cos(angle), -np.sin(angle)], [np.sin(angle), np.cos(angle)]])
        turned = points @ turn
        low, high = turned.min(0), turned.max(0)
        area = float(np.prod(high - low))
        if area < best[0]:
            best = (area, np.array([low, [high[0], low[1]], high, [low[0], high[1]]]) @ turn.T)
    return best[1]


def fitted(gray: np.ndarray, corners: np.ndarray, reach: float) -> np.ndarray:
    """Corners moved to where lines along the steepest change within ``reach`` of each side meet; as they were where a side shows no clear line."""
    lines = []
    centre = corners.mean(0)
    for a, b in zip(corners, np.roll(corners, -1, 0), strict=True):
        along = (b - a) / max(np.hypot(*(b - a)), 1e-9)
        normal = np.array([-along[1], along[0]])
        normal = normal if normal @ (centre - a) > 0 else -normal
        t = np.linspace(0.06, 0.94, 200)[:, None]
        step = np.arange(-np.ceil(reach), np.ceil(reach) + 1)
        at = a + t * (b - a)
        x, y = at[:, :1] + step * normal[0], at[:, 1:] + step * normal[1]
        fits = (x > 0).all(1) & (x < gray.shape[1] - 1).all(1) & (y > 0).all(1) & (y < gray.shape[0] - 1).all(1)
        if fits.sum() < 20:
            return corners
        light = _sample(gray, y[fits], x[fits]).astype(np.float64)
        change = np.diff(light, axis=1)
        sign = 1.0 if np.median(light[:, -1] - light[:, 0]) >= 0 else -1.0
        rise = np.maximum(sign * change, 0)
        # the middle of the steepest rise, with its neighbours
        peak = rise.argmax(1)
        near = np.abs(np.arange(rise.shape[1]) - peak[:, None]) <= 2
        weight = np.where(near, rise, 0)
        total = weight.sum(1)
        clear = total > 10
        if clear.sum() < 20:
            return corners
        place = (weight * (step[:-1] + 0.5)).sum(1)[clear] / total[clear]
        points = (at[fits])[clear] + place[:, None] * normal
        u, v = (points - a) @ along, (points - a) @ normal
        good = np.ones(len(u), bool)
        for _ in range(5):
            slope, base = np.polyfit(u[good], v[good], 1)
            off = np.abs(v - slope * u - base)
            good = off <= max(1.0, 2.5 * float(np.median(off[good])))
        if good.sum() < 20:
            return corners
        lines.append((a + base * normal, along + slope * normal))
    out = []
    for (p, d), (q, e) in zip([lines[-1], *lines[:-1]], lines, strict=True):
        cross = d[0] * e[1] - d[1] * e[0]
        if abs(cross) < 1e-6:
            return corners
        out.append(p + d * ((q - p)[0] * e[1] - (q - p)[1] * e[0]) / cross)
    out = np.array(out)
    return out if np.abs(out - corners).max() <= 4 * reach else corners


def homography(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The 3 x 3 matrix that maps source points to target points, by least squares."""
    rows = []
    for (x, y), (u, v) in zip(source, target, strict=True):
        rows += [[x, y, 1, 0, 0, 0, -u * x, -u * y, u], [0, 0, 0, x, y, 1, -v * x, -v * y, v]]
    system = np.array(rows)
    return np.append(np.linalg.lstsq(system[:, :8], system[:, 8], rcond=None)[0], 1.0).reshape(3, 3)


def warp(gray: np.ndarray, corners: np.ndarray, width: int, height: int) -> np.ndarray:
    """The quadrilateral (x, y of pixel edges: top left, top right, bottom right, bottom left) as a rectangle."""
    m = homography(np.array([[0, 0], [width, 0], [width, height], [0, height]], float), corners)
    out = np.empty((height, width), np.uint8)
    for top in range(0, height, 256):  # rows at a time, as coordinates take much more than pixels
        y, x = np.mgrid[top : min(top + 256, height), 0:width] + 0.5
        w = m[2, 0] * x + m[2, 1] * y + m[2, 2]
        sx, sy = (m[0, 0] * x + m[0, 1] * y + m[0, 2]) / w - 0.5, (m[1, 0] * x + m[1, 1] * y + m[1, 2]) / w - 0.5
        out[top : top + 256] = _sample(gray, np.clip(sy, 0, gray.shape[0] - 1), np.clip(sx, 0, gray.shape[1] - 1))
    return out


def page_corners(gray: np.ndarray) -> np.ndarray | None:
    """The corners of the paper (top left, top right, bottom right, bottom left; places between pixels), or None where no outline is a page."""
    if min(gray.shape) < 32:
        return None
    small, scale = shrunk(gray)
    found = edges(small)
    closed = _spread(_spread(_spread(found, 3, True), CLOSE, True), CLOSE, False)
    hull, inside = outline(closed)
    if len(hull) < 3 or not LEAST_SHARE < inside / small.size < MOST_SHARE:
        return None
    around = np.hypot(*(np.roll(hull, -1, 0) - hull).T).sum()
    corners = simplified(hull, SIMPLIFY * around)
    corners = order_corners((corners if len(corners) == 4 else least_rectangle(hull)).astype(np.float64))
    if len(np.unique(corners, axis=0)) < 4:
        corners = order_corners(least_rectangle(hull))
    return fitted(gray, (corners + 0.5) / scale - 0.5, 6 / scale + 2) + 0.5


def flatten_page(gray: np.ndarray) -> np.ndarray:
    """The page of a photograph, flat; the image itself where there is none, or a page of under ``LEAST_SIDE`` pixels."""
    corners = page_corners(gray)
    if corners is None:
        return gray
    tl, tr, br, bl = corners
    width = int(round(max(np.hypot(*(tr - tl)), np.hypot(*(br - bl))), 6))
    height = int(round(max(np.hypot(*(bl - tl)), np.hypot(*(br - tr))), 6))
    return gray if width < LEAST_SIDE or height < LEAST_SIDE else warp(gray, corners, width, height)
