"""Images as arrays: grey, blur, gradients, resampling, warps, masks, contrast equalisation."""

from __future__ import annotations

import numpy as np


def grey(bgr: np.ndarray) -> np.ndarray:
    """Luma of BGR pixels, float32 in 0..255."""
    return bgr[..., :3].astype(np.float32) @ np.array([0.114, 0.587, 0.299], np.float32)


def blur(a: np.ndarray, sigma: float) -> np.ndarray:
    """Separable Gaussian, radius 3 sigma, mirrored edges."""
    r = max(1, int(round(3 * sigma)))
    k = np.exp(-(np.arange(-r, r + 1) ** 2) / (2 * sigma * sigma)).astype(np.float32)
    return _along(_along(a.astype(np.float32), k / k.sum(), 0), k / k.sum(), 1)


def _along(a: np.ndarray, k: np.ndarray, axis: int, step: int = 1) -> np.ndarray:
    """Weighted sums along an axis (of every step-th place), mirrored edges; some rows at a time, so that they stay in the cache."""
    r, n = len(k) // 2, a.shape[axis]
    pad = [(0, 0)] * a.ndim
    pad[axis] = (r, r)
    p = np.pad(a, pad, mode="reflect" if n > r else "edge")
    shape = list(a.shape)
    shape[axis] = -(-n // step)
    out = np.empty(shape, a.dtype)
    rows = max(8, (1 << 18) // max(out[:1].nbytes, 1))
    for y in range(0, len(out), rows):
        part = out[y : y + rows]
        one = np.empty_like(part)
        for i, w in enumerate(k):
            src = p[y * step + i : (y + len(part) - 1) * step + i + 1 : step] if axis == 0 else p[y : y + len(part), i : i + n : step]
            if i:
                np.multiply(src, w, out=one)
                part += one
            else:
                np.multiply(src, w, out=part)
    return out


def halved(a: np.ndarray, sigma: float = 1.0) -> np.ndarray:
    """Every second pixel of blur(), without working the others out."""
    r = max(1, int(round(3 * sigma)))
    k = np.exp(-(np.arange(-r, r + 1) ** 2) / (2 * sigma * sigma)).astype(np.float32)
    return _along(_along(a.astype(np.float32, copy=False), k / k.sum(), 0, 2), k / k.sum(), 1, 2)


def sobel(g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    d, s = np.array([-1, 0, 1], np.float32), np.array([1, 2, 1], np.float32)
    return _along(_along(g, d, 1), s, 0), _along(_along(g, d, 0), s, 1)


def gradient(bgr: np.ndarray, sigma: float = 1.2) -> np.ndarray:
    """Gradient magnitude of the blurred grey image (sigma 0: no blur)."""
    g = grey(bgr)
    return np.hypot(*sobel(blur(g, sigma) if sigma else g))


def resample(a: np.ndarray, h: int, w: int) -> np.ndarray:
    """Area averages (each output pixel averages the input it covers); rounds integers."""
    out = _shrink(_shrink(a.astype(np.float64), h, 0), w, 1)
    return np.clip(np.rint(out), 0, 255).astype(a.dtype) if a.dtype.kind == "u" else out.astype(a.dtype)


def _shrink(a: np.ndarray, n: int, axis: int) -> np.ndarray:
    total = np.concatenate([np.zeros_like(a.take([0], axis)), a.cumsum(axis)], axis)
    at = np.linspace(0, a.shape[axis], n + 1)
    lo = np.minimum(at.astype(int), a.shape[axis] - 1)
    f = (at - lo).reshape([-1 if k == axis else 1 for k in range(a.ndim)])
    edge = total.take(lo, axis) * (1 - f) + total.take(lo + 1, axis) * f
    return np.diff(edge, axis=axis) / (a.shape[axis] / n)


def fitted(h: int, w: int, most: int) -> tuple[int, int, float]:
    """Size whose longest side is at most `most`, never enlarged, and the realised scale of the width."""
    s = min(1.0, most / max(h, w))
    hh, ww = max(1, round(h * s)), max(1, round(w * s))
    return hh, ww, ww / w


def equalised(g: np.ndarray, clip: float = 2.0, tiles: int = 8) -> np.ndarray:
    """Contrast-limited histogram equalisation of uint8 grey; tables of tiles are mixed bilinearly."""
    h, w = g.shape
    ys, xs = np.linspace(0, h, tiles + 1).astype(int), np.linspace(0, w, tiles + 1).astype(int)
    lut = np.zeros((tiles, tiles, 256), np.float32)
    for i in range(tiles):
        for j in range(tiles):
            part = g[ys[i] : max(ys[i + 1], ys[i] + 1), xs[j] : max(xs[j + 1], xs[j] + 1)]
            c = np.bincount(part.ravel(), minlength=256).astype(np.float64)
            top = max(1.0, clip * part.size / 256)
            c = np.minimum(c, top) + np.maximum(c - top, 0).sum() / 256
            lut[i, j] = c.cumsum() * 255 / part.size
    fy = np.clip((np.arange(h) + 0.5) * tiles / h - 0.5, 0, tiles - 1)
    fx = np.clip((np.arange(w) + 0.5) * tiles / w - 0.5, 0, tiles - 1)
    y0, x0 = np.minimum(fy.astype(int), tiles - 2), np.minimum(fx.astype(int), tiles - 2)
    dy, dx = (fy - y0)[:, None], (fx - x0)[None]
    at = lambda a, b: lut[(y0 + a)[:, None], (x0 + b)[None], g]
    return (at(0, 0) * (1 - dy) + at(1, 0) * dy) * (1 - dx) + (at(0, 1) * (1 - dy) + at(1, 1) * dy) * dx


def apply(h: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Points under a homography; |w| is kept from 0."""
    q = p @ h[:, :2].T + h[:, 2]
    w = q[:, 2]
    w = np.where(np.abs(w) < 1e-9, np.where(w < 0, -1e-9, 1e-9), w)
    return q[:, :2] / w[:, None]


def frame(h: int, w: int) -> np.ndarray:
    """Clockwise corners from the top left, edges at w and h."""
    return np.array([[0, 0], [w, 0], [w, h], [0, h]], float)


def warp(img: np.ndarray, h: np.ndarray, x0: int, y0: int, hh: int, ww: int) -> tuple[np.ndarray, np.ndarray]:
    """The image under h on the window at (x0, y0): bilinear pixels (float32), and where the nearest pixel exists."""
    back = np.linalg.inv(h)
    yy, xx = np.mgrid[y0 : y0 + hh, x0 : x0 + ww]
    w = back[2, 0] * xx + back[2, 1] * yy + back[2, 2]
    with np.errstate(divide="ignore", invalid="ignore"):
        sx = (back[0, 0] * xx + back[0, 1] * yy + back[0, 2]) / w
        sy = (back[1, 0] * xx + back[1, 1] * yy + back[1, 2]) / w
    n, m = img.shape[:2]
    # Only points before the camera: w has the sign that the image's own centre gets.
    sign = np.sign(1 / (h[2] @ np.array([m / 2, n / 2, 1.0])) or 1)
    inside = (sx > -0.5) & (sx < m - 0.5) & (sy > -0.5) & (sy < n - 0.5) & (w * sign > 0)
    sx, sy = np.where(inside, sx, 0), np.where(inside, sy, 0)
    x, y = np.clip(np.floor(sx).astype(int), 0, max(m - 2, 0)), np.clip(np.floor(sy).astype(int), 0, max(n - 2, 0))
    fx, fy = np.clip(sx - x, 0, 1).astype(np.float32)[..., None], np.clip(sy - y, 0, 1).astype(np.float32)[..., None]
    x1, y1 = np.minimum(x + 1, m - 1), np.minimum(y + 1, n - 1)
    px = img if img.ndim == 3 else img[..., None]
    top = px[y, x] * (1 - fx) + px[y, x1] * fx
    low = px[y1, x] * (1 - fx) + px[y1, x1] * fx
    out = (top * (1 - fy) + low * fy) * inside[..., None]
    return (out if img.ndim == 3 else out[..., 0]).astype(np.float32), inside


def eroded(mask: np.ndarray, k: int) -> np.ndarray:
    """Square erosion of odd width k; outside the array counts as set."""
    r = k // 2
    for axis in (0, 1):
        pad = [(0, 0), (0, 0)]
        pad[axis] = (r, r)
        p, n = np.pad(mask, pad, constant_values=True), mask.shape[axis]
        mask = np.logical_and.reduce([p.take(range(i, i + n), axis) for i in range(k)])
    return mask


def dilated(mask: np.ndarray, k: int) -> np.ndarray:
    return ~eroded(~mask, k)


def inner_distance(mask: np.ndarray) -> np.ndarray:
    """City-block distance of each set pixel to the nearest unset one or the edge."""
    d = np.where(mask, np.float32(1e9), np.float32(0))
    for axis in (0, 1):
        n = mask.shape[axis]
        step = np.arange(1, n + 1, dtype=np.float32).reshape((-1, 1) if axis == 0 else (1, -1))
        for flip in (False, True):
            e = np.flip(d, axis) if flip else d
            e = np.minimum(np.minimum.accumulate(e - step, axis) + step, step)
            d = np.flip(e, axis) if flip else e
    return d


def correlation(a: np.ndarray, b: np.ndarray, h: np.ndarray, least: int = 2000) -> tuple[float, float]:
    """Correlation of gradient magnitudes of a (warped by h) and b, and the share of b's frame that a covers.

    Fixed: the widths of the blur and of the rim, and the least numbers of pixels. Fewer than `least` common pixels, or no variance: correlation 0.
    """
    hh, ww = b.shape[:2]
    if not np.isfinite(h).all() or abs(np.linalg.det(h)) < 1e-12:
        return 0.0, 0.0
    moved, mask = warp(a, h, 0, 0, hh, ww)
    share = float(mask.mean())
    core = eroded(mask, 7)
    if mask.sum() < least or core.sum() < least:
        return 0.0, share
    x, y = gradient(np.rint(moved))[core].astype(float), gradient(b)[core].astype(float)
    x, y = x - x.mean(), y - y.mean()
    norm = np.linalg.norm(x) * np.linalg.norm(y)
    return (float(x @ y / norm) if norm >= 1e-6 else 0.0), share


def checkerboard(a: np.ndarray, b: np.ndarray, mask: np.ndarray, cell: int = 120) -> np.ndarray:
    """b, with a in every other cell where the mask is set."""
    y, x = np.indices(mask.shape)
    return np.where((((y // cell + x // cell) % 2 == 1) & mask)[..., None], a, b)


def disagreement(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Difference of gradients, three times stretched to its largest value, uint8."""
    d = np.abs(gradient(a, 0) - gradient(b, 0))
    return np.clip(d / max(float(d.max()), 1e-9) * 255 * 3, 0, 255).astype(np.uint8)


def hues(n: int) -> np.ndarray:
    """n distinct BGR colours: full saturation, hues spread evenly."""
    six = np.arange(n) * 6.0 / max(n, 1)
    rgb = np.clip(np.stack([abs(six - 3) - 1, 2 - abs(six - 2), 2 - abs(six - 4)], 1), 0, 1)
    return np.rint(rgb[:, ::-1] * 255).astype(np.uint8)
