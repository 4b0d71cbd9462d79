"""Exposure gains, seams and blending of overlapping warped images."""

from __future__ import annotations

import numpy as np

from mosaiq.kernels.raster import grey, halved, inner_distance, sobel

EXPOSURES, SEAMS, BLENDS = ("blocks", "gain", "none"), ("graphcut", "dp", "voronoi", "none"), ("multiband", "feather", "none")

#: A warped image: left, top, BGR (float32), mask (bool).
Piece = tuple[int, int, np.ndarray, np.ndarray]


def _common(a: Piece, b: Piece):
    """Slices of both that cover the common rectangle; None if there is none."""
    x0, y0 = max(a[0], b[0]), max(a[1], b[1])
    x1, y1 = min(a[0] + a[3].shape[1], b[0] + b[3].shape[1]), min(a[1] + a[3].shape[0], b[1] + b[3].shape[0])
    if x1 <= x0 or y1 <= y0:
        return None
    return tuple((slice(y0 - p[1], y1 - p[1]), slice(x0 - p[0], x1 - p[0])) for p in (a, b))


#: Fixed: the widths of the differences of means and of the distance from 1, as factors of squares.
CLOSE, EVEN = 2 / 10.0**2, 1 / 0.1**2


def grid_shape(h: int, w: int, kind: str, block: int = 32) -> tuple[int, int]:
    """Rows and columns of a piece's factors."""
    return (-(-h // block), -(-w // block)) if kind == "blocks" else (1, 1)


def pair_means(a: Piece, b: Piece, kind: str, block: int = 32):
    """Where two pieces overlap: unit of a, unit of b, pixels, means of a and of b (n, 3); None where they don't. gain: means of grey."""
    cut = _common(a, b)
    if cut is None:
        return None
    both = a[3][cut[0]] & b[3][cut[1]]
    y, x = np.nonzero(both)
    if not len(y):
        return None
    shape = [grid_shape(*p[3].shape, kind, block) for p in (a, b)]
    unit = [(y + c[0].start) // block * s[1] + (x + c[1].start) // block if kind == "blocks" else np.zeros(len(y), int) for c, s in zip(cut, shape, strict=True)]
    size = shape[1][0] * shape[1][1]
    key, inv = np.unique(unit[0] * size + unit[1], return_inverse=True)
    n = np.bincount(inv).astype(float)
    va, vb = a[2][cut[0]][both], b[2][cut[1]][both]
    if kind == "gain":
        va, vb = (np.repeat(grey(v)[:, None], 3, 1) for v in (va, vb))
    ma, mb = (np.stack([np.bincount(inv, v[:, c]) / n for c in range(3)], 1) for v in (va, vb))
    return key // size, key % size, n, ma, mb


def solved_gains(means: list, size: int) -> np.ndarray:
    """Factors (size, 3) for units numbered over all pieces; means: (unit, unit, pixels, means, means) of pairs. Units without an overlap: 1."""
    out = np.ones((size, 3))
    if means:
        a, b, n, ma, mb = (np.concatenate(v) for v in zip(*means, strict=True))
        for c in range(3):
            out[:, c] = _solved(a, b, n, ma[:, c], mb[:, c], size)
    return out


def softened(grid: np.ndarray, kind: str) -> np.ndarray:
    return _soft(_soft(grid)) if kind == "blocks" else grid


def gains(pieces: list[Piece], kind: str, block: int = 32) -> list[np.ndarray]:
    """Of each piece a grid (rows, columns, 3) of factors that bring overlaps to like brightness.

    gain: one factor a piece, from grey means. blocks: a factor for each block and channel,
    smoothed. Least squares of differences of means (sigma 10) and of distance from 1 (sigma 0.1).
    """
    shape = [grid_shape(*p[3].shape, kind, block) for p in pieces]
    base = np.concatenate([[0], np.cumsum([h * w for h, w in shape])])
    found = [(i, j, pair_means(pieces[i], pieces[j], kind, block)) for i in range(len(pieces)) for j in range(i + 1, len(pieces)) if kind != "none"]
    out = solved_gains([(m[0] + base[i], m[1] + base[j], *m[2:]) for i, j, m in found if m is not None], base[-1])
    return [softened(out[base[k] : base[k + 1]].reshape(*shape[k], 3), kind) for k in range(len(pieces))]


def _soft(g: np.ndarray) -> np.ndarray:
    p = np.pad(g, ((1, 1), (1, 1), (0, 0)), mode="edge")
    r = (p[:-2] + 2 * p[1:-1] + p[2:]) / 4
    return (r[:, :-2] + 2 * r[:, 1:-1] + r[:, 2:]) / 4


def _solved(a, b, n, ma, mb, size: int) -> np.ndarray:
    """Conjugate gradients on the normal equations, which are as sparse as the overlaps."""
    sn, sg = CLOSE, EVEN
    count = lambda k, v: np.bincount(k, v, size)
    diag = count(a, n * (ma * ma * sn + sg)) + count(b, n * (mb * mb * sn + sg))
    off = -n * ma * mb * sn
    free = diag == 0
    diag[free] = 1
    right = count(a, n * sg) + count(b, n * sg) + free
    times = lambda v: diag * v + count(a, off * v[b]) + count(b, off * v[a])
    x = np.ones(size)
    r = right - times(x)
    z = r / diag
    d, rz = z.copy(), float(r @ z)
    for _ in range(10 * size + 50):
        if rz <= 1e-18 * max(float(right @ right), 1e-30):
            break
        q = times(d)
        s = rz / float(d @ q)
        x, r = x + s * d, r - s * q
        z = r / diag
        rz, old = float(r @ z), rz
        d = z + rz / old * d
    return x


def gain_at(grid: np.ndarray, fy: np.ndarray, fx: np.ndarray) -> np.ndarray:
    """Factors at places that are shares of the piece's height and width, mixed bilinearly."""
    h, w = grid.shape[:2]
    y, x = np.clip(fy * h - 0.5, 0, h - 1), np.clip(fx * w - 0.5, 0, w - 1)
    y0, x0 = np.minimum(y.astype(int), max(h - 2, 0)), np.minimum(x.astype(int), max(w - 2, 0))
    y1, x1 = np.minimum(y0 + 1, h - 1), np.minimum(x0 + 1, w - 1)
    dy, dx = (y - y0)[:, None, None], (x - x0)[None, :, None]
    top = grid[y0][:, x0] * (1 - dx) + grid[y0][:, x1] * dx
    return top * (1 - dy) + (grid[y1][:, x0] * (1 - dx) + grid[y1][:, x1] * dx) * dy


def pair_seam(a: Piece, b: Piece, kind: str):
    """(slices of a and b that cover their common rectangle, where a stays in it); None where they don't overlap. Pieces have like brightness."""
    cut = _common(a, b)
    if cut is None:
        return None
    both = a[3][cut[0]] & b[3][cut[1]]
    if not both.any():
        return None
    if kind == "voronoi":
        return cut, inner_distance(a[3])[cut[0]] >= inner_distance(b[3])[cut[1]]
    return cut, _cut(a, b, cut, both, kind)


def decided(masks: dict[int, np.ndarray], cuts: list[tuple]) -> None:
    """Take from masks (on one window each) what pairs' cuts (i, j, slices of i and j, where i stays) give to the other, pair by pair; each covered pixel stays covered."""
    for i, j, (at_i, at_j), first in cuts:
        mi, mj = masks[i][at_i], masks[j][at_j]
        both = mi & mj
        mi[both & ~first] = False
        mj[both & first] = False


def seams(pieces: list[Piece], kind: str) -> list[np.ndarray]:
    """Masks of which no two overlap (kind none: the masks as they are); each covered pixel stays covered."""
    masks = {k: p[3].copy() for k, p in enumerate(pieces)}
    if kind != "none":
        found = [(i, j, pair_seam(pieces[i], pieces[j], kind)) for i in range(len(pieces)) for j in range(i + 1, len(pieces))]
        decided(masks, [(i, j, *f) for i, j, f in found if f is not None])
    return list(masks.values())


def _cut(a: Piece, b: Piece, cut, both: np.ndarray, kind: str) -> np.ndarray:
    """Where a stays: its side of the cheapest path through the common rectangle.

    The path crosses the axis in which the pieces lie apart. Steps cost the colour
    difference over the strength of gradients; outside the overlap they are dear. dp: one
    step forward a row. graphcut: the cheapest path of all (in the plane the dual of a minimum cut).
    """
    x, y = a[2][cut[0]], b[2][cut[1]]
    gx, gy = np.hypot(*sobel(grey(x))), np.hypot(*sobel(grey(y)))
    cost = np.abs(x - y).sum(2) / (gx + gy + 1) + 1e-3
    cost = np.where(both, cost, cost[both].max() * 4 + 1).astype(np.float64)
    mid = lambda p: (p[0] + p[3].shape[1] / 2, p[1] + p[3].shape[0] / 2)
    (ax, ay), (bx, by) = mid(a), mid(b)
    across = abs(bx - ax) >= abs(by - ay)
    if not across:
        cost = cost.T
    side = _left_of(cost, kind == "graphcut")
    before = ax <= bx if across else ay <= by
    side = side if before else ~side
    return side if across else side.T


def _left_of(cost: np.ndarray, free: bool) -> np.ndarray:
    """Pixels left of (and on) the cheapest path from the first row to the last."""
    h, w = cost.shape
    if not free:
        d = cost.copy()
        for r in range(1, h):
            p = np.pad(d[r - 1], 1, constant_values=np.inf)
            d[r] += np.minimum(np.minimum(p[:-2], p[1:-1]), p[2:])
        at = np.empty(h, int)
        at[-1] = d[-1].argmin()
        for r in range(h - 2, -1, -1):
            lo = max(at[r + 1] - 1, 0)
            at[r] = lo + d[r, lo : at[r + 1] + 2].argmin()
        return np.arange(w)[None] <= at[:, None]
    start = np.full(cost.shape, np.inf)
    start[0] = cost[0]
    d = _distances(cost, start)
    path = np.zeros(cost.shape, bool)
    r, c = h - 1, int(d[-1].argmin())
    while True:
        path[r, c] = True
        if r == 0 and d[r, c] <= cost[r, c]:
            break
        near = [(r + y, c + x) for y, x in ((-1, 0), (0, -1), (0, 1), (1, 0)) if 0 <= r + y < h and 0 <= c + x < w and not path[r + y, c + x]]
        if not near:
            break
        r, c = min(near, key=lambda q: d[q])
    seed = np.full((h, w + 1), np.inf)
    seed[:, 0] = 0
    walls = np.pad(np.where(path, 1e12, 0.0), ((0, 0), (1, 0)))
    return (_distances(walls, seed)[:, 1:] < 1e12) | path


def _distances(cost: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Cheapest sums from the starts, four neighbours, by sweeps along whole rows and columns until nothing moves."""
    sums = [np.cumsum(np.flip(cost, x) if f else cost, x) for x in (0, 1) for f in (0, 1)]
    while True:
        was = d
        for k, (x, f) in enumerate((x, f) for x in (0, 1) for f in (0, 1)):
            e = np.flip(d, x) if f else d
            e = np.minimum(e, np.minimum.accumulate(e - sums[k], x) + sums[k])
            d = np.flip(e, x) if f else e
        known = np.isfinite(was)
        if known.all() and not (was - d > 1e-9 * (1 + np.abs(d))).any():
            return d


def bands(w: int, h: int, strength: float) -> int:
    return int(np.clip(np.ceil(np.log2(max(np.sqrt(w * h) * strength / 100, 1e-9))), 1, 7))


def blended(pieces: list[tuple[np.ndarray, np.ndarray, np.ndarray]], kind: str, depth: int = 5, strength: float = 5.0) -> tuple[np.ndarray, np.ndarray]:
    """One image (float32) and where anything covers it; pieces: (BGR, mask, weight 0..1) on one window, in order."""
    covered = np.logical_or.reduce([w > 0 for _, _, w in pieces])
    shape = pieces[0][0].shape
    if kind == "none":
        out = np.zeros(shape, np.float32)
        for px, _, w in pieces:
            out = np.where((w > 0.5)[..., None] | ((w > 0)[..., None] & (out == 0).all(2, keepdims=True)), px, out)
        return out, covered
    if kind == "feather":
        ws = [np.clip(inner_distance(np.pad(w > 0, 1, mode="edge"))[1:-1, 1:-1] / strength, 1e-4, 1) * (w > 0) for _, _, w in pieces]
        total = np.maximum(sum(ws), 1e-9)
        return (sum(px * w[..., None] for (px, _, _), w in zip(pieces, ws, strict=True)) / total[..., None]).astype(np.float32), covered
    top, under = None, None
    for px, mask, w in pieces:
        image, weight = _pyramid(_filled(px, mask, depth), depth), _pyramid(w.astype(np.float32)[..., None], depth)
        lap = [image[k] - _up(image[k + 1], image[k].shape) for k in range(depth)] + [image[depth]]
        part = [a * b for a, b in zip(lap, weight, strict=True)]
        top = part if top is None else [a + b for a, b in zip(top, part, strict=True)]
        under = weight if under is None else [a + b for a, b in zip(under, weight, strict=True)]
    levels = [a / np.maximum(b, 1e-5) for a, b in zip(top, under, strict=True)]
    out = levels[-1]
    for k in range(depth - 1, -1, -1):
        out = levels[k] + _up(out, levels[k].shape)
    return out * covered[..., None], covered


def _down(a: np.ndarray) -> np.ndarray:
    return halved(a, 1.0)


def _up(a: np.ndarray, shape) -> np.ndarray:
    y, x = np.arange(shape[0]) / 2, np.arange(shape[1]) / 2
    y0, x0 = np.minimum(y.astype(int), a.shape[0] - 1), np.minimum(x.astype(int), a.shape[1] - 1)
    y1, x1 = np.minimum(y0 + 1, a.shape[0] - 1), np.minimum(x0 + 1, a.shape[1] - 1)
    dy, dx = (y - y0).astype(np.float32)[:, None, None], (x - x0).astype(np.float32)[None, :, None]
    rows = a[y0] * (1 - dy) + a[y1] * dy
    return rows[:, x0] * (1 - dx) + rows[:, x1] * dx


def _pyramid(a: np.ndarray, depth: int) -> list[np.ndarray]:
    out = [a]
    for _ in range(depth):
        out.append(_down(out[-1]))
    return out


def _filled(px: np.ndarray, mask: np.ndarray, depth: int) -> np.ndarray:
    """Pixels outside the mask take the colours near it, so its border makes no edge."""
    m = mask.astype(np.float32)[..., None]
    if not mask.any() or mask.all() or depth < 0 or min(mask.shape) < 2:
        return px
    w = _down(m)
    small = _down(px * m) / np.maximum(w, 1e-6)
    return np.where(m > 0, px, _up(_filled(small, w[..., 0] > 1e-3, depth - 1), px.shape))
