"""Homographies from correspondences: robust fits, sequential modes, photometric polish, joint adjustment."""

from __future__ import annotations

import zlib

import numpy as np

from mosaiq.kernels.raster import apply, blur, grey, warp


def homography(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least squares over normalised points (direct linear transform), h33 = 1."""

    def unit(p):
        c = p.mean(0)
        s = np.sqrt(2) / max(np.sqrt(((p - c) ** 2).sum(1)).mean(), 1e-12)
        return np.array([[s, 0, -s * c[0]], [0, s, -s * c[1]], [0, 0, 1]])

    ta, tb = unit(a), unit(b)
    (x, y), (u, v) = apply(ta, a).T, apply(tb, b).T
    one, nil = np.ones_like(x), np.zeros_like(x)
    rows = np.concatenate([np.stack([x, y, one, nil, nil, nil, -u * x, -u * y, -u], 1), np.stack([nil, nil, nil, x, y, one, -v * x, -v * y, -v], 1)])
    h = np.linalg.inv(tb) @ np.linalg.eigh(rows.T @ rows)[1][:, 0].reshape(3, 3) @ ta
    return h / h[2, 2]


def _exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Homographies (k, 3, 3) of k sets of four correspondences (k, 4, 2); NaN where none is."""
    x, y, u, v = a[..., 0], a[..., 1], b[..., 0], b[..., 1]
    one, nil = np.ones_like(x), np.zeros_like(x)
    m = np.concatenate([np.stack([x, y, one, nil, nil, nil, -u * x, -u * y], -1), np.stack([nil, nil, nil, x, y, one, -v * x, -v * y], -1)], 1)
    ok = np.abs(np.linalg.det(m)) > 1e-9
    out = np.full((len(a), 9), np.nan)
    if ok.any():
        out[ok, :8] = np.linalg.solve(m[ok], np.concatenate([u, v], 1)[ok][..., None])[..., 0]
    out[:, 8] = 1
    return out.reshape(-1, 3, 3)


def robust(a: np.ndarray, b: np.ndarray, rng: np.random.Generator, within: float = 3.0, most: int = 20000, sure: float = 0.9999, batch: int = 256):
    """(h, inliers): the homography of the least truncated squared error, then refitted; (None, none) if there is none."""
    n = len(a)
    if n < 4:
        return None, np.zeros(n, bool)
    c, s = b.mean(0), max(float(b.std()), 1e-9)
    ca, sa = a.mean(0), max(float(a.std()), 1e-9)
    p, q, cut = (a - ca) / sa, (b - c) / s, (within / s) ** 2
    best, h, need, tried = np.inf, None, most, 0
    while tried < min(need, most):
        pick = rng.integers(0, n, (batch, 4))
        pick = pick[(np.diff(np.sort(pick, 1), axis=1) > 0).all(1)]
        hs = _exact(p[pick], q[pick])
        w = hs[:, 2, :2] @ p.T + hs[:, 2, 2:]
        with np.errstate(all="ignore"):
            dx = (hs[:, 0, :2] @ p.T + hs[:, 0, 2:]) / w - q[:, 0]
            dy = (hs[:, 1, :2] @ p.T + hs[:, 1, 2:]) / w - q[:, 1]
            e = dx * dx + dy * dy
        e = np.where((e < cut) & (w > 0), e, cut)
        cost = e.sum(1)
        tried += batch
        k = int(cost.argmin()) if len(cost) else 0
        if len(cost) and cost[k] < best:
            best, h = cost[k], hs[k]
            good = (e[k] < cut).mean() ** 4
            need = np.log(1 - sure) / np.log(1 - good) if 0 < good < 1 else (0 if good else most)
    if h is None:
        return None, np.zeros(n, bool)
    h = np.array([[s, 0, c[0]], [0, s, c[1]], [0, 0, 1]]) @ h @ np.array([[1 / sa, 0, -ca[0] / sa], [0, 1 / sa, -ca[1] / sa], [0, 0, 1]])
    inliers = ((apply(h, a) - b) ** 2).sum(1) < within**2
    for _ in range(4):
        if inliers.sum() < 4:
            break
        trial = homography(a[inliers], b[inliers])
        now = ((apply(trial, a) - b) ** 2).sum(1) < within**2
        if now.sum() < inliers.sum():
            break
        h, same, inliers = trial, bool((now == inliers).all()), now
        if same:
            break
    return h / h[2, 2], inliers


def modes(a: np.ndarray, b: np.ndarray, seed: int, most: int = 6, least: int = 40, within: float = 3.0) -> list[tuple[np.ndarray, np.ndarray]]:
    """Up to `most` homographies with the places of their inliers; each is fitted to what the earlier left."""
    rng, pool, out = np.random.default_rng(seed), np.arange(len(a)), []
    while len(out) < most and len(pool) >= max(least, 4):
        h, good = robust(a[pool], b[pool], rng, within)
        if h is None or good.sum() < max(least, 4):
            break
        out.append((h, pool[good]))
        pool = pool[~good]
    return out


def polished(a: np.ndarray, b: np.ndarray, h: np.ndarray, scale: float = 0.5, rounds: int = 60, least: int = 5000) -> np.ndarray | None:
    """h moved so that a under it correlates best with b (enhanced correlation, Gauss-Newton at half scale); None if it fails."""
    s = np.diag([scale, scale, 1.0])
    hh, ww = int(b.shape[0] * scale), int(b.shape[1] * scale)
    small = lambda im: warp(blur(grey(im), 5 / 3), s, 0, 0, int(im.shape[0] * scale), int(im.shape[1] * scale))[0]
    x, t = small(a), small(b)
    # From b's frame to a's: the direction in which pixels are fetched.
    w = s @ np.linalg.inv(h) @ np.linalg.inv(s)
    yy, xx = (v.astype(float) for v in np.mgrid[:hh, :ww])
    try:
        for _ in range(rounds):
            moved, inside = warp(x, np.linalg.inv(w), 0, 0, hh, ww)
            if inside.sum() < least:
                return None
            gy, gx = np.gradient(x)
            dx, _ = warp(gx, np.linalg.inv(w), 0, 0, hh, ww)
            dy, _ = warp(gy, np.linalg.inv(w), 0, 0, hh, ww)
            k = inside
            px, py, fx, fy = xx[k], yy[k], dx[k].astype(float), dy[k].astype(float)
            d = w[2, 0] * px + w[2, 1] * py + w[2, 2]
            u, v = (w[0, 0] * px + w[0, 1] * py + w[0, 2]) / d, (w[1, 0] * px + w[1, 1] * py + w[1, 2]) / d
            turn = -(fx * u + fy * v)
            j = np.stack([fx * px, fx * py, fx, fy * px, fy * py, fy, turn * px, turn * py], 1) / d[:, None]
            i, r = moved[k].astype(float), t[k].astype(float)
            i, r = i - i.mean(), r - r.mean()
            j = j - j.mean(0)
            unit = np.maximum(np.linalg.norm(j, axis=0), 1e-12)
            j /= unit
            n = np.linalg.pinv(j.T @ j)
            fit = j @ (n @ (j.T @ i))
            bottom = float(r @ i - r @ (j @ (n @ (j.T @ i))))
            gain = float(i @ i - i @ fit) / bottom if bottom > 0 else float(np.linalg.norm(i) / max(np.linalg.norm(r), 1e-9))
            step = n @ (j.T @ (gain * r - i)) / unit
            w = w + np.append(step, 0).reshape(3, 3)
            w /= w[2, 2]
            if np.abs(step * [ww, hh, 1, ww, hh, 1, ww * ww, hh * hh]).max() < 1e-4:
                break
        out = np.linalg.inv(s) @ np.linalg.inv(w) @ s
        return out / out[2, 2] if np.isfinite(out).all() else None
    except np.linalg.LinAlgError:
        return None


def spread(p: np.ndarray, most: int, rng: np.random.Generator, grid: int = 8) -> np.ndarray:
    """Places of up to `most` points, dealt round-robin over grid cells, by chance inside a cell."""
    if len(p) <= most:
        return np.arange(len(p))
    lo, wide = p.min(0), np.maximum(np.ptp(p, 0), 1e-9)
    cell = np.minimum(((p - lo) / wide * grid).astype(int), grid - 1) @ [grid, 1]
    mixed = rng.permutation(len(p))
    order = mixed[np.argsort(cell[mixed], kind="stable")]
    starts = np.r_[True, np.diff(cell[order]) != 0]
    depth = np.arange(len(p)) - np.maximum.accumulate(np.where(starts, np.arange(len(p)), 0))
    return order[np.lexsort((cell[order], depth))][:most]


def pair_system(hi: np.ndarray, hj: np.ndarray, a: np.ndarray, b: np.ndarray, w: float, huber: float):
    """A pair's part of the joint adjustment: (16 x 16 normal matrix, gradient, Huber cost, sum of squares, numbers).

    Errors are the weighted transfer errors in both frames; unknowns are the first eight
    entries of i's and then of j's homography. None if one has no inverse or a point goes to infinity.
    """
    try:
        ii, jj = np.linalg.inv(hi), np.linalg.inv(hj)
    except np.linalg.LinAlgError:
        return None
    jac, err, n = [], [], len(a)
    for k, (x, y, inv, m) in enumerate(((a, b, jj, jj @ hi), (b, a, ii, ii @ hj))):
        x = np.column_stack([x, np.ones(n)])
        q = x @ m.T
        if not np.isfinite(q).all() or (np.abs(q[:, 2]) < 1e-12).any():
            return None
        p, d = q[:, :2] / q[:, 2:], np.zeros((n, 2, 3))
        d[:, 0, 0] = d[:, 1, 1] = 1 / q[:, 2]
        d[:, :, 2] = -p / q[:, 2:]
        d = d @ inv
        # d(inv M x) for a change of M, which moves the point, and of the frame it moves to
        own = (d[..., None] * x[:, None, None]).reshape(n, 2, 9)[..., :8]
        other = -(d[..., None] * q[:, None, None]).reshape(n, 2, 9)[..., :8]
        jac.append(np.concatenate([own, other] if k == 0 else [other, own], 2).reshape(-1, 16))
        err.append((p - y).ravel())
    j, e = np.concatenate(jac) * w, np.concatenate(err) * w
    size = np.abs(e)
    soft = np.minimum(1, huber / np.maximum(size, 1e-12))
    return (j * soft[:, None]).T @ j, j.T @ (soft * e), float(np.where(size <= huber, e * e, 2 * huber * size - huber**2).sum()), float(e @ e), e.size


def sampled(store: str, i: int, j: int, q: np.ndarray, ncc: float, most: int = 600) -> tuple[np.ndarray, float] | None:
    """(up to `most` of the correspondences (n, 4), weight) of a pair in the joint adjustment; None with under four. Chance depends on store, i and j alone."""
    if len(q) < 4:
        return None
    rng = np.random.default_rng(zlib.crc32(f"{store}/{i}/{j}".encode()))
    return q[spread(q[:, :2], most, rng)], float(np.sqrt(max(ncc, 0.0)))


def adjusted(start: dict[int, np.ndarray], pairs: list, anchor: int, huber: float = 3.0, most: int = 600, rounds: int = 200, store: str = ""):
    """All homographies but the anchor's, moved to the least Huber cost of both-way transfer errors (Levenberg-Marquardt).

    pairs: (i, j, points in i, points in j, ncc). Pairs with an end outside the layout, or
    of under four points, are left out. A step that makes a homography singular is refused, and
    so is a result of a larger error than the start. Returns homographies and a dict of statistics.
    """
    some = [(i, j, sampled(store, i, j, np.column_stack([a, b]), ncc, most)) for i, j, a, b, ncc in pairs if i in start and j in start]
    data = [(i, j, x[0][:, :2], x[0][:, 2:], x[1]) for i, j, x in some if x is not None]
    free = sorted(set(start) - {anchor})
    stats = {"rms_before": 0.0, "rms_after": 0.0, "n_points": sum(len(d[2]) for d in data), "accepted": True}
    at = {v: 8 * k for k, v in enumerate(free)}
    h = {k: v / v[2, 2] for k, v in start.items()}
    h[anchor] = np.eye(3)

    def measured(h):
        return [pair_system(h[i], h[j], a, b, w, huber) for i, j, a, b, w in data]

    def rms(found):  # fixed: the weighted error of both frames, a point's two numbers together
        return float(np.sqrt(sum(f[3] for f in found) / max(sum(f[4] for f in found), 1) * 2))

    found = measured(h)
    if not free or not data or any(f is None for f in found):
        return dict(start), stats
    now, first, damp, quiet = sum(f[2] for f in found), rms(found), 1e-3, 0
    for _ in range(rounds):
        full, side = np.zeros((8 * len(free),) * 2), np.zeros(8 * len(free))
        for (i, j, *_), (block, gradient, *_) in zip(data, found, strict=True):
            own = np.r_[np.arange(8) if i != anchor else [], np.arange(8, 16) if j != anchor else []].astype(int)
            where = np.concatenate([np.arange(at[v], at[v] + 8) for v in (i, j) if v != anchor] or [np.zeros(0, int)])
            full[np.ix_(where, where)] += block[np.ix_(own, own)]
            side[where] += gradient[own]
        unit = np.sqrt(np.maximum(np.diag(full), 1e-30))
        better = False
        for _ in range(12):
            step = -np.linalg.lstsq(full / np.outer(unit, unit) + damp * np.eye(len(side)), side / unit, rcond=None)[0] / unit
            trial = dict(h)
            for v in free:
                trial[v] = h[v] + np.append(step[at[v] : at[v] + 8], 0).reshape(3, 3)
            again = measured(trial)
            cost = np.inf if any(f is None for f in again) else sum(f[2] for f in again)
            if cost < now:
                better, damp = True, max(damp / 10, 1e-12)
                quiet = quiet + 1 if now - cost < 1e-10 * max(now, 1e-12) else 0
                h, found, now = trial, again, cost
                break
            damp *= 10
        if not better or quiet >= 2:
            break
    stats |= {"rms_before": first, "rms_after": rms(found), "accepted": rms(found) <= first}
    return (h if stats["accepted"] else dict(start)), stats
