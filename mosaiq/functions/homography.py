"""3 x 3 homographies as nine columns (row-major), scaled to h33 = 1."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def dehomogenised(h: list[Column], x: Column, y: Column, guard: float | None = None) -> tuple[Column, Column]:
    """The image of (x, y). guard: |w| below it becomes guard of w's sign; without one, w = 0 gives null."""
    w = h[6] * x + h[7] * y + h[8]
    if guard is not None:
        w = F.when(F.abs(w) < guard, F.signum(w) * guard + guard / 1000).otherwise(w)
    return F.try_divide(h[0] * x + h[1] * y + h[2], w), F.try_divide(h[3] * x + h[4] * y + h[5], w)


def rescaled(h: list[Column], r: Column) -> list[Column]:
    """S H S^-1 for a change of scale by r."""
    return [h[0], h[1], h[2] * r, h[3], h[4], h[5] * r, F.try_divide(h[6], r), F.try_divide(h[7], r), h[8]]


def to_render(h: list[Column], scale: Column, anchor_scale: Column, render: Column) -> list[Column]:
    """From work pixels of an image to render pixels of the anchor: R Sa^-1 H S."""
    r = F.try_divide(render, anchor_scale)
    top = [v * scale * r for v in h[:2]] + [h[2] * r] + [v * scale * r for v in h[3:5]] + [h[5] * r]
    return [*top, h[6] * scale, h[7] * scale, h[8]]


def inverse(h: list[Column]) -> list[Column]:
    """The adjugate over its last entry: the inverse scaled to h33 = 1; null if there is none."""
    a, b, c, d, e, f, g, i, j = h
    adj = [e * j - f * i, c * i - b * j, b * f - c * e, f * g - d * j, a * j - c * g, c * d - a * f, d * i - e * g, b * g - a * i, a * e - b * d]
    return [F.try_divide(v, adj[8]) for v in adj]


def product(a: list[Column], b: list[Column]) -> list[Column]:
    return [sum((a[3 * i + k] * b[3 * k + j] for k in range(1, 3)), a[3 * i] * b[j]) for i in range(3) for j in range(3)]


def corners(w: Column, h: Column) -> list[tuple[Column, Column]]:
    """Clockwise from the top left, edges at w and h."""
    zero = F.lit(0.0)
    return [(zero, zero), (w, zero), (w, h), (zero, h)]


def implausible(h: list[Column], w: Column, ht: Column, max_scale: float = 6.0, max_sides: float = 12.0, max_tilt: float = 2.0) -> Column:
    """Why a homography can't be a view of one plane by a hand-held camera; 'ok' if it can. The first rule that fails names it."""
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    every = lambda cs: _all([finite(c) for c in cs])
    named = F.struct(*[c.alias(f"{n}{i}") for i, q in enumerate(dehomogenised(h, x, y) for x, y in corners(w, ht)) for n, c in zip("xy", q, strict=True)], *[v.alias(f"h{k}") for k, v in enumerate(h)], w.alias("w"), ht.alias("ht"))

    def rules(s: Column) -> Column:
        h, w, ht = [s[f"h{k}"] for k in range(9)], s["w"], s["ht"]
        p = [(s[f"x{i}"], s[f"y{i}"]) for i in range(4)]
        edge = [(p[(i + 1) % 4][0] - p[i][0], p[(i + 1) % 4][1] - p[i][1]) for i in range(4)]
        cross = [edge[i][0] * edge[(i + 1) % 4][1] - edge[i][1] * edge[(i + 1) % 4][0] for i in range(4)]
        area = F.abs(sum((p[i][0] * p[(i + 1) % 4][1] - p[(i + 1) % 4][0] * p[i][1] for i in range(1, 4)), p[0][0] * p[1][1] - p[1][0] * p[0][1])) / 2
        side = [F.sqrt(x * x + y * y) for x, y in edge]
        ratio = F.try_divide(area, w * ht)
        return (
            F.when(~every(h), "non-finite")
            .when(~every([c for q in p for c in q]), "non-finite corners")
            .when(~(_all([c > 0 for c in cross]) | _all([c < 0 for c in cross])), "warped outline not convex")
            .when(cross[0] < 0, "warp mirrors the image")
            .when(~(area > 0), "zero area")
            .when(~((ratio > 1 / max_scale) & (ratio < max_scale)), "area ratio")
            .when((F.least(*side) < 1e-6) | (F.greatest(*side) > max_sides * F.least(*side)), "sliver")
            .when(F.greatest(F.abs(h[6]), F.abs(h[7])) * F.sqrt(w * w + ht * ht) > max_tilt, "extreme perspective")
            .otherwise("ok")
        )

    # Bound once: written out, the corners would repeat in every rule and outgrow compiled code.
    return F.transform(F.array(named), rules)[0]


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out
