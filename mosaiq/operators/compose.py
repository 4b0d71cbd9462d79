"""From layouts and photographs to mosaics: canvas, exposure and seams at a small scale, tiles at full scale."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from mosaiq.functions.homography import corners, dehomogenised, to_render
from mosaiq.kernels import blend as B
from mosaiq.kernels.raster import apply, dilated, eroded, frame, grey, hues, warp
from mosaiq.operators.graph import dealt
from mosaiq.operators.pairing import fault, nine, pixels
from mosaiq.operators.seams import bits_of as _bits, cuts  # noqa: F401


def canvas(work: DataFrame, layout: DataFrame, render_scale: float = 1.0, most_mp: float = 220.0) -> DataFrame:
    """store, idx, name, hr (full pixels to canvas), cw, ch, render_scale of placed images; a canvas over most_mp megapixels is rendered smaller."""
    placed = layout.where("h IS NOT NULL").select("store", "idx", F.col("h").alias("hw"), "is_anchor")
    rows = work.select("store", "idx", "name", "full_h", "full_w", "scale").join(placed, ["store", "idx"])
    rows = rows.join(rows.where("is_anchor").select("store", F.col("scale").alias("sa")), "store")

    def sized(rows: DataFrame) -> DataFrame:
        hr = to_render(nine("hw"), F.col("scale"), F.col("sa"), F.col("rs"))
        pts = [dehomogenised(hr, x, y, 1e-9) for x, y in corners(F.col("full_w").cast("double"), F.col("full_h").cast("double"))]
        xs, ys = zip(*pts, strict=True)
        flat = rows.withColumn("hr", F.array(*hr)).withColumn("_b", F.struct(F.least(*xs).alias("x0"), F.least(*ys).alias("y0"), F.greatest(*xs).alias("x1"), F.greatest(*ys).alias("y1")))
        box = flat.groupBy("store").agg(F.floor(F.min("_b.x0")).alias("x0"), F.floor(F.min("_b.y0")).alias("y0"), F.ceil(F.max("_b.x1")).alias("x1"), F.ceil(F.max("_b.y1")).alias("y1"))
        return flat.drop("_b").join(box, "store")

    area = (F.col("x1") - F.col("x0")).cast("double") * (F.col("y1") - F.col("y0"))
    first = sized(rows.withColumn("rs", F.lit(render_scale)))
    shrunk = first.withColumn("rs", F.when(area > most_mp * 1e6, F.col("rs") * F.sqrt(F.lit(most_mp * 1e6) / area)).otherwise(F.col("rs"))).drop("hr", "x0", "y0", "x1", "y1")
    last = sized(shrunk)
    h, x0, y0 = nine("hr"), F.col("x0"), F.col("y0")
    moved = F.array(*[h[k] - x0 * h[6 + k] for k in range(3)], *[h[3 + k] - y0 * h[6 + k] for k in range(3)], *h[6:])
    return last.select("store", "idx", "name", moved.alias("hr"), (F.col("x1") - x0).cast("int").alias("cw"), (F.col("y1") - y0).cast("int").alias("ch"), F.col("rs").alias("render_scale"))


def _region(h: np.ndarray, size: tuple[int, int], cw: int, ch: int) -> tuple[int, int, int, int]:
    """Left, top, width, height of the warped frame inside the canvas; 1 x 1 if it is outside."""
    p = apply(h, frame(*size))
    x0, y0 = np.maximum(np.floor(p.min(0)), 0).astype(int)
    x1, y1 = np.minimum(np.ceil(p.max(0)), [cw, ch]).astype(int)
    return (int(x0), int(y0), int(x1 - x0), int(y1 - y0)) if x1 > x0 and y1 > y0 else (0, 0, 1, 1)


def from_work(h: list, scale) -> list:
    """From work pixels to the canvas, of a homography from full pixels to the canvas: each is `scale` of a full pixel."""
    return [F.try_divide(v, scale) if k % 3 < 2 else v for k, v in enumerate(h)]


def work_canvas(work: DataFrame, layout: DataFrame, render_scale: float = 1.0, most_mp: float = 60.0) -> DataFrame:
    """canvas() with hr from work pixels, for previews that are made of the work images."""
    plan = canvas(work, layout, render_scale, most_mp)
    rows = plan.join(work.select("store", "idx", "scale"), ["store", "idx"])
    return rows.withColumn("hr", F.array(*from_work(nine("hr"), F.col("scale")))).select(plan.columns)


def warped(images: DataFrame, plan: DataFrame, tile: int = 1024) -> DataFrame:
    """store, idx, y0, x0, h, w, bgr, mask (bits): each image on the whole canvas, in the tiles that it reaches; images: h, w, bgr."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in it:
            for r in df.itertuples(index=False):
                h, px = np.array(r.hr).reshape(3, 3), pixels(r.bgr, r.ih, r.iw)
                x0, y0, w, hh = _region(h, (r.ih, r.iw), r.cw, r.ch)
                for y in range(y0 // tile * tile, y0 + hh, tile):
                    for x in range(x0 // tile * tile, x0 + w, tile):
                        part, mask = warp(px, h, x, y, min(tile, r.ch - y), min(tile, r.cw - x))
                        if mask.any():
                            yield pd.DataFrame([(r.store, r.idx, y, x, *mask.shape, np.rint(part).astype(np.uint8).tobytes(), np.packbits(mask).tobytes())], columns=["store", "idx", "y0", "x0", "h", "w", "bgr", "mask"])

    rows = images.select("store", "idx", F.col("h").alias("ih"), F.col("w").alias("iw"), "bgr").join(plan.drop("name"), ["store", "idx"])
    return dealt(rows, "store", "idx").mapInPandas(run, "store string, idx int, y0 int, x0 int, h int, w int, bgr binary, mask binary")


def thumbs(images: DataFrame, plan: DataFrame, seam_scale: float = 0.25) -> DataFrame:
    """store, idx, name, x0, y0, h, w, bgr, mask, error: each placed image warped onto the canvas at seam_scale; no pixels where that fails."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in it:
            out = []
            for r in df.itertuples(index=False):
                try:
                    h = np.diag([seam_scale, seam_scale, 1]) @ np.array(r.hr).reshape(3, 3)
                    x0, y0, w, hh = _region(h, (r.full_h, r.full_w), int(np.ceil(r.cw * seam_scale)), int(np.ceil(r.ch * seam_scale)))
                    px, mask = warp(pixels(r.bgr, r.full_h, r.full_w), h, x0, y0, hh, w)
                    out.append((r.store, r.idx, r.name, x0, y0, hh, w, np.rint(px).astype(np.uint8).tobytes(), np.packbits(eroded(mask, 3)).tobytes(), None))
                except Exception as e:  # noqa: BLE001
                    out.append((r.store, r.idx, r.name, 0, 0, 0, 0, b"", b"", fault(e)))
            yield pd.DataFrame(out, columns=["store", "idx", "name", "x0", "y0", "h", "w", "bgr", "mask", "error"])

    rows = images.select("store", "idx", "full_h", "full_w", "bgr").join(plan, ["store", "idx"])
    return dealt(rows, "store", "idx").mapInPandas(run, "store string, idx int, name string, x0 int, y0 int, h int, w int, bgr binary, mask binary, error string")


def tiles(images: DataFrame, plan: DataFrame, cut: DataFrame, *, blend: str = "multiband", strength: float = 5.0, seam_scale: float = 0.25, tile: int = 1024) -> DataFrame:
    """store, y0, x0, h, w, bgr, covered, the box of its non-black pixels (cy0, cy1, cx0, cx1), and error: the mosaic in tiles.

    A tile that fails is a row with its error and no pixels; a store whose cuts failed has no tiles.

    Images are warped tile by tile, with a margin as wide as the coarsest band reaches, and
    meet in groups of one tile, so neither an image's canvas nor a whole mosaic is ever in one task.
    """
    if blend not in B.BLENDS:
        raise ValueError(f"{blend!r}: one of {', '.join(B.BLENDS)}")

    def margin(cw: int, ch: int) -> tuple[int, int]:
        n = B.bands(cw, ch, strength) if blend == "multiband" else 1
        return n, 2**n if blend == "multiband" else int(2 ** np.ceil(np.log2(max(strength, 1) + 1)))

    names = ["store", "ty", "tx", "idx", "cw", "ch", "h", "w", "bgr", "mask", "weight", "error"]

    def patches(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in it:
            for r in df.itertuples(index=False):
                try:
                    yield from patch(r)
                except Exception as e:  # noqa: BLE001
                    yield pd.DataFrame([(r.store, 0, 0, r.idx, r.cw, r.ch, 0, 0, b"", b"", b"", fault(e))], columns=names)

    def patch(r) -> Iterator[pd.DataFrame]:
        h, px = np.array(r.hr).reshape(3, 3), pixels(r.bgr, r.full_h, r.full_w)
        seam = dilated(_bits(r.seam, r.h, r.w), 3).astype(np.float32)
        grid = np.frombuffer(r.gains).reshape(r.gh, r.gw, 3)
        x0, y0, w, hh = _region(h, (r.full_h, r.full_w), r.cw, r.ch)
        _, m = margin(r.cw, r.ch)
        for ty in range(max(y0 - m, 0) // tile, (min(y0 + hh + m, r.ch) - 1) // tile + 1):
            for tx in range(max(x0 - m, 0) // tile, (min(x0 + w + m, r.cw) - 1) // tile + 1):
                left, top = tx * tile - m, ty * tile - m
                wide, high = min((tx + 1) * tile, r.cw) + m - left, min((ty + 1) * tile, r.ch) + m - top
                # what of the window the image can reach, and a rim that the erosion needs
                a, b = max(y0 - 2, top), min(y0 + hh + 2, top + high)
                c, d = max(x0 - 2, left), min(x0 + w + 2, left + wide)
                if a >= b or c >= d:
                    continue
                part, mask = np.zeros((high, wide, 3), np.float32), np.zeros((high, wide), bool)
                inner = (slice(a - top, b - top), slice(c - left, d - left))
                part[inner], mask[inner] = warp(px, h, c, a, b - a, d - c)
                mask = eroded(mask, 3)
                if not mask.any():
                    continue
                fy, fx = (np.arange(high) + top + 0.5) * seam_scale, (np.arange(wide) + left + 0.5) * seam_scale
                weight = B.gain_at(seam[..., None], (fy - r.y0) / r.h, (fx - r.x0) / r.w)[..., 0] * mask
                part = part * B.gain_at(grid, (fy - r.y0) / r.h, (fx - r.x0) / r.w)
                yield pd.DataFrame([(r.store, ty, tx, r.idx, r.cw, r.ch, high, wide, np.clip(np.rint(part), 0, 255).astype(np.uint8).tobytes(), np.packbits(mask).tobytes(), np.rint(weight * 255).astype(np.uint8).tobytes(), None)], columns=names)

    ends = ["store", "y0", "x0", "h", "w", "bgr", "covered", "cy0", "cy1", "cx0", "cx1", "error"]

    def mix(df: pd.DataFrame) -> pd.DataFrame:
        try:
            if (bad := df["error"].dropna()).size:
                raise RuntimeError(bad.iloc[0])
            return mixed(df.sort_values("idx"))
        except Exception as e:  # noqa: BLE001
            return pd.DataFrame([(df["store"].iloc[0], int(df["ty"].iloc[0]) * tile, int(df["tx"].iloc[0]) * tile, 0, 0, b"", 0, None, None, None, None, fault(e))], columns=ends)

    def mixed(df: pd.DataFrame) -> pd.DataFrame:
        r = df.iloc[0]
        n, m = margin(r.cw, r.ch)
        ps = [(pixels(q.bgr, q.h, q.w).astype(np.float32), _bits(q.mask, q.h, q.w), np.frombuffer(q.weight, np.uint8).reshape(q.h, q.w) / np.float32(255)) for q in df.itertuples()]
        out, covered = B.blended(ps, blend, n, strength)
        out = np.clip(np.rint(out[m:-m, m:-m]), 0, 255).astype(np.uint8)
        y0, x0 = int(r.ty) * tile, int(r.tx) * tile
        y, x = np.nonzero(grey(out) > 0)
        box = (int(y.min()) + y0, int(y.max()) + 1 + y0, int(x.min()) + x0, int(x.max()) + 1 + x0) if len(y) else (None,) * 4
        return pd.DataFrame([(r.store, y0, x0, out.shape[0], out.shape[1], out.tobytes(), int(covered[m:-m, m:-m].sum()), *box, None)], columns=ends)

    rows = images.select("store", "idx", "full_h", "full_w", "bgr").join(plan.drop("name"), ["store", "idx"]).join(cut.where("error IS NULL").drop("name", "error"), ["store", "idx"])
    flat = dealt(rows, "store", "idx").mapInPandas(patches, "store string, ty int, tx int, idx int, cw int, ch int, h int, w int, bgr binary, mask binary, weight binary, error string")
    return dealt(flat, "store", "ty", "tx").groupBy("store", "ty", "tx").applyInPandas(mix, "store string, y0 int, x0 int, h int, w int, bgr binary, covered long, cy0 int, cy1 int, cx0 int, cx1 int, error string")


def canvas_statistics(mosaic: DataFrame, plan: DataFrame) -> DataFrame:
    """store, canvas_px, covered_px, coverage (of the whole canvas, before it is cropped)."""
    size = plan.groupBy("store").agg((F.max("cw").cast("long") * F.max("ch")).alias("canvas_px"))
    filled = mosaic.groupBy("store").agg(F.sum("covered").alias("covered_px"))
    out = size.join(filled, "store", "left").withColumn("covered_px", F.coalesce("covered_px", F.lit(0).cast("long")))
    return out.withColumn("coverage", F.coalesce(F.try_divide(F.col("covered_px").cast("double"), "canvas_px"), F.lit(0.0)))


def crop_boxes(mosaic: DataFrame) -> DataFrame:
    """store, cy0, cy1, cx0, cx1: the box of all non-black pixels, nulls if all are black."""
    return mosaic.groupBy("store").agg(F.min("cy0").alias("cy0"), F.max("cy1").alias("cy1"), F.min("cx0").alias("cx0"), F.max("cx1").alias("cx1"))


def opened(m: np.ndarray, k: int) -> np.ndarray:
    """Without specks that a k x k square doesn't fit into."""
    return dilated(eroded(m, k), k)


def completeness(mosaic: DataFrame, small: DataFrame, seam_scale: float = 0.25, tile: int = 1024) -> DataFrame:
    """store, union_px, filled_px, missing_pct, complete: canvas pixels that some image covers (at seam_scale) against those filled.

    The union is eroded by 5 x 5 (its rim is shaved by warping and cropping); of what is
    missing in it, specks that 5 x 5 doesn't fit into don't count. complete: under 0.5 % missing.

    Masks are cut into tiles with a rim as wide as the three steps reach together, clipped at
    the canvas, whose edge they treat as one array would. So each tile counts its own pixels
    exactly, whatever its size, and no task holds a canvas.
    """
    rim = 3 * (5 // 2)
    size = small.groupBy("store").agg(F.max(F.col("y0") + F.col("h")).alias("ch"), F.max(F.col("x0") + F.col("w")).alias("cw"))

    def spots(y0: int, x0: int, bits: np.ndarray, ch: int, cw: int) -> Iterator[tuple]:
        """The parts of a mask that tiles with their rims see: ty, tx, y, x, h, w, bits."""
        h, w = min(bits.shape[0], ch - y0), min(bits.shape[1], cw - x0)
        for ty in range(max(y0 - rim, 0) // tile, (min(y0 + h + rim, ch) - 1) // tile + 1):
            for tx in range(max(x0 - rim, 0) // tile, (min(x0 + w + rim, cw) - 1) // tile + 1):
                a, b = max(y0, ty * tile - rim), min(y0 + h, (ty + 1) * tile + rim)
                c, d = max(x0, tx * tile - rim), min(x0 + w, (tx + 1) * tile + rim)
                if a < b and c < d:
                    yield ty, tx, a, c, b - a, d - c, np.packbits(bits[a - y0 : b - y0, c - x0 : d - x0]).tobytes()

    cols = ["store", "ch", "cw", "kind", "ty", "tx", "y", "x", "h", "w", "bits"]

    def covers(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in it:
            yield pd.DataFrame([(r.store, r.ch, r.cw, 0, *p) for r in df.itertuples(index=False) for p in spots(r.y0, r.x0, _bits(r.mask, r.h, r.w), r.ch, r.cw)], columns=cols)

    def fills(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in it:
            out = []
            for r in df.itertuples(index=False):
                px = grey(pixels(r.bgr, r.h, r.w)) > 0
                y = np.arange(int(np.ceil(r.y0 * seam_scale)), int(np.ceil((r.y0 + r.h) * seam_scale)))
                x = np.arange(int(np.ceil(r.x0 * seam_scale)), int(np.ceil((r.x0 + r.w) * seam_scale)))
                at = lambda v, o, n: np.clip((v / seam_scale).astype(int) - o, 0, n - 1)
                got = px[np.ix_(at(y, r.y0, r.h), at(x, r.x0, r.w))]
                if got.size and y[0] < r.ch and x[0] < r.cw:
                    out += [(r.store, r.ch, r.cw, 1, *p) for p in spots(int(y[0]), int(x[0]), got, r.ch, r.cw)]
            yield pd.DataFrame(out, columns=cols)

    def count(df: pd.DataFrame) -> pd.DataFrame:
        r = df.iloc[0]
        top, left = max(int(r.ty) * tile - rim, 0), max(int(r.tx) * tile - rim, 0)
        high, wide = min((int(r.ty) + 1) * tile + rim, int(r.ch)) - top, min((int(r.tx) + 1) * tile + rim, int(r.cw)) - left
        both = np.zeros((2, high, wide), bool)
        for p in df.itertuples():
            both[p.kind, p.y - top : p.y - top + p.h, p.x - left : p.x - left + p.w] |= _bits(p.bits, p.h, p.w)
        on = eroded(both[0], 5)
        missing = opened(on & ~both[1], 5)
        own = (slice(int(r.ty) * tile - top, (int(r.ty) + 1) * tile - top), slice(int(r.tx) * tile - left, (int(r.tx) + 1) * tile - left))
        n, lost = int(on[own].sum()), int(missing[own].sum())
        return pd.DataFrame([(r.store, n, n - lost)], columns=["store", "union_px", "filled_px"])

    kinds = "store string, ch int, cw int, kind int, ty int, tx int, y int, x int, h int, w int, bits binary"
    parts = small.select("store", "x0", "y0", "h", "w", "mask").join(size, "store").mapInPandas(covers, kinds)
    parts = parts.unionByName(mosaic.select("store", "y0", "x0", "h", "w", "bgr").join(size, "store").mapInPandas(fills, kinds))
    each = parts.groupBy("store", "ty", "tx").applyInPandas(count, "store string, union_px long, filled_px long")
    got = each.groupBy("store").agg(F.sum("union_px").alias("union_px"), F.sum("filled_px").alias("filled_px"))
    pct = F.coalesce(F.try_divide((F.col("union_px") - F.col("filled_px")) * F.lit(100.0), "union_px"), F.lit(0.0))
    return got.withColumn("missing_pct", pct).withColumn("complete", F.col("missing_pct") < 0.5)


def seam_map(small: DataFrame, cut: DataFrame) -> DataFrame:
    """store, h, w, bgr: at the seams' scale, which image each pixel comes from: 0.55 of the photograph and 0.45 of a hue."""

    def run(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values("idx")
        h, w = int((df.y0 + df.h).max()), int((df.x0 + df.w).max())
        out, colour = np.zeros((h, w, 3), np.uint8), hues(len(df))
        for k, r in enumerate(df.itertuples()):
            m = _bits(r.seam, r.h, r.w)
            out[r.y0 : r.y0 + r.h, r.x0 : r.x0 + r.w][m] = np.rint(0.55 * pixels(r.bgr, r.h, r.w)[m] + 0.45 * colour[k])
        return pd.DataFrame([(df.store.iloc[0], h, w, out.tobytes())], columns=["store", "h", "w", "bgr"])

    both = small.select("store", "idx", "x0", "y0", "h", "w", "bgr").join(cut.where("error IS NULL").select("store", "idx", "seam"), ["store", "idx"])
    return both.groupBy("store").applyInPandas(run, "store string, h int, w int, bgr binary")


def assembled(mosaic: DataFrame, store: str, crop: bool = True) -> np.ndarray:
    """One store's mosaic as an array on the driver; canvas() bounds its size. crop: without the black border."""
    mine = mosaic.where(F.col("store") == store)
    e = mine.agg(F.max(F.col("y0") + F.col("h")), F.max(F.col("x0") + F.col("w")), F.min("cy0"), F.max("cy1"), F.min("cx0"), F.max("cx1")).first()
    out = np.zeros((e[0] or 1, e[1] or 1, 3), np.uint8)
    for r in mine.select("y0", "x0", "h", "w", "bgr").toLocalIterator():
        out[r.y0 : r.y0 + r.h, r.x0 : r.x0 + r.w] = pixels(r.bgr, r.h, r.w)
    return out[e[2] : e[3], e[4] : e[5]] if crop and e[2] is not None else out
