"""Exposure and seams of mosaics of any size: pairs of overlapping images are rows, and so are blocks, tiles and unknowns.

Boxes that share a coarse cell of the canvas are candidates, so pairs come from an equi-join.
Each pair leaves the means of its overlap by blocks; the least-squares system of their
factors is solved in one task for a store of few blocks, and by conjugate gradients over
rows for a large one. Each pair is then cut once, by the brightened pixels of both. What a
cut takes from an image is a matter of single pixels, so masks and cuts meet in tiles of the
canvas, pair after pair in one order, and each image's mask is put together from its tiles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from mosaiq.kernels import blend as B
from mosaiq.operators.adjust import _summed, solved
from mosaiq.operators.graph import FEW, dealt, kept, looked_up, numbered
from mosaiq.operators.pairing import fault, pixels

#: Pixels of a coarse cell's side, and of a tile's, at the seams' scale.
CELL, TILE = 512, 512


def bits_of(data: bytes, h: int, w: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(data, np.uint8), count=h * w).reshape(h, w).astype(bool)


def near_pairs(small: DataFrame, cell: int = CELL) -> DataFrame:
    """store, i, j (i < j) of images whose boxes meet; small: store, idx, x0, y0, h, w."""
    run = lambda at, size: F.explode(F.expr(f"sequence({at} div {cell}, ({at} + {size} - 1) div {cell})"))
    box = small.where("h > 0 and w > 0").select("store", "idx", "x0", "y0", "h", "w").withColumn("cy", run("y0", "h")).withColumn("cx", run("x0", "w"))
    side = lambda s: box.select("store", "cy", "cx", F.col("idx").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in ("x0", "y0", "h", "w")])
    meet = "i < j and x0_i < x0_j + w_j and x0_j < x0_i + w_i and y0_i < y0_j + h_j and y0_j < y0_i + h_i"
    return side("i").join(side("j"), ["store", "cy", "cx"]).where(meet).select("store", "i", "j").distinct()


def _both(pairs: DataFrame, small: DataFrame, more: list[str]) -> DataFrame:
    side = lambda s: small.select("store", F.col("idx").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in ("x0", "y0", "h", "w", *more)])
    both = pairs.join(side("i"), ["store", "i"]).join(side("j"), ["store", "j"])
    return dealt(both, "store", "i", "j")


def _piece(r, s: str) -> B.Piece:
    at = lambda c: getattr(r, f"{c}_{s}")
    return at("x0"), at("y0"), pixels(at("bgr"), at("h"), at("w")).astype(np.float32), bits_of(at("mask"), at("h"), at("w"))


def overlap_means(small: DataFrame, pairs: DataFrame, exposure: str) -> DataFrame:
    """store, i, j, means, error: of each overlap the units of both, pixels, and means of both channels, packed (n rows of 9 float64)."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in it:
            out = []
            for r in df.itertuples(index=False):
                try:
                    m = B.pair_means(_piece(r, "i"), _piece(r, "j"), exposure)
                    if m is not None:
                        out.append((r.store, r.i, r.j, np.column_stack(m).astype(float).tobytes(), None))
                except Exception as e:  # noqa: BLE001
                    out.append((r.store, r.i, r.j, None, fault(e)))
            yield pd.DataFrame(out, columns=["store", "i", "j", "means", "error"])

    return _both(pairs, small, ["bgr", "mask"]).mapInPandas(run, "store string, i int, j int, means binary, error string")


_GAINS = "store string, idx int, gains binary, gh int, gw int"


def _rows_of_gains(store: str, exposure: str, shapes: list[tuple], flat: np.ndarray) -> list[tuple]:
    out, at = [], 0
    for idx, gh, gw in shapes:
        grid = B.softened(flat[at : at + gh * gw].reshape(gh, gw, 3), exposure)
        out.append((store, idx, grid.tobytes(), gh, gw))
        at += gh * gw
    return out


def small_gains(grids: DataFrame, means: DataFrame, exposure: str) -> DataFrame:
    """store, idx, gains, gh, gw: the system of a store in one task. grids: store, idx, gh, gw."""

    def run(g: pd.DataFrame, m: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("idx")
        base, at, found = {}, 0, []
        for r in g.itertuples():
            base[r.idx] = at
            at += r.gh * r.gw
        for r in m.sort_values(["i", "j"]).itertuples():
            x = np.frombuffer(r.means).reshape(-1, 9)
            found.append((x[:, 0].astype(int) + base[r.i], x[:, 1].astype(int) + base[r.j], x[:, 2], x[:, 3:6], x[:, 6:9]))
        rows = _rows_of_gains(g["store"].iloc[0], exposure, list(zip(g["idx"], g["gh"], g["gw"], strict=True)), B.solved_gains(found, at)) if len(g) else []
        return pd.DataFrame(rows, columns=["store", "idx", "gains", "gh", "gw"])

    return grids.groupBy("store").cogroup(means.groupBy("store")).applyInPandas(run, _GAINS)


def large_gains(grids: DataFrame, means: DataFrame, exposure: str, few: int = FEW, tolerance: float = 1e-7) -> DataFrame:
    """small_gains() of stores of any size: a row of unknowns a unit, the system solved by conjugate gradients over rows."""
    units, _ = kept(numbered(grids.select("store", "idx", F.explode(F.expr("sequence(0, gh * gw - 1)")).alias("unit")), ["store", "idx", "unit"]))

    def unpack(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in it:
            for r in df.itertuples(index=False):
                x = np.frombuffer(r.means).reshape(-1, 9)
                n, ma, mb = x[:, 2:3], x[:, 3:6], x[:, 6:9]
                yield pd.DataFrame({"store": r.store, "i": r.i, "ui": x[:, 0].astype(int), "j": r.j, "uj": x[:, 1].astype(int), "di": list(n * (ma * ma * B.CLOSE + B.EVEN)), "dj": list(n * (mb * mb * B.CLOSE + B.EVEN)), "m": list(-n * ma * mb * B.CLOSE), "s": x[:, 2] * B.EVEN})

    rows = means.mapInPandas(unpack, "store string, i int, ui int, j int, uj int, di array<double>, dj array<double>, m array<double>, s double")
    end = lambda s: units.select("store", F.col("idx").alias(s), F.col("unit").alias(f"u{s}"), F.col("node").alias(f"n{s}"))
    links, _ = kept(looked_up(looked_up(rows, ["store", "i", "ui"], end("i"), few), ["store", "j", "uj"], end("j"), few).select("ni", "nj", "di", "dj", "m", "s"))
    zero = F.lit(0.0)
    block = lambda v: F.array(*[F.col(v)[k // 4] if k % 4 == 0 else zero for k in range(9)])
    side = lambda n, d: F.struct(F.col(n).alias("node"), block(d).alias("a"), F.array(*[-F.col("s")] * 3).alias("g"))
    diag, _ = kept(_summed(links.select(F.explode(F.array(side("ni", "di"), side("nj", "dj"))).alias("e")).select("e.*"), "node", a=9, g=3))
    both = F.array(F.struct(F.col("ni").alias("to"), F.col("nj").alias("from")), F.struct(F.col("nj").alias("to"), F.col("ni").alias("from")))
    off, _ = kept(links.select(F.explode(both).alias("e"), block("m").alias("m")).select("e.*", "m"))
    x, _ = solved(diag, off, width=3, tolerance=tolerance, few=few)
    flat = units.join(x, "node", "left").select("store", "idx", "unit", F.coalesce("x", F.array(*[F.lit(1.0)] * 3)).alias("x"))  # units without an overlap stay as they are
    grid = flat.groupBy("store", "idx").agg(F.transform(F.array_sort(F.collect_list(F.struct("unit", "x"))), lambda u: u["x"]).alias("x")).join(grids, ["store", "idx"])

    def soften(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in it:
            out = [_rows_of_gains(r.store, exposure, [(r.idx, r.gh, r.gw)], np.array([list(v) for v in r.x], float)) for r in df.itertuples(index=False)]
            yield pd.DataFrame([r for rows_ in out for r in rows_], columns=["store", "idx", "gains", "gh", "gw"])

    return grid.select("store", "idx", "gh", "gw", "x").mapInPandas(soften, _GAINS)


def gains(small: DataFrame, means: DataFrame | None, exposure: str, *, most_units: int = 200_000, few: int = FEW) -> DataFrame:
    """store, idx, gains (gh x gw x 3 float64), gh, gw: factors that bring overlaps to like brightness; 1 everywhere for exposure none."""
    step = lambda c: F.greatest(F.expr(f"({c} + 31) div 32"), F.lit(1)).cast("int") if exposure == "blocks" else F.lit(1)
    grids = small.where("h > 0 and w > 0").select("store", "idx", step("h").alias("gh"), step("w").alias("gw"))
    if means is None:
        ones = np.ones(3).tobytes()
        return grids.select("store", "idx", F.lit(bytearray(ones)).alias("gains"), "gh", "gw")
    means = means.where("means is not null")
    large, _ = kept(grids.groupBy("store").agg(F.sum(F.col("gh") * F.col("gw")).alias("n")).where(F.col("n") > most_units).select("store"))
    if not large.limit(1).count():
        return small_gains(grids, means, exposure)
    part = lambda df, how: df.join(F.broadcast(large), "store", how) if large.count() <= few else df.join(large, "store", how)
    return small_gains(part(grids, "left_anti"), part(means, "left_anti"), exposure).unionByName(large_gains(part(grids, "left_semi"), part(means, "left_semi"), exposure, few))


def pair_cuts(small: DataFrame, gain: DataFrame, pairs: DataFrame, seam: str) -> DataFrame:
    """store, i, j, y, x, h, w, first (bits: where i stays in their common rectangle on the canvas), error."""
    lit = small.select("store", "idx", "x0", "y0", "h", "w", "bgr", "mask").join(gain, ["store", "idx"])

    def even(r, s: str) -> B.Piece:
        x0, y0, px, mask = _piece(r, s)
        grid = np.frombuffer(getattr(r, f"gains_{s}")).reshape(getattr(r, f"gh_{s}"), getattr(r, f"gw_{s}"), 3)
        h, w = mask.shape
        return x0, y0, (px * B.gain_at(grid, (np.arange(h) + 0.5) / h, (np.arange(w) + 0.5) / w)).astype(np.float32), mask

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in it:
            out = []
            for r in df.itertuples(index=False):
                try:
                    found = B.pair_seam(even(r, "i"), even(r, "j"), seam)
                    if found is not None:
                        (at, _), first = found
                        out.append((r.store, r.i, r.j, r.y0_i + at[0].start, r.x0_i + at[1].start, *first.shape, np.packbits(first).tobytes(), None))
                except Exception as e:  # noqa: BLE001
                    out.append((r.store, r.i, r.j, 0, 0, 0, 0, b"", fault(e)))
            yield pd.DataFrame(out, columns=["store", "i", "j", "y", "x", "h", "w", "first", "error"])

    return _both(pairs, lit, ["bgr", "mask", "gains", "gh", "gw"]).mapInPandas(run, "store string, i int, j int, y int, x int, h int, w int, first binary, error string")


def decided(small: DataFrame, cuts: DataFrame, tile: int = TILE) -> DataFrame:
    """store, idx, seam (bits), px: what is left of each image's mask after all pairs' cuts, worked out tile by tile."""
    cols = ["store", "ty", "tx", "i", "j", "y", "x", "h", "w", "bits"]

    def spread(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """A row a tile that a mask (j is -1) or a cut lies in."""
        for df in it:
            out = []
            for r in df.itertuples(index=False):
                if not r.h or not r.w:
                    continue
                m = bits_of(r.bits, r.h, r.w)
                for ty in range(r.y // tile, (r.y + r.h - 1) // tile + 1):
                    for tx in range(r.x // tile, (r.x + r.w - 1) // tile + 1):
                        a, b = max(r.y, ty * tile), min(r.y + r.h, (ty + 1) * tile)
                        c, d = max(r.x, tx * tile), min(r.x + r.w, (tx + 1) * tile)
                        out.append((r.store, ty, tx, r.i, r.j, a, c, b - a, d - c, np.packbits(m[a - r.y : b - r.y, c - r.x : d - r.x]).tobytes()))
            yield pd.DataFrame(out, columns=cols)

    masks = small.select("store", F.col("idx").alias("i"), F.lit(-1).alias("j"), F.col("y0").alias("y"), F.col("x0").alias("x"), "h", "w", F.col("mask").alias("bits"))
    every = masks.unionByName(cuts.select("store", "i", "j", "y", "x", "h", "w", F.col("first").alias("bits")))
    parts = every.mapInPandas(spread, "store string, ty int, tx int, i int, j int, y int, x int, h int, w int, bits binary")

    def merge(df: pd.DataFrame) -> pd.DataFrame:
        top, left = int(df["ty"].iloc[0]) * tile, int(df["tx"].iloc[0]) * tile
        window = lambda r: (slice(r.y - top, r.y - top + r.h), slice(r.x - left, r.x - left + r.w))
        left_of, own = {}, {}
        for r in df[df["j"] < 0].itertuples():
            left_of[r.i], own[r.i] = np.zeros((tile, tile), bool), r
            left_of[r.i][window(r)] = bits_of(r.bits, r.h, r.w)
        B.decided(left_of, [(r.i, r.j, (window(r), window(r)), bits_of(r.bits, r.h, r.w)) for r in df[df["j"] >= 0].sort_values(["i", "j"]).itertuples() if r.i in own and r.j in own])
        return pd.DataFrame([(r.store, i, r.y, r.x, r.h, r.w, np.packbits(left_of[i][window(r)]).tobytes()) for i, r in own.items()], columns=["store", "idx", "y", "x", "h", "w", "bits"])

    done = parts.groupBy("store", "ty", "tx").applyInPandas(merge, "store string, idx int, y int, x int, h int, w int, bits binary")
    box = small.select("store", "idx", F.col("y0").alias("by"), F.col("x0").alias("bx"), F.col("h").alias("bh"), F.col("w").alias("bw"))

    def whole(df: pd.DataFrame) -> pd.DataFrame:
        r0 = df.iloc[0]
        m = np.zeros((r0.bh, r0.bw), bool)
        for r in df.itertuples():
            m[r.y - r.by : r.y - r.by + r.h, r.x - r.bx : r.x - r.bx + r.w] = bits_of(r.bits, r.h, r.w)
        return pd.DataFrame([(r0.store, r0.idx, np.packbits(m).tobytes(), int(m.sum()))], columns=["store", "idx", "seam", "px"])

    return done.join(box, ["store", "idx"]).groupBy("store", "idx").applyInPandas(whole, "store string, idx int, seam binary, px long")


def cuts(small: DataFrame, exposure: str = "blocks", seam: str = "graphcut", *, most_units: int = 200_000, tile: int = TILE, few: int = FEW) -> DataFrame:
    """store, idx, name, x0, y0, h, w, seam (bits), gains (float64), gh, gw, share of all pixels, error.

    A store of which an image or a pair fails has nothing but the error in its rows. `small`
    is staged: its pixels are read for overlaps and for cuts.
    """
    for v, allowed in ((exposure, B.EXPOSURES), (seam, B.SEAMS)):
        if v not in allowed:
            raise ValueError(f"{v!r}: one of {', '.join(allowed)}")
    fine = small.where("error is null") if "error" in small.columns else small.withColumn("error", F.lit(None).cast("string"))
    pairs, _ = kept(near_pairs(fine))
    means = kept(overlap_means(fine, pairs, exposure))[0] if exposure != "none" else None
    gain, _ = kept(gains(fine, means, exposure, most_units=most_units, few=few))
    cut = kept(pair_cuts(fine, gain, pairs, seam))[0] if seam != "none" else None
    none = fine.select("store", F.lit(None).cast("string").alias("error")).limit(0)
    bad = small.select("store", "error") if "error" in small.columns else none
    for t in (means, cut):
        bad = bad if t is None else bad.unionByName(t.select("store", "error"))
    bad, _ = kept(bad.where("error is not null").groupBy("store").agg(F.max("error").alias("error")))
    empty = fine.select("store", F.col("idx").alias("i"), F.col("idx").alias("j"), *[F.lit(0).alias(c) for c in "yxhw"], F.lit(bytearray()).alias("first")).limit(0)
    masks, _ = kept(decided(fine, empty if cut is None else cut, tile))
    total, _ = kept(masks.groupBy("store").agg(F.greatest(F.sum("px"), F.lit(1)).alias("all_px")))
    out = looked_up(small.select("store", "idx", "name", "x0", "y0", "h", "w"), ["store"], bad, few)
    out = looked_up(out.join(masks, ["store", "idx"], "left").join(gain, ["store", "idx"], "left"), ["store"], total, few)
    ok = F.col("error").isNull()
    value = lambda c, none: F.when(ok, F.col(c)).otherwise(F.lit(none)).alias(c)
    share = F.when(ok, F.coalesce(F.col("px") / F.col("all_px"), F.lit(0.0))).otherwise(0.0).alias("share")
    return out.select("store", "idx", "name", *[value(c, 0) for c in ("x0", "y0", "h", "w")], value("seam", bytearray()), value("gains", bytearray()), value("gh", 0), value("gw", 0), share, "error")
