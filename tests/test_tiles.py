"""Tiled morphology and gains against single arrays; forests of k-d trees against exhaustive matching."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from mosaiq.kernels.raster import eroded
from mosaiq.operators import compose as C
from mosaiq.operators.matching import mutual, mutual_matches
from mosaiq.operators.neighbours import forest_matches, forest_nearest, grown, leaf_bounds


@pytest.mark.parametrize("tile", [16, 37, 64, 1024])
def test_completeness_is_that_of_one_array(spark, tile):
    rng = np.random.default_rng(3)
    h, w = 90, 130
    px = np.full((h, w, 3), 120, np.uint8)
    for _ in range(40):
        y, x, k = rng.integers(0, h), rng.integers(0, w), rng.integers(2, 12)
        px[y : y + k, x : x + k] = 0
    masks = [(0, 0, rng.random((70, 80)) < 0.999), (50, 10, rng.random((80, 80)) < 0.999), (100, 60, np.ones((30, 30), bool))]
    on, filled = np.zeros((h, w), bool), px[..., 0] > 0
    for x0, y0, m in masks:
        on[y0 : y0 + m.shape[0], x0 : x0 + m.shape[1]] |= m
    on = eroded(on, 5)
    missing = C.opened(on & ~filled, 5)
    mosaic = spark.createDataFrame([("s", y, x, *px[y : y + 40, x : x + 50].shape[:2], px[y : y + 40, x : x + 50].tobytes()) for y in range(0, h, 40) for x in range(0, w, 50)], "store string, y0 int, x0 int, h int, w int, bgr binary")
    small = spark.createDataFrame([("s", x0, y0, *m.shape, np.packbits(m).tobytes()) for x0, y0, m in masks], "store string, x0 int, y0 int, h int, w int, mask binary")
    r = C.completeness(mosaic, small, 1.0, tile).first()
    assert missing.any() and (r.union_px, r.filled_px) == (on.sum(), on.sum() - missing.sum())


def clouds(spark, sizes, dims=24):
    """Groups of descriptors; half of each group are near those of the group before."""
    rng = np.random.default_rng(12)
    rows, last = [], None
    for g, n in enumerate(sizes):
        x = rng.normal(size=(n, dims))
        if last is not None:
            k = min(len(last), n) // 2
            x[:k] = last[rng.permutation(len(last))[:k]] + rng.normal(0, 0.05, (k, dims))
        rows += [(g, g * 10_000 + i, v.tolist()) for i, v in enumerate(x)]
        last = x
    return spark.createDataFrame(rows, "grp long, id long, desc array<double>").repartition(4)


def test_a_forest_finds_what_matters(spark):
    features = clouds(spark, [600, 500, 700])
    exact = {tuple(r)[:4] for r in mutual_matches(features, 0.85).collect()}
    near = forest_nearest(features, checks=64)
    got = {tuple(r)[:4] for r in mutual(near, 0.85).collect()}
    took = near.agg(F.sum("looked_at")).first()[0]
    every = 2 * (600 * 500 + 600 * 700 + 500 * 700)
    assert len(exact) > 400 and len(got & exact) >= 0.95 * len(exact) and took < every / 4
    again = {tuple(r)[:4] for r in forest_matches(features.repartition(2), 0.85, checks=64).collect()}
    assert again == got


def test_a_forest_with_all_leaves_is_exhaustive(spark):
    features = clouds(spark, [60, 1, 45, 2], dims=6)
    exact = {(*tuple(r)[:4], round(r.d, 9)) for r in mutual_matches(features, 0.8).collect()}
    for block in (4096, 20):
        got = {(*tuple(r)[:4], round(r.d, 9)) for r in forest_matches(features, 0.8, trees=2, checks=10_000, block=block).collect()}
        assert got == exact and exact


def test_bounds_of_leaves_hold():
    rng = np.random.default_rng(1)
    x, q = rng.normal(size=(300, 5)), rng.normal(size=(50, 5))
    dims, cuts, at = grown(x, 16, rng)
    bounds = leaf_bounds(q, dims, cuts)
    assert bounds.shape == (50, 32) and np.bincount(at, minlength=32).max() <= 16
    # each split on the way is a coordinate's distance: one coordinate at a time, the bound holds for the largest of them
    for leaf in range(32):
        d = ((q[:, None] - x[at == leaf][None]) ** 2).sum(2).min(1)
        assert (bounds[:, leaf] <= d * 5 + 1e-9).all() and (bounds.min(1) == 0).all()


def photographs(spark, n=4, seed=5):
    """Overlapping warped images of one store at the seams' scale, each brighter than the last."""
    from test_layout import texture

    img = texture(90, 60 + 45 * n, seed)
    rows, pieces = [], []
    for k in range(n):
        px = np.clip(img[:, 45 * k : 45 * k + 100].astype(float) * (0.8 + 0.12 * k), 0, 255).astype(np.uint8)
        mask = np.ones(px.shape[:2], bool)
        mask[:3 + k] = False
        rows.append(("s", k, f"n{k}", 45 * k, 2 * k, *px.shape[:2], px.tobytes(), np.packbits(mask).tobytes(), None))
        pieces.append((45 * k, 2 * k, px.astype(np.float32), mask))
    from mosaiq.operators.graph import kept

    return kept(spark.createDataFrame(rows, "store string, idx int, name string, x0 int, y0 int, h int, w int, bgr binary, mask binary, error string"))[0], pieces


@pytest.mark.parametrize("exposure,most_units", [("blocks", 200_000), ("blocks", 0), ("gain", 0), ("none", 0)])
def test_gains_of_rows_are_those_of_one_array(spark, exposure, most_units):
    from mosaiq.kernels import blend as B
    from mosaiq.operators import seams as S

    small, pieces = photographs(spark, 3)
    pairs = S.near_pairs(small)
    assert {(r.i, r.j) for r in pairs.collect()} == {(0, 1), (1, 2), (0, 2)}
    means = None if exposure == "none" else S.overlap_means(small, pairs, exposure)
    got = {r.idx: np.frombuffer(r.gains).reshape(r.gh, r.gw, 3) for r in S.gains(small, means, exposure, most_units=most_units).collect()}
    for k, want in enumerate(B.gains(pieces, exposure)):
        assert got[k].shape == want.shape and np.abs(got[k] - want).max() < 1e-3
    assert exposure == "none" or got[0].mean() > got[2].mean()


@pytest.mark.parametrize("seam,tile", [("graphcut", 512), ("dp", 32), ("voronoi", 50), ("none", 64)])
def test_cuts_of_pairs_and_tiles(spark, seam, tile):
    """Masks that don't overlap and cover what the images cover, whatever the tiles; and as one array gives them."""
    from mosaiq.kernels import blend as B

    small, pieces = photographs(spark)
    got = {r.idx: r for r in C.cuts(small, "none", seam, tile=tile).collect()}
    seams = B.seams([(x, y, px, m) for x, y, px, m in pieces], seam)
    count, there = np.zeros((110, 300), int), np.zeros((110, 300), bool)
    for k, (x, y, _, m) in enumerate(pieces):
        mine = C._bits(got[k].seam, got[k].h, got[k].w)
        assert (mine == seams[k]).all()
        count[y : y + m.shape[0], x : x + m.shape[1]] += mine
        there[y : y + m.shape[0], x : x + m.shape[1]] |= m
    assert ((count > 0) == there).all() and (seam == "none" or count.max() == 1) and abs(sum(r.share for r in got.values()) - 1) < 1e-9


def test_pairs_of_near_boxes_alone(spark):
    from mosaiq.operators.seams import near_pairs

    rng = np.random.default_rng(9)
    boxes = [("s", k, int(x), int(y), int(h), int(w)) for k, (x, y, h, w) in enumerate(zip(rng.integers(0, 900, 40), rng.integers(0, 900, 40), rng.integers(0, 200, 40), rng.integers(0, 200, 40), strict=True))]
    meets = lambda a, b: min(a[4:]) > 0 and min(b[4:]) > 0 and a[2] < b[2] + b[5] and b[2] < a[2] + a[5] and a[3] < b[3] + b[4] and b[3] < a[3] + a[4]
    want = {(a[1], b[1]) for a in boxes for b in boxes if a[1] < b[1] and meets(a, b)}
    df = spark.createDataFrame(boxes, "store string, idx int, x0 int, y0 int, h int, w int")
    for cell in (64, 5000):
        assert {(r.i, r.j) for r in near_pairs(df, cell).collect()} == want


@pytest.mark.parametrize("tile", [64, 1024])
def test_work_images_on_the_canvas(spark, tile):
    """Work pixels land where full pixels do, and tiles are the whole warp."""
    from mosaiq.kernels.raster import warp
    from test_layout import texture

    img = texture(90, 120)
    work = spark.createDataFrame([("s", k, f"n{k}", 180, 240, 90, 120, 0.5, img.tobytes()) for k in range(2)], "store string, idx int, name string, full_h int, full_w int, h int, w int, scale double, bgr binary")
    hs = [np.eye(3), np.array([[1.02, 0.01, 60], [-0.01, 0.98, 9], [1e-5, 0, 1]])]
    layout = spark.createDataFrame([("s", k, h.ravel().tolist(), k == 0) for k, h in enumerate(hs)], "store string, idx int, h array<double>, is_anchor boolean")
    full, plan = ({r.idx: r for r in p.collect()} for p in (C.canvas(work, layout, 0.5), C.work_canvas(work, layout, 0.5)))
    for k in range(2):
        a, b = (np.array(p[k].hr).reshape(3, 3) for p in (full, plan))
        assert np.abs(a @ np.diag([2, 2, 1.0]) - b).max() < 1e-9 and (full[k].cw, full[k].ch) == (plan[k].cw, plan[k].ch)
    for k in range(2):
        px, mask = warp(img, np.array(plan[k].hr).reshape(3, 3), 0, 0, plan[k].ch, plan[k].cw)
        got, on = np.zeros_like(px), np.zeros_like(mask)
        for r in C.warped(work, C.work_canvas(work, layout, 0.5), tile).where(F.col("idx") == k).collect():
            at = (slice(r.y0, r.y0 + r.h), slice(r.x0, r.x0 + r.w))
            got[at], on[at] = np.frombuffer(r.bgr, np.uint8).reshape(r.h, r.w, 3), C._bits(r.mask, r.h, r.w)
        assert (on == mask).all() and mask.any() and np.abs(got - px)[mask].max() <= 0.5


def shuffled(df):
    """Exchanges in the plan of what df reads and does."""
    return df._jdf.queryExecution().executedPlan().toString()


def test_vectors_of_two_blocks_are_not_shuffled(spark, monkeypatch):
    """Blocks meet where they are staged; a row's nearest two of a group leave a task once, however many blocks the group has."""
    from mosaiq.operators import matching

    plans, real = [], matching.kept
    monkeypatch.setattr(matching, "kept", lambda df: plans.append((df.columns, shuffled(df))) or real(df))
    features = clouds(spark, [300, 260], dims=6)
    for found in (mutual_matches(features, 0.8, 8), forest_matches(features, 0.8, checks=10_000, block=8)):
        assert found.count() > 50
    merged = [plan for columns, plan in plans if "second" in columns]
    assert len(merged) == 2
    for plan in merged:
        product = plan[plan.index("MapInArrow") :]
        assert "CartesianProduct" in product and "Exchange" not in product
