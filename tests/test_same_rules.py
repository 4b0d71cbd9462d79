"""Rules that the plan's kernels apply to one store and the operators to tables: both on the same rows."""

import numpy as np
import pytest
from pyspark.sql import Window as W, functions as F

from mosaiq.kernels import fit, raster
from mosaiq.kernels.raster import apply
from mosaiq.operators import compose as C, evaluate, forest, graph, pairing as P, reach
from mosaiq.operators.matching import acceptance, best_effort, best_mode, edge_score, grid_sample, mutual_matches, viable
from test_layout import PAIRS, WORK, pair, texture


def test_matches(spark):
    """Mutual nearest neighbours with ratio tests: packed features of two images, and rows."""
    rng = np.random.default_rng(5)
    a, b = rng.normal(size=(120, 8)), rng.normal(size=(90, 8))
    b[:50] = a[30:80] + rng.normal(0, 0.1, (50, 8))
    a, b = a.astype(np.float32), b.astype(np.float32)
    rows = [(g, k, [float(v) for v in x]) for g, m in ((0, a), (1, b)) for k, x in enumerate(m)]
    got = {(r.id_i, r.id_j) for r in mutual_matches(spark.createDataFrame(rows, "grp long, id long, desc array<double>"), 0.8).collect()}
    assert got == set(map(tuple, P.matched(a, b, 0.8).tolist())) and len(got) > 30


def drawn_modes(seed, pairs=80):
    """Modes of many pairs: implausible ones, ties, low overlaps, few inliers; some pairs have none."""
    rng = np.random.default_rng(seed)
    out = []
    for i in range(pairs):
        n = int(rng.integers(0, 5))
        modes = []
        for k in range(n):
            why = "ok" if rng.random() < 0.7 else "sliver"
            fine = why == "ok"
            modes.append((k, int(rng.integers(30, 90)), [float(v) for v in np.eye(3).ravel()], b"", why, float(rng.choice([0.1, 0.3, 0.3, 0.6])) if fine else 0.0, float(rng.choice([0.01, 0.2])) if fine else 0.0))
        out.append(("s", i, i + 1, int(rng.integers(20, 800)), modes))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_selection_and_gates(spark, seed):
    rows = drawn_modes(seed)
    scored = spark.createDataFrame(rows, f"store string, i int, j int, n_matches int, modes array<{P._MODE}>")
    got = {r.i: r for r in P.accepted(scored).collect()}
    flat, _ = graph.kept(scored.select("i", "n_matches", F.explode("modes").alias("m")).select("i", "n_matches", "m.*"))
    fine = F.col("why") == "ok"
    won = {r.i: r for r in best_mode(flat, ["i"], "ncc", "mode_no", viable(F.col("overlap"), F.col("n_inliers")), fine).withColumn("gate", acceptance(F.col("n_matches"), F.col("n_inliers"), F.col("ncc"))).withColumn("s", edge_score(F.col("gate") == "ok", F.col("n_inliers"), F.col("ncc"))).collect()}
    tried = {r.i: r for r in best_effort(flat, ["i"], "ncc", "mode_no", fine).collect()}
    seen = set()
    for _, i, _, n, modes in rows:
        r = got[i]
        if i in won:
            w = won[i]
            assert (r.n_inliers, r.ncc, r.overlap) == (w.n_inliers, w.ncc, w.overlap) and r.ok == (w.gate == "ok") and abs(r.score - w.s) < 1e-12
            want = {"ok": "ncc overruled top-inlier mode" if w.overruled else "", "inlier ratio": "inlier ratio 0.", "ncc": "ncc 0."}.get(w.gate, w.gate)
            assert r.reason.startswith(want) and (r.ok or want)
            seen.add(w.gate.split()[0])
        elif modes:
            t = tried[i]
            assert not r.ok and (r.n_inliers, r.ncc) == (t.n_inliers, t.ncc)
            assert n < 40 or r.reason == (t.why if not t.plausible else r.reason)
            seen.add("effort")
        else:
            assert not r.ok and r.reason.startswith("only" if n < 40 else "no homography")
    assert seen >= {"ok", "ncc", "inlier", "effort"}


def test_graphs_and_trees(spark):
    """Components, anchors, trees and homographies of one store, as the kernel and as tables give them."""
    rng = np.random.default_rng(3)
    edges = []
    for i, j in [(0, 1), (1, 2), (2, 3), (0, 3), (1, 3), (3, 4), (2, 4), (6, 7)]:
        edges.append((i, j, np.array([[1, 0.01 * rng.normal(), 50 * rng.normal()], [0.01 * rng.normal(), 1, 50 * rng.normal()], [0, 0, 1]]), float(rng.choice([3.0, 5.0, 8.0]))))
    placed, anchor, comps = P.lay_out(list(range(9)), edges)
    df = spark.createDataFrame([(i, j, s, h.ravel().tolist()) for i, j, h, s in edges], "a long, b long, weight double, h array<double>")
    nodes = graph.kept(graph.components(spark.range(9).withColumnRenamed("id", "node"), df))[0]
    by = {}
    for r in nodes.collect():
        by.setdefault(r.component, []).append(r.node)
    assert sorted(map(sorted, by.values()), key=lambda c: (-len(c), c[0])) == comps
    main = nodes.where(F.col("component") == min(comps[0]))
    both = graph.kept(graph.both_ways(df, "a", "b", [("strength", F.col("weight"), F.col("weight"))]))[0]
    got = reach.anchors(main, both.where(F.col("a").isin(comps[0]))).select("anchor")
    assert got.first().anchor == anchor
    _, places = forest.spanning(df, placed=True)
    frames = {r.node: np.array(r.h).reshape(3, 3) for r in forest.framed(places, graph.kept(got)[0]).collect()}
    assert sorted(frames) == sorted(placed) and all(np.abs(frames[k] - placed[k]).max() < 1e-9 for k in placed)


def store(n, two=True):
    """n images in a row, an arm that closes a cycle, and (two) a pair of images apart."""
    work = [("s", k, f"n{k}", 160, 240, b"") for k in range(n + 2 * two)]
    rows = [pair(k, k + 1, 40, dx=-90) for k in range(n - 1)] + [pair(0, 2, 30, ncc=0.5, dx=-180)] + ([pair(n, n + 1, 40, dx=-50)] if two else [])
    return work, rows


def test_layouts_of_a_task_and_of_tables(spark):
    work, rows = store(4)
    w, p = spark.createDataFrame(work, WORK), spark.createDataFrame(rows, PAIRS)
    small, large = ({r.idx: r for r in P.layouts(w, p, adjust=False, most=most).collect()} for most in (200, 1))
    assert sorted(small) == sorted(large) == list(range(6))
    for k, a in small.items():
        b = large[k]
        assert (a.is_anchor, a.position, a.component, a.error, a.h is None) == (b.is_anchor, b.position, b.component, b.error, b.h is None)
        assert a.h is None or np.abs(np.array(a.h) - np.array(b.h)).max() < 1e-9


def test_sampling_over_cells():
    """Round-robin over cells: the kernel takes as many of each cell as the operator's rule of depths gives."""
    rng = np.random.default_rng(2)
    p = np.concatenate([rng.uniform(0, 100, (300, 2)), rng.uniform(0, 10, (900, 2)), [[0, 0], [100, 100]]])
    took = fit.spread(p, 400, rng)
    cell = np.minimum((p / 100 * 8).astype(int), 7) @ [8, 1]
    full, got = np.bincount(cell, minlength=64), np.bincount(cell[took], minlength=64)
    depth = max(d for d in range(1, 1000) if np.minimum(full, d).sum() <= 400)
    assert len(took) == len(set(took)) == 400 and (got >= np.minimum(full, depth)).all() and (got <= np.minimum(full, depth + 1)).all()


def test_sampling_as_rows(spark):
    rng = np.random.default_rng(2)
    p = rng.uniform(0, 100, (500, 2))
    rows = spark.createDataFrame([(k, int(x // 12.5), int(y // 12.5)) for k, (x, y) in enumerate(p)], "id long, gx int, gy int")
    took = np.array([r.id for r in grid_sample(rows, ["gx", "gy"], [F.col("id")], 200).collect()])
    cell = (p // 12.5).astype(int) @ [8, 1]
    full, got = np.bincount(cell, minlength=64), np.bincount(cell[took], minlength=64)
    depth = max(d for d in range(1, 500) if np.minimum(full, d).sum() <= 200)
    assert len(took) == 200 and (got >= np.minimum(full, depth)).all() and (got <= np.minimum(full, depth + 1)).all()


def test_correlations(spark):
    """The kernel's correlation of gradients under a shift, and the aggregate over the same pixels."""
    a = texture(120, 180)
    b = np.clip(np.roll(a, -20, 1).astype(int) + np.random.default_rng(1).integers(-30, 30, a.shape), 0, 255).astype(np.uint8)
    h = np.array([[1, 0, -20.0], [0, 1, 0], [0, 0, 1]])
    ncc, overlap = raster.correlation(a, b, h)
    moved, mask = raster.warp(a, h, 0, 0, 120, 180)
    ga, gb, on = raster.gradient(np.rint(moved)), raster.gradient(b), raster.eroded(mask, 7)
    y, x = np.nonzero(on)
    rows = spark.createDataFrame([(float(ga[i, j]), float(gb[i, j])) for i, j in zip(y, x, strict=True)], "x double, y double")
    assert abs(rows.agg(evaluate.guarded_correlation(F.col("x"), F.col("y"), 2000).alias("r")).first().r - ncc) < 1e-6 and ncc > 0.3
    size = spark.range(1).select(evaluate.overlap_fraction(F.lit(int(mask.sum())), F.lit(180), F.lit(120)).alias("o")).first()
    assert abs(overlap - size.o) < 1e-9


def test_crops(spark):
    """The box of pixels that aren't black: from tiles, and from pixels as rows."""
    px = np.zeros((50, 70, 3), np.uint8)
    px[7:31, 12:55] = 9
    tiles = []
    for y in range(0, 50, 20):
        for x in range(0, 70, 30):
            t = px[y : y + 20, x : x + 30]
            ys, xs = np.nonzero(raster.grey(t) > 0)
            tiles.append(("s", y, x, *t.shape[:2], t.tobytes(), 0, *((int(ys.min()) + y, int(ys.max()) + 1 + y, int(xs.min()) + x, int(xs.max()) + 1 + x) if len(ys) else (None,) * 4), None))
    mosaic = spark.createDataFrame(tiles, "store string, y0 int, x0 int, h int, w int, bgr binary, covered long, cy0 int, cy1 int, cx0 int, cx1 int, error string")
    box = C.crop_boxes(mosaic).first()
    rows = spark.createDataFrame([("s", int(x), int(y), float(v)) for (y, x), v in np.ndenumerate(raster.grey(px))], "store string, x int, y int, g double")
    r = evaluate.content_box(rows, ["store"], F.col("x"), F.col("y"), F.col("g"), F.lit(70), F.lit(50)).first()
    assert (box.cy0, box.cy1, box.cx0, box.cx1) == (r.y0, r.y1, r.x0, r.x1) == (7, 31, 12, 55)


@pytest.mark.parametrize("few", [0, 500_000])
def test_quantiles_of_any_size(spark, few):
    rng = np.random.default_rng(4)
    groups = {"flat": np.full(50, 3.25), "wide": rng.normal(0, 1, 4000) ** 5 * 1e6, "ties": rng.integers(0, 4, 500).astype(float), "one": np.array([-7.5]), "two": np.array([1.0, 2.0])}
    rows = spark.createDataFrame([(g, float(v)) for g, x in groups.items() for v in x] + [("wide", None), ("none", None)], "g string, v double").repartition(3)
    shares = [0.0, 0.1, 0.5, 0.95, 1.0]
    got = {(r.g, r.share): r.quantile for r in evaluate.quantiles(rows, ["g"], "v", shares, bins=16, few=few).collect()}
    assert got.keys() == {(g, q) for g in groups for q in shares}
    assert all(abs(v - np.quantile(groups[g], q)) < 1e-9 * max(1, abs(v)) for (g, q), v in got.items())
    every = np.concatenate(list(groups.values()))
    if few:
        assert abs(evaluate.quantiles(rows, [], "v", [0.5]).first().quantile - np.quantile(every, 0.5)) < 1e-9
        held = graph.kept(rows)[0]
        a, b = ({r.g: tuple(None if v is None else round(v, 6) for v in r[1:]) for r in f.collect()} for f in (evaluate.residual_metrics(held, ["g"], "v"), evaluate.residual_metrics_of_any_size(held, ["g"], "v", most=100)))
        assert a == b and a["none"] == (0, None, None, None)


def test_places_without_one_task(spark):
    rng = np.random.default_rng(6)
    rows = spark.createDataFrame([(int(s), float(v), k) for k, (s, v) in enumerate(zip(rng.integers(0, 3, 500), rng.integers(0, 40, 500), strict=True))], "s int, v double, k long").repartition(6)
    want = {r.k: r.p for r in rows.select("k", (F.row_number().over(W.orderBy(F.desc("v"), "k")) - 1).alias("p")).collect()}
    assert {r.k: r.place for r in graph.ranked(rows, [F.desc("v"), "k"]).collect()} == want
    want = {r.k: r.p for r in rows.select("k", (F.row_number().over(W.partitionBy("s").orderBy("v", "k")) - 1).alias("p")).collect()}
    for few in (0, 500_000):
        assert {r.k: r.place for r in graph.ranked_within(rows, "s", ["v", "k"], few=few).collect()} == want


def test_corner_centroids(spark):
    h = np.array([[1.1, 0.02, 30], [-0.01, 0.9, 5], [1e-4, 2e-5, 1]])
    got = spark.range(1).select(P.centroid([F.lit(float(v)) for v in h.ravel()], F.lit(1600.0), F.lit(900.0)).alias("x")).first().x
    assert abs(got - apply(h, raster.frame(900, 1600))[:, 0].mean()) < 1e-9
