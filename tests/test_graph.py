"""Graphs of any size: components, forests, placements, anchors and the joint adjustment, in rounds and in one task, against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from mosaiq.kernels import fit
from mosaiq.kernels.raster import apply
from mosaiq.operators import adjust, forest, graph, reach


def random_graph(seed, n, m):
    rng = np.random.default_rng(seed)
    pairs = {(int(min(a, b)), int(max(a, b))) for a, b in rng.integers(0, n, (m, 2)) if a != b}
    return sorted((a, b, float(rng.integers(1, 9))) for a, b in pairs)


def near(edges):
    out = {}
    for a, b, *_ in edges:
        out.setdefault(a, set()).add(b)
        out.setdefault(b, set()).add(a)
    return out


def hops(graph_, start):
    far, front, d = {start: 0}, [start], 0
    while front:
        d += 1
        front = [b for a in front for b in graph_[a] if b not in far and not far.update({b: d})]
    return far


def best_forest(edges):
    root, out = {}, set()
    find = lambda x: x if root.setdefault(x, x) == x else find(root[x])
    for a, b, w in sorted(edges, key=lambda e: (-e[2], e[0], e[1])):
        if find(a) != find(b):
            root[find(a)] = find(b)
            out.add((a, b, w))
    return out


GRAPHS = {"sparse": random_graph(1, 40, 40), "dense": random_graph(2, 30, 300), "chain": [(k, k + 1, float(k % 5)) for k in range(9)], "star": [(0, k, 1.0) for k in range(1, 60)] + [(100, 101, 2.0)], "one": [(3, 9, 1.0)]}


@pytest.mark.parametrize("name,few", [("sparse", 0), ("sparse", 500_000), ("chain", 0)])
def test_components(spark, name, few):
    edges = GRAPHS[name]
    g = near(edges)
    nodes = spark.range(110).withColumnRenamed("id", "node")
    got = {r.node: r.component for r in graph.components(nodes, spark.createDataFrame([e[:2] for e in edges], "a long, b long").repartition(3), few).collect()}
    assert got == {k: min(hops(g, k)) if k in g else k for k in range(110)}


@pytest.mark.parametrize("name,few", [("sparse", 0), ("dense", 500_000), ("star", 0), ("one", 500_000)])
def test_spanning_forest(spark, name, few):
    edges = GRAPHS[name]
    tree, _ = forest.spanning(spark.createDataFrame(edges, "a long, b long, weight double").repartition(3), few=few, alone=few if name == "one" else 0)
    assert sorted(map(tuple, tree.collect())) == sorted(best_forest(edges))


def test_no_edges(spark):
    none = spark.createDataFrame([], "a long, b long, weight double, h array<double>")
    for few in (0, 10):
        assert forest.spanning(none, few=few, alone=few)[0].collect() == []
    tree, places = forest.spanning(none, few=0, placed=True)
    assert tree.collect() == places.collect() == []
    assert reach.eccentricities(none.select("a", "b")).collect() == []


@pytest.mark.parametrize("name,few", [("sparse", 0), ("chain", 500_000), ("star", 500_000)])
def test_homographies_along_the_forest(spark, name, few):
    edges, rng = GRAPHS[name], np.random.default_rng(4)
    nodes = sorted(near(edges))
    true = {v: np.array([[1 + 0.1 * rng.normal(), 0.05 * rng.normal(), 300 * rng.normal()], [0.05 * rng.normal(), 1 + 0.1 * rng.normal(), 300 * rng.normal()], [1e-5 * rng.normal(), 1e-5 * rng.normal(), 1]]) for v in nodes}
    kept = {e[:2] for e in best_forest(edges)}
    rows = []
    for a, b, w in edges:
        h = np.linalg.inv(true[b]) @ true[a] if (a, b) in kept else np.eye(3)  # edges that close cycles are wrong, so they may not be used
        rows.append((a, b, w, (h / h[2, 2]).ravel().tolist()))
    tree, places = forest.spanning(spark.createDataFrame(rows, "a long, b long, weight double, h array<double>").repartition(3), few=few, placed=True)
    assert {(r.a, r.b) for r in tree.collect()} == kept
    g = near(kept)
    anchor = {min(hops(g, v)): max(hops(g, v)) for v in nodes}
    got = forest.framed(places, spark.createDataFrame([(a,) for a in anchor.values()], "anchor long"), few).collect()
    assert sorted(r.node for r in got) == nodes
    for r in got:
        want = np.linalg.inv(true[r.anchor]) @ true[r.node]
        corners = np.array([[0, 0], [1600, 0], [1600, 900], [0, 900.0]])
        assert r.anchor == anchor[min(hops(g, r.node))] and np.abs(apply(np.array(r.h).reshape(3, 3), corners) - apply(want, corners)).max() < 1e-4
        assert r.node != r.anchor or r.h == forest.ONE


@pytest.mark.parametrize("name,few", [("sparse", 500_000), ("dense", 0), ("chain", 500_000), ("star", 500_000)])
def test_eccentricities_and_anchors(spark, name, few):
    edges = GRAPHS[name]
    g = near(edges)
    both = spark.createDataFrame([(a, b, w) for a, b, w in edges] + [(b, a, w) for a, b, w in edges], "a long, b long, strength double")
    if name in ("dense", "star"):
        want = {(v, max(hops(g, v).values()), len(g[v]), len(hops(g, v))) for v in g}
        assert {tuple(r) for r in reach.eccentricities(both, few).collect()} == want
    power = {v: sum(w for a, b, w in edges if v in (a, b)) for v in g}
    best = {}
    for v in g:
        c = min(hops(g, v))
        best[c] = max(best.get(c, ((-99,), 0)), ((-max(hops(g, v).values()), len(g[v]), power[v], -v), v))
    nodes = spark.createDataFrame([(v, min(hops(g, v))) for v in g] + [(500, 500)], "node long, component long")
    got = {r.component: (r.anchor, r.ecc) for r in reach.anchors(nodes, both, few).collect()}
    assert got == {c: (v, -r[0]) for c, (r, v) in best.items()} | {500: (500, 0)}


def scene(rows, cols, seed=0, points=40):
    """Views of a plane on a grid: true homographies into view 0, pairs of neighbours with exact correspondences, perturbed places."""
    rng = np.random.default_rng(seed)
    n = rows * cols
    true = {k: np.array([[1 + 0.02 * rng.normal(), 0.02 * rng.normal(), 1000.0 * (k % cols)], [0.02 * rng.normal(), 1 + 0.02 * rng.normal(), 600.0 * (k // cols)], [5e-6 * rng.normal(), 5e-6 * rng.normal(), 1]]) for k in range(n)}
    true[0] = np.eye(3)
    pairs = []
    for k in range(n):
        for j in ([k + 1] if k % cols < cols - 1 else []) + ([k + cols] if k + cols < n else []):
            p = rng.uniform([0, 0], [1600, 900], (4000, 2))
            q = apply(np.linalg.inv(true[j]) @ true[k], p)
            ok = np.flatnonzero((q > 0).all(1) & (q < [1600, 900]).all(1))[:points]
            pairs.append((k, j, p[ok], q[ok], 0.8))
    start = {k: true[k] + (0 if k == 0 else 1) * np.append(rng.normal(0, [0.01, 0.01, 12, 0.01, 0.01, 12, 1e-7, 1e-7]), 0).reshape(3, 3) for k in true}
    return true, pairs, start


def worst(got, true):
    corners = np.array([[0, 0], [1600, 0], [1600, 900], [0, 900.0]])
    return max(np.abs(apply(got[k], corners) - apply(true[k], corners)).max() for k in true)


def test_joint_adjustment_over_rows(spark):
    true, pairs, start = scene(2, 2, points=20)
    places = spark.createDataFrame([("s", k, (h / h[2, 2]).ravel().tolist(), k == 0) for k, h in start.items()], "store string, node long, h array<double>, fixed boolean")
    rows = spark.createDataFrame([("s", i, j, np.column_stack([a, b]).tobytes(), ncc) for i, j, a, b, ncc in pairs] + [("s", 0, 1, b"", 0.9)], "store string, i long, j long, pts binary, ncc double").repartition(2)
    out, stats = adjust.adjusted(places, rows, rounds=4, tolerance=5e-2)
    got = {r.node: np.array(r.h).reshape(3, 3) for r in out.collect()}
    s = stats.first()
    assert worst(got, true) < 0.5 and (got[0] == np.eye(3)).all() and s.accepted and s.rms_after < 0.1 < s.rms_before
    local, _ = fit.adjusted(start, pairs, 0, store="s")
    assert worst(local, true) < 0.5


@pytest.mark.parametrize("few", [0, 500_000])
def test_a_step_solves_the_whole_system(spark, few):
    """Blocks of three images beside a dense solution."""
    rng = np.random.default_rng(6)
    m = rng.normal(size=(30, 24))
    full, g, damp = m.T @ m + 3 * np.eye(24), rng.normal(size=24), 0.1
    diag = [(k, full[8 * k : 8 * k + 8, 8 * k : 8 * k + 8].ravel().tolist(), g[8 * k : 8 * k + 8].tolist()) for k in range(3)]
    off = [(i, j, full[8 * i : 8 * i + 8, 8 * j : 8 * j + 8].ravel().tolist()) for i in range(3) for j in range(3) if i != j]
    d, o = graph.kept(spark.createDataFrame(diag, "node long, a array<double>, g array<double>"))[0], graph.kept(spark.createDataFrame(off, "to long, from long, m array<double>"))[0]
    x, n = adjust.solved(d, o, damp, tolerance=1e-2 if few else 1e-1, few=few)
    got = np.concatenate([r.x for r in x.orderBy("node").collect()])
    want = np.linalg.solve(full + damp * np.diag(np.diag(full)), -g)
    assert 0 < n <= 24 and np.linalg.norm(got - want) < (0.05 if few else 0.5) * np.linalg.norm(want)


def test_adjustment_without_pairs_or_gain(spark):
    true, pairs, _ = scene(1, 3)
    places = spark.createDataFrame([("s", k, h.ravel().tolist(), k == 0) for k, h in true.items()], "store string, node long, h array<double>, fixed boolean")
    none = spark.createDataFrame([], "store string, i long, j long, pts binary, ncc double")
    out, stats = adjust.adjusted(places, none)
    assert {r.node: r.h for r in out.collect()} == {k: h.ravel().tolist() for k, h in true.items()} and stats.collect() == []
    rows = spark.createDataFrame([("s", i, j, np.column_stack([a, b]).tobytes(), ncc) for i, j, a, b, ncc in pairs], none.schema)
    out, _ = adjust.adjusted(places, rows, rounds=1)
    assert worst({r.node: np.array(r.h).reshape(3, 3) for r in out.collect()}, true) < 1e-3


def test_pair_systems_agree_with_differences():
    true, pairs, start = scene(1, 2, seed=3)
    i, j, a, b, _ = pairs[0]
    h = [start[i], start[j]]
    found = fit.pair_system(*h, a, b, 0.7, 3.0)
    scale = np.array([1e-5, 1e-5, 1e-2, 1e-5, 1e-5, 1e-2, 1e-8, 1e-8] * 2)
    for k in range(16):
        cost = []
        for sign in (1, -1):
            moved = [x.copy() for x in h]
            moved[k // 8].ravel()[k % 8] += sign * scale[k]
            cost.append(fit.pair_system(*moved, a, b, 0.7, 3.0)[2])
        assert abs((cost[0] - cost[1]) / (4 * scale[k]) / found[1][k] - 1) < 1e-3
    assert fit.pair_system(np.zeros((3, 3)), h[1], a, b, 1.0, 3.0) is None


def test_lookups_of_hot_keys(spark):
    rows = spark.range(5000).selectExpr("if(id < 2500, 7, id) AS k", "id AS v", "'x' AS other")
    table, _ = graph.kept(spark.range(0, 5000, 2).selectExpr("id AS k", "id * 10 AS t").unionByName(spark.createDataFrame([(7, 70)], "k long, t long")))
    for few in (0, 10_000):
        got = graph.looked_up(rows, ["k"], table, few)
        assert got.columns == ["k", "v", "other", "t"] and got.count() == 5000
        assert got.where("k = 7 and t = 70").count() == 2500 and got.where("t = k * 10").count() == 2500 + 1250 and got.where(F.col("t").isNull()).count() == 1250


def test_forest_rounds_thin_edges_where_they_lie(spark, monkeypatch):
    """Between rounds edges aren't shuffled: each task drops those that a heavier cycle of its own closes among components."""
    plans, real = [], forest.kept

    def watched(df):
        out = real(df)
        if "ca" in df.columns:
            plans.append((df._jdf.queryExecution().executedPlan().toString(), out[0].count(), out[0].select("ca").union(out[0].select("cb")).distinct().count()))
        return out

    monkeypatch.setattr(forest, "kept", watched)
    edges = [(a, b, float((a * 31 + b * 17) % 101)) for a in range(50) for b in range(a + 1, 50)]
    tree, _ = forest.spanning(spark.createDataFrame(edges, "a long, b long, weight double").repartition(3), alone=0)
    a, b, w = (np.array(x) for x in zip(*edges, strict=True))
    assert {(r.a, r.b) for r in tree.collect()} == {edges[k][:2] for k in forest.kruskal(a, b, w)} and plans
    assert all("hashpartitioning" not in plan and n <= 4 * max(nodes - 1, 0) for plan, n, nodes in plans)
