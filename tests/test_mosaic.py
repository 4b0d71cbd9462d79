"""Photographs made here: cut pieces of one scene must find their way back."""

import json

import numpy as np
import pytest

from mosaiq.cli import config, main, parser
from mosaiq.kernels import blend as B, fit, raster
from mosaiq.kernels.detect import KINDS, detect
from mosaiq.operators import compose as C, pairing as P
from mosaiq.plans import mosaic as M
from mosaiq.sources import images as S


def scene(h=460, w=1080, bars=520, seed=21):
    """A slanted ramp with turned bars of all sizes on it."""
    rng = np.random.default_rng(seed)
    y, x = np.mgrid[:h, :w].astype(float)
    img = np.repeat((70 + 60 * x / w + 40 * y / h)[..., None], 3, 2)
    for _ in range(bars):
        u, v = x - rng.uniform(0, w), y - rng.uniform(0, h)
        c, s = np.cos(t := rng.uniform(0, np.pi)), np.sin(t)
        img[(np.abs(u * c + v * s) < rng.uniform(4, 24)) & (np.abs(v * c - u * s) < rng.uniform(2, 12))] = rng.uniform(10, 250, 3)
    return np.rint(np.clip(raster.blur(img, 0.7), 0, 255)).astype(np.uint8)


#: Pieces of the scene (columns), by names whose order is not that of their places.
PIECES = {"k2": (0, 500), "k9": (310, 800), "k1": (590, 1080)}


@pytest.fixture(scope="module")
def root(spark, tmp_path_factory):
    top, img = tmp_path_factory.mktemp("stores"), scene()
    for name, (a, b) in PIECES.items():
        S.write_image(spark, f"{top}/store_1/images/{name}.png", img[:, a:b])
    S.write_image(spark, f"{top}/store_2/images/x.PNG".replace("PNG", "png"), img[:, :480])
    S.write_image(spark, f"{top}/store_2/images/y.jpg", scene(seed=9)[:, :480])
    (top / "store_2/images/z.jpg").write_bytes(b"no picture")
    return str(top)


def test_pieces_come_together(spark, root):
    image, rep = M.stitch_store(spark, f"{root}/store_1/images")
    assert rep["order"] == list(PIECES) and rep["n_images_used"] == len(PIECES) and not rep["dropped_images"]
    assert 0 < rep["metrics"]["reproj_rms_px"] < 2 and {p["pair"] for p in rep["per_pair"]} <= {f"{i}->{j}" for i in PIECES for j in PIECES}
    h, w = scene().shape[:2]
    assert 0.9 < image.shape[1] / w < 1.1 and 0.9 < image.shape[0] / h < 1.2
    # where it lies best, it is the scene
    inner = scene()[12 : h - 12, 12 : w - 12].astype(int)
    off = [np.abs(part.astype(int) - inner).mean() for y in range(6, 20) for x in range(6, 20) if (part := image[y : y + h - 24, x : x + w - 24]).shape == inner.shape]
    assert min(off) < 10
    json.dumps(rep, default=str)


def test_many_stores_and_exit_code(spark, root, tmp_path):
    assert main(["--data-root", root, "--out", str(tmp_path), "--debug-seams", "--quiet"]) == 2
    rep = json.loads((tmp_path / "store_2_report.json").read_text())["report"]
    assert rep["n_images_used"] == 1 and rep["dropped_images"] == ["y"] and rep["metrics"]["reproj_rms_px"] is None
    assert (tmp_path / "store_1_stitched.jpg").stat().st_size > 1000 and (tmp_path / "store_1_seams.jpg").exists()
    assert main(["--data-root", str(tmp_path), "--out", str(tmp_path), "--quiet"]) == 1


def test_ablations_are_whole_and_rendered(spark, root, tmp_path):
    assert len(M.ABLATIONS) == 11 and len(M.RENDERINGS) == 5 and [M.Config(**c) for c in {**M.ABLATIONS, **M.RENDERINGS}.values()]
    plain = "render_no_seam_no_blend"
    rows = M.ablate(spark, root, {plain: M.RENDERINGS[plain]}, out=str(tmp_path)).collect()
    assert {(r.config, r.store, r.error) for r in rows} >= {(plain, "store_1", None)} and all(r.error is None for r in rows)
    assert (tmp_path / f"{plain}_store_1.jpg").stat().st_size > 1000


def test_bad_files(spark, root):
    where = f"{root}/store_2/images"
    assert [r.reason for r in S.read_images(spark, where, on_bad="report").orderBy("idx").collect()] == [None, None, "cannot be decoded"]
    assert S.read_images(spark, where, on_bad="skip").count() == 2
    with pytest.raises(Exception, match="can't decode"):
        S.read_images(spark, where).count()


def test_uploads_and_bundle(spark, tmp_path):
    data = S.encode(spark, scene(120, 200, 20), "jpg")
    saved, bad = S.from_bytes(spark, [("a b.jpg", data), ("c.png", b"x"), ("d.jpg", bytes(2 * 2**20))], str(tmp_path), most_mb=1)
    assert saved == ["000_a_b.jpg"] and [r for _, r in bad] == ["cannot be decoded", "larger than 1 MB"]
    r = S.read_images(spark, str(tmp_path)).first()
    assert (r.full_h, r.full_w) == (120, 200) and S.bundle({"a": data})[:2] == b"PK"


@pytest.mark.parametrize("exposure,seam,blend", [(e, "dp", "feather") for e in B.EXPOSURES] + [("none", s, "none") for s in B.SEAMS] + [("gain", "voronoi", b) for b in B.BLENDS])
def test_rendering_options(exposure, seam, blend):
    img = scene(220, 640, 150).astype(np.float32)
    on = np.ones((220, 400), bool)
    pieces = [(0, 0, img[:, :400], on), (240, 0, img[:, 240:] * np.float32(0.8), on)]
    grids = B.gains(pieces, exposure)
    if exposure != "none":
        assert grids[1].mean() > grids[0].mean()
    masks = B.seams(pieces, seam)
    full = np.zeros((2, 220, 640), bool)
    full[0, :, :400], full[1, :, 240:] = masks
    assert full.any(0).all() and (seam == "none" or not full.all(0).any())
    parts = []
    for k, (x, _, px, _) in enumerate(pieces):
        wide, m = np.zeros((220, 640, 3), np.float32), np.zeros((220, 640), bool)
        wide[:, x : x + 400], m[:, x : x + 400] = px, True
        parts.append((wide, m, full[k].astype(np.float32)))
    out, covered = B.blended(parts, blend, 3)
    assert covered.all() and np.isfinite(out).all() and np.abs(out - img).mean() < 40


def test_graph_cut_costs_no_more_than_a_monotone_path():
    cost = np.random.default_rng(1).uniform(0.1, 9, (40, 30))
    for free in (False, True):
        left = B._left_of(cost, free)
        assert left[:, 0].all() or free
    d = B._distances(cost, np.where(np.arange(40)[:, None] == 0, cost, np.inf))
    import heapq

    best, heap = {}, [(cost[0, c], 0, c) for c in range(30)]
    heapq.heapify(heap)
    while heap:
        v, r, c = heapq.heappop(heap)
        if (r, c) not in best:
            best[r, c] = v
            for y, x in ((r + 1, c), (r - 1, c), (r, c + 1), (r, c - 1)):
                if 0 <= y < 40 and 0 <= x < 30:
                    heapq.heappush(heap, (v + cost[y, x], y, x))
    assert all(abs(d[k] - v) < 1e-9 for k, v in best.items())


def test_adjustment_recovers_and_holds():
    rng = np.random.default_rng(0)
    true = {0: np.eye(3), 1: np.array([[1.02, 0.01, 300], [0.005, 0.99, -12], [1e-5, 2e-6, 1]]), 2: np.array([[0.97, -0.02, 610], [0.01, 1.03, 22], [-1e-5, 5e-6, 1]])}
    pairs = []
    for i, j in ((0, 1), (0, 2), (1, 2)):
        p = rng.uniform([0, 0], [900, 1600], (300, 2))
        pairs.append((i, j, p, raster.apply(np.linalg.inv(true[j]) @ true[i], p), 0.8))
    start = {k: h.copy() for k, h in true.items()}
    for k in (1, 2):
        start[k][:2, 2] += rng.normal(0, 12, 2)
        start[k][:2, :2] += rng.normal(0, 0.01, (2, 2))
    got, s = fit.adjusted(start, pairs, 0)
    assert s["rms_after"] < 0.5 < s["rms_before"] and np.abs(got[0] - np.eye(3)).max() < 1e-12
    assert fit.adjusted(true, pairs, 0)[1]["rms_after"] < 1e-6
    assert fit.adjusted({0: np.eye(3)}, [], 0)[1]["rms_after"] == 0


def test_layout_prefers_the_strong_way_and_its_sign():
    shift = lambda d: np.array([[1, 0, d], [0, 1, 0], [0, 0, 1.0]])
    h, anchor, comps = P.lay_out([0, 1, 2, 3], [(0, 1, shift(300), 20.0), (1, 2, shift(300), 20.0), (0, 2, shift(555), 0.6)])
    assert comps == [[0, 1, 2], [3]] and anchor == 1
    assert np.allclose(raster.apply(h[0], np.zeros((1, 2))), [[300, 0]]) and np.allclose(raster.apply(h[2], np.zeros((1, 2))), [[-300, 0]])


@pytest.mark.parametrize("kind", KINDS)
def test_detectors_find_the_same_places(kind):
    img = scene()
    (xa, _, da), (xb, _, db) = detect(img[:, :600], kind, 3000), detect(img[:, 300:900], kind, 3000)
    m = P.matched(da, db, 0.85)
    off = xa[m[:, 0]] - xb[m[:, 1]]
    assert len(m) > 80 and (np.abs(off - [300, 0]).max(1) < 2).mean() > 0.6
    xy, _, d = detect(np.zeros((60, 60, 3), np.uint8), kind)
    assert len(xy) == len(d) == 0
    with pytest.raises(ValueError, match="detector"):
        detect(img, "surf")


def test_polish_and_modes():
    img = scene()
    a, b = img[:, :600], img[:, 300:900]
    h = np.array([[1, 0, -298.8], [0, 1, 0.9], [0, 0, 1.0]])
    better = fit.polished(a, b, h)
    assert raster.correlation(a, b, better)[0] > raster.correlation(a, b, h)[0]
    assert raster.correlation(a * 0 + 9, b, np.eye(3)) == (0.0, 1.0)
    rng = np.random.default_rng(2)
    p = rng.uniform(0, 500, (300, 2))
    q = np.concatenate([p[:150] + [40, 5], p[150:250] + [-70, 9], rng.uniform(0, 500, (50, 2))])
    assert [len(k) for _, k in fit.modes(p, q, 1)][:2] == [150, 100] or len(fit.modes(p, q, 1)) == 2
    assert fit.modes(p[:3], q[:3], 1, least=2) == [] and len(set(fit.spread(p, 60, rng))) == 60


def test_rasters():
    a = np.arange(48, dtype=float).reshape(6, 8)
    assert np.allclose(raster.resample(a, 3, 4), a.reshape(3, 2, 4, 2).mean((1, 3))) and raster.fitted(100, 50, 1600) == (100, 50, 1.0)
    same, on = raster.warp(a, np.eye(3), 0, 0, 6, 8)
    assert np.allclose(same, a) and on.all()
    m = np.zeros((7, 7), bool)
    m[2:5, 2:5] = True
    assert raster.eroded(m, 3).sum() == 1 and raster.dilated(m, 3).sum() == 25 and len(np.unique(raster.hues(6), axis=0)) == 6
    board = raster.checkerboard(np.ones((4, 4, 3)), np.zeros((4, 4, 3)), np.ones((4, 4), bool), 2)
    assert board[..., 0].tolist() == [[0, 0, 1, 1]] * 2 + [[1, 1, 0, 0]] * 2


def test_settings():
    with pytest.raises(ValueError, match="seam"):
        M.Config(seam="lazy")
    assert config(parser().parse_args(["--images", "x", "--no-bundle", "--ratio", "0.7"])) == M.Config(bundle=False, ratio=0.7)


def test_canvas_cap_and_completeness(spark, root):
    g = M.solve(S.read_images(spark, f"{root}/store_1/images"), M.Config())
    plan = C.canvas(g.work, g.layout, 1.0, 0.1).first()
    assert plan.cw * plan.ch <= 1.05e5 and plan.render_scale < 1
    mosaic, _, cut, small = M.render(g, M.Config(exposure="gain", blend="feather"))
    assert C.completeness(mosaic, small).first().complete and abs(sum(r.share for r in cut.collect()) - 1) < 1e-9
    assert P.keypoints(g.features).count() == sum(r.n for r in g.features.collect())
    assert P.pair_metrics(g.layout, g.pairs).count() == 2 and M.bridges(g.pairs, g.layout).count() == 0
    with pytest.raises(FileNotFoundError):
        M.stitch_store(spark, f"{root}/store_1")
