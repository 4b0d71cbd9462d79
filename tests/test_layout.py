"""Layout scores, rescues, failures, turned photographs and kernels, against brute force."""

import json
import zipfile
from io import BytesIO

import numpy as np
import pytest
from pyspark.errors import PythonException

from mosaiq.kernels import raster
from mosaiq.operators import compose as C, graph as G, pairing as P
from mosaiq.operators.matching import mutual_matches
from mosaiq.plans import mosaic as M
from mosaiq.sources import images as S

WORK = "store string, idx int, name string, h int, w int, bgr binary"
PAIRS = "store string, i int, j int, h array<double>, n_matches int, n_inliers int, inlier_ratio double, overlap double, ncc double, score double, ok boolean, reason string, pts binary"


def texture(h=160, w=240, seed=4):
    rng = np.random.default_rng(seed)
    return np.rint(raster.blur(rng.integers(0, 256, (h, w, 3)).astype(np.uint8), 1.5)).astype(np.uint8)


def shift(dx):
    return [1.0, 0.0, float(dx), 0.0, 1.0, 0.0, 0.0, 0.0, 1.0]


def pair(i, j, n, ok=True, ncc=0.9, dx=0.0, store="s"):
    p = np.random.default_rng(i * 7 + j).uniform(20, 120, (n, 2))
    return (store, i, j, shift(dx), 50, n, 0.9, 0.8, ncc, 9.0, ok, "", np.concatenate([p, p + [dx, 0]], 1).tobytes())


@pytest.fixture
def two(spark):
    """Two pieces of one texture, 40 columns apart."""
    img = texture()
    a, b = (np.ascontiguousarray(x) for x in (img[:, :200], img[:, 40:240]))
    return spark.createDataFrame([("s", k, f"n{k}", *x.shape[:2], x.tobytes()) for k, x in enumerate((a, b))], WORK), a, b


def test_scores_are_those_of_the_layout(spark, two):
    work, a, b = two
    pairs = spark.createDataFrame([pair(0, 1, 30, dx=-40)], PAIRS)
    seen = []
    for drift in (0, 6):
        layout = spark.createDataFrame([("s", 0, shift(0)), ("s", 1, shift(40 + drift))], "store string, idx int, h array<double>")
        m, each = P.layout_metrics(work, layout, pairs).first(), P.pair_metrics(layout, pairs, work).first()
        ncc, overlap = raster.correlation(a, b, np.array(shift(-40 - drift)).reshape(3, 3))
        assert abs(m.mean_overlap_ncc - ncc) < 1e-9 and abs(m.mean_overlap_frac - overlap) < 1e-9 and m.min_overlap_ncc == each.overlap_ncc
        assert abs(m.reproj_rms_px - drift) < 1e-9 and each.n_points == 30
        seen.append(ncc)
    assert seen[0] > 0.95 > seen[1] + 0.2
    few = spark.createDataFrame([pair(0, 1, 3)], PAIRS)
    assert P.layout_metrics(work, layout, few).first().n_pairs_scored == 0


def test_rescues_go_on_from_component_to_component(spark):
    work = spark.createDataFrame([("s", k, f"n{k}", 4, 4, bytes(48)) for k in range(5)], WORK)
    # 0-1 and 3-4 are joined; bridges by promise: 2-3, 1-2, 0-2, 0-3, 1-4
    rows = [pair(0, 1, 20), pair(3, 4, 20), pair(2, 3, 20, False, 0.2), pair(1, 2, 20, False, 0.15), pair(0, 2, 20, False, 0.1), pair(0, 3, 20, False, 0.05), pair(1, 4, 20, False, 0.01)]
    pairs = spark.createDataFrame(rows, PAIRS)
    asked = []

    def rescue(some, _):
        from pyspark.sql import functions as F

        asked.extend((r.i, r.j) for r in some.collect())
        return some.withColumn("ok", F.expr("(i, j) in ((1, 2), (0, 3))")).withColumn("reason", F.lit("loftr"))

    got, saved = M.rescued(pairs, P.layouts(work, pairs, adjust=False), work, rescue)
    # 2-3 fails, 1-2 joins 2 to 0 and 1, so 0-2 isn't paid for; 0-3 joins all, so 1-4 isn't
    assert asked == [(2, 3), (1, 2), (0, 3)]
    assert {(r.i, r.j) for r in saved.collect()} == {(1, 2), (0, 3)}
    assert {(r.i, r.j): r.reason for r in got.where("ok").collect()} == {(0, 1): "", (3, 4): "", (1, 2): "loftr", (0, 3): "loftr"} and got.count() == len(rows)


def test_a_store_that_fails_is_a_row(spark, tmp_path, monkeypatch):
    for k in (1, 2):
        S.write_image(spark, f"{tmp_path}/in/store_{k}/images/a.png", texture(seed=k))
    real = M._saved

    def sometimes(spark, images, *args):
        stores = {r.store for r in images.select("store").distinct().collect()}
        if "store_2" in stores:
            raise PythonException("a kernel broke")
        return [{"store": s, "n_images": 1, "n_images_used": 1} for s in sorted(stores)]

    monkeypatch.setattr(M, "_saved", sometimes)
    done = M.run_many(spark, f"{tmp_path}/in", f"{tmp_path}/out")
    assert real is not sometimes and [(d["store"], d["n_images_used"], "error" in d) for d in done] == [("store_1", 1, False), ("store_2", 0, True)]


def test_turned_photographs(spark):
    a = np.arange(24).reshape(2, 4, 3)
    want = {1: a, 2: a[:, ::-1], 3: a[::-1, ::-1], 4: a[::-1], 5: a.transpose(1, 0, 2), 6: np.rot90(a, -1), 7: np.rot90(a, 2).transpose(1, 0, 2), 8: np.rot90(a)}
    for turn, w in want.items():
        assert np.array_equal(S.upright(a, turn), w), turn
        for order, mark in (("little", b"II*\0"), ("big", b"MM\0*")):
            n = lambda v, k: v.to_bytes(k, order)  # noqa: E731, B023
            tiff = mark + n(8, 4) + n(2, 2) + n(0x010F, 2) + n(2, 2) + n(4, 4) + b"abc\0" + n(0x0112, 2) + n(3, 2) + n(1, 4) + n(turn, 2) + b"\0\0" + n(0, 4)
            block = b"Exif\0\0" + tiff
            head = b"\xff\xd8" + b"\xff\xe0\0\x06JFIF"[:2] + b"\0\x06JFIF" + b"\xff\xe1" + (len(block) + 2).to_bytes(2, "big") + block + b"\xff\xda"
            assert S.orientation(head) == turn
    assert [S.orientation(x) for x in (None, b"", b"\x89PNG", b"\xff\xd8", b"\xff\xd8\xff\xe1\xff\xff")] == [1] * 5


def test_a_turned_file_is_read_upright(spark, tmp_path):
    img = texture(40, 60)
    plain = S.encode(spark, img, "jpg", 97)
    tiff = b"II*\0" + (8).to_bytes(4, "little") + b"\x01\0" + b"\x12\x01\x03\0\x01\0\0\0\x06\0\0\0" + bytes(4)
    block = b"Exif\0\0" + tiff
    (tmp_path / "t.jpg").write_bytes(plain[:2] + b"\xff\xe1" + (len(block) + 2).to_bytes(2, "big") + block + plain[2:])
    (tmp_path / "u.jpg").write_bytes(plain)
    t, u = S.read_images(spark, str(tmp_path)).orderBy("name").collect()
    assert (t.full_h, t.full_w, u.full_h, u.full_w) == (60, 40, 40, 60)
    assert np.array_equal(P.pixels(t.bgr, 60, 40), np.rot90(P.pixels(u.bgr, 40, 60), -1))


def test_holes_count_and_specks_do_not(spark):
    def share(holes):
        px = np.full((80, 100, 3), 200, np.uint8)
        for y, x, k in holes:
            px[y : y + k, x : x + k] = 0
        mosaic = spark.createDataFrame([("s", y, 0, 40, 100, px[y : y + 40].tobytes()) for y in (0, 40)], "store string, y0 int, x0 int, h int, w int, bgr binary")
        small = spark.createDataFrame([("s", 0, 0, 80, 100, np.packbits(np.ones((80, 100), bool)).tobytes())], "store string, x0 int, y0 int, h int, w int, mask binary")
        return C.completeness(mosaic, small, 1.0).first()

    assert share([]).missing_pct == 0 and share([(20, 20, 4), (60, 50, 3)]).missing_pct == 0
    r = share([(36, 30, 10), (10, 10, 2)])  # over the edge of two tiles
    assert r.union_px - r.filled_px == 100 and not r.complete


def test_previews_bundles_and_names(spark):
    img = texture(120, 300)
    assert S.preview(img, 100).shape == (40, 100, 3) and S.preview(img, 400) is img
    with zipfile.ZipFile(BytesIO(M.bundled(spark, img, {"store": "s"}, img))) as z:
        assert sorted(z.namelist()) == ["panorama.jpg", "report.json", "seam_map.jpg"] and json.loads(z.read("report.json")) == {"store": "s"}
    df = spark.createDataFrame([("abcdefgh_1",), ("abcdefgX",), ("abc",)], "name string")
    assert [r.name for r in S.by_short_name(df, "abcdefgh").collect()] == ["abcdefgh_1"] and S.by_short_name(df, "abc").count() == 1
    assert M.outputs("o/x.PNG") == {"picture": "o/x.PNG", "report": "o/x_report.json", "seams": "o/x_seams.jpg"}
    assert M.outputs("o/")["picture"] == "o/stitched.jpg" and M.outputs("o", "store_3")["report"] == "o/store_3_report.json"


def test_one_photograph_has_a_whole_report(spark, tmp_path):
    S.write_image(spark, f"{tmp_path}/s/images/a.png", texture())
    image, rep = M.stitch_store(spark, f"{tmp_path}/s/images")
    assert np.array_equal(image, texture()) and rep["n_images_used"] == 1 and rep["output_shape"] == [160, 240, 3]
    assert {"pairs", "components", "dropped_images", "anchor", "order", "metrics", "deep_rescued_pairs", "n_pairs_verified", "seconds"} <= set(rep)


def test_blocks_of_a_group_match_as_the_whole(spark):
    rng = np.random.default_rng(8)
    x = {g: rng.normal(size=(n, 6)) for g, n in ((1, 70), (2, 45), (5, 1), (6, 30))}
    x[2][:20] = x[1][:20] + rng.normal(size=(20, 6)) * 0.01
    x[6][:5], x[6][5:9] = x[1][3], x[1][30:34]  # ties, and copies
    rows = [(g, g * 1000 + k, [float(v) for v in r]) for g, v in x.items() for k, r in enumerate(v)]
    df = spark.createDataFrame(rows, "grp long, id long, desc array<double>").repartition(3)
    want = set()
    for a in x:
        for b in x:
            if a < b and len(x[a]) > 1 and len(x[b]) > 1:
                d = np.sqrt(((x[a][:, None] - x[b][None]) ** 2).sum(2))
                best = lambda m: (m.argmin(1), np.sort(m, 1)[:, 0] < 0.8 * np.sort(m, 1)[:, 1])
                (ab, ok), (ba, ko) = best(d), best(d.T)
                want |= {(a, b, a * 1000 + i, b * 1000 + int(j)) for i, j in enumerate(ab) if ok[i] and ba[j] == i and ko[j]}
    for block in (8, 4096):
        got = mutual_matches(df, 0.8, block).collect()
        assert {tuple(r)[:4] for r in got} == want and len(got) == len(want) > 20
    split = mutual_matches(df.withColumn("store", df.grp % 2), 0.8).collect()
    assert {tuple(r)[:4] for r in split} == {w for w in want if w[0] % 2 == w[1] % 2}


def test_graph_components(spark):
    rng = np.random.default_rng(1)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 60, (35, 2)) if a != b] + [(k, k + 1) for k in range(100, 130)]
    root = {k: k for k in [*range(60), *range(100, 131)]}
    for _ in root:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    nodes = spark.createDataFrame([(k,) for k in root], "node long")
    both = spark.createDataFrame(edges + [(b, a) for a, b in edges], "a long, b long")
    assert {r.node: r.component for r in G.components(nodes, both).collect()} == root


def test_kernels_pixel_by_pixel():
    img, other = texture(40, 56, 1), texture(40, 56, 2)
    g = np.rint(raster.grey(img)).astype(np.uint8)
    got = raster.equalised(g)
    ys, xs = np.linspace(0, 40, 9).astype(int), np.linspace(0, 56, 9).astype(int)

    def table(i, j):
        part = g[ys[i] : ys[i + 1], xs[j] : xs[j + 1]]
        counts, most = [int((part == v).sum()) for v in range(256)], max(1.0, 2.0 * part.size / 256)
        over = sum(max(c - most, 0) for c in counts)
        return np.cumsum([min(c, most) + over / 256 for c in counts]) * 255 / part.size

    for y, x in ((0, 0), (20, 30), (39, 55), (7, 50), (33, 3)):
        fy, fx = (min(max((v + 0.5) * 8 / n - 0.5, 0), 7) for v, n in ((y, 40), (x, 56)))
        i, j = min(int(fy), 6), min(int(fx), 6)
        mix = sum(table(i + a, j + b)[g[y, x]] * (fy - i if a else 1 - fy + i) * (fx - j if b else 1 - fx + j) for a in (0, 1) for b in (0, 1))
        assert abs(got[y, x] - mix) < 0.01
    a, b = raster.gradient(img, 0), raster.gradient(other, 0)
    d = np.abs(a - b)
    assert np.array_equal(raster.disagreement(img, other), np.array([[min(int(v / d.max() * 765), 255) for v in row] for row in d]))
    m = np.zeros((30, 30), bool)
    m[4:9, 4:9] = m[20:24, 20:29] = True
    assert C.opened(m, 5).sum() == 25
