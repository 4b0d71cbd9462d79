"""Failures as values: a bad photograph, pair, store or tile costs its own row; names, gates of a rescuer and canvas statistics."""

import numpy as np
import pytest
from pyspark.errors import PythonException
from pyspark.sql import functions as F

from mosaiq.operators import compose as C, pairing as P
from mosaiq.plans import mosaic as M
from mosaiq.sources import images as S
from test_layout import PAIRS, WORK, pair, shift, texture


def test_a_bad_photograph_is_a_row(spark):
    img = texture()
    rows = [("s", 0, "good", 160, 240, img.tobytes()), ("s", 1, "bad", 160, 240, img.tobytes()[:100])]
    feats = P.features(spark.createDataFrame(rows, WORK), "rootsift", 200)
    got = {r.idx: (r.n, r.error) for r in feats.collect()}
    assert got[0][0] > 10 and got[0][1] is None and got[1][0] == 0 and got[1][1].startswith("ValueError")
    modes = P.pair_modes(feats)
    r = P.accepted(P.judged(modes, spark.createDataFrame(rows, WORK))).first()
    assert (r.i, r.j, r.ok, r.reason) == (0, 1, False, "only 0 raw matches")
    photo = spark.createDataFrame([("s", 0, "a", 10, 10, b"short")], "store string, idx int, name string, full_h int, full_w int, bgr binary")
    assert S.work_images(photo).first().h == 0 and P.features(S.work_images(photo)).first().error


def test_a_pair_that_fails_is_rejected(spark):
    feats = [("s", k, 50, np.zeros((50, 2)).tobytes(), np.zeros(50).tobytes(), bytes(50 * 4 * 8 - k), None) for k in range(2)]
    modes = P.pair_modes(spark.createDataFrame(feats, "store string, idx int, n int, xy binary, response binary, desc binary, error string"))
    work = spark.createDataFrame([("s", k, f"n{k}", 160, 240, texture().tobytes()) for k in range(2)], WORK)
    r = P.accepted(P.judged(modes, work)).first()
    assert not r.ok and r.reason.startswith("failed: ValueError")


def test_a_store_whose_layout_fails_costs_itself(spark):
    work = spark.createDataFrame([(s, k, f"n{k}", 160, 240, b"") for s in ("bad", "fine") for k in range(2)], WORK)
    bad = list(pair(0, 1, 30, store="bad"))
    bad[-1] = b"not a row of points"
    got = P.layouts(work, spark.createDataFrame([tuple(bad), pair(0, 1, 30, store="fine", dx=-40)], PAIRS)).collect()
    assert {(r.store, r.h is None, r.error is None) for r in got} == {("bad", True, False), ("fine", False, True)}


def test_cuts_and_tiles_that_fail(spark):
    img = np.ascontiguousarray(texture(60, 80))
    full = "store string, idx int, full_h int, full_w int, bgr binary"
    images = spark.createDataFrame([(s, k, 60, 80, img.tobytes()[: 9 if (s, k) == ("bad", 1) else None]) for s in ("bad", "fine") for k in range(2)], full)
    plan = spark.createDataFrame([(s, k, f"n{k}", shift(30 * k), 110, 60, 1.0) for s in ("bad", "fine") for k in range(2)], "store string, idx int, name string, hr array<double>, cw int, ch int, render_scale double")
    small = C.thumbs(images, plan, 0.5)
    assert {(r.store, r.idx) for r in small.where("error IS NOT NULL").collect()} == {("bad", 1)}
    cut = C.cuts(small)
    assert {(r.store, r.error is None) for r in cut.collect()} == {("bad", False), ("fine", True)}
    mosaic = C.tiles(images, plan, cut, seam_scale=0.5)
    assert {(r.store, r.error) for r in mosaic.collect()} == {("fine", None)}
    stats = {r.store: r for r in C.canvas_statistics(mosaic, plan).collect()}
    assert stats["bad"].coverage == 0 and 0.85 < stats["fine"].coverage <= 1 and stats["fine"].canvas_px == 6600
    # one tile's failure: the cut of a photograph whose pixels are gone since
    whole = C.cuts(C.thumbs(images.where("store = 'fine'").unionByName(images.where("store = 'fine'").withColumn("store", F.lit("bad"))), plan, 0.5))
    got = C.tiles(images, plan, whole, seam_scale=0.5)
    assert got.where("store = 'bad' AND error IS NOT NULL").count() == 1 and got.where("store = 'fine' AND error IS NOT NULL").count() == 0


def test_a_batch_runs_once_and_lists_its_failures(spark, tmp_path, monkeypatch):
    for k in (1, 2, 3):
        for name in "ab":
            S.write_image(spark, f"{tmp_path}/in/store_{k}/images/{name}.png", texture(seed=k + ord(name)))
    real, read, runs = M._saved, S.read_images, []

    def broken(*args, **kw):
        px = F.when((F.col("store") == "store_2") & (F.col("name") == "b"), F.substring("bgr", 1, 50)).otherwise(F.col("bgr"))
        return read(*args, **kw).withColumn("bgr", px)

    monkeypatch.setattr(S, "read_images", broken)
    monkeypatch.setattr(M, "_saved", lambda *args: runs.append(1) or real(*args))
    done = {d["store"]: d for d in M.run_many(spark, f"{tmp_path}/in", f"{tmp_path}/out", seams=True)}
    assert len(runs) == 1 and sorted(done) == ["store_1", "store_2", "store_3"] and all(d["error"] is None for d in done.values())
    assert done["store_2"]["image_errors"][0].startswith("b: ValueError") and done["store_1"]["image_errors"] is None
    assert all(d["n_images"] == 2 and d["n_images_used"] == 1 and 0.9 < d["canvas"]["coverage"] <= 1 for d in done.values())
    assert {f.name for f in (tmp_path / "out").glob("*_*") if not f.name.startswith(".")} == {f"store_{k}_{x}" for k in (1, 2, 3) for x in ("stitched.jpg", "report.json", "seams.jpg")}

    monkeypatch.setattr(M, "_saved", lambda spark, images, *args: (_ for _ in ()).throw(PythonException("lost")))
    lost = M.run_many(spark, f"{tmp_path}/in", f"{tmp_path}/out")
    assert [(d["store"], d["n_images_used"], d["error"]) for d in lost] == [(f"store_{k}", 0, "lost") for k in (1, 2, 3)]


@pytest.mark.parametrize("change,reason", [({}, "loftr"), ({"confident": 30}, "loftr: only 30 confident matches"), ({"h": None}, "loftr: no model"), ({"h": [-1.0, 0, 0, 0, 1, 0, 0, 0, 1]}, "loftr: warp mirrors the image"), ({"n_inliers": 20}, "loftr: 20 inliers < 40"), ({"confident": 900}, "loftr: inlier ratio 0.06 low"), ({"overlap": 0.01}, "loftr: overlap 0.010 low"), ({"ncc": 0.1}, "loftr: ncc 0.10 < 0.25")])
def test_a_rescuer_is_judged_by_its_own_gates(spark, change, reason):
    work = spark.createDataFrame([("s", k, f"n{k}", 160, 240, bytes(160 * 240 * 3)) for k in range(2)], WORK)
    pairs = spark.createDataFrame([pair(0, 1, 20, False, 0.1)], PAIRS)

    def rescue(some, _):
        found = {"confident": 90, "h": shift(-40), "n_inliers": 50, "overlap": 0.5, "ncc": 0.6} | change
        h = F.lit(None).cast("array<double>") if found["h"] is None else F.array(*[F.lit(float(v)) for v in found["h"]])
        return some.withColumns({"h": h, **{k: F.lit(found[k]) for k in ("confident", "n_inliers", "overlap", "ncc")}})

    got, saved = M.rescued(pairs, P.layouts(work, pairs, adjust=False), work, rescue)
    r = got.first()
    assert (r.reason, r.ok, saved.count()) == (reason, reason == "loftr", int(reason == "loftr")) and got.count() == 1
    if r.ok:
        assert r.n_matches == 90 and abs(r.inlier_ratio - 50 / 90) < 1e-12 and abs(r.score - 50**0.5 * 0.36) < 1e-9
