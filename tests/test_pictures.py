"""The sink of whole mosaics: strips of tiles as TIFF files, read back by the JVM; failures leave nothing."""

import numpy as np
import pytest

from mosaiq.sources import pictures
from mosaiq.sources.pictures import Mosaics, head, write_mosaics

TILES = "store string, y0 int, x0 int, h int, w int, bgr binary, cy0 int, cy1 int, cx0 int, cx1 int, error string"


def tiles(store, px, tile, skip=(), error=None):
    rows = []
    for y in range(0, px.shape[0], tile):
        for x in range(0, px.shape[1], tile):
            t = px[y : y + tile, x : x + tile]
            ys, xs = np.nonzero(t.any(2))
            box = (int(ys.min()) + y, int(ys.max()) + 1 + y, int(xs.min()) + x, int(xs.max()) + 1 + x) if len(ys) else (None,) * 4
            if (y // tile, x // tile) not in skip:
                rows.append((store, y, x, *t.shape[:2], np.ascontiguousarray(t).tobytes(), *box, error))
    return rows


def read(spark, path):
    """BGR pixels by the JVM's own reader."""
    image = spark._jvm.javax.imageio.ImageIO.read(spark._jvm.java.io.File(path))
    w, h = image.getWidth(), image.getHeight()
    flat = np.array(list(image.getRaster().getPixels(0, 0, w, h, spark.sparkContext._gateway.new_array(spark._jvm.int, w * h * 3))), np.uint8)
    return flat.reshape(h, w, 3)[..., ::-1]


def scene(h, w, seed):
    return np.random.default_rng(seed).integers(1, 256, (h, w, 3)).astype(np.uint8)


def test_pictures_of_many_stores(spark, tmp_path):
    a, b = scene(150, 90, 1), scene(40, 70, 2)
    a[:10] = a[:, :6] = a[140:] = 0
    hole = {(2, 1)}  # no image covers this tile
    c = scene(100, 30, 3)
    rows = tiles("a", a, 32, hole) + tiles("b", b, 32) + tiles("c", c, 25, {(1, 0), (1, 1)}) + tiles("bad", b, 32, error="ValueError: x") + tiles("black", np.zeros((20, 10, 3), np.uint8), 32)
    mosaic = spark.createDataFrame(rows, TILES).repartition(5)
    write_mosaics(spark, mosaic, str(tmp_path / "out"))
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == [f"{s}_stitched.tif" for s in ("a", "b", "black", "c")]
    a[64:96, 32:64] = 0
    assert np.array_equal(read(spark, f"{tmp_path}/out/a_stitched.tif"), a[10:140, 6:]) and np.array_equal(read(spark, f"{tmp_path}/out/b_stitched.tif"), b)
    c[25:50] = 0
    assert np.array_equal(read(spark, f"{tmp_path}/out/c_stitched.tif"), c) and read(spark, f"{tmp_path}/out/black_stitched.tif").shape == (20, 10, 3)
    write_mosaics(spark, mosaic.where("store = 'a'"), str(tmp_path / "whole"), crop=False)
    assert np.array_equal(read(spark, f"{tmp_path}/whole/a_stitched.tif"), a)


def test_a_failed_task_leaves_no_file(spark, tmp_path):
    rows = [r if k != 3 else (*r[:5], b"short", *r[6:]) for k, r in enumerate(tiles("a", scene(90, 90, 4), 32))]
    with pytest.raises(Exception):  # noqa: B017
        write_mosaics(spark, spark.createDataFrame(rows + tiles("b", scene(40, 40, 5), 32), TILES), str(tmp_path))
    assert list(tmp_path.iterdir()) == []


def test_heads_of_large_pictures():
    """Past 4 GB offsets have 64 bits; strips follow one another up to the end."""
    for w, h in ((30_000, 60_000), (500, 700), (9, 1)):
        data = head(w, h)
        big = data[2] == 43
        assert big == (3 * w * h > pictures.LARGE)
        word, kind = (8, "<u8") if big else (4, "<u4")
        at, entry = (24, 20) if big else (10, 12)
        tags = {}
        for k in range(10):
            e = data[at + k * entry : at + (k + 1) * entry]
            tag, typ = np.frombuffer(e[:4], "<u2")
            n = int(np.frombuffer(e[4 : 4 + word], kind)[0])
            size = {3: 2, 4: 4, 16: 8}[int(typ)]
            raw = e[4 + word :] if n * size <= word else data[(o := int(np.frombuffer(e[4 + word :], kind)[0])) : o + n * size]
            tags[int(tag)] = np.frombuffer(raw[: n * size], f"<u{size}").astype(np.int64)
        assert (tags[256][0], tags[257][0]) == (w, h) and tags[258].tolist() == [8, 8, 8] and tags[273][0] == len(data)
        assert (tags[273][1:] == tags[273][:-1] + tags[279][:-1]).all() and tags[279].sum() == 3 * w * h
    assert Mosaics.name() == "mosaic"
