"""Photographs as rows, and mosaics as files, on any file system that Spark reads."""

from __future__ import annotations

import io
import json
import re
import zipfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from mosaiq.kernels.raster import fitted, resample

#: Fixed: the kinds of files read, in any case.
GLOB = "*.{[jJ][pP][gG],[jJ][pP][eE][gG],[pP][nN][gG]}"


def list_images(spark: SparkSession, path: str, many: bool = False) -> DataFrame:
    """store, idx, path, name, length: files in path order. many: path holds store_*/images folders.

    Only names are read. Files whose name starts with _ or . are not seen (Spark's rule).
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", GLOB).load(f"{path.rstrip('/')}/store_*/images" if many else path)
    store = F.regexp_extract("path", r"/(store_[^/]*)/images/[^/]*$", 1) if many else F.regexp_extract("path", r"([^/]*)/[^/]*/[^/]*$", 1)
    name = F.regexp_extract("path", r"([^/]*)\.[^./]*$", 1)
    rows = files.select(store.alias("store"), "path", name.alias("name"), "length")
    return rows.withColumn("idx", (F.row_number().over(W.partitionBy("store").orderBy("path")) - 1).cast("int"))


def _plain(path) -> F.Column:
    """Spellings of one path by different readers: file:/x, file:///x."""
    return F.regexp_replace(path, r"^file:/+", "file:/")


def orientation(head: bytes | None) -> int:
    """The EXIF orientation (1 to 8) that a JPEG's first bytes name; 1 if they name none."""
    if not head or head[:2] != b"\xff\xd8":
        return 1
    at = 2
    while at + 4 <= len(head) and head[at] == 0xFF and head[at + 1] not in (0xDA, 0xD9):
        size = int.from_bytes(head[at + 2 : at + 4], "big")
        if head[at + 1] == 0xE1 and head[at + 4 : at + 10] == b"Exif\0\0":
            t = head[at + 10 : at + 2 + size]
            order = "little" if t[:2] == b"II" else "big"
            n = lambda o, k: int.from_bytes(t[o : o + k], order)  # noqa: E731, B023
            first = n(4, 4)
            for e in range(first + 2, first + 2 + 12 * n(first, 2), 12):
                if n(e, 2) == 0x0112 and 1 <= n(e + 8, 2) <= 8:
                    return n(e + 8, 2)
            return 1
        at += 2 + size
    return 1


def upright(a: np.ndarray, turn: int) -> np.ndarray:
    """A picture as its EXIF orientation wants it shown."""
    if turn in (5, 6, 7, 8):
        a = a.swapaxes(0, 1)
    if turn in (2, 3, 6, 7):
        a = a[:, ::-1]
    if turn in (3, 4, 7, 8):
        a = a[::-1]
    return a


def by_short_name(images: DataFrame, short: str, name: str = "name") -> DataFrame:
    """The images whose names begin with the eight (or fewer) letters of a short name, which is how reports name them."""
    return images.where(F.substring(name, 1, 8) == short)


def preview(bgr: np.ndarray, most: int = 1600) -> np.ndarray:
    """A picture for display: an area average whose longest side is at most `most`."""
    h, w, s = fitted(bgr.shape[0], bgr.shape[1], most)
    return bgr if s == 1 else np.clip(np.rint(resample(bgr, h, w)), 0, 255).astype(np.uint8)


def read_images(spark: SparkSession, path: str, many: bool = False, on_bad: str = "fail") -> DataFrame:
    """store, idx, path, name, full_h, full_w, bgr (row-major bytes), reason. Pictures stand as their EXIF orientation says.

    on_bad: a file that can't be decoded ends the job ('fail'), or stays as a row without
    pixels that names the reason ('report'), or goes ('skip'). idx counts the files that stay.
    """
    if on_bad not in ("fail", "report", "skip"):
        raise ValueError(f"on_bad {on_bad!r}")
    names = list_images(spark, path, many)
    where = f"{path.rstrip('/')}/store_*/images" if many else path
    raw = spark.read.format("image").option("pathGlobFilter", GLOB).load(where).select(_plain("image.origin").alias("_at"), "image.height", "image.width", "image.nChannels", "image.data")
    # the beginnings of files: an EXIF block is within the first 64 KB
    heads = spark.read.format("binaryFile").option("pathGlobFilter", GLOB).load(where).select(_plain("path").alias("_at"), F.substring("content", 1, 1 << 17).alias("head"))
    rows = names.withColumn("_at", _plain("path")).join(raw, "_at", "left").join(heads, "_at", "left").drop("_at")

    def three(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in it:
            out = []
            for r in df.itertuples(index=False):
                ok = r.height is not None and r.height > 0
                if not ok and on_bad == "fail":
                    raise OSError(f"can't decode {r.path}")
                if not ok and on_bad == "skip":
                    continue
                px = r.data if ok else None
                if ok and r.nChannels != 3:
                    a = np.frombuffer(r.data, np.uint8).reshape(r.height, r.width, r.nChannels)
                    px = (np.repeat(a, 3, 2) if r.nChannels == 1 else a[..., :3]).tobytes()
                hh, ww = r.height, r.width
                if ok and (turn := orientation(r.head)) > 1:
                    a = np.ascontiguousarray(upright(np.frombuffer(px, np.uint8).reshape(hh, ww, 3), turn))
                    hh, ww, px = a.shape[0], a.shape[1], a.tobytes()
                out.append((r.store, r.idx, r.path, r.name, hh if ok else None, ww if ok else None, px, None if ok else "cannot be decoded"))
            yield pd.DataFrame(out, columns=["store", "idx", "path", "name", "full_h", "full_w", "bgr", "reason"]).astype({"full_h": "Int32", "full_w": "Int32"})

    out = rows.mapInPandas(three, "store string, idx int, path string, name string, full_h int, full_w int, bgr binary, reason string")
    if on_bad == "skip":
        kept = out.select("store", "path")
        again = kept.withColumn("idx", (F.row_number().over(W.partitionBy("store").orderBy("path")) - 1).cast("int"))
        out = out.drop("idx").join(again, ["store", "path"]).select("store", "idx", "path", "name", "full_h", "full_w", "bgr", "reason")
    return out


def from_bytes(spark: SparkSession, files: list[tuple[str, bytes]], folder: str, most_mb: float = 60.0) -> tuple[list[str], list[tuple[str, str]]]:
    """Uploaded files go into `folder` as NNN_stem.jpg (quality 97); (saved names, (name, reason) of rejected ones)."""
    saved, rejected = [], []
    for name, data in files:
        if len(data) > most_mb * 2**20:
            rejected.append((name, f"larger than {most_mb:g} MB"))
            continue
        got = spark._jvm.javax.imageio.ImageIO.read(spark._jvm.java.io.ByteArrayInputStream(data))
        if got is None:
            rejected.append((name, "cannot be decoded"))
            continue
        stem = re.sub(r"[^\w-]", "_", name.rsplit("/", 1)[-1].rsplit(".", 1)[0])
        out = f"{len(saved):03d}_{stem}.jpg"
        flat = spark._jvm.java.awt.image.BufferedImage(got.getWidth(), got.getHeight(), 5)
        flat.createGraphics().drawImage(got, 0, 0, None)
        write_bytes(spark, f"{folder}/{out}", _jpeg(spark, flat, 97))
        saved.append(out)
    return saved, rejected


def work_images(images: DataFrame, most: int = 1600) -> DataFrame:
    """store, idx, name, full_h, full_w, h, w, scale, bgr: area averages whose longest side is at most `most`; no pixels where that fails."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in it:
            out = []
            for r in df.itertuples(index=False):
                try:
                    h, w, s = fitted(r.full_h, r.full_w, most)
                    a = np.frombuffer(r.bgr, np.uint8).reshape(r.full_h, r.full_w, 3)
                    out.append((r.store, r.idx, r.name, r.full_h, r.full_w, h, w, s, (a if s == 1 else resample(a, h, w)).tobytes()))
                except Exception:  # noqa: BLE001 - looking for features in no pixels will say so
                    out.append((r.store, r.idx, r.name, r.full_h, r.full_w, 0, 0, 1.0, b""))
            yield pd.DataFrame(out, columns=["store", "idx", "name", "full_h", "full_w", "h", "w", "scale", "bgr"])

    return images.where("bgr IS NOT NULL").select("store", "idx", "name", "full_h", "full_w", "bgr").mapInPandas(run, "store string, idx int, name string, full_h int, full_w int, h int, w int, scale double, bgr binary")


def _jpeg(spark: SparkSession, image, quality: int) -> bytes:
    jvm = spark._jvm
    writer = jvm.javax.imageio.ImageIO.getImageWritersByFormatName("jpeg").next()
    how = writer.getDefaultWriteParam()
    how.setCompressionMode(jvm.javax.imageio.ImageWriteParam.MODE_EXPLICIT)
    how.setCompressionQuality(float(quality) / 100)
    to = jvm.java.io.ByteArrayOutputStream()
    stream = jvm.javax.imageio.ImageIO.createImageOutputStream(to)
    writer.setOutput(stream)
    writer.write(None, jvm.javax.imageio.IIOImage(image, None, None), how)
    stream.close()
    writer.dispose()
    return bytes(to.toByteArray())


def encode(spark: SparkSession, bgr: np.ndarray, kind: str = "jpg", quality: int = 95) -> bytes:
    """JPEG or PNG bytes of one image, by the driver's JVM."""
    h, w = bgr.shape[:2]
    image = spark._jvm.java.awt.image.BufferedImage(w, h, 5)
    for y in range(0, h, 256):
        part = bgr[y : y + 256]
        image.getRaster().setDataElements(0, y, w, len(part), bytearray(np.ascontiguousarray(part[..., ::-1]).tobytes()))
    if kind in ("jpg", "jpeg"):
        return _jpeg(spark, image, quality)
    to = spark._jvm.java.io.ByteArrayOutputStream()
    spark._jvm.javax.imageio.ImageIO.write(image, kind, to)
    return bytes(to.toByteArray())


def write_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    """One file, folders made as needed, through Spark's file systems."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, True)
    out.write(bytearray(data))
    out.close()


def write_image(spark: SparkSession, path: str, bgr: np.ndarray, quality: int = 95) -> None:
    write_bytes(spark, path, encode(spark, bgr, path.rsplit(".", 1)[-1].lower(), quality))


def write_report(spark: SparkSession, path: str, report: dict | list) -> None:
    write_bytes(spark, path, json.dumps(report, indent=2, default=str).encode())


def bundle(parts: dict[str, bytes]) -> bytes:
    """A ZIP file of named parts."""
    to = io.BytesIO()
    with zipfile.ZipFile(to, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in parts.items():
            z.writestr(name, data)
    return to.getvalue()
