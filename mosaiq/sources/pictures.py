"""Mosaics of any size as TIFF files, written by tasks: a data source whose writer streams strips of tiles.

`tiles.write.format("mosaic").save(folder)` gives <folder>/<store>_stitched.tif for each
store. Rows come sorted by store and place (see write_mosaics), so a writer holds one strip
of tiles, as wide as the picture, at a time, and no pixel passes the driver. Files are
written under names of their own attempt and get theirs when the job commits; an attempt
that fails, or that another one overtakes, leaves nothing.
"""

from __future__ import annotations

import os
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

#: Rows of a TIFF strip, and bytes from which the 64-bit kind of the format is needed.
STRIP, LARGE = 64, 4_000_000_000


class Folder:
    """A folder on the shared file system: of this machine's view (a path, file:) or of a store that Arrow knows by its URI."""

    def __init__(self, path: str):
        self.local = path.removeprefix("file://").removeprefix("file:") if path.startswith(("/", "file:")) else None
        if self.local is None:
            from pyarrow import fs

            self.fs, self.at = fs.FileSystem.from_uri(path)
        else:
            self.at = self.local

    def create(self, name: str):
        if self.local is not None:
            os.makedirs(self.at, exist_ok=True)
            return open(f"{self.at}/{name}", "wb")
        self.fs.create_dir(self.at, recursive=True)
        return self.fs.open_output_stream(f"{self.at}/{name}")

    def rename(self, old: str, new: str) -> None:
        if self.local is not None:
            os.replace(f"{self.at}/{old}", f"{self.at}/{new}")
        else:
            self.fs.move(f"{self.at}/{old}", f"{self.at}/{new}")

    def delete(self, name: str) -> None:
        if self.local is not None:
            if os.path.exists(f"{self.at}/{name}"):
                os.remove(f"{self.at}/{name}")
        else:
            from pyarrow import fs

            if self.fs.get_file_info(f"{self.at}/{name}").type != fs.FileType.NotFound:
                self.fs.delete_file(f"{self.at}/{name}")


def head(w: int, h: int) -> bytes:
    """All that stands before the pixels of an uncompressed RGB TIFF of w x h; strips follow one another."""
    n, size = -(-h // STRIP), 3 * w
    big = size * h > LARGE
    counts = [size * min(STRIP, h - k * STRIP) for k in range(n)]
    number, pack = (16, "<Q") if big else (4, "<I")  # LONG8 or LONG
    width = struct.calcsize(pack)
    entry, ends = (20, 8) if big else (12, 4)
    tags = 10
    start = 16 if big else 8
    lists = start + (8 if big else 2) + tags * entry + ends
    room = n * width if n > 1 else 0
    first = lists + 2 * room + (0 if big else 6)
    offsets = np.cumsum([first, *counts[:-1]]).tolist()

    def item(tag: int, kind: int, values: list[int], at: int | None = None) -> bytes:
        form = {3: "<H", 4: "<I", 16: "<Q"}[kind]
        body = b"".join(struct.pack(form, v) for v in values) if at is None else struct.pack(pack, at)
        return struct.pack("<HH" + ("Q" if big else "I"), tag, kind, len(values)) + body.ljust(8 if big else 4, b"\0")

    listed = lambda k: lists + k * room if n > 1 else None
    body = [
        item(256, 4, [w]), item(257, 4, [h]), item(258, 3, [8, 8, 8], None if big else lists + 2 * room), item(259, 3, [1]), item(262, 3, [2]),
        item(273, number, offsets, listed(0)), item(277, 3, [3]), item(278, 4, [STRIP]), item(279, number, counts, listed(1)), item(284, 3, [1]),
    ]
    begin = struct.pack("<2sHHHQ", b"II", 43, 8, 0, 16) + struct.pack("<Q", tags) if big else struct.pack("<2sHI", b"II", 42, 8) + struct.pack("<H", tags)
    out = begin + b"".join(body) + bytes(ends)
    if n > 1:
        out += b"".join(struct.pack(pack, v) for v in offsets) + b"".join(struct.pack(pack, v) for v in counts)
    return out + (b"" if big else struct.pack("<HHH", 8, 8, 8))


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]  # the attempt's name and the one it gets


class _Writer(DataSourceWriter):
    def __init__(self, folder: str):
        self.folder = folder

    def write(self, iterator: Iterator) -> Written:
        """Rows store, y0, x0, h, w, bgr, and the crop top, bottom, left, right, by store, y0 and x0."""
        to, done, out, now = Folder(self.folder), [], None, None

        def flush(upto: int) -> None:
            """Rows of the picture up to a line of the canvas: what the strip holds, and black where there is no tile."""
            nonlocal line, band, band_at
            a, b = max(line, top), min(upto, bottom)
            while a < b:
                if band is not None and band_at <= a < band_at + len(band):
                    n = min(b, band_at + len(band)) - a
                    out.write(np.ascontiguousarray(band[a - band_at : a - band_at + n, :, ::-1]).tobytes())
                else:
                    n = min(b - a, STRIP)
                    out.write(bytes(3 * (right - left) * n))
                a += n
            line = max(line, upto)

        try:
            line, band, band_at = 0, None, 0
            top = bottom = left = right = 0
            for r in iterator:
                if r.store != now:
                    if out is not None:
                        flush(bottom)
                        out.close()
                    now, line, band = r.store, r.top, None
                    top, bottom, left, right = r.top, r.bottom, r.left, r.right
                    done.append((f".{now}-{uuid.uuid4().hex}.part", f"{now}_stitched.tif"))
                    out = to.create(done[-1][0])
                    out.write(head(right - left, bottom - top))
                if band is None or r.y0 != band_at:
                    flush(r.y0)
                    band, band_at = np.zeros((r.h, right - left, 3), np.uint8), r.y0
                a, b = max(r.x0, left), min(r.x0 + r.w, right)
                if a < b:
                    band[:, a - left : b - left] = np.frombuffer(r.bgr, np.uint8).reshape(r.h, r.w, 3)[:, a - r.x0 : b - r.x0]
            if out is not None:
                flush(bottom)
                out.close()
            return Written(done)
        except BaseException:
            if out is not None:
                out.close()
            for name, _ in done:
                to.delete(name)
            raise

    def commit(self, messages: list) -> None:
        to = Folder(self.folder)
        for m in messages:
            for old, new in m.files if m is not None else []:
                to.rename(old, new)

    def abort(self, messages: list) -> None:
        to = Folder(self.folder)
        for m in messages:
            for old, _ in m.files if m is not None else []:
                to.delete(old)


class Mosaics(DataSource):
    """The sink `mosaic`."""

    @classmethod
    def name(cls) -> str:
        return "mosaic"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["path"])


def write_mosaics(spark: SparkSession, mosaic: DataFrame, folder: str, crop: bool = True) -> None:
    """<folder>/<store>_stitched.tif of every store of tiles(); crop: without the black border (an all black picture stays whole).

    Tiles that failed (error) leave their store out. A picture is written by one task, strip by strip.
    """
    spark.dataSource.register(Mosaics)
    bad = F.max(F.col("error").isNotNull()) if "error" in mosaic.columns else F.lit(False)
    size = mosaic.groupBy("store").agg(F.max(F.col("y0") + F.col("h")).alias("_h"), F.max(F.col("x0") + F.col("w")).alias("_w"), *[f(c).alias(f"_{c}") for f, c in ((F.min, "cy0"), (F.max, "cy1"), (F.min, "cx0"), (F.max, "cx1"))], bad.alias("_bad")).where("not _bad")
    edge = lambda c, whole: F.coalesce(F.col(f"_{c}"), whole) if crop else whole
    box = size.select("store", *[edge(c, whole).cast("int").alias(n) for n, c, whole in (("top", "cy0", F.lit(0)), ("bottom", "cy1", F.col("_h")), ("left", "cx0", F.lit(0)), ("right", "cx1", F.col("_w")))])
    rows = mosaic.select("store", "y0", "x0", "h", "w", "bgr").join(box, "store")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows.repartition(n, "store").sortWithinPartitions("store", "y0", "x0").write.format("mosaic").mode("append").save(folder)
