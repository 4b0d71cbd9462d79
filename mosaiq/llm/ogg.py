"""Media columns in the Ogg container (RFC 3533), with 8-bit samples as packets.

Writing: a stream's packets become lacing values (255, 255, ..., rest), 255 of them a
page; each page has a checksum and the granule position (samples so far) of the last
packet that ends on it. Reading: verify every page's checksum and sequence number,
demultiplex by serial number, reassemble packets over page borders, and take the
time of each packet from the granule positions.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from mosaiq.llm.shared import back, keyed

CONTINUED, FIRST, LAST, NO_PACKET = 1, 2, 4, 2**64 - 1
HEAD = struct.Struct("<4sBBQIIIB")
ID = struct.Struct("<5sBII")
REVERSED = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))


class OggError(ValueError):
    pass


def checksum(page: bytes) -> int:
    """The container's CRC (polynomial 0x04C11DB7, no reflection, 0 before and after) through zlib's, its mirror image."""
    c = zlib.crc32(page.translate(REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(c.to_bytes(4, "little").translate(REVERSED), "big")


def _page(flags: int, granule: int, serial: int, number: int, lacing: bytes, body: bytes) -> bytes:
    page = bytearray(HEAD.pack(b"OggS", 0, flags, granule, serial, number, 0, len(lacing)) + lacing + body)
    page[22:26] = checksum(bytes(page)).to_bytes(4, "little")
    return bytes(page)


def write_stream(serial: int, header: bytes, packets: list[bytes]) -> list[bytes]:
    """The pages of one logical stream; a packet has as many samples as bytes."""
    pages = [_page(FIRST | (0 if packets else LAST), 0, serial, 0, bytes([len(header)]), header)]
    lacing = bytearray()
    ends = {}  # places in the lacing after which a packet ends: samples so far
    samples = 0
    for p in packets:
        full, rest = divmod(len(p), 255)
        lacing += b"\xff" * full + bytes([rest])
        samples += len(p)
        ends[len(lacing)] = samples
    body, at, granule = b"".join(packets), 0, 0
    for i in range(0, len(lacing), 255):
        part = bytes(lacing[i : i + 255])
        size = sum(part)
        done = [ends[k] for k in range(i + 1, i + len(part) + 1) if k in ends]
        granule = done[-1] if done else NO_PACKET
        flags = (CONTINUED if i and i not in ends else 0) | (LAST if i + 255 >= len(lacing) else 0)
        pages.append(_page(flags, granule, serial, len(pages), part, body[at : at + size]))
        at += size
    return pages


def store(payload: bytes, packet: int = 1920, streams: int = 2, rate: int = 8000) -> bytes:
    """8-bit samples as `streams` logical streams that take packets in turn; serial numbers follow from the payload."""
    packets = [payload[i : i + packet] for i in range(0, len(payload), packet)]
    base = zlib.crc32(payload)
    each = [write_stream((base + i) & 0xFFFFFFFF, ID.pack(b"PCM8\0", i, rate, packet), packets[i::streams]) for i in range(streams)]
    pages = [p[0] for p in each]  # all first pages come before any other
    for i in range(1, max(map(len, each))):
        pages += [p[i] for p in each if i < len(p)]
    return b"".join(pages)


@dataclass
class Stream:
    serial: int
    packets: list[bytes] = field(default_factory=list)
    begins: list[int] = field(default_factory=list)  # granule position at which each packet begins
    pages: int = 0
    ended: bool = False
    _parts: list[bytes] = field(default_factory=list)
    _samples: int = 0


def read(data: bytes) -> list[Stream]:
    """All logical streams, in order of their first pages, header packets first. OggError says what is wrong."""
    streams: dict[int, Stream] = {}
    at = 0
    while at < len(data):
        if len(data) - at < HEAD.size:
            raise OggError(f"page cut off at {at}")
        magic, version, flags, granule, serial, number, crc, n = HEAD.unpack_from(data, at)
        if magic != b"OggS" or version:
            raise OggError(f"no page at {at}")
        lacing = data[at + HEAD.size : at + HEAD.size + n]
        begin = at + HEAD.size + n
        end = begin + sum(lacing)
        if len(lacing) < n or end > len(data):
            raise OggError(f"page cut off at {at}")
        if checksum(data[at : at + 22] + bytes(4) + data[at + 26 : end]) != crc:
            raise OggError(f"checksum of the page at {at}")
        if flags & FIRST:
            if serial in streams:
                raise OggError(f"stream {serial} begins twice")
            streams[serial] = Stream(serial)
        s = streams.get(serial)
        if s is None or s.ended or number != s.pages:
            raise OggError(f"page {number} of stream {serial} out of order")
        if bool(flags & CONTINUED) != bool(s._parts):
            raise OggError(f"page {number} of stream {serial}: a packet's part is missing")
        s.pages += 1
        fresh = s.pages == 1
        ended = False
        a = begin
        size = 0
        for v in lacing:
            size += v
            if v < 255:
                s._parts.append(data[a : a + size])
                p = b"".join(s._parts)
                s._parts = []
                s.packets.append(p)
                s.begins.append(s._samples)
                s._samples += 0 if fresh else len(p)
                a, size, ended = a + size, 0, True
        if size:
            s._parts.append(data[a : a + size])
        if granule != (s._samples if ended else NO_PACKET):
            raise OggError(f"granule position of page {number} of stream {serial}")
        s.ended = bool(flags & LAST)
        at = end
    for s in streams.values():
        if s._parts or not s.ended:
            raise OggError(f"stream {s.serial} has no end")
    return list(streams.values())


def restore(data: bytes) -> tuple[bytes, str]:
    """What store() was given, and a line of features of the stream: pages, packets, times and sample statistics."""
    streams = read(data)
    heads = [ID.unpack(s.packets[0]) for s in streams]
    if any(h[0] != b"PCM8\0" for h in heads):
        raise OggError("unknown header packet")
    order = [s for _, s in sorted(zip([h[1] for h in heads], streams, strict=True), key=lambda x: x[0])]
    rate = heads[0][2]
    out: list[bytes] = [b""] * sum(len(s.packets) - 1 for s in order)
    for i, s in enumerate(order):
        out[i :: len(order)] = s.packets[1:]
    payload = b"".join(out)
    last = max(s.begins[-1] for s in order)
    x = np.frombuffer(payload, np.uint8)
    total = int(x.sum(dtype=np.int64))
    power = int(np.dot(x.astype(np.int64), x.astype(np.int64)))
    n = max(len(x), 1)
    return payload, f"streams={len(order)};pages={sum(s.pages for s in order)};packets={len(out)};ms={len(x) * 1000 // rate};last_ms={last * 1000 // rate};mean={total / n:.4f};rms={(power / n) ** 0.5:.4f}"


def op5_ogg(spark, sf_dir: str) -> DataFrame:
    """Each text, padded, as Ogg media and what is read back of it.

    Null and empty texts are 192 spaces; null ids stay null; rows that repeat have a row
    each, with equal values. A task holds one text and its media at a time; an empty table
    gives no rows.
    """
    docs = keyed(spark.read.parquet(f"{sf_dir}/documents.parquet"))

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = [t.encode() for t in b.column("text").to_pylist()]
            media = [store(r + b" " * (max(192, -(-len(r) // 192) * 192) - len(r))) for r in raw]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(map(len, raw), pa.int64()), pa.array(media, pa.binary())], ["id", "n_bytes", "media"])

    names = ["id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for doc, n, media in zip(*(b.column(c).to_pylist() for c in ("id", "n_bytes", "media")), strict=True):
                payload, feature = restore(media)
                rows.append((doc, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature))
            cols = list(zip(*rows, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

    out = docs.mapInArrow(save, "id long, n_bytes long, media binary").mapInArrow(load, "id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
    return out.select(back(F.col("id")).alias("doc_id"), *names[1:])


def with_ogg(df: DataFrame, payload_col: str, media_col: str, **options) -> DataFrame:
    """df with a binary column of Ogg media in place of nothing else: payload (binary, null: null) stored by store().

    A column of the name media_col is replaced; other columns, ties and rows that repeat pass.
    """
    from pyspark.sql import types as T

    base = df.drop(media_col)
    schema = T.StructType([*base.schema.fields, T.StructField(media_col, T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            media = [None if p is None else store(bytes(p), **options) for p in b.column(b.schema.get_field_index(payload_col)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(media, pa.binary())], [*b.schema.names, media_col])

    return base.mapInArrow(run, schema)


def ogg_packets(df: DataFrame, id_col: str, media_col: str) -> DataFrame:
    """A row a packet: id, stream (order of first pages), serial, packet (0: the header), begin (samples), data; or error.

    Null media give no rows; media that fail a check give one row whose error says why.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for doc, media in zip(b.column("id").to_pylist(), b.column("media").to_pylist(), strict=True):
                if media is None:
                    continue
                try:
                    rows = [(doc, i, s.serial, k, begin, p, None) for i, s in enumerate(read(media)) for k, (p, begin) in enumerate(zip(s.packets, s.begins, strict=True))]
                except OggError as e:
                    rows = [(doc, None, None, None, None, None, str(e))]
                if rows:
                    cols = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string()), strict=True)], ["id", "stream", "serial", "packet", "begin", "data", "error"])

    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(media_col).alias("media"))
    return rows.mapInArrow(run, "id long, stream int, serial long, packet long, begin long, data binary, error string").withColumnRenamed("id", id_col)
