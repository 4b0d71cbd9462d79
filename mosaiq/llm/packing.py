"""Harmonic packing of token sequences.

A piece of length L in sequences of capacity C is of class k = C // L: k such pieces
fill a bin, and each class's bins take exactly k pieces, independently in each worker.
Documents may be cut, so a length whose class would waste much of a bin gives up a
piece of C // (k + 1) ids first, which fits its class without waste; what is left is
far shorter, and the longer the class number, the less it wastes. The bins that are
still open when a worker's documents end are laid end to end, cut at C.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from mosaiq.llm.shared import back, keyed
from mosaiq.llm.tokens import crc, encoder


def cuts(length: int, capacity: int, waste: int = 32) -> list[int]:
    """Lengths of a document's pieces; each wastes at most capacity / waste of a bin of its class."""
    out = []
    while length >= capacity:
        out.append(capacity)
        length -= capacity
    while length:
        k = capacity // length
        piece = length if (capacity - k * length) * waste <= capacity else capacity // (k + 1)
        out.append(piece)
        length -= piece
    return out


class Packer:
    """Takes documents' ids, gives pieces (doc, start, ids, sequence, offset) of bins that are full."""

    def __init__(self, capacity: int, item: int):
        self.capacity, self.item, self.open, self.sequence, self.done = capacity, item, {}, 0, []

    def add(self, doc, ids: bytes) -> None:
        start, n = 0, len(ids) // self.item
        for length in cuts(n, self.capacity):
            k = self.capacity // length
            bin_ = self.open.setdefault(k, [])
            bin_.append((doc, n, start, ids[start * self.item : (start + length) * self.item]))
            start += length
            if len(bin_) == k:
                self._close(self.open.pop(k))

    def _close(self, pieces: list) -> None:
        offset = 0
        for doc, n, start, ids in pieces:
            self.done.append((doc, n, start, ids, self.sequence, offset))
            offset += len(ids) // self.item
        self.sequence += 1

    def end(self) -> None:
        room, held = self.capacity, []
        for doc, n, start, ids in [p for k in sorted(self.open) for p in self.open[k]]:
            while ids:
                take = ids[: room * self.item]
                held.append((doc, n, start, take))
                start, ids, room = start + len(take) // self.item, ids[len(take) :], room - len(take) // self.item
                if not room:
                    self._close(held)
                    room, held = self.capacity, []
        if held:
            self._close(held)
        self.open = {}


def pack(docs: DataFrame, tokenizer: str, end_id: int | None, capacity: int = 2048, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces: doc_id, start, length, ids (binary, uint16 or uint32), width, doc_tokens, sequence_id, offset, ids_crc32.

    A worker is an input partition; nothing is shuffled and open bins hold a few hundred
    thousand ids at most. sequence_id is unique, not dense: the partition's number above
    32 bits. Null and empty texts have the end id alone (without one, no piece). Rows that
    repeat are packed each. An empty table gives no pieces.
    """
    from pyspark import TaskContext

    schema = pa.schema([("id", pa.int64()), ("start", pa.int64()), ("ids", pa.binary()), ("width", pa.int32()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids_crc32", pa.int64())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        end = b"" if end_id is None else np.array([end_id], enc.dtype).tobytes()
        packer, base, held = Packer(capacity, enc.dtype.itemsize), TaskContext.get().partitionId() << 32, 0

        def out() -> pa.RecordBatch:
            doc, n, start, ids, seq, offset = zip(*packer.done, strict=True)
            packer.done = []
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip((doc, start, ids, [enc.dtype.itemsize] * len(doc), n, [base + s for s in seq], offset, [crc(i, enc.dtype) for i in ids]), schema.types, strict=True)], schema=schema)

        for batch in batches:
            for doc, ids in zip(batch.column("id").to_pylist(), enc.encode(batch.column("text").to_pylist()), strict=True):
                packer.add(doc, ids + end)
                held += len(ids)
                if held > 4 << 20 and packer.done:
                    held = 0
                    yield out()
        packer.end()
        if packer.done:
            yield out()

    pieces = keyed(docs, id_col, text_col).mapInArrow(work, "id long, start long, ids binary, width int, doc_tokens long, sequence_id long, offset long, ids_crc32 long")
    return pieces.select(back(F.col("id")).alias("doc_id"), "start", F.expr("cast(octet_length(ids) div width as long)").alias("length"), "ids", "width", "doc_tokens", "sequence_id", "offset", "ids_crc32")


def op9_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"), 1).drop("ids", "width")
