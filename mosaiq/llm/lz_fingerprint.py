"""Document fingerprints from Lempel-Ziv phrases.

A text's bytes are parsed into dictionary phrases: from where the last phrase ended, the
shortest string that is not yet in the dictionary is the next phrase and enters it (the
parse of LZ78). The set of phrases tells what a compressor would learn from the text; two
texts that compress well together share phrases. Each phrase is hashed, the hashes are dealt
into bins by their high bits, and the least hash of each bin is kept (16 bits of it): a
minimum-hash signature. The share of bins that agree, of those that either set fills,
estimates the Jaccard similarity of the two phrase sets, whatever their sizes.

For pairs of neighbours, documents are range-partitioned and sorted once by id; each task
streams through its range and holds one document and the next. Where a range ends, its last
document meets the first of the next range in a join of one row a range.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from mosaiq.llm.shared import back, keyed, staged

#: Bins of a signature (a power of two); each takes four hexadecimal digits, zeros if it is empty.
BINS = 128
INNER = bytes(range(0x80, 0xC0))  # UTF-8 bytes that begin no code point


def parse(data: bytes, at: int, end: int, known: set[bytes], length: int = 3) -> int:
    """Parse data[at:end] into phrases, which enter `known`; where the last, unfinished phrase begins.

    All beginnings of a phrase are phrases, so the shortest new string is found by going
    up or down from the last phrase's length.
    """
    add = known.add
    while at < end:
        to = at + length
        if to > end:
            to = end
        if data[at:to] in known:
            to += 1
            while to <= end and data[at:to] in known:
                to += 1
            if to > end:
                break
        else:
            while to - 1 > at and data[at : to - 1] not in known:
                to -= 1
        add(data[at:to])
        length = to - at
        at = to
    return at


def signature(phrases: set[bytes], bins: int = BINS) -> np.ndarray:
    """16 bits of the least hash of each bin (1 to 65535), 0 in empty bins."""
    out = np.zeros(bins, np.uint16)
    if phrases:
        h = np.fromiter(map(xxhash.xxh3_64_intdigest, phrases), np.uint64, len(phrases))
        h.sort()  # so bins are runs, and each one's first is its least
        bin_ = h >> np.uint64(64 - int(bins).bit_length() + 1)
        first = np.flatnonzero(np.r_[True, bin_[1:] != bin_[:-1]])
        out[bin_[first].astype(np.int64)] = (h[first] % np.uint64(65535) + np.uint64(1)).astype(np.uint16)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Of the bins that either signature fills, the share that agrees; 1 if both are empty."""
    filled = int(((a | b) > 0).sum())
    return float(((a == b) & (a > 0)).sum() / filled) if filled else 1.0


def as_hex(sig: np.ndarray) -> str:
    return sig.astype(">u2").tobytes().hex()


def of_hex(text: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(text), ">u2").astype(np.uint16)


def fingerprint(text: bytes) -> np.ndarray:
    known: set[bytes] = set()
    parse(text, 0, len(text), known)
    return signature(known)


def fingerprints(docs: DataFrame, *, text_col: str = "text", out: str = "fingerprint") -> DataFrame:
    """docs with a column `out`: the signature of each text, in hexadecimal digits.

    Equal texts have equal ones. Null and empty texts have no phrases: all zeros. A task
    holds the phrases of one text at a time. An empty table gives no rows; `out` replaces
    a column of that name.
    """

    @F.pandas_udf("string")
    def made(texts):
        return texts.map(lambda t: as_hex(fingerprint((t or "").encode())))

    return docs.withColumn(out, made(F.col(f"`{text_col}`")))


def likeness_of(a: Column, b: Column) -> Column:
    """The estimated Jaccard similarity (0 to 1) of the phrase sets behind two fingerprints; null where either is."""

    @F.pandas_udf("double")
    def compared(x, y):
        return x.combine(y, lambda p, q: None if p is None or q is None else likeness(of_hex(p), of_hex(q)))

    return compared(a, b)


def _bytes_of(text: bytes, chars: int) -> int:
    """How many bytes the first `chars` code points take."""
    if chars <= 0:
        return 0
    raw = np.frombuffer(text, np.uint8)
    starts = np.flatnonzero((raw & 0xC0) != 0x80)
    return int(starts[chars]) if chars < len(starts) else len(text)


class _Half:
    """A text with its fingerprint, and its parse up to where its last quarter begins."""

    def __init__(self, text: bytes):
        self.text, self.chars = text, len(text.translate(None, INNER))
        self.cut = _bytes_of(text, self.chars - self.chars // 4)
        known: set[bytes] = set()
        self.at = parse(text, 0, self.cut, known)
        self.known = set(known)
        parse(text, self.at, len(text), known)
        self.own = signature(known)

    def edited(self, next_text: bytes) -> tuple[bytes, np.ndarray]:
        """The text with its last quarter replaced by the beginning of the next, and its fingerprint; may be asked once."""
        text = self.text[: self.cut] + next_text[: _bytes_of(next_text, self.chars // 4)]
        parse(text, self.at, len(text), self.known)
        return text, signature(self.known)


OUT = {"id": pa.int64(), "n_chars": pa.int64(), "edited_sha256": pa.string(), "fingerprint": pa.string(), "edited_fingerprint": pa.string(), "near_edited": pa.float64(), "near_next": pa.float64()}


def _told(i: int, one: _Half, next_text: bytes, next_sig: np.ndarray) -> tuple:
    text, sig = one.edited(next_text)
    return i, one.chars, hashlib.sha256(text).hexdigest(), as_hex(one.own), as_hex(sig), likeness(one.own, sig), likeness(one.own, next_sig)


def _batch(rows: list[tuple], **more: list) -> pa.RecordBatch:
    cols = zip(*rows, strict=True) if rows else [[] for _ in OUT]
    arrays = [pa.array(c, t) for c, t in zip(cols, OUT.values(), strict=True)]
    return pa.RecordBatch.from_arrays([*arrays, *more.values()], [*OUT, *more])


def ranges(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None) -> DataFrame:
    """(id, text) by id, a hash of the text and the row, cut into ranges of about as many rows each: a partition a range."""
    rows = keyed(docs, id_col, text_col).withColumn("tie", F.xxhash64("text")).withColumn("row", F.monotonically_increasing_id())
    n = parts or max(docs.select(id_col).rdd.getNumPartitions(), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return rows.repartitionByRange(n, "id", "tie", "row").sortWithinPartitions("id", "tie", "row").select("id", "text")


def with_edits(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has its last quarter (floor of n_chars / 4 code points) replaced by as
    many from the beginning of the next document, or all there are; the next document is
    that of the next larger id, and the first one after the last. near_edited compares a
    document's fingerprint with its edited text's, near_next with the next document's.

    Null texts are empty; null ids come last. Rows of one id go by a hash of their texts;
    rows alike in both are each other's next, in any order, with the same results. A table
    of one row is its own next; an empty table gives no rows. Ranges are cut by id, text and
    row, so neither a hot id nor a text that repeats fills a task.
    """
    from pyspark import TaskContext

    ordered = ranges(docs, id_col, text_col, parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row a document; the last of a range is not worked out: it leaves with its text, and so does the first."""
        part, held, first, i = TaskContext.get().partitionId(), None, None, None

        def mark(rows: list[tuple], kind: int, text: bytes | None) -> pa.RecordBatch:
            k = len(rows)
            return _batch(rows, part=pa.array([part] * k, pa.int32()), kind=pa.array([kind] * k, pa.int32()), text=pa.array([text] * k, pa.binary()))

        for batch in batches:
            out = []
            for j, t in zip(batch.column("id").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), strict=True):
                one = _Half(t)
                if held is None:
                    first = (j, t, one.own)
                else:
                    out.append(_told(i, held, t, one.own))
                held, i = one, j
            if out:
                yield mark(out, 0, None)
        if held is not None:
            yield mark([(first[0], None, None, as_hex(first[2]), None, None, None)], 1, first[1])
            yield mark([(i, None, None, None, None, None, None)], 2, held.text)

    names = "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    told = staged(ordered.mapInArrow(run, f"{names}, part int, kind int, text binary"), "fingerprints")
    # of each range that has rows the number of the next one: as many rows as ranges
    heads = told.where("kind = 1").select("part", F.col("text").alias("next_text"), F.col("fingerprint").alias("next_print"))
    every = told.where("kind = 1").select("part")
    after = every.select("part", F.coalesce(F.lead("part").over(W.orderBy("part")), F.min("part").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, W.unboundedFollowing))).alias("next_part"))
    open_ = told.where("kind = 2").select("id", "part", "text").join(after, "part").join(heads.withColumnRenamed("part", "next_part"), "next_part").select("id", "text", "next_text", "next_print")

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                yield _batch([_told(r["id"], _Half(r["text"]), r["next_text"], of_hex(r["next_print"]))])

    done = told.where("kind = 0").select(*OUT).unionByName(open_.mapInArrow(close, names))
    return done.select(back(F.col("id")).alias("doc_id"), *[c for c in OUT if c != "id"])


def op12_lz_fingerprint(spark, sf_dir: str) -> DataFrame:
    return with_edits(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
