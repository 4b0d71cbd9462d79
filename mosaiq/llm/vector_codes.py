"""Vector codes: each part of a vector becomes the number of its nearest codebook entry, found through a VA file.

The VA file of a codebook quantises each coordinate of its entries into 2**bits cells and
keeps, of each cell, the least and the largest coordinate in it. For a query a lookup table
gives, for each coordinate and cell, the least and the largest squared distance to anything
in the cell; summed over coordinates they bound the distance to each entry from below and
above. Only entries whose lower bound is no more than the least upper bound are candidates;
these are refined by exact distances in integers, so bounds never change a result.

Codebooks are learned by rounds of assigning and averaging. Each task sums the parts that it
gave to each entry, so a round shuffles a row an entry and coordinate from each task, and
the driver gets the sums of the entries alone, of which there are parts * entries.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from mosaiq.llm.shared import FEW, NULL_ID, back, met, small_batches, staged

#: Queries whose bounds are in memory together, and components that squared sums can hold in 64 bits.
CHUNK, LARGEST = 512, 1 << 28


class VAFile:
    """The nearest of some entries (n, d) of integers, ties to the lower index."""

    def __init__(self, entries: np.ndarray, bits: int = 4):
        self.entries = entries
        n, d = entries.shape
        low, high = entries.min(0), entries.max(0)
        width = (high - low) // (1 << bits) + 1
        self.cell = (entries - low) // width
        self.low, self.high = (np.zeros((d, 1 << bits), np.int64) for _ in range(2))
        at = (np.tile(np.arange(d), n), self.cell.ravel())
        self.low[at], self.high[at] = np.iinfo(np.int64).max, np.iinfo(np.int64).min
        np.minimum.at(self.low, at, entries.ravel())
        np.maximum.at(self.high, at, entries.ravel())
        self.asked = self.refined = 0

    def bounds(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of the squared distances of x (m, d) to each entry."""
        q = x[:, :, None]
        below, above = self.low - q, q - self.high
        least = np.maximum(np.maximum(below, above), 0) ** 2
        most = np.maximum(np.abs(below), np.abs(above)) ** 2
        lower, upper = (np.zeros((len(x), len(self.entries)), np.int64) for _ in range(2))
        for k in range(x.shape[1]):
            lower += least[:, k].take(self.cell[:, k], 1)
            upper += most[:, k].take(self.cell[:, k], 1)
        return lower, upper

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index, squared distance) of each row of x (m, d)."""
        index, best = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
        for a in range(0, len(x), CHUNK):
            part = x[a : a + CHUNK]
            lower, upper = self.bounds(part)
            row, entry = np.nonzero(lower <= upper.min(1, keepdims=True))
            dist = ((part[row] - self.entries[entry]) ** 2).sum(1)
            start = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
            least = np.minimum.reduceat(dist, start)
            hit = np.flatnonzero(dist == least[row])
            first = hit[np.r_[True, row[hit][1:] != row[hit][:-1]]]
            index[a : a + CHUNK], best[a : a + CHUNK] = entry[first], least
            self.asked, self.refined = self.asked + part.shape[0] * len(self.entries), self.refined + len(row)
        return index, best


def _matrix(column: pa.Array, length: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(-1, length)


def kept_vectors(vectors: DataFrame, parts: int, scale: int, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """id, label (text), v (integers): the vectors that have codes, staged."""
    small_batches(vectors.sparkSession, 2000)
    v = F.col("v")
    fine = v.isNotNull() & (F.size("v") > 0) & (F.size("v") % parts == 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float(LARGEST // scale)))
    label = F.coalesce(F.concat(F.lit("="), F.col(label_col).cast("string")), F.lit(""))
    rows = vectors.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("id"), label.alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = rows.where(F.coalesce(fine, F.lit(False))).withColumn("v", F.transform("v", lambda x: F.floor(x * float(scale))))
    return staged(rows, "integer_vectors")


def learn(rows: DataFrame, length: int, *, parts: int = 4, entries: int = 256, rounds: int = 4, bits: int = 4) -> list[np.ndarray]:
    """A codebook (entries, length / parts) of each part position; rows (id, v) are integer vectors of one length."""
    d = length // parts
    first = np.array([r.v for r in rows.select("id", "v").orderBy("id", "v").limit(entries).select("v").collect()], np.int64).reshape(-1, length)
    books = [first[:, p * d : (p + 1) * d].copy() for p in range(parts)]
    for _ in range(rounds if len(first) else 0):
        held = books

        def sums(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            files = [VAFile(b, bits) for b in held]
            n, total = np.zeros((parts, len(held[0])), np.int64), np.zeros((parts, len(held[0]), d), np.int64)
            for batch in batches:
                x = _matrix(batch.column("v"), length)
                for p, file in enumerate(files):
                    own = x[:, p * d : (p + 1) * d]
                    index = file.nearest(own)[0]
                    n[p] += np.bincount(index, minlength=n.shape[1])
                    np.add.at(total[p], index, own)
            p, e = np.nonzero(n)
            if len(p):
                yield pa.RecordBatch.from_arrays([pa.array(p), pa.array(e), pa.array(n[p, e]), pa.array(list(total[p, e]), pa.list_(pa.int64()))], ["part", "entry", "n", "total"])

        each = rows.select("v").mapInArrow(sums, "part long, entry long, n long, total array<long>").select("part", "entry", "n", F.posexplode("total").alias("k", "t"))
        books = [b.copy() for b in held]
        for r in each.groupBy("part", "entry", "k").agg(F.sum("n").alias("n"), F.sum("t").alias("t")).collect():  # parts * entries * d numbers
            books[r.part][r.entry, r.k] = r.t // r.n
    return books


def encode(rows: DataFrame, books: list[np.ndarray], *, bits: int = 4) -> DataFrame:
    """rows (id, label, v) with code (two hexadecimal digits a part) and error (the squared distances' sum)."""
    length, d = sum(b.shape[1] for b in books), books[0].shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = [VAFile(b, bits) for b in books]
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column("v"), length)
                found = [f.nearest(x[:, p * d : (p + 1) * d]) for p, f in enumerate(files)]
                codes = np.stack([i for i, _ in found], 1).astype(np.uint8)
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), pa.array([c.tobytes().hex() for c in codes]), pa.array(sum(e for _, e in found))], ["id", "label", "code", "error"])

    return rows.mapInArrow(run, "id long, label string, code string, error long")


def digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all integers by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()


def vector_codes(vectors: DataFrame, *, parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024, bits: int = 4, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", few: int = FEW) -> DataFrame:
    """vec_id, code, error, label_error (error summed over equal labels), codebooks_sha256.

    Components become floor(scale * x); a codebook (entries <= 256) starts as that part of
    the `entries` smallest ids (null last; of one id by components), or as many as there
    are. Dropped are vectors that are null, empty, hold null or non-finite components or
    some of 2**28 / scale and more in size (beyond which 64-bit sums would not hold), whose
    length is no multiple of `parts`, or is not that of the first vector that has codes.
    Null labels are one label. Rows that repeat have a row each. An empty table: no rows.
    """
    assert 1 <= entries <= 256
    rows = kept_vectors(vectors, parts, scale, id_col, vector_col, label_col)
    one = rows.select("id", "v").orderBy("id", "v").limit(1).collect()
    length = len(one[0].v) if one else parts
    rows = rows.where(F.size("v") == length)
    books = learn(rows, length, parts=parts, entries=entries, rounds=rounds, bits=bits)
    coded = staged(encode(rows, books, bits=bits), "vector_codes") if one else rows.select("id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"))
    by_label = coded.groupBy("label").agg(F.sum("error").alias("label_error"))
    out = met(coded, "label", by_label, coded.count(), few)
    return out.select(back(F.col("id")).alias(id_col), "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def op13_vector_codes(spark, sf_dir: str) -> DataFrame:
    return vector_codes(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label"))


def _sql(rounds: int = 4) -> str:
    """Rounds of assigning every part to every entry, and of averaging, one after the other."""
    with_ = [
        "v AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST) AS k, vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS q FROM embeddings"
        " WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        "s AS MATERIALIZED (SELECT k, p, q[p * len(q) // 4 + 1:(p + 1) * len(q) // 4] AS x FROM v, range(4) AS r(p))",
        "b0 AS MATERIALIZED (SELECT p, k - 1 AS e, x AS y FROM s WHERE k <= 256)",
    ]
    for r in range(rounds + 1):
        with_.append(f"d{r} AS (SELECT s.k, s.p, s.x, b.e, list_sum(list_transform(list_zip(s.x, b.y), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM s JOIN b{r} b ON s.p = b.p)")
        with_.append(f"a{r} AS MATERIALIZED (SELECT k, p, any_value(x) AS x, min(d) AS d, arg_min(e, d * 256 + e) AS e FROM d{r} GROUP BY k, p)")
        if r < rounds:
            with_.append(f"m{r} AS (SELECT p, e, i, floor(sum(x[i]) / count(*))::BIGINT AS y FROM a{r}, range(1, 1 + (SELECT max(len(x)) FROM s)) AS r(i) GROUP BY p, e, i)")
            with_.append(f"b{r + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(n.y, b.y) AS y FROM b{r} b LEFT JOIN (SELECT p, e, list(y ORDER BY i) AS y FROM m{r} GROUP BY p, e) n ON b.p = n.p AND b.e = n.e)")
    return (
        f"WITH {', '.join(with_)}, h AS (SELECT sha256(string_agg(array_to_string(y, ','), ',' ORDER BY p, e)) AS h FROM b{rounds}), "
        f"c AS (SELECT k, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a{rounds} GROUP BY k) "
        "SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, h AS codebooks_sha256 FROM v JOIN c USING (k), h"
    )


OP13_SQL = _sql()
