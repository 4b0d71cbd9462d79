"""Toxicity by a factorization machine over hashed terms.

A text's features are the hashes of its words and of their beginnings (4 to 6 letters).
The score is the logistic of bias + sum of weights + sum over pairs of features of the
dot products of their factors, so a pair such as an insult and a mention of a group can
weigh more, or less, than its members do apart. Of the hash buckets, those take part
that tell the classes apart in the training rows by a chi-square test.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from mosaiq.llm.shared import keyed, staged

BITS, STEMS, EDGE = 20, (4, 5, 6), b".,;:!?\"'()[]"
#: Texts that score this much and more are toxic, for op6 and for the pipeline.
TOXIC = 0.3


def terms(word: bytes) -> tuple[int, ...]:
    """Hash buckets of a lower-cased word and of its beginnings."""
    w = word.strip(EDGE)
    letters = w.decode(errors="ignore")
    parts = [b"w" + w] + [b"p" + letters[:n].encode() for n in STEMS if len(letters) > n]
    return tuple(xxhash.xxh3_64_intdigest(p) >> (64 - BITS) for p in parts) if w else ()


class Features(dict):
    """The features of each word, kept while there is room; `chosen` maps buckets to columns (None: all buckets)."""

    ROOM = 400_000

    def __init__(self, chosen: dict[int, int] | None = None):
        super().__init__()
        self.chosen = chosen

    def __missing__(self, word: bytes) -> tuple[int, ...]:
        t = terms(word)
        self[word] = t = t if self.chosen is None else tuple(self.chosen[x] for x in t if x in self.chosen)
        return t

    def of(self, text: str) -> np.ndarray:
        if len(self) > self.ROOM:
            self.clear()
        return np.array(sorted(set(chain.from_iterable(map(self.__getitem__, set(text.encode().lower().split()))))), np.int64)


@dataclass
class Machine:
    """score() takes the columns that a text has."""

    buckets: np.ndarray  # of the columns
    bias: float
    weights: np.ndarray
    factors: np.ndarray  # columns x k

    def score(self, columns: np.ndarray) -> float:
        z = self.bias
        if len(columns):
            v = self.factors[columns]
            s = v.sum(0)
            z += self.weights[columns].sum() + 0.5 * (s @ s - (v * v).sum())
        return round(float(1 / (1 + np.exp(-np.clip(z, -30, 30)))), 6)


def telling(pos: np.ndarray, neg: np.ndarray, p: int, n: int, limit: int) -> np.ndarray:
    """The buckets whose presence differs most between p toxic rows and n others: chi-square over 15, in 4 rows at least, `limit` at most."""
    pos, neg, p, n = pos.astype(float), neg.astype(float), max(p, 1), max(n, 1)
    df = pos + neg
    with np.errstate(divide="ignore", invalid="ignore"):
        chi = (pos * n - neg * p) ** 2 * (p + n) / (p * n * df * (p + n - df))
    chi = np.where((df >= 4) & np.isfinite(chi), chi, 0)
    best = np.argsort(-chi, kind="stable")[:limit]
    return best[chi[best] > 15]


def choose(rows: list[np.ndarray], y: np.ndarray, limit: int) -> np.ndarray:
    """telling() of rows of buckets."""
    count = lambda k: np.bincount(np.concatenate([r for r, t in zip(rows, y, strict=True) if t == k] or [np.zeros(0, np.int64)]), minlength=1 << BITS)
    return telling(count(1), count(0), int(y.sum()), int(len(y) - y.sum()), limit)


def fit(rows: list[np.ndarray], y: np.ndarray, *, k: int = 6, columns: int = 4096, steps: int = 150, rate: float = 0.05, l2: float = 2e-4, seed: int = 3) -> Machine:
    """Train on rows of buckets by Adam on the whole (weighted) log loss. Without both classes: a constant."""
    prior = (y.sum() + 0.5) / (len(y) + 1)
    bias0 = float(np.log(prior / (1 - prior)))
    if not y.any() or y.all():
        return Machine(np.zeros(0, np.int64), bias0, np.zeros(0), np.zeros((0, k)))
    buckets = choose(rows, y, columns)
    at = np.full(1 << BITS, -1)
    at[buckets] = np.arange(len(buckets))
    cols = [(c := at[r])[c >= 0] for r in rows]
    row = np.repeat(np.arange(len(rows)), [len(c) for c in cols])
    col = np.concatenate(cols) if cols else np.zeros(0, np.int64)
    rng = np.random.default_rng(seed)
    d = len(buckets)
    theta = np.concatenate([np.zeros((d, 1)), rng.normal(0, 0.01, (d, k))], 1)
    bias, m, v, mb, vb = bias0, np.zeros_like(theta), np.zeros_like(theta), 0.0, 0.0

    def summed(index: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
        return np.stack([np.bincount(index, values[:, j], n) for j in range(values.shape[1])], 1)

    for t in range(1, steps + 1):
        each = theta[col]
        sums = summed(row, each, len(rows))
        squares = np.bincount(row, (each[:, 1:] ** 2).sum(1), len(rows))
        z = bias + sums[:, 0] + 0.5 * ((sums[:, 1:] ** 2).sum(1) - squares)
        g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / len(y)
        part = g[row][:, None] * np.concatenate([np.ones((len(row), 1)), sums[row, 1:] - each[:, 1:]], 1)
        grad = summed(col, part, d) + l2 * theta
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        theta = theta - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        mb, vb = 0.9 * mb + 0.1 * g.sum(), 0.999 * vb + 0.001 * g.sum() ** 2
        bias -= rate * (mb / (1 - 0.9**t)) / (vb / (1 - 0.999**t)) ** 0.5 if vb else 0.0
    return Machine(buckets, float(bias), theta[:, 0], theta[:, 1:])


def train(docs: DataFrame, labels: DataFrame, *, most: int = 12_000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", **options) -> Machine:
    """A machine from labelled documents: all, or the `most` of them whose ids hash lowest (a bounded sample).

    labels: id and label (1: toxic; null labels and ids don't count). Null and empty texts
    are texts without features. Rows that repeat are examples of their own.
    """
    few = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), (F.col(label_col) == 1).cast("int").alias("y"))
    few = few.orderBy(F.xxhash64(F.lit(11), "id"), "id", "y").limit(most)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Features()
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("y"), pa.array([known.of(t).astype("<u4").tobytes() for t in b.column("text").to_pylist()], pa.binary())], ["id", "y", "terms"])

    labelled = keyed(docs, id_col, text_col).join(F.broadcast(few), "id").select("id", "y", "text").mapInArrow(hashed, "id long, y int, terms binary")
    # ids may repeat: no more rows than ids
    labelled = staged(labelled.orderBy(F.xxhash64(F.lit(11), "id"), "id", "y", "terms").limit(most), "labelled")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((2, 1 << BITS), np.int64)
        for b in batches:
            for y, t in zip(b.column("y").to_pylist(), b.column("terms").to_pylist(), strict=True):
                n[y, np.frombuffer(t, "<u4")] += 1
        k = np.flatnonzero(n.any(0))
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(n[1, k]), pa.array(n[0, k])], ["bucket", "pos", "neg"])

    n = {r["y"]: r["count"] for r in labelled.groupBy("y").count().collect()}
    counts = np.zeros((2, 1 << BITS), np.int64)
    sums = labelled.mapInArrow(counted, "bucket long, pos long, neg long").groupBy("bucket").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).where("pos + neg >= 4").toArrow()  # a row a bucket at most
    counts[:, sums["bucket"].to_numpy()] = sums["pos"].to_numpy(), sums["neg"].to_numpy()
    buckets = np.sort(telling(counts[0], counts[1], n.get(1, 0), n.get(0, 0), options.get("columns", 4096)))

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            terms_ = [t[np.isin(t, buckets)].astype("<u4").tobytes() for t in (np.frombuffer(x, "<u4") for x in b.column("terms").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("y"), pa.array(terms_, pa.binary())], ["id", "y", "terms"])

    rows = labelled.mapInArrow(kept, "id long, y int, terms binary").collect()  # `most` rows of `columns` terms at most
    rows.sort(key=lambda r: (r["id"], r["y"], bytes(r["terms"])))
    return fit([np.frombuffer(bytes(r["terms"]), "<u4").astype(np.int64) for r in rows], np.array([r["y"] for r in rows], np.int64), **options)


def with_scores(docs: DataFrame, machine: Machine, *, text_col: str = "text") -> DataFrame:
    """`row` (a struct of docs' columns) and score (0 to 1) of the whole text; null and empty texts get the bias alone.

    The input's columns live in `row`, so none can clash. Rows that repeat score alike.
    """
    from pyspark.sql import types as T

    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(machine)  # columns x (k + 2) numbers
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    schema = T.StructType([held.schema["row"], T.StructField("score", T.DoubleType())])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        known = Features({int(b): i for i, b in enumerate(m.buckets)})
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array([m.score(known.of(t)) for t in b.column("text").to_pylist()], pa.float64())], ["row", "score"])

    return held.mapInArrow(score, schema)


def held_out(id_col: str = "doc_id"):
    """Rows never learned from: crc32 of the id's text modulo 4 is 2."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op6_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic").where(~held_out())
    scored = with_scores(docs, train(docs, labels)).select("row.doc_id", "score")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= TOXIC).cast("int").alias("predicted"))
