"""Approximate matching of descriptors through a forest of k-d trees.

Groups are cut into blocks. Each block has a few trees: a node splits its rows at the
median of a coordinate that is drawn from those of the largest variance, so every tree cuts
space in its own way. A block and its trees are a row of a table (store, grp, blk), which
lists the block's rows leaf after leaf.
Queries are sent down all trees of a block at once: the sum of squared distances to the
splits on the way bounds from below how near a leaf can be, and each query visits the leaves
of the least bounds, of all trees together, as many as its checks allow. Queries come packed
to the block, where their distances are exact; only the nearest two leave the task.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from mosaiq.operators.graph import gone
from mosaiq.operators.matching import blocks_of, laid_out, mutual, nearest_by_blocks

#: Coordinates of the largest variance that a split is drawn from.
VARIED = 5


def grown(x: np.ndarray, leaf: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One balanced tree over the rows of x: the coordinate and threshold of each inner node (level by level), and each row's leaf."""
    depth = max(0, int(np.ceil(np.log2(max(len(x), 1) / leaf))))
    dims, cuts, at = np.zeros(2**depth - 1, np.int32), np.zeros(2**depth - 1), np.zeros(len(x), np.int64)
    for level in range(depth):
        for node in range(2**level):
            k, own = 2**level - 1 + node, np.flatnonzero(at == node)
            dim = 0
            if len(own):
                dim = int(rng.choice(np.argsort(-x[own].var(0), kind="stable")[:VARIED]))
                cuts[k] = np.median(x[own, dim])
            dims[k] = dim
        k = 2**level - 1 + at
        at = 2 * at + (x[np.arange(len(x)), dims[k]] > cuts[k])
    return dims, cuts, at


def leaf_bounds(x: np.ndarray, dims: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """For each query and leaf of a tree: the sum of squared distances to the splits that lie between them."""
    out, level = np.zeros((len(x), 1)), 1
    while level <= len(dims):
        over = x[:, dims[level - 1 : 2 * level - 1]] - cuts[level - 1 : 2 * level - 1]
        out = np.stack([out + np.maximum(over, 0) ** 2, out + np.maximum(-over, 0) ** 2], 2).reshape(len(x), -1)
        level *= 2
    return out


def _two(q: np.ndarray, x: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids and distances (n, 2) of the nearest two rows of a leaf, ties to the smaller id; id -1 where there is none."""
    d = np.sqrt(((q[:, None] - x[None]) ** 2).sum(2))
    order = np.lexsort((np.broadcast_to(ids, d.shape), d))[:, :2]
    near, far = ids[order], np.take_along_axis(d, order, 1)
    if near.shape[1] < 2:
        near, far = np.pad(near, ((0, 0), (0, 1)), constant_values=-1), np.pad(far, ((0, 0), (0, 1)), constant_values=np.inf)
    return near, far


def forest_matches(features: DataFrame, ratio: float, **options) -> DataFrame:
    """As mutual_matches(), but nearest neighbours are looked for by forest_nearest(), not among all rows.

    A match may be missed, or let through because its second nearest was not seen; distances
    that are given are exact.
    """
    return mutual(forest_nearest(features, **options), ratio)


def forest_nearest(features: DataFrame, *, trees: int = 5, checks: int = 64, leaf: int = 16, block: int = 4096, seed: int = 0) -> DataFrame:
    """grp_i, grp_j, back, id, best, d, second, looked_at: of each row of a group (grp_j's, if back) the nearest two rows of the other that a forest finds among about `checks` a block; staged.

    looked_at: how many distances it took. Trees hang on the seed, the group and its rows alone.
    """
    packed, packed_at = laid_out(blocks_of(features, block))
    kind = packed.schema["store"].dataType.simpleString()
    spark = features.sparkSession

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row a block: its rows, and of its trees the splits, the order of rows by leaves and where each leaf ends."""
        for batch in batches:
            for b in batch.to_pylist():
                ids, x = np.frombuffer(b["ids"], "<i8"), np.frombuffer(b["x"], "<f8").reshape(b["n"], -1)
                order = np.argsort(ids)  # rows of a block come in any order
                ids, x = ids[order], x[order]
                out = []
                for t in range(trees):
                    dims, cuts, at = grown(x, leaf, np.random.default_rng([seed, t, zlib.crc32(f"{b['store']}/{b['grp']}/{b['blk']}".encode())]))
                    out.append((dims, cuts, np.argsort(at, kind="stable").astype(np.int32), np.bincount(at, minlength=len(dims) + 1).cumsum().astype(np.int32)))
                cols = [pa.array([b[c]], batch.schema.field(c).type) for c in ("store", "grp", "blk")]
                yield pa.RecordBatch.from_arrays([*cols, *[pa.array([v.tobytes()], pa.binary()) for v in (ids, x, *[np.concatenate(v) for v in zip(*out, strict=True)])]], ["store", "grp", "blk", "ids", "x", "dims", "cuts", "rows", "ends"])

    index, index_at = laid_out(packed.mapInArrow(grow, f"store {kind}, grp long, blk long, ids binary, x binary, dims binary, cuts binary, rows binary, ends binary"))

    def search(q: np.ndarray, to: dict) -> tuple[np.ndarray, ...]:
        read = lambda c, kind: np.frombuffer(to[c].as_buffer(), kind)
        ids = read("ids", "<i8")
        x, (dims, cuts, rows, ends) = read("x", "<f8").reshape(len(ids), -1), (read(c, k).reshape(trees, -1) for c, k in (("dims", np.int32), ("cuts", np.float64), ("rows", np.int32), ("ends", np.int32)))
        leaves, every = ends.shape[1], np.concatenate([leaf_bounds(q, *t) for t in zip(dims, cuts, strict=True)], 1)
        m = min(max(1, checks // leaf), every.shape[1])
        where = (np.argpartition(every, m - 1, 1)[:, :m] if m < every.shape[1] else np.broadcast_to(np.arange(m), (len(q), m))).ravel()
        order = np.argsort(where, kind="stable")
        start = np.flatnonzero(np.r_[True, where[order][1:] != where[order][:-1]])
        near, far, took = np.full((len(where), 2), -1), np.full((len(where), 2), np.inf), np.zeros(len(where), np.int64)
        for a, b in zip(start, np.r_[start[1:], len(where)], strict=True):
            visits, (t, k) = order[a:b], divmod(int(where[order[a]]), leaves)
            own = rows[t, ends[t, k - 1] if k else 0 : ends[t, k]]
            if len(own):
                near[visits], far[visits] = _two(q[visits // m], x[own], ids[own])
                took[visits] = len(own)
        # trees may find one row twice
        near, far = near.reshape(len(q), -1), far.reshape(len(q), -1)
        far[np.isnan(far)] = np.inf
        d = far.min(1)
        best = np.where((far == d[:, None]) & (near >= 0), near, np.iinfo(np.int64).max).min(1)
        second = np.where(near != best[:, None], far, np.inf).min(1)
        return np.where(d < np.inf, best, -1), d, second, took.reshape(len(q), -1).sum(1)

    merged = nearest_by_blocks(packed, index, search, "store" in features.columns)
    gone(spark, packed_at)
    gone(spark, index_at)
    return merged
