"""Joint adjustment of layouts of any size: Levenberg-Marquardt steps by block conjugate gradients over rows.

Each pair of images gives, by an Arrow kernel, its 16 x 16 block of the normal equations and
its gradient. Blocks on the diagonal are summed by image; those beside it stay rows (to,
from, 8 x 8). A step is solved by conjugate gradients whose vectors are tables of eight
numbers an image: a product sends each block its image's numbers, sums by image, and leaves
the scalars of the next step as sums, one job an iteration. The preconditioner is each image's own
block, inverted. The driver sees scalars only, so a store may have any number of images.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from mosaiq.kernels import fit
from mosaiq.operators.graph import FEW, gone, kept, looked_up

SYSTEM = "store string, i long, j long, aii array<double>, ajj array<double>, aij array<double>, gi array<double>, gj array<double>, cost double, sq double, n long, ok boolean"


def _rows(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _lists(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))


def sampled_pairs(pairs: DataFrame, most: int = 600) -> DataFrame:
    """store, i, j, w, pts: up to `most` correspondences of each pair, spread over the image, and its weight; pairs of under four are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [fit.sampled(r["store"], r["i"], r["j"], np.frombuffer(r["pts"] or b"").reshape(-1, 4), r["ncc"] or 0.0, most) for r in batch.to_pylist()]
            keep = pa.array([k for k, x in enumerate(out) if x is not None], pa.int64())
            some = [x for x in out if x is not None]
            yield pa.RecordBatch.from_arrays([*[batch.column(c).take(keep) for c in ("store", "i", "j")], pa.array([w for _, w in some], pa.float64()), pa.array([p.tobytes() for p, _ in some], pa.binary())], ["store", "i", "j", "w", "pts"])

    return pairs.select("store", F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), "pts", F.col("ncc").cast("double").alias("ncc")).mapInArrow(run, "store string, i long, j long, w double, pts binary")


def linearised(pairs: DataFrame, places: DataFrame, huber: float, few: int = FEW) -> DataFrame:
    """The normal equations of each pair (sampled_pairs) under places (node, h); `ok` is false where a homography has no inverse."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            a, g, tail = np.zeros((n, 16, 16)), np.zeros((n, 16)), np.zeros((n, 3))
            ok = np.zeros(n, bool)
            hi, hj = (_rows(batch.column(c), 9).reshape(-1, 3, 3) for c in ("hi", "hj"))
            for k, (pts, w) in enumerate(zip(batch.column("pts").to_pylist(), batch.column("w").to_pylist(), strict=True)):
                q = np.frombuffer(pts).reshape(-1, 4)
                found = fit.pair_system(hi[k], hj[k], q[:, :2], q[:, 2:], w, huber)
                if found is not None:
                    a[k], g[k], *rest = found
                    tail[k], ok[k] = rest, True
            blocks = [a[:, :8, :8], a[:, 8:, 8:], a[:, :8, 8:]]
            cols = [*[batch.column(c) for c in ("store", "i", "j")], *[_lists(np.ascontiguousarray(b).reshape(n, 64)) for b in blocks], _lists(np.ascontiguousarray(g[:, :8])), _lists(np.ascontiguousarray(g[:, 8:])), pa.array(tail[:, 0]), pa.array(tail[:, 1]), pa.array(tail[:, 2].astype(np.int64)), pa.array(ok)]
            yield pa.RecordBatch.from_arrays(cols, [c.split()[0] for c in SYSTEM.split(", ")])

    end = lambda s: places.select(F.col("node").alias(s), F.col("h").alias(f"h{s}"))
    both = looked_up(looked_up(pairs, ["i"], end("i"), few), ["j"], end("j"), few).where("hi is not null and hj is not null")
    return both.mapInArrow(run, SYSTEM)


def _summed(df: DataFrame, key: str, **widths: int) -> DataFrame:
    """Arrays of some widths, summed place by place over equal keys."""
    flat = df.groupBy(key).agg(*[F.sum(F.col(c)[k]).alias(f"{c}_{k}") for c, n in widths.items() for k in range(n)])
    return flat.select(key, *[F.array(*[F.col(f"{c}_{k}") for k in range(n)]).alias(c) for c, n in widths.items()])


STATE = "node long, a array<double>, inv array<double>, x array<double>, r array<double>, p array<double>"


def _start(damp: float, k: int):
    """(node, a, g) to the first vectors: the damped block and its inverse, x = 0, r = -g, p = the preconditioned r."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, g = _rows(batch.column("a"), k * k).reshape(-1, k, k).copy(), _rows(batch.column("g"), k)
                d = np.arange(k)
                unit = np.sqrt(np.maximum(a[:, d, d], 1e-30))
                a[:, d, d] += damp * unit**2
                scale = unit[:, :, None] * unit[:, None, :]
                inv = np.linalg.pinv(a / scale, hermitian=True) / scale
                p = np.einsum("nij,nj->ni", inv, -g)
                yield pa.RecordBatch.from_arrays([batch.column("node"), *[_lists(np.ascontiguousarray(v).reshape(len(g), -1)) for v in (a, inv, np.zeros_like(g), -g, p)]], ["node", "a", "inv", "x", "r", "p"])

    return run


def _product(k: int):
    """(to, m, p) to (to, v): what blocks give to each row of unknowns, summed within a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                to, at = np.unique(batch.column("to").to_numpy(), return_inverse=True)
                v = np.zeros((len(to), k))
                np.add.at(v, at, np.einsum("nij,nj->ni", _rows(batch.column("m"), k * k).reshape(-1, k, k), _rows(batch.column("p"), k)))
                yield pa.RecordBatch.from_arrays([pa.array(to), _lists(v)], ["to", "v"])

    return run


def _measured(k: int):
    """The state with y = A p, and this row's part of the scalars that the next step needs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, inv = (_rows(batch.column(c), k * k).reshape(-1, k, k) for c in ("a", "inv"))
                r, p, v = (_rows(batch.column(c), k) for c in ("r", "p", "v"))
                y = np.einsum("nij,nj->ni", a, p) + v
                z, w = np.einsum("nij,nj->ni", inv, r), np.einsum("nij,nj->ni", inv, y)
                dots = [(p * y).sum(1), (r * z).sum(1), (y * z).sum(1), (y * w).sum(1)]
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("node", "a", "inv", "x", "r", "p")], _lists(y), *map(pa.array, dots)], ["node", "a", "inv", "x", "r", "p", "y", "py", "rz", "yz", "yw"])

    return run


def _moved(alpha: float, beta: float, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                inv = _rows(batch.column("inv"), k * k).reshape(-1, k, k)
                x, r, p, y = (_rows(batch.column(c), k) for c in ("x", "r", "p", "y"))
                r = r - alpha * y
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("node", "a", "inv")], *map(_lists, (x + alpha * p, r, np.einsum("nij,nj->ni", inv, r) + beta * p))], ["node", "a", "inv", "x", "r", "p"])

    return run


def solved(diag: DataFrame, off: DataFrame, damp: float = 0.0, *, width: int = 8, tolerance: float = 1e-3, least: float = 0.0, most: int = 200, few: int = FEW) -> tuple[DataFrame, int]:
    """(node, x) with (A + damp * diag A) x = -g, and the iterations it took.

    A row stands for `width` unknowns. diag: node, a (width x width), g; off: to, from, m; both staged. A is positive definite.
    It ends when the preconditioned residual has fallen by `tolerance`, or to `least`.
    """
    spark = diag.sparkSession
    state, path, first = diag.mapInArrow(_start(damp, width), STATE), None, None
    zero = F.array(*[F.lit(0.0)] * width)
    for done in range(most + 1):
        p = state.select(F.col("node").alias("from"), "p")
        # vectors that are small go to the blocks, or else blocks and vectors shuffle
        near = looked_up(off, ["from"], p, few).where("p is not null").select("to", "m", "p")
        v = _summed(near.mapInArrow(_product(width), "to long, v array<double>"), "to", v=width).withColumnRenamed("to", "node")
        now, new = kept(state.join(v, "node", "left").withColumn("v", F.coalesce("v", zero)).mapInArrow(_measured(width), STATE + ", y array<double>, py double, rz double, yz double, yw double"))
        s = now.agg(*[F.sum(c).alias(c) for c in ("py", "rz", "yz", "yw")]).first()
        if path is not None:
            gone(spark, path)
        path, first = new, first or s.rz
        if done == most or not s.rz or not s.py > 0 or s.rz <= max(tolerance**2 * first, least):
            return now.select("node", "x"), done
        alpha = s.rz / s.py
        # the next r'z is known from sums that are here already
        beta = max(0.0, (s.rz - 2 * alpha * s.yz + alpha * alpha * s.yw) / s.rz)
        state = now.mapInArrow(_moved(alpha, beta, width), STATE)


def adjusted(places: DataFrame, pairs: DataFrame, *, huber: float = 3.0, most: int = 600, rounds: int = 30, tolerance: float = 1e-2, few: int = FEW) -> tuple[DataFrame, DataFrame]:
    """(node, store, h), moved to the least Huber cost of all pairs' transfer errors, and (store, rms_before, rms_after, accepted).

    places: store, node, h, fixed (the anchor of each layout); pairs: store, i, j (nodes),
    pts, ncc. A store that would end with a larger error than it began with keeps its
    places. A step that makes a homography singular is refused, as one that costs more.
    """
    spark = places.sparkSession
    points, points_path = kept(sampled_pairs(pairs, most))
    here, here_path = kept(places.select("store", "node", "h", "fixed"))
    free = here.where("not fixed").select("node")
    lin, lin_path = kept(linearised(points, here, huber, few))
    total = lambda t: t.agg(F.sum("cost").alias("cost"), F.coalesce(F.bool_and("ok"), F.lit(True)).alias("ok")).first()
    rms = lambda t, name: t.where("ok").groupBy("store").agg(F.sqrt(F.sum("sq") / F.sum("n") * 2).alias(name))
    before, _ = kept(rms(lin, "rms_before"))
    cost, damp, start = total(lin).cost or 0.0, 1e-4, here
    for _ in range(rounds if cost else 0):
        sides = lin.where("ok").select(F.explode(F.array(F.struct(F.col("i").alias("node"), F.col("aii").alias("a"), F.col("gi").alias("g")), F.struct(F.col("j").alias("node"), F.col("ajj").alias("a"), F.col("gj").alias("g")))).alias("e")).select("e.*")
        diag, diag_path = kept(_summed(sides.join(free.hint("merge"), "node"), "node", a=64, g=8))
        turned = F.array(*[F.col("aij")[8 * c + r] for r in range(8) for c in range(8)])
        off = lin.where("ok").select(F.explode(F.array(F.struct(F.col("i").alias("to"), F.col("j").alias("from"), F.col("aij").alias("m")), F.struct(F.col("j").alias("to"), F.col("i").alias("from"), turned.alias("m")))).alias("e")).select("e.*")
        off, off_path = kept(off.join(free.withColumnRenamed("node", "to").hint("merge"), "to").join(free.withColumnRenamed("node", "from").hint("merge"), "from").select("to", "from", "m"))
        gain = None
        for _ in range(8):
            # a step of this size would gain nothing that can be told from the cost
            x, took = solved(diag, off, damp, tolerance=tolerance, least=1e-8 * cost + 1e-9, few=few)
            if not took:
                break
            step = F.transform(F.arrays_zip("h", F.concat("x", F.array(F.lit(0.0)))), lambda z: z["h"] + z["1"])
            trial, trial_path = kept(here.join(x, "node", "left").select("store", "node", F.when(F.col("x").isNull(), F.col("h")).otherwise(step).alias("h"), "fixed"))
            new, new_path = kept(linearised(points, trial, huber, few))
            t = total(new)
            if t.ok and t.cost < cost:
                gain = (cost - t.cost) / cost
                cost, damp = t.cost, max(damp / 10, 1e-10)
                gone(spark, lin_path)
                if here is not start:
                    gone(spark, here_path)
                here, here_path, lin, lin_path = trial, trial_path, new, new_path
                break
            damp *= 10
            gone(spark, trial_path)
            gone(spark, new_path)
        gone(spark, diag_path)
        gone(spark, off_path)
        if gain is None or gain < 1e-7:
            break
    stats = before.join(rms(lin, "rms_after"), "store", "left").withColumn("accepted", F.coalesce(F.col("rms_after") <= F.col("rms_before"), F.lit(False)))
    stats, _ = kept(stats)
    refused = stats.where("not accepted").select("store", F.lit(True).alias("refused"))
    old = start.select("node", F.col("h").alias("h0"))
    out = here.join(F.broadcast(refused), "store", "left").join(old, "node").select("node", "store", F.when(F.col("refused"), F.col("h0")).otherwise(F.col("h")).alias("h"))
    out = kept(out)[0]
    gone(spark, points_path)
    return out, stats
