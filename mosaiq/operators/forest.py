"""Maximum spanning forests, and homographies composed along their trees, over graphs of any size.

Edges are compared by (weight, -a, -b), so no two are equal and every spanning forest that
is best is the same one. Each task first drops what a heavier cycle of its own edges
closes; such an edge is in no best forest. What is left, if it is little, is joined up in
one task. More goes through Boruvka rounds: each component's best edge is a partial maximum;
components that point at each other through one edge make the smaller one a root; pointers
are doubled until all end at roots; edges and nodes move to their roots, and each task drops
anew what a heavier cycle of its edges closes among components.

A pointer carries the homography from its component's frame to the next one's, and doubling
multiplies them, so a chain of d images takes log d joins. Edges carry theirs between
components, so nothing is ever recomposed from the beginning.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from mosaiq.functions.homography import inverse, product
from mosaiq.operators.graph import FEW, gone, kept, looked_up

#: Edges that a task holds while it drops what closes a cycle.
CHUNK = 1 << 20
ONE = [1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0]


def kruskal(a: np.ndarray, b: np.ndarray, weight: np.ndarray, ends: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """Places of the edges of the best forest of some edges, the best first; ends: the nodes that they join, if not a and b."""
    nodes, at = np.unique(np.concatenate(ends or (a, b)), return_inverse=True)
    x, y, root, out = at[: len(a)].tolist(), at[len(a) :].tolist(), list(range(len(nodes))), []
    for k in np.lexsort((b, a, -weight)).tolist():
        p, q = x[k], y[k]
        while root[p] != p:
            root[p] = p = root[root[p]]
        while root[q] != q:
            root[q] = q = root[root[q]]
        if p != q:
            root[max(p, q)] = min(p, q)
            out.append(k)
    return np.array(out, np.int64)


def _thinner(x: str = "a", y: str = "b"):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The best forest over the nodes x and y of a task's edges, a chunk at a time with what earlier chunks left."""
        held: list[pa.RecordBatch] = []
        n = 0

        def best() -> pa.Table:
            t = pa.Table.from_batches(held)
            a, b, *ends = (t[c].to_numpy() for c in ("a", "b", x, y))
            return t.take(pa.array(kruskal(a, b, t["weight"].to_numpy(), tuple(ends)))).combine_chunks()

        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n > CHUNK:
                t = best()
                if 2 * t.num_rows > CHUNK:  # hardly any cycles among so many nodes
                    yield from t.to_batches(1 << 16)
                    held, n = [], 0
                else:
                    held, n = t.to_batches(), t.num_rows
        if n:
            yield from best().to_batches(1 << 16)

    return run


def _nine(h: Column) -> list[Column]:
    return [h[k] for k in range(9)]


def _scaled(h: list[Column]) -> Column:
    """Nine columns as an array with h33 = 1."""
    return F.transform(F.array(*h), lambda v: F.try_divide(v, h[8]))


def _times(a: str, b: str) -> Column:
    return _scaled(product(_nine(F.col(a)), _nine(F.col(b))))


def _back(h: str) -> Column:
    return F.array(*inverse(_nine(F.col(h))))


def spanning(edges: DataFrame, *, few: int = FEW, alone: int = FEW, placed: bool = False) -> tuple[DataFrame, DataFrame | None]:
    """(tree, places): the edges a, b, weight of the best spanning forest; with `placed`, node, root and h from each node's frame to its root's.

    edges: a < b (long), weight (double), and, with `placed`, h (array of nine): from a's
    frame to b's. Of edges that repeat with one weight any one counts. Nodes without edges
    are not listed. A graph whose edges, thinned by tasks, are `alone` at most is joined up
    in one task if nothing is to be placed; tables of up to `few` rows are broadcast. No
    edges: no rows. An h that has no
    inverse leaves nulls in the places beyond it.
    """
    spark = edges.sparkSession
    own = ["a", "b", "weight", *(["h"] if placed else [])]
    rows = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"), F.col("weight").cast("double").alias("weight"), *(["h"] if placed else [])).where("a <> b")
    kind = "a long, b long, weight double" + ", h array<double>" * placed
    now, path = kept(rows.mapInArrow(_thinner(), kind))
    total = now.count()
    if total <= alone and not placed:
        return kept(now.coalesce(1).mapInArrow(_thinner(), kind))[0], None
    nodes = node_path = None
    if placed:
        nodes, node_path = kept(now.select(F.explode(F.array("a", "b")).alias("node")).distinct().select("node", F.col("node").alias("root"), F.array(*map(F.lit, ONE)).alias("h")))
    # ca, cb: the components of a and b; h: from ca's frame to cb's
    now = now.select(*own, F.col("a").alias("ca"), F.col("b").alias("cb"))
    trees: list[DataFrame] = []
    while total:
        order = ["weight", (-F.col("a")).alias("na"), (-F.col("b")).alias("nb")]
        out = lambda c, o, h: F.struct(F.col(c).alias("c"), F.struct(*order, F.col(o).alias("to"), *([h.alias("t")] if placed else [])).alias("best"))
        ends = now.select(F.explode(F.array(out("ca", "cb", F.col("h") if placed else None), out("cb", "ca", _back("h") if placed else None))).alias("e")).select("e.*")
        best, best_path = kept(ends.groupBy("c").agg(F.max("best").alias("best")))
        n = best.count()
        trees.append(kept(best.select((-F.col("best.na")).alias("a"), (-F.col("best.nb")).alias("b"), F.col("best.weight").alias("weight")).distinct())[0])
        step = best.select("c", F.col("best.to").alias("to"), *([F.col("best.t").alias("t")] if placed else []))
        ahead = step.select(F.col("c").alias("to"), F.col("to").alias("next"))
        root = (F.col("next") == F.col("c")) & (F.col("c") < F.col("to"))
        mine = [F.when(root, F.array(*map(F.lit, ONE))).otherwise(F.col("t")).alias("t")] if placed else []
        points, point_path = kept(looked_up(step, ["to"], ahead, few, n).select("c", F.when(root, F.col("c")).otherwise(F.col("to")).alias("to"), *mine))
        gone(spark, best_path)
        for _ in itertools.count():
            ahead = points.select(F.col("c").alias("to"), F.col("to").alias("next"), *([F.col("t").alias("u")] if placed else []))
            moved = points
            for _ in range(1 if placed or n > few else 3):  # where pointers are broadcast, two doublings at once
                both = looked_up(moved, ["to"], ahead, few, n)
                moved = both.select("c", F.col("next").alias("to"), *([_times("u", "t").alias("t")] if placed else []), (F.col("next") != F.col("to")).alias("moved"))
            after, after_path = kept(moved)
            gone(spark, point_path)
            points, point_path = after.drop("moved"), after_path
            if not after.where("moved").limit(1).count():
                break
        end = lambda s: points.select(F.col("c").alias(f"c{s}"), F.col("to").alias(f"r{s}"), *([F.col("t").alias(f"t{s}")] if placed else []))
        there = looked_up(looked_up(now, ["ca"], end("a"), few, n), ["cb"], end("b"), few, n).where("ra <> rb")
        if placed:
            there = there.withColumn("ta", _back("ta")).withColumn("h", _times("h", "ta")).withColumn("h", _times("tb", "h"))
            nodes, old = kept(looked_up(nodes.withColumnRenamed("root", "ca"), ["ca"], end("a"), few, n).select("node", F.coalesce("ra", "ca").alias("root"), F.when(F.col("ra").isNull(), F.col("h")).otherwise(_times("ta", "h")).alias("h")))  # whole trees have no pointers any more
            gone(spark, node_path)
            node_path = old
        # each task drops again what a heavier cycle closes, now among components: of many edges hardly more stay than there are components
        after, after_path = kept(there.select(*own, F.col("ra").alias("ca"), F.col("rb").alias("cb")).mapInArrow(_thinner("ca", "cb"), kind + ", ca long, cb long"))
        gone(spark, path)
        gone(spark, point_path)
        now, path, total = after, after_path, after.count()
    tree = rows.select("a", "b", "weight").limit(0)
    for t in trees:
        tree = tree.unionByName(t)
    return tree, nodes


def framed(places: DataFrame, anchors: DataFrame, few: int = FEW) -> DataFrame:
    """node, anchor, h from each node's frame to its anchor's: places (node, root, h) of spanning(), anchors (anchor): one node of each tree that is wanted."""
    at = looked_up(anchors.select("anchor", F.col("anchor").alias("node")), ["node"], places, few).select("root", "anchor", F.col("h").alias("to_root"))
    both = looked_up(places, ["root"], at, few).where("anchor is not null")
    return both.withColumn("back", _back("to_root")).select("node", "anchor", F.when(F.col("node") == F.col("anchor"), F.array(*map(F.lit, ONE))).otherwise(_times("back", "h")).alias("h"))
