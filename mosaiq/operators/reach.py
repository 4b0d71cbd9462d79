"""Hop distances, eccentricities and anchors of graphs of any size.

Distances grow from sources as a table of (source, node, d), a level a round: the frontier
meets edges by a join, and what an anti-join finds in the two levels before is dropped (in
an undirected graph a neighbour is one level off at most). No task holds a graph, nor all
that one source reaches.

An anchor does not need all eccentricities. Distances from a few sources bound those of all
other nodes from below (max of d and ecc - d) and above (ecc + d); a node whose lower bound
already loses to the best node that is known is never a source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from mosaiq.operators.graph import FEW, gone, kept, looked_up


def distances(edges: DataFrame, sources: DataFrame, few: int = FEW) -> DataFrame:
    """source, node, d: hops from each source to all that it reaches, itself (0) included.

    edges: a, b, both ways and staged; sources: source (distinct). A frontier of up to
    `few` rows is broadcast, so edges stay where they are; a larger one shuffles.
    """
    levels, d = [kept(sources.select("source", F.col("source").alias("node"), F.lit(0).cast("long").alias("d")))[0]], 0
    while n := levels[-1].count():
        front = levels[-1].select("source", F.col("node").alias("a"))
        ahead = edges.join(F.broadcast(front) if n <= few else front, "a").select("source", F.col("b").alias("node")).distinct()
        for seen in levels[-2:]:
            ahead = ahead.join(seen.select("source", "node"), ["source", "node"], "left_anti")
        d += 1
        levels.append(kept(ahead.select("source", "node", F.lit(d).cast("long").alias("d")))[0])
    out = levels[0]
    for more in levels[1:-1]:
        out = out.unionByName(more)
    return out


def eccentricities(edges: DataFrame, few: int = FEW) -> DataFrame:
    """node, ecc, degree, component_size of every node: the largest hop distance inside its component. edges: a, b, both ways, distinct."""
    edges, _ = kept(edges.select("a", "b").distinct())
    degree = edges.groupBy(F.col("a").alias("node")).agg(F.count("*").alias("degree"))
    far = distances(edges, edges.select(F.col("a").alias("source")).distinct(), few)
    far = far.groupBy(F.col("source").alias("node")).agg(F.max("d").alias("ecc"), F.count("*").alias("component_size"))
    return far.join(degree, "node").select("node", "ecc", "degree", "component_size")


def anchors(nodes: DataFrame, edges: DataFrame, few: int = FEW, spread: int = 4) -> DataFrame:
    """component, anchor, ecc, degree, strength: of each component the node of the least eccentricity; ties: more edges, more strength, the smaller node.

    nodes: node, component (of several nodes or one); edges: a, b, strength (double), both
    ways, one row a pair. Each round takes up to 2 * `spread` sources a component: those
    that may be far out, which raise the others' lower bounds, and those that may win.
    """
    spark = nodes.sparkSession
    graph, graph_path = kept(edges.select("a", "b"))
    power = edges.groupBy(F.col("a").alias("node")).agg(F.count("*").alias("degree"), F.sum("strength").alias("strength"))
    start = nodes.select("component", "node").join(power, "node", "left").select("component", "node", F.coalesce("degree", F.lit(0)).alias("degree"), F.coalesce("strength", F.lit(0.0)).alias("strength"))
    top = F.lit(2**62)
    # a node alone has eccentricity 0, all others 1 at least
    state, path = kept(start.withColumn("lo", F.when(F.col("degree") > 0, 1).otherwise(0).cast("long")).withColumn("hi", F.when(F.col("degree") > 0, top).otherwise(0).cast("long")))
    rank = lambda bound: F.struct((-F.col(bound)).alias("e"), "degree", "strength", (-F.col("node")).alias("n"))
    found = None
    while True:
        best = state.where("lo = hi").groupBy("component").agg(F.max(rank("hi")).alias("best"))
        best = best if found is None else best.unionByName(found).groupBy("component").agg(F.max("best").alias("best"))
        found, _ = kept(best)
        # who may still win: an optimist's rank is above the best that is certain
        left, left_path = kept(looked_up(state.where("lo < hi"), ["component"], found, few).where(F.col("best").isNull() | (rank("lo") > F.col("best"))).drop("best"))
        gone(spark, path)
        if not left.limit(1).count():
            gone(spark, graph_path)
            return found.select("component", (-F.col("best.n")).alias("anchor"), (-F.col("best.e")).alias("ecc"), F.col("best.degree").alias("degree"), F.col("best.strength").alias("strength"))
        part = F.pmod(F.xxhash64("node"), F.lit(spread))
        picks = [F.max(F.struct(F.col("hi").alias("k"), "node")), F.max(F.struct((-F.col("lo")).alias("k"), "degree", "strength", "node"))]
        picked = left.groupBy("component", part.alias("p")).agg(*[p.alias(f"s{k}") for k, p in enumerate(picks)])
        sources = kept(picked.select(F.explode(F.array("s0.node", "s1.node")).alias("source")).distinct())[0]
        far, far_path = kept(distances(graph, sources, few))
        ecc = far.groupBy("source").agg(F.max("d").alias("ecc"))
        told = looked_up(far, ["source"], kept(ecc)[0], few)
        bounds = told.groupBy("node").agg(F.max(F.greatest(F.col("d"), F.col("ecc") - F.col("d"))).alias("l"), F.min(F.col("ecc") + F.col("d")).alias("h"), F.max(F.when(F.col("d") == 0, F.col("ecc"))).alias("x"))
        state, path = kept(looked_up(left, ["node"], kept(bounds)[0], few).select("component", "node", "degree", "strength", F.coalesce("x", F.greatest("lo", F.coalesce("l", F.lit(0)))).alias("lo"), F.coalesce("x", F.least("hi", F.coalesce("h", top))).alias("hi")))
        gone(spark, left_path)
        gone(spark, far_path)
