"""One query an operator, with the SQL that must agree with it.

The tables hold no photographs, so each operator runs on a relation of the same shape:
embeddings stand for descriptors (label: image), nations for images, trade between
nations for matched pairs, line items for points and modes, events for pixels.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from mosaiq.functions.homography import corners, dehomogenised, implausible, inverse, product, rescaled, to_render
from mosaiq.operators.compose import from_work
from mosaiq.operators.evaluate import area_ratio, content_box, coverage, guarded_correlation, local_agreement, local_summary, overlap_fraction, pair_scores as scores_of_pairs, pooled_errors as pooled, quantiles, residual_metrics
from mosaiq.operators.forest import framed, spanning
from mosaiq.operators.graph import both_ways, components, kept, looked_up, ranked, ranked_within
from mosaiq.operators.matching import acceptance, best_effort, best_mode, confident, demo_pair, edge_score, enumerated, gathered, grid_sample, marked_modes, mutual_matches, replaced, rescue_reason, root_normalised, sampled, viable
from mosaiq.operators.neighbours import forest_matches
from mosaiq.operators.pairing import all_residuals, centroid, scorable, transfer
from mosaiq.operators.reach import anchors, eccentricities
from mosaiq.sources.images import by_short_name

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trade(spark: SparkSession, sf: str) -> DataFrame:
    """a < b (nations), n, qty, disc: trade between nations. The small tables are 25 to a few thousand rows per nation; Spark picks the joins."""
    items = table(spark, sf, "lineitem").select("l_orderkey", "l_suppkey", "l_quantity", "l_discount")
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    buyers = table(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").cast("long").alias("x"))
    sellers = table(spark, sf, "supplier").select("s_suppkey", F.col("s_nationkey").cast("long").alias("y"))
    j = items.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(buyers, F.col("o_custkey") == F.col("c_custkey")).join(sellers, F.col("l_suppkey") == F.col("s_suppkey"))
    return j.where("x <> y").groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.count("*").alias("n"), F.sum("l_quantity").alias("qty"), F.avg("l_discount").alias("disc"))


TRADE = """trade AS (SELECT least(c_nationkey, s_nationkey)::BIGINT AS a, greatest(c_nationkey, s_nationkey)::BIGINT AS b, count(*) AS n, sum(l_quantity) AS qty, avg(l_discount) AS disc
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey WHERE c_nationkey <> s_nationkey GROUP BY 1, 2)"""


def r6(c: Column) -> Column:
    return F.round(c, 6)


@query("""WITH e AS (SELECT label AS g, vec_id AS id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
d AS (SELECT a.g AS gi, b.g AS gj, a.id AS i, b.id AS j, list_distance(a.v, b.v) AS d FROM e a JOIN e b ON a.g <> b.g),
f AS (SELECT *, row_number() OVER (PARTITION BY gi, gj, i ORDER BY d, j) AS r, lead(d) OVER (PARTITION BY gi, gj, i ORDER BY d, j) AS d2 FROM d),
k AS (SELECT gi, gj, i, j, d FROM f WHERE r = 1 AND d < 0.95 * d2)
SELECT x.gi::BIGINT AS group_i, x.gj::BIGINT AS group_j, x.i AS id_i, x.j AS id_j, round(x.d, 6) AS d FROM k x JOIN k y ON x.gi = y.gj AND x.gj = y.gi AND x.i = y.j AND x.j = y.i WHERE x.gi < x.gj""")
def knn_ratio_mutual(spark, sf):
    e = table(spark, sf, "embeddings").where("label is not null and embedding is not null")
    m = mutual_matches(e.select(F.col("label").cast("long").alias("grp"), F.col("vec_id").alias("id"), F.col("embedding").alias("desc")), 0.95)
    return m.withColumn("d", r6("d"))


def knn_forest(spark, sf):
    """The matches of knn_ratio_mutual that a forest of k-d trees finds: no SQL says which leaves it looks into (tests hold its recall)."""
    e = table(spark, sf, "embeddings").where("label is not null and embedding is not null")
    m = forest_matches(e.select(F.col("label").cast("long").alias("grp"), F.col("vec_id").alias("id"), F.col("embedding").alias("desc")), 0.95)
    return m.withColumn("d", r6("d"))


QUERIES["knn_forest"] = knn_forest


@query("""WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: abs(x::DOUBLE)) AS v FROM embeddings), p AS (SELECT vec_id, list_sum(v) + 1e-7 AS s, v, unnest(range(1, len(v) + 1)) AS k FROM e)
SELECT vec_id, (k - 1)::INT AS pos, round(sqrt(v[k] / s), 6) AS value FROM p""")
def root_normalise(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", F.posexplode(root_normalised(F.transform("embedding", lambda v: F.abs(v.cast("double"))))).alias("pos", "value"))
    return e.select("vec_id", "pos", r6("value").alias("value"))


H = (0.9, 0.1, 12.0, -0.05, 1.1, -7.0, 0.0004, 0.0002, 1.0)


@query(f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(({H[0]}::DOUBLE * x + {H[1]}::DOUBLE * y + {H[2]}::DOUBLE) / w, 6) AS px, round(({H[3]}::DOUBLE * x + {H[4]}::DOUBLE * y + {H[5]}::DOUBLE) / w, 6) AS py
FROM (SELECT *, l_quantity AS x, l_linenumber::DOUBLE AS y, {H[6]}::DOUBLE * l_quantity + {H[7]}::DOUBLE * l_linenumber + 1.0 AS w FROM lineitem)""")
def warp_points(spark, sf):
    x, y = dehomogenised([F.lit(v) for v in H], F.col("l_quantity"), F.col("l_linenumber").cast("double"))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", r6(x).alias("px"), r6(y).alias("py"))


@query("""SELECT p_partkey, round(hx, 6) AS px, round(hy, 6) AS py FROM (SELECT p_partkey, (x + 3) / (CASE WHEN abs(w) < 0.5 THEN sign(w) * 0.5 + 0.0005 ELSE w END) AS hx, (y - 3) / (CASE WHEN abs(w) < 0.5 THEN sign(w) * 0.5 + 0.0005 ELSE w END) AS hy
FROM (SELECT p_partkey, p_size::DOUBLE AS x, p_retailprice AS y, 0.03::DOUBLE * (p_size - 25) AS w FROM part))""")
def warp_guarded(spark, sf):
    one, zero = F.lit(1.0), F.lit(0.0)
    h = [one, zero, F.lit(3.0), zero, one, F.lit(-3.0), F.lit(0.03), zero, F.lit(-0.75)]
    x, y = dehomogenised(h, F.col("p_size").cast("double"), F.col("p_retailprice"), guard=0.5)
    return table(spark, sf, "part").select("p_partkey", r6(x).alias("px"), r6(y).alias("py"))


#: A translation and scale an image (part), in stores of equal size class.
@query("""WITH h AS (SELECT p_size % 10 AS store, 0.5 + p_size / 50.0::DOUBLE AS s, (p_partkey % 97 * 30)::DOUBLE AS tx, (p_partkey % 31 * 40)::DOUBLE AS ty FROM part),
c AS (SELECT store, s * 2.0 * x + tx * 2.0 AS px, s * 2.0 * y + ty * 2.0 AS py FROM h, (VALUES (0.0::DOUBLE, 0.0::DOUBLE), (1600.0, 0.0), (1600.0, 900.0), (0.0, 900.0)) v(x, y)),
b AS (SELECT store, floor(min(px)) AS x0, floor(min(py)) AS y0, ceil(max(px)) AS x1, ceil(max(py)) AS y1 FROM c GROUP BY store)
SELECT store, x0::BIGINT AS x0, y0::BIGINT AS y0, (x1 - x0)::BIGINT AS width, (y1 - y0)::BIGINT AS height, round(CASE WHEN (x1 - x0) * (y1 - y0) > 20e6 THEN sqrt(20e6 / ((x1 - x0) * (y1 - y0))) ELSE 1.0 END, 6) AS shrink FROM b""")
def canvas_plan(spark, sf):
    s = F.lit(0.5) + F.col("p_size") / F.lit(50.0)
    zero, one = F.lit(0.0), F.lit(1.0)
    h = rescaled([s, zero, (F.col("p_partkey") % 97 * 30).cast("double"), zero, s, (F.col("p_partkey") % 31 * 40).cast("double"), zero, zero, one], F.lit(2.0))
    h = to_render(h, one, one, F.lit(1.0))
    h = [h[0] * 2, h[1], h[2], h[3], h[4] * 2, *h[5:]]
    pts = F.explode(F.array(*[F.struct(*[c.alias(n) for c, n in zip(dehomogenised(h, x, y), ("px", "py"), strict=True)]) for x, y in corners(F.lit(1600.0), F.lit(900.0))])).alias("p")
    c = table(spark, sf, "part").select((F.col("p_size") % 10).alias("store"), pts)
    b = c.groupBy("store").agg(F.floor(F.min("p.px")).alias("x0"), F.floor(F.min("p.py")).alias("y0"), F.ceil(F.max("p.px")).alias("x1"), F.ceil(F.max("p.py")).alias("y1"))
    area = ((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))).cast("double")
    return b.select("store", "x0", "y0", (F.col("x1") - F.col("x0")).alias("width"), (F.col("y1") - F.col("y0")).alias("height"), r6(F.when(area > 20e6, F.sqrt(F.lit(20e6) / area)).otherwise(1.0)).alias("shrink"))


@query("""WITH h AS (SELECT p_partkey, (1 + (p_partkey % 7 - 3) * 0.4)::DOUBLE AS a, ((p_size % 5 - 2) * 0.3)::DOUBLE AS b, (p_size * 3)::DOUBLE AS c, ((p_partkey % 3 - 1) * 0.5)::DOUBLE AS d, (1 + (p_size % 9 - 4) * 0.24)::DOUBLE AS e, -5.0::DOUBLE AS f, ((p_partkey % 11 - 5) * 0.0003)::DOUBLE AS g, ((p_size % 6 - 3) * 0.0002)::DOUBLE AS i FROM part),
q AS (SELECT p_partkey, g, i, c AS x0, f AS y0, (a * 1600 + c) / nullif(g * 1600 + 1, 0) AS x1, (d * 1600 + f) / nullif(g * 1600 + 1, 0) AS y1, (a * 1600 + b * 900 + c) / nullif(g * 1600 + i * 900 + 1, 0) AS x2, (d * 1600 + e * 900 + f) / nullif(g * 1600 + i * 900 + 1, 0) AS y2, (b * 900 + c) / nullif(i * 900 + 1, 0) AS x3, (e * 900 + f) / nullif(i * 900 + 1, 0) AS y3 FROM h),
s AS (SELECT *, (x1 - x0) * (y2 - y1) - (y1 - y0) * (x2 - x1) AS k0, (x2 - x1) * (y3 - y2) - (y2 - y1) * (x3 - x2) AS k1, (x3 - x2) * (y0 - y3) - (y3 - y2) * (x0 - x3) AS k2, (x0 - x3) * (y1 - y0) - (y0 - y3) * (x1 - x0) AS k3,
 abs(x0 * y1 - x1 * y0 + x1 * y2 - x2 * y1 + x2 * y3 - x3 * y2 + x3 * y0 - x0 * y3) / 2 AS area, sqrt((x1 - x0) ** 2 + (y1 - y0) ** 2) AS s0, sqrt((x2 - x1) ** 2 + (y2 - y1) ** 2) AS s1, sqrt((x3 - x2) ** 2 + (y3 - y2) ** 2) AS s2, sqrt((x0 - x3) ** 2 + (y0 - y3) ** 2) AS s3 FROM q)
SELECT p_partkey, CASE WHEN x1 IS NULL OR x2 IS NULL OR x3 IS NULL THEN 'non-finite corners' WHEN NOT ((k0 > 0 AND k1 > 0 AND k2 > 0 AND k3 > 0) OR (k0 < 0 AND k1 < 0 AND k2 < 0 AND k3 < 0)) THEN 'warped outline not convex' WHEN k0 < 0 THEN 'warp mirrors the image' WHEN NOT area > 0 THEN 'zero area'
 WHEN NOT (area / (1600.0 * 900) > 1 / 6.0::DOUBLE AND area / (1600.0 * 900) < 6) THEN 'area ratio' WHEN least(s0, s1, s2, s3) < 1e-6 OR greatest(s0, s1, s2, s3) > 12 * least(s0, s1, s2, s3) THEN 'sliver' WHEN greatest(abs(g), abs(i)) * sqrt(1600.0 * 1600 + 900.0 * 900) > 2 THEN 'extreme perspective' ELSE 'ok' END AS reason FROM s""")
def plausibility_gate(spark, sf):
    k, s = F.col("p_partkey"), F.col("p_size")
    d = lambda c: c.cast("double")
    h = [1 + d(k % 7 - 3) * 0.4, d(s % 5 - 2) * 0.3, d(s * 3), d(k % 3 - 1) * 0.5, 1 + d(s % 9 - 4) * 0.24, F.lit(-5.0), d(k % 11 - 5) * 0.0003, d(s % 6 - 3) * 0.0002, F.lit(1.0)]
    return table(spark, sf, "part").select("p_partkey", implausible(h, F.lit(1600.0), F.lit(900.0)).alias("reason"))


@query(f"WITH {TRADE} SELECT a, b, n, round(CASE WHEN disc > 0.02 THEN sqrt(n) * pow(greatest(disc * 10, 0), 2) ELSE 0 END, 6) AS score FROM trade")
def pair_scores(spark, sf):
    return trade(spark, sf).select("a", "b", "n", r6(edge_score(F.col("disc") > 0.02, F.col("n"), F.col("disc") * 10)).alias("score"))


@query(f"""WITH {TRADE}, e AS (SELECT a, b, n, qty / 1000.0 AS tx, n / 10.0::DOUBLE AS ty FROM trade)
SELECT a, b, n, round(tx, 6) AS tx, round(ty, 6) AS ty FROM (SELECT a, b, n, tx, ty FROM e UNION ALL SELECT b, a, n, -tx / 2, -ty / 2 FROM e)""")
def symmetric_edges(spark, sf):
    """Edges with homographies [2 0 tx; 0 2 ty; 0 0 1]; the reverse has the inverse's translation."""
    e = trade(spark, sf).withColumn("tx", F.col("qty") / 1000).withColumn("ty", F.col("n") / F.lit(10.0))
    zero, two = F.lit(0.0), F.lit(2.0)
    inv = inverse([two, zero, F.col("tx"), zero, two, F.col("ty"), zero, zero, F.lit(1.0)])
    out = both_ways(e, "a", "b", [("n", F.col("n"), F.col("n")), ("tx", F.col("tx"), inv[2]), ("ty", F.col("ty"), inv[5])])
    return out.select("a", "b", "n", r6("tx").alias("tx"), r6("ty").alias("ty"))


def strong(spark, sf, q: float) -> tuple[DataFrame, DataFrame]:
    """(trade, its share of the largest counts), staged once."""
    t, _ = kept(trade(spark, sf))
    return t, t.where(F.col("n") >= F.lit(t.agg(F.percentile("n", F.lit(q))).first()[0]))


STRONG = "{T}, s AS (SELECT * FROM trade WHERE n >= (SELECT quantile_cont(n, {q}) FROM trade)), u AS (SELECT a, b FROM s UNION SELECT b, a FROM s)"


@query(f"WITH RECURSIVE {STRONG.format(T=TRADE, q=0.95)}, r(x, y) AS (SELECT n_nationkey::BIGINT, n_nationkey::BIGINT FROM nation UNION SELECT r.x, u.b FROM r JOIN u ON r.y = u.a), c AS (SELECT x AS node, min(y) AS component FROM r GROUP BY x) SELECT node, component, count(*) OVER (PARTITION BY component) AS size FROM c")
def layout_components(spark, sf):
    _, e = strong(spark, sf, 0.95)
    nodes = table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("node"))
    c, _ = kept(components(nodes, e))
    size = kept(c.groupBy("component").agg(F.count("*").alias("size")))[0]
    return looked_up(c, ["component"], size).select("node", "component", "size")


@query(f"""WITH RECURSIVE {STRONG.format(T=TRADE, q=0.8)}, r(x, y, d) AS (SELECT DISTINCT a, a, 0 FROM u UNION SELECT r.x, u.b, r.d + 1 FROM r JOIN u ON r.y = u.a WHERE r.d < 25), m AS (SELECT x, y, min(d) AS d FROM r GROUP BY x, y)
SELECT x AS node, max(d)::BIGINT AS ecc, (SELECT count(*) FROM u WHERE u.a = x) AS degree FROM m GROUP BY x""")
def hop_eccentricity(spark, sf):
    return eccentricities(both_ways(strong(spark, sf, 0.8)[1], "a", "b", [])).select("node", "ecc", "degree")


@query(f"""WITH RECURSIVE {STRONG.format(T=TRADE, q=0.8)}, r(x, y, d) AS (SELECT DISTINCT a, a, 0 FROM u UNION SELECT r.x, u.b, r.d + 1 FROM r JOIN u ON r.y = u.a WHERE r.d < 25), m AS (SELECT x, y, min(d) AS d FROM r GROUP BY x, y),
k AS (SELECT x AS node, max(d) AS ecc, (SELECT count(*) FROM u WHERE u.a = x) AS degree, (SELECT sum(n) FROM s WHERE s.a = x OR s.b = x) AS strength, count(*) AS size FROM m GROUP BY x)
SELECT node AS anchor FROM k ORDER BY size DESC, ecc, degree DESC, strength DESC, node LIMIT 1""")
def layout_anchor(spark, sf):
    """Of the largest component, as the layout has only that."""
    _, e = strong(spark, sf, 0.8)
    both, _ = kept(both_ways(e, "a", "b", [("strength", F.col("n").cast("double"), F.col("n").cast("double"))]))
    nodes, _ = kept(components(both.select(F.col("a").alias("node")).distinct(), both))
    size = nodes.groupBy("component").agg(F.count("*").alias("size"))
    best = F.max(F.struct("size", (-F.col("ecc")).alias("e"), "degree", "strength", (-F.col("anchor")).alias("n"))).alias("m")
    return anchors(nodes, both).join(size, "component").agg(best).select((-F.col("m.n")).alias("anchor"))


@query(f"""WITH RECURSIVE {TRADE}, k AS (SELECT a, b, qty, row_number() OVER (ORDER BY qty DESC, a, b) AS r FROM trade), u AS (SELECT a, b, r FROM k UNION ALL SELECT b, a, r FROM k),
c(r, x) AS (SELECT r, a FROM k UNION SELECT c.r, u.b FROM c JOIN u ON c.x = u.a AND u.r < c.r)
SELECT a, b, round(qty, 6) AS weight FROM k WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.r = k.r AND c.x = k.b)""")
def max_spanning_tree(spark, sf):
    e = trade(spark, sf).select("a", "b", F.col("qty").alias("weight"))
    return spanning(e)[0].select("a", "b", r6("weight").alias("weight"))


#: Customers as images: those whose orders of one day and priority follow each other are a pair, the weight is what both orders cost.
BUYERS = """f AS (SELECT o_custkey AS x, lead(o_custkey) OVER (PARTITION BY o_orderdate::DATE, o_orderpriority ORDER BY o_orderkey) AS y, o_totalprice AS p, lead(o_totalprice) OVER (PARTITION BY o_orderdate::DATE, o_orderpriority ORDER BY o_orderkey) AS q FROM orders),
buyers AS (SELECT least(x, y) AS a, greatest(x, y) AS b, round(sum(p + q), 2)::DOUBLE AS weight FROM f WHERE x <> y GROUP BY 1, 2)"""


def buyers(spark, sf) -> DataFrame:
    w = W.partitionBy(F.to_date("o_orderdate"), "o_orderpriority").orderBy("o_orderkey")
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("x"), F.lead("o_custkey").over(w).alias("y"), (F.col("o_totalprice") + F.lead("o_totalprice").over(w)).alias("p"))
    return o.where("x <> y").groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.round(F.sum("p"), 2).alias("weight"))


@query(f"""WITH RECURSIVE {BUYERS}, k AS (SELECT a, b, weight, row_number() OVER (ORDER BY weight DESC, a, b) AS r FROM buyers), u AS (SELECT a, b, r FROM k UNION ALL SELECT b, a, r FROM k),
c(r, x) AS (SELECT r, a FROM k UNION SELECT c.r, u.b FROM c JOIN u ON c.x = u.a AND u.r < c.r)
SELECT a, b, weight FROM k WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.r = k.r AND c.x = k.b)""")
def customer_forest(spark, sf):
    """The best spanning forest of all customers, in rounds, as a graph of any size takes it: no task joins up what others left."""
    return spanning(buyers(spark, sf), alone=0)[0]


#: Pairs with homographies [s 0 tx; 0 s ty; 0 0 1]; (s, tx, ty) of a product is (s1 s2, s1 tx2 + tx1, s1 ty2 + ty1).
STEPS = """k AS (SELECT a, b, qty, (1 + (a + 2 * b) % 7 / 100.0::DOUBLE)::DOUBLE AS s, (a * 10 - b)::DOUBLE AS tx, (b % 5 * 20)::DOUBLE AS ty, row_number() OVER (ORDER BY qty DESC, a, b) AS r FROM trade)"""


@query(f"""WITH RECURSIVE {TRADE}, {STEPS}, u AS (SELECT a, b, r FROM k UNION ALL SELECT b, a, r FROM k), c(r, x) AS (SELECT r, a FROM k UNION SELECT c.r, u.b FROM c JOIN u ON c.x = u.a AND u.r < c.r),
t AS (SELECT a, b, s, tx, ty FROM k WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.r = k.r AND c.x = k.b)),
v AS (SELECT b AS child, a AS parent, 1 / s AS s, -tx / s AS tx, -ty / s AS ty FROM t UNION ALL SELECT a, b, s, tx, ty FROM t),
m AS (SELECT max(x) AS top FROM (SELECT unnest([a, b]) AS x FROM t)),
p(node, came, s, tx, ty) AS (SELECT top, NULL::BIGINT, 1.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE FROM m UNION ALL SELECT v.child, v.parent, p.s * v.s, p.s * v.tx + p.tx, p.s * v.ty + p.ty FROM p JOIN v ON v.parent = p.node WHERE v.child IS DISTINCT FROM p.came)
SELECT node, round(s, 6) AS s, round(tx, 6) AS tx, round(ty, 6) AS ty FROM p""")
def tree_homographies(spark, sf):
    """Each nation's homography into the frame of the last one, composed along the best tree by doubling pointers."""
    a, b, one, zero = F.col("a"), F.col("b"), F.lit(1.0), F.lit(0.0)
    s = 1 + (a + 2 * b) % 7 / F.lit(100.0)
    e = trade(spark, sf).select("a", "b", F.col("qty").alias("weight"), F.array(s, zero, (a * 10 - b).cast("double"), zero, s, (b % 5 * 20).cast("double"), zero, zero, one).alias("h"))
    _, places = spanning(e, placed=True)
    placed = framed(places, kept(places.agg(F.max("node").alias("anchor")))[0])
    return placed.select("node", r6(F.col("h")[0]).alias("s"), r6(F.col("h")[2]).alias("tx"), r6(F.col("h")[5]).alias("ty"))


@query(f"""WITH RECURSIVE {STRONG.format(T=TRADE, q=0.95)}, r(x, y) AS (SELECT n_nationkey::BIGINT, n_nationkey::BIGINT FROM nation UNION SELECT r.x, u.b FROM r JOIN u ON r.y = u.a), c AS (SELECT x, min(y) AS k FROM r GROUP BY x)
SELECT t.a, t.b, t.n, row_number() OVER (ORDER BY t.n DESC, t.a, t.b) AS turn FROM trade t JOIN c i ON t.a = i.x JOIN c j ON t.b = j.x WHERE i.k <> j.k AND t.n < (SELECT quantile_cont(n, 0.95) FROM trade)""")
def bridge_candidates(spark, sf):
    """Rejected pairs that would join two components, best first."""
    t, e = strong(spark, sf, 0.95)
    c, _ = kept(components(table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("node")), e))
    end = lambda s: c.select(F.col("node").alias(s), F.col("component").alias(f"k{s}"))
    left = looked_up(looked_up(t.join(e.select("a", "b"), ["a", "b"], "left_anti"), ["a"], end("a")), ["b"], end("b")).where("ka <> kb")
    return ranked(left, [F.desc("n"), "a", "b"], "turn").select("a", "b", "n", (F.col("turn") + 1).alias("turn"))


@query(f"""WITH {TRADE}, p AS (SELECT a, b, n AS m, floor(n * disc * 8)::BIGINT AS k, disc * 5 AS ncc FROM trade)
SELECT a, b, CASE WHEN m < 40 THEN 'only ' || m || ' raw matches' WHEN k < 40 THEN 'few inliers' WHEN k / m < 0.1 THEN 'inlier ratio' WHEN ncc < 0.25 THEN 'ncc' ELSE 'ok' END AS reason FROM p""")
def acceptance_reasons(spark, sf):
    t = trade(spark, sf).withColumn("k", F.floor(F.col("n") * F.col("disc") * 8))
    return t.select("a", "b", acceptance(F.col("n"), F.col("k"), F.col("disc") * 5).alias("reason"))


KEY4 = "l_linenumber, l_partkey, l_suppkey"
MODES = f"""m AS (SELECT l_orderkey, l_extendedprice, l_quantity, row_number() OVER (PARTITION BY l_orderkey ORDER BY {KEY4}) AS mode, l_discount, l_tax FROM lineitem)"""


def modes(spark, sf) -> DataFrame:
    w = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    return table(spark, sf, "lineitem").select("l_orderkey", "l_extendedprice", "l_quantity", F.row_number().over(w).cast("long").alias("mode"), "l_discount", "l_tax")


@query(f"WITH {MODES}, r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, mode) AS k FROM m WHERE l_quantity >= 10) SELECT l_orderkey, mode, l_extendedprice FROM r WHERE k = 1")
def mode_argmax(spark, sf):
    return best_mode(modes(spark, sf), ["l_orderkey"], "l_extendedprice", "mode", F.col("l_quantity") >= 10).select("l_orderkey", "mode", "l_extendedprice")


@query(f"""WITH {MODES}, p AS (SELECT *, min(CASE WHEN l_discount < 0.08 THEN mode END) OVER (PARTITION BY l_orderkey) AS first_mode FROM m),
r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, mode) AS k FROM p WHERE l_quantity >= 10 AND l_discount < 0.08) SELECT l_orderkey, mode, mode <> first_mode AS overruled FROM r WHERE k = 1""")
def mode_overruled(spark, sf):
    """Whether the winner is another than the first plausible mode; implausible ones don't count."""
    fine = F.col("l_discount") < 0.08
    return best_mode(modes(spark, sf), ["l_orderkey"], "l_extendedprice", "mode", F.col("l_quantity") >= 10, fine).select("l_orderkey", "mode", "overruled")


@query(f"""WITH {MODES}, k AS (SELECT *, l_quantity >= 25 AS fine, CASE WHEN l_quantity >= 25 THEN round(l_discount * 10 - 0.4, 6) ELSE 0.0::DOUBLE END AS ncc FROM m),
r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY ncc DESC, mode) AS j FROM k WHERE fine OR mode = 1) SELECT l_orderkey, CASE WHEN fine THEN 'ncc' ELSE 'implausible' END AS reason, ncc, mode FROM r WHERE j = 1""")
def best_effort_reason(spark, sf):
    """What to report of a rejected pair: its best plausible mode; an implausible first one counts 0."""
    m = modes(spark, sf).withColumn("ncc", F.round(F.col("l_discount") * 10 - 0.4, 6))
    b = best_effort(m, ["l_orderkey"], "ncc", "mode", F.col("l_quantity") >= 25)
    return b.select("l_orderkey", F.when(F.col("plausible"), "ncc").otherwise("implausible").alias("reason"), "ncc", "mode")


CORR = "CASE WHEN n < {least} OR vx <= 1e-12 OR vy <= 1e-12 THEN 0.0 ELSE c / sqrt(vx * vy) END"
SUMS = "SELECT {k}, count(*)::DOUBLE AS n, sum(x * y) - sum(x) * sum(y) / count(*) AS c, sum(x * x) - sum(x) * sum(x) / count(*) AS vx, sum(y * y) - sum(y) * sum(y) / count(*) AS vy FROM p GROUP BY ALL"


@query(f"WITH p AS (SELECT l_returnflag AS k, l_quantity AS x, l_extendedprice AS y FROM lineitem), s AS ({SUMS.format(k='k')}) SELECT k AS l_returnflag, round({CORR.format(least=2000)}, 6) AS ncc, n::BIGINT AS n FROM s")
def ncc_guarded(spark, sf):
    g = table(spark, sf, "lineitem").groupBy("l_returnflag")
    return g.agg(r6(guarded_correlation(F.col("l_quantity"), F.col("l_extendedprice"), 2000)).alias("ncc"), F.count("*").alias("n"))


@query(f"WITH p AS (SELECT floor(l_quantity / 10)::BIGINT AS bx, l_linenumber AS ly, l_discount AS x, l_extendedprice AS y FROM lineitem), s AS ({SUMS.format(k='bx, ly')}) SELECT bx, ly, round({CORR.format(least=50)}, 5) AS ncc FROM s")
def local_blocks_ncc(spark, sf):
    g = table(spark, sf, "lineitem").groupBy(F.floor(F.col("l_quantity") / 10).alias("bx"), F.col("l_linenumber").alias("ly"))
    return g.agg(F.round(guarded_correlation(F.col("l_discount"), F.col("l_extendedprice"), 50), 5).alias("ncc"))


@query("""WITH e AS (SELECT l_returnflag, l_quantity * l_discount AS x FROM lineitem) SELECT l_returnflag, count(x) AS n, round(sqrt(avg(x * x)), 3) AS rms, round(quantile_cont(x, 0.5), 3) AS median, round(quantile_cont(x, 0.95), 3) AS p95 FROM e GROUP BY 1""")
def layout_metrics(spark, sf):
    e = table(spark, sf, "lineitem").select("l_returnflag", (F.col("l_quantity") * F.col("l_discount")).alias("x"))
    return residual_metrics(e, ["l_returnflag"], "x").select("l_returnflag", "n", *[F.round(c, 3).alias(c) for c in ("rms", "median", "p95")])


@query("""WITH e AS (SELECT l_returnflag, l_linestatus, l_extendedprice * (1 - l_discount) - 30000 AS x FROM lineitem), q AS (SELECT unnest([0.0, 0.05, 0.5, 0.95, 1.0])::DOUBLE AS share),
g AS (SELECT l_returnflag, l_linestatus, list(x ORDER BY x) AS v FROM e GROUP BY ALL), k AS (SELECT *, share * (len(v) - 1) AS r FROM g, q)
SELECT l_returnflag, l_linestatus, share, round(v[floor(r)::BIGINT + 1] + (v[ceil(r)::BIGINT + 1] - v[floor(r)::BIGINT + 1]) * (r - floor(r)), 4) AS quantile FROM k""")
def rank_quantiles(spark, sf):
    """Quantiles of a few very large groups, by passes of counts: no task holds a group's values."""
    e = table(spark, sf, "lineitem").select("l_returnflag", "l_linestatus", (F.col("l_extendedprice") * (1 - F.col("l_discount")) - 30000).alias("x"))
    q = quantiles(e, ["l_returnflag", "l_linestatus"], "x", [0.0, 0.05, 0.5, 0.95, 1.0])
    return q.withColumn("quantile", F.round("quantile", 4))


@query("""WITH e AS (SELECT l_returnflag, l_linestatus, l_quantity * l_discount AS x FROM lineitem), g AS (SELECT l_returnflag, l_linestatus, sqrt(avg(x * x)) AS rms, avg(x) AS m FROM e GROUP BY ALL)
SELECT count(*) AS pairs, round(avg(m), 6) AS mean_of_pairs, round(min(m), 6) AS least, round((SELECT sqrt(avg(x * x)) FROM e), 6) AS pooled_rms FROM g""")
def pair_then_layout_metrics(spark, sf):
    """Two levels: per pair, then over pairs; the pooled error weighs points, the means weigh pairs."""
    e = table(spark, sf, "lineitem").select("l_returnflag", "l_linestatus", (F.col("l_quantity") * F.col("l_discount")).alias("x"))
    g = e.groupBy("l_returnflag", "l_linestatus").agg(F.sum(F.col("x") * F.col("x")).alias("sq"), F.count("*").alias("k"), F.avg("x").alias("m"))
    return g.agg(F.count("*").alias("pairs"), r6(F.avg("m")).alias("mean_of_pairs"), r6(F.min("m")).alias("least"), r6(F.sqrt(F.sum("sq") / F.sum("k"))).alias("pooled_rms"))


@query("""WITH e AS (SELECT o_custkey, l_quantity * l_discount AS x FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_returnflag = 'R'), m AS (SELECT o_custkey, count(x) AS n, sqrt(avg(x * x)) AS rms, quantile_cont(x, 0.5) AS median, quantile_cont(x, 0.95) AS p95 FROM e GROUP BY 1)
SELECT c_custkey, coalesce(n, 0) AS n, round(rms, 6) AS rms, round(median, 6) AS median, round(p95, 6) AS p95 FROM customer LEFT JOIN m ON c_custkey = o_custkey""")
def metrics_empty(spark, sf):
    """Metrics of every store (customer), also of those that nothing was scored for: n is 0 and the others are null."""
    items = table(spark, sf, "lineitem").where("l_returnflag = 'R'").select("l_orderkey", (F.col("l_quantity") * F.col("l_discount")).alias("x"))
    e = table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey")).join(items, F.col("o_orderkey") == F.col("l_orderkey"))
    m = table(spark, sf, "customer").select("c_custkey").join(residual_metrics(e, ["c_custkey"], "x"), "c_custkey", "left")
    return m.select("c_custkey", F.coalesce("n", F.lit(0)).alias("n"), *[r6(c).alias(c) for c in ("rms", "median", "p95")])


@query(f"""WITH p AS (SELECT l_orderkey, {KEY4}, floor(l_quantity / 7)::BIGINT AS gx, floor(l_discount * 50)::BIGINT AS gy FROM lineitem),
r AS (SELECT *, row_number() OVER (PARTITION BY gx, gy ORDER BY l_orderkey, {KEY4}) AS depth FROM p) SELECT gx, gy, depth::INT AS depth, l_orderkey, l_partkey FROM r ORDER BY depth, gx, gy LIMIT 600""")
def grid_round_robin(spark, sf):
    p = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.floor(F.col("l_quantity") / 7).alias("gx"), F.floor(F.col("l_discount") * 50).alias("gy"))
    s = grid_sample(p, ["gx", "gy"], [F.col(c) for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")], 600)
    return s.select("gx", "gy", "depth", "l_orderkey", "l_partkey")


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem a WHERE l_extendedprice < (SELECT max(l_extendedprice) FROM lineitem b WHERE a.l_orderkey = b.l_orderkey)")
def strip_pool(spark, sf):
    """What is left of each pool of points without its best mode's."""
    i = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return i.withColumn("m", F.max("l_extendedprice").over(W.partitionBy("l_orderkey"))).where("l_extendedprice < m").drop("m", "l_extendedprice")


@query("""WITH c AS (SELECT c_nationkey AS k, avg(c_acctbal) AS cx FROM customer GROUP BY 1) SELECT k::BIGINT AS idx, round(cx, 6) AS cx, row_number() OVER (ORDER BY cx, k)::INT AS place FROM c""")
def left_to_right(spark, sf):
    c = table(spark, sf, "customer").groupBy(F.col("c_nationkey").cast("long").alias("idx")).agg(F.avg("c_acctbal").alias("cx"))
    return ranked(c, ["cx", "idx"]).select("idx", r6("cx").alias("cx"), (F.col("place") + 1).cast("int").alias("place"))


@query("""WITH h AS (SELECT p_partkey, p_size % 10 AS store, (1 + p_size * 0.01)::DOUBLE AS a, 0.02::DOUBLE AS b, (p_partkey % 97 * 30)::DOUBLE AS c, 0.00001::DOUBLE * (p_size % 7) AS g, 0.00002::DOUBLE AS i FROM part),
q AS (SELECT p_partkey, store, (c + (a * 1600 + c) / (g * 1600 + 1) + (a * 1600 + b * 900 + c) / (g * 1600 + i * 900 + 1) + (b * 900 + c) / (i * 900 + 1)) / 4 AS cx FROM h)
SELECT p_partkey, store, round(cx, 6) AS cx, row_number() OVER (PARTITION BY store ORDER BY round(cx, 9), p_partkey)::INT AS place FROM q""")
def corner_order(spark, sf):
    """Images (parts) of each store from left to right, by the mean of their four warped corners."""
    k, s, f = F.col("p_partkey"), F.col("p_size"), F.lit
    h = [1 + s * 0.01, f(0.02), (k % 97 * 30).cast("double"), f(-0.01), 1 - s * 0.005, f(-7.0), s % 7 * 0.00001, f(0.00002), f(1.0)]
    c = table(spark, sf, "part").select("p_partkey", (s % 10).alias("store"), centroid(h, f(1600.0), f(900.0)).alias("cx"))
    placed = ranked_within(c.withColumn("by", F.round("cx", 9)), "store", ["by", "p_partkey"])
    return placed.select("p_partkey", "store", r6("cx").alias("cx"), (F.col("place") + 1).cast("int").alias("place"))


@query("""WITH c AS (SELECT event_type, count(*) AS px FROM events GROUP BY 1) SELECT event_type, px, round(px / (sum(px) OVER ())::DOUBLE, 4) AS share, px / (sum(px) OVER ())::DOUBLE < 0.2 AS low FROM c""")
def pixel_share(spark, sf):
    c = table(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("px"))
    share = F.try_divide(F.col("px").cast("double"), F.sum("px").over(W.partitionBy()))
    return c.select("event_type", "px", F.round(share, 4).alias("share"), (share < 0.2).alias("low"))


CELLS = "SELECT DISTINCT user_id AS x, floor(value / 10)::BIGINT AS y FROM events WHERE event_type {op}"


@query(f"WITH u AS ({CELLS.format(op='IS NOT NULL')}), f AS ({CELLS.format(op="= 'click'")}) SELECT count(*) AS covered, count(f.x) AS filled, round(100.0 * (count(*) - count(f.x)) / greatest(count(*), 1), 6) AS missing_pct, CASE WHEN 100.0 * (count(*) - count(f.x)) / greatest(count(*), 1) < 0.5 THEN 'COMPLETE' ELSE 'INCOMPLETE' END AS verdict FROM u LEFT JOIN f ON u.x = f.x AND u.y = f.y")
def completeness(spark, sf):
    cell = table(spark, sf, "events").where("event_type is not null").select(F.col("user_id").alias("x"), F.floor(F.col("value") / 10).alias("y"), (F.col("event_type") == "click").cast("int").alias("f"))
    c = cell.where("y is not null and x is not null").groupBy("x", "y").agg(F.max("f").alias("f")).agg(F.count("*").alias("covered"), F.coalesce(F.sum("f"), F.lit(0)).alias("filled"))
    pct = F.lit(100.0) * (F.col("covered") - F.col("filled")) / F.greatest("covered", F.lit(1))
    return c.select("covered", "filled", r6(pct).alias("missing_pct"), F.when(pct < 0.5, "COMPLETE").otherwise("INCOMPLETE").alias("verdict"))


@query("SELECT event_id, CASE WHEN (floor(user_id / 12)::BIGINT + floor(value / 12)::BIGINT) % 2 = 1 THEN 'a' ELSE 'b' END AS side FROM events")
def checkerboard(spark, sf):
    odd = (F.floor(F.col("user_id") / 12) + F.floor(F.col("value") / 12)) % 2 == 1
    return table(spark, sf, "events").select("event_id", F.when(odd, "a").otherwise("b").alias("side"))


@query("SELECT user_id AS x, floor(value / 10)::BIGINT AS y, arg_max(event_type, event_id) AS pixel, count(*) > 1 AS overlap FROM events GROUP BY 1, 2")
def last_wins_paste(spark, sf):
    g = table(spark, sf, "events").groupBy(F.col("user_id").alias("x"), F.floor(F.col("value") / 10).alias("y"))
    return g.agg(F.max_by("event_type", "event_id").alias("pixel"), (F.count("*") > 1).alias("overlap"))


@query("""WITH s AS (SELECT o_orderpriority AS config, c_mktsegment AS store, count(*) AS n, sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS used, avg(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END) AS rms, sum(o_totalprice) AS secs FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL)
SELECT config, sum(used)::BIGINT AS used, sum(n)::BIGINT AS n, round(avg(rms), 4) AS mean_rms, round(min(rms), 4) AS least, round(sum(secs), 2) AS secs FROM s GROUP BY config""")
def ablation_rollup(spark, sf):
    o = table(spark, sf, "orders").join(table(spark, sf, "customer").select("c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))
    done = F.col("o_orderstatus") == "F"
    s = o.groupBy(F.col("o_orderpriority").alias("config"), F.col("c_mktsegment").alias("store")).agg(F.count("*").alias("n"), F.count_if(done).alias("used"), F.avg(F.when(done, F.col("o_totalprice"))).alias("rms"), F.sum("o_totalprice").alias("secs"))
    return s.groupBy("config").agg(F.sum("used").alias("used"), F.sum("n").alias("n"), F.round(F.avg("rms"), 4).alias("mean_rms"), F.round(F.min("rms"), 4).alias("least"), F.round(F.sum("secs"), 2).alias("secs"))


#: Two homographies a part: a general one and one near it.
PARTS_H = """h AS (SELECT p_partkey, (1 + p_size * 0.01)::DOUBLE AS a0, 0.02::DOUBLE AS a1, (p_size * 3)::DOUBLE AS a2, -0.01::DOUBLE AS a3, (1 - p_size * 0.005)::DOUBLE AS a4, -7.0::DOUBLE AS a5, 0.00001::DOUBLE AS a6, 0.00002::DOUBLE AS a7, 1.0::DOUBLE AS a8,
 0.9::DOUBLE AS b0, (p_partkey % 5 * 0.01)::DOUBLE AS b1, 5.0::DOUBLE AS b2, 0.03::DOUBLE AS b3, 1.1::DOUBLE AS b4, (p_partkey % 7)::DOUBLE AS b5, 0.0::DOUBLE AS b6, 0.00003::DOUBLE AS b7, 1.0::DOUBLE AS b8 FROM part)"""


def parts_h() -> tuple[list[Column], list[Column]]:
    k, s, f = F.col("p_partkey"), F.col("p_size"), lambda v: F.lit(float(v))
    a = [1 + s * 0.01, f(0.02), (s * 3).cast("double"), f(-0.01), 1 - s * 0.005, f(-7), f(0.00001), f(0.00002), f(1)]
    return a, [f(0.9), k % 5 * 0.01, f(5), f(0.03), f(1.1), (k % 7).cast("double"), f(0), f(0.00003), f(1)]


@query(f"WITH {PARTS_H} SELECT p_partkey, {', '.join(f'round(a{3 * i} * b{j} + a{3 * i + 1} * b{3 + j} + a{3 * i + 2} * b{6 + j}, 6) AS m{3 * i + j}' for i in range(3) for j in range(3))} FROM h")
def composed_homographies(spark, sf):
    a, b = parts_h()
    return table(spark, sf, "part").select("p_partkey", *[r6(c).alias(f"m{k}") for k, c in enumerate(product(a, b))])


INV_B = ["(b4 * b8 - b5 * b7)", "(b2 * b7 - b1 * b8)", "(b1 * b5 - b2 * b4)", "(b5 * b6 - b3 * b8)", "(b0 * b8 - b2 * b6)", "(b2 * b3 - b0 * b5)", "(b3 * b7 - b4 * b6)", "(b1 * b6 - b0 * b7)", "(b0 * b4 - b1 * b3)"]


@query(f"WITH {PARTS_H}, t AS (SELECT p_partkey, {', '.join(f'({INV_B[3 * i]} * a{j} + {INV_B[3 * i + 1]} * a{3 + j} + {INV_B[3 * i + 2]} * a{6 + j}) / {INV_B[8]} AS t{3 * i + j}' for i in range(3) for j in range(3))} FROM h), q AS (SELECT p_partkey, (t0 * 300 + t1 * 200 + t2) / nullif(t6 * 300 + t7 * 200 + t8, 0) - 310 AS x, (t3 * 300 + t4 * 200 + t5) / nullif(t6 * 300 + t7 * 200 + t8, 0) - 190 AS y FROM t) SELECT p_partkey, round(sqrt(x * x + y * y), 6) AS err FROM q")
def layout_residuals(spark, sf):
    """How far a point of i lands from its partner in j under inverse(h_j) h_i, unguarded."""
    a, b = parts_h()
    f = lambda v: F.lit(float(v))
    p = table(spark, sf, "part").withColumns({"xi": f(300), "yi": f(200), "xj": f(310), "yj": f(190)})
    return all_residuals(p, a, b).select("p_partkey", r6(F.col("err")).alias("err"))


@query(f"WITH {PARTS_H}, s AS (SELECT h.*, 0.25::DOUBLE + p_size * 0.01 AS s, 0.5::DOUBLE AS sa, 0.8::DOUBLE AS r FROM h JOIN part USING (p_partkey)) SELECT p_partkey, {', '.join(f'round(a{k} * s * r / sa, 6) AS m{k}' for k in (0, 1, 3, 4))}, round(a2 * r / sa, 6) AS m2, round(a5 * r / sa, 6) AS m5, round(a6 * s * 1e4, 6) AS m6, round(a7 * s * 1e4, 6) AS m7 FROM s")
def render_frames(spark, sf):
    """Work pixels of images of different scales to render pixels of the anchor: R / Sa H S."""
    a, _ = parts_h()
    m = to_render(a, 0.25 + F.col("p_size") * 0.01, F.lit(0.5), F.lit(0.8))
    return table(spark, sf, "part").select("p_partkey", *[r6(m[k] * (1e4 if k > 5 else 1)).alias(f"m{k}") for k in range(8)])


@query(f"WITH {PARTS_H}, s AS (SELECT h.*, 0.25::DOUBLE + p_size * 0.01 AS s FROM h JOIN part USING (p_partkey)) SELECT p_partkey, {', '.join(f'round(a{k} / s, 6) AS m{k}' for k in (0, 1, 3, 4))}, round(a2, 6) AS m2, round(a5, 6) AS m5, round(a6 / s * 1e4, 6) AS m6, round(a7 / s * 1e4, 6) AS m7 FROM s")
def work_frames(spark, sf):
    """Work pixels to a canvas that full pixels are mapped to: H S^-1."""
    a, _ = parts_h()
    m = from_work(a, 0.25 + F.col("p_size") * 0.01)
    return table(spark, sf, "part").select("p_partkey", *[r6(m[k] * (1e4 if k > 5 else 1)).alias(f"m{k}") for k in range(8)])


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem WHERE l_discount >= 0.04 AND l_quantity >= 20")
def viable_modes(spark, sf):
    i = table(spark, sf, "lineitem").where(viable(F.col("l_discount"), F.col("l_quantity"), min_inliers=20))
    return i.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@query(f"""WITH {TRADE}, p AS (SELECT a, b, n AS m, floor(n * disc * 8)::BIGINT AS k, CASE WHEN a % 11 = 0 THEN 'sliver' WHEN a % 7 <> 6 THEN 'ok' END AS fault, b / 100.0::DOUBLE AS overlap, disc * 5 AS ncc FROM trade)
SELECT a, b, CASE WHEN m < 40 THEN 'loftr: only ' || m || ' confident matches' WHEN fault IS NULL THEN 'loftr: no model' WHEN fault <> 'ok' THEN 'loftr: ' || fault WHEN k < 40 THEN 'loftr: ' || k || ' inliers < 40' WHEN k / m < 0.1 THEN 'loftr: inlier ratio ' || printf('%.2f', k / m) || ' low' WHEN overlap < 0.04 THEN 'loftr: overlap ' || printf('%.3f', overlap) || ' low' WHEN ncc < 0.25 THEN 'loftr: ncc ' || printf('%.2f', ncc) || ' < 0.25' ELSE 'loftr' END AS reason FROM p""")
def rescuer_gates(spark, sf):
    t = trade(spark, sf).withColumn("k", F.floor(F.col("n") * F.col("disc") * 8))
    fault = F.when(F.col("a") % 11 == 0, "sliver").when(F.col("a") % 7 != 6, "ok")
    return t.select("a", "b", rescue_reason(F.col("n"), F.col("k"), fault, F.col("b") / F.lit(100.0), F.col("disc") * 5).alias("reason"))


@query("SELECT l_orderkey, count(*) AS n, sum(l_quantity) AS qty FROM lineitem WHERE l_discount * 10 >= 0.6 GROUP BY 1")
def confident_matches(spark, sf):
    i = table(spark, sf, "lineitem").withColumn("confidence", F.col("l_discount") * 10)
    return confident(i).groupBy("l_orderkey").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("qty"))


#: Nations as placed images (two in three), trade as pairs.
PLACED = "l AS (SELECT n_nationkey::BIGINT AS idx FROM nation WHERE n_nationkey % 3 <> 0)"


@query(f"WITH {TRADE}, {PLACED} SELECT t.a AS i, t.b AS j, t.n, t.a * 2.0::DOUBLE AS ti, t.b * 2.0::DOUBLE AS tj FROM trade t JOIN l x ON t.a = x.idx JOIN l y ON t.b = y.idx WHERE t.disc > 0.049 AND t.n >= 4")
def scorable_pairs(spark, sf):
    """Accepted pairs of four points and more whose ends are both placed, with the ends' homographies."""
    one, zero = F.lit(1.0), F.lit(0.0)
    layout = table(spark, sf, "nation").select(F.lit("s").alias("store"), F.col("n_nationkey").cast("long").alias("idx"), F.when(F.col("n_nationkey") % 3 != 0, F.array(one, zero, F.col("n_nationkey") * 2.0, zero, one, zero, zero, zero, one)).alias("h"))
    pairs = trade(spark, sf).select(F.lit("s").alias("store"), F.col("a").alias("i"), F.col("b").alias("j"), "n", (F.col("disc") > 0.049).alias("ok"))
    return scorable(pairs, layout, n_points=F.col("n")).select("i", "j", "n", F.col("h_i")[2].alias("ti"), F.col("h_j")[2].alias("tj"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, p_size::DOUBLE AS xi, p_retailprice AS yi, s_nationkey::DOUBLE AS xj, s_acctbal AS yj FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey")
def gathered_keypoints(spark, sf):
    """Matches (line items) with the places of their keypoints (parts and suppliers)."""
    m = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    i = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_size").cast("double").alias("xi"), F.col("p_retailprice").alias("yi"))
    j = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").cast("double").alias("xj"), F.col("s_acctbal").alias("yj"))
    return gathered(m, i, j, ["l_partkey"], ["l_suppkey"]).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "xi", "yi", "xj", "yj")


@query(f"WITH {TRADE} SELECT a, b, CASE WHEN a % 4 = 1 THEN n * 10 ELSE n END AS n, CASE WHEN a % 4 = 1 THEN 'loftr' ELSE '' END AS reason FROM trade")
def rescued_pairs(spark, sf):
    t = trade(spark, sf).select("a", "b", "n", F.lit("").alias("reason"))
    return replaced(t, t.where("a % 4 = 1").select("a", "b", (F.col("n") * 10).alias("n"), F.lit("loftr").alias("reason")), ["a", "b"])


@query("SELECT l_returnflag AS layout, count(*) AS n, round(sum(l_quantity), 3) AS total FROM lineitem GROUP BY 1")
def pooled_errors(spark, sf):
    """Errors as an array a pair (an order's items), pooled again by layout; rows of one order and layout may be any number."""
    i = table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("layout"), "l_orderkey").agg(F.collect_list("l_quantity").alias("e"))
    return pooled(i, "e", ["layout"]).groupBy("layout").agg(F.count("*").alias("n"), F.round(F.sum("err"), 3).alias("total"))


@query("""WITH p AS (SELECT l_returnflag, l_orderkey, avg(l_discount) AS ncc, sum(l_quantity) / 400 AS overlap FROM lineitem GROUP BY ALL)
SELECT l_returnflag, count(*) AS n_pairs_scored, round(avg(ncc), 6) AS mean_overlap_ncc, round(min(ncc), 6) AS min_overlap_ncc, round(avg(overlap), 6) AS mean_overlap_frac FROM p GROUP BY 1""")
def pair_weighted_scores(spark, sf):
    """Correlation and overlap of each pair under the layout, then over pairs, which weigh the same."""
    p = table(spark, sf, "lineitem").groupBy("l_returnflag", "l_orderkey").agg(F.avg("l_discount").alias("ncc"), (F.sum("l_quantity") / 400).alias("overlap"))
    s = scores_of_pairs(p, ["l_returnflag"])
    return s.select("l_returnflag", "n_pairs_scored", *[r6(c).alias(c) for c in ("mean_overlap_ncc", "min_overlap_ncc", "mean_overlap_frac")])


@query("""WITH e AS (SELECT l_returnflag, l_orderkey, l_quantity * l_discount AS x FROM lineitem) SELECT l_returnflag, l_orderkey, count(x) AS n, round(sqrt(avg(x * x)), 6) AS rms, round(quantile_cont(x, 0.5), 6) AS median FROM e GROUP BY ALL""")
def pairwise_metrics(spark, sf):
    """Residuals of each pair (an order's items of one flag): an aggregate a pair."""
    e = table(spark, sf, "lineitem").select("l_returnflag", "l_orderkey", (F.col("l_quantity") * F.col("l_discount")).alias("x"))
    m = residual_metrics(e, ["l_returnflag", "l_orderkey"], "x")
    return m.select("l_returnflag", "l_orderkey", "n", r6("rms").alias("rms"), r6("median").alias("median"))


EVENT_PX = "p AS (SELECT event_type AS layer, user_id::BIGINT AS x, floor(value / 5)::BIGINT AS y, event_id FROM events WHERE user_id IS NOT NULL AND value IS NOT NULL)"


def event_px(spark, sf) -> DataFrame:
    e = table(spark, sf, "events").where("user_id is not null and value is not null")
    return e.select(F.col("event_type").alias("layer"), F.col("user_id").cast("long").alias("x"), F.floor(F.col("value") / 5).alias("y"), "event_id")


@query(f"WITH {EVENT_PX} SELECT layer, round(count(DISTINCT (x, y)) / ((SELECT max(x) - min(x) + 1 FROM p) * (SELECT max(y) - min(y) + 1 FROM p))::DOUBLE, 9) AS overlap FROM p GROUP BY 1")
def overlap_share(spark, sf):
    """Pixels of a mask over the frame's pixels."""
    p = event_px(spark, sf)
    frame = p.agg((F.max("x") - F.min("x") + 1).alias("w"), (F.max("y") - F.min("y") + 1).alias("h"))
    n = p.select("layer", "x", "y").distinct().groupBy("layer").agg(F.count("*").alias("px"))
    return n.join(F.broadcast(frame)).select("layer", F.round(overlap_fraction(F.col("px"), F.col("w"), F.col("h")), 9).alias("overlap"))  # the frame is one row


@query(f"WITH {EVENT_PX}, c AS (SELECT x, y, max(CASE WHEN layer = 'click' THEN 1 ELSE 0 END) AS mask FROM p GROUP BY x, y) SELECT count(*) AS canvas_px, round(avg(CASE WHEN mask > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS coverage FROM c")
def canvas_coverage(spark, sf):
    c = event_px(spark, sf).groupBy("x", "y").agg(F.max((F.col("layer") == "click").cast("int")).alias("mask"))
    return c.agg(F.count("*").alias("canvas_px"), r6(coverage(F.col("mask"))).alias("coverage"))


@query(f"""WITH {EVENT_PX}, b AS (SELECT layer, min(CASE WHEN y >= 10 AND layer <> 'view' THEN x END) AS x0, max(CASE WHEN y >= 10 AND layer <> 'view' THEN x END) AS x1, min(CASE WHEN y >= 10 AND layer <> 'view' THEN y END) AS y0, max(CASE WHEN y >= 10 AND layer <> 'view' THEN y END) AS y1 FROM p GROUP BY 1)
SELECT layer, greatest(0, coalesce(x0 - 2, 0))::BIGINT AS x0, least(100000, coalesce(x1 + 3, 100000))::BIGINT AS x1, greatest(0, coalesce(y0 - 2, 0))::BIGINT AS y0, least(1000, coalesce(y1 + 3, 1000))::BIGINT AS y1 FROM b""")
def content_boxes(spark, sf):
    """Boxes of non-black pixels, two wider, inside the picture; a picture that is all black stays whole."""
    lit = F.when((F.col("y") >= 10) & (F.col("layer") != "view"), 200).otherwise(0)
    return content_box(event_px(spark, sf), ["layer"], F.col("x"), F.col("y"), lit, F.lit(100000).cast("long"), F.lit(1000).cast("long"), 2)


WINDOWS = f"""p AS (SELECT l_orderkey % 97 AS wx, l_linenumber AS wy, CASE WHEN l_tax > 0.005 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS c, l_discount AS x, l_extendedprice AS y FROM lineitem),
s AS (SELECT wx, wy, avg(c) AS cover, count(*)::DOUBLE AS n, sum(x * y) - sum(x) * sum(y) / count(*) AS c, sum(x * x) - sum(x) * sum(x) / count(*) AS vx, sum(y * y) - sum(y) * sum(y) / count(*) AS vy FROM p GROUP BY ALL),
w AS (SELECT wx, wy, CASE WHEN cover >= 0.9 THEN {CORR.format(least=2)} END AS ncc FROM s)"""


def windows(spark, sf) -> DataFrame:
    i = table(spark, sf, "lineitem").select((F.col("l_orderkey") % 97).alias("wx"), F.col("l_linenumber").alias("wy"), (F.col("l_tax") > 0.005).alias("on"), "l_discount", "l_extendedprice")
    return local_agreement(i, ["wx", "wy"], F.col("on"), F.col("l_discount"), F.col("l_extendedprice"))


@query(f"WITH {WINDOWS} SELECT wx, wy, round(ncc, 5) AS ncc FROM w")
def covered_windows(spark, sf):
    """Local correlation where a window is covered by nine tenths; null elsewhere."""
    return windows(spark, sf).select("wx", "wy", F.round("ncc", 5).alias("ncc"))


@query(f"WITH {WINDOWS} SELECT wy, count(ncc) AS windows, round(quantile_cont(ncc, 0.5), 5) AS median, round(quantile_cont(ncc, 0.1), 5) AS p10, round(quantile_cont(ncc, 0.9), 5) AS p90, round(avg(CASE WHEN ncc IS NOT NULL THEN CASE WHEN ncc > 0.4 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END END), 6) AS share_good FROM w GROUP BY wy")
def local_summaries(spark, sf):
    s = local_summary(windows(spark, sf), ["wy"])
    return s.select("wy", "windows", *[F.round(c, 5).alias(c) for c in ("median", "p10", "p90")], r6("share_good").alias("share_good"))


#: Modes of pairs (orders): plausible by tax; an implausible one has correlation 0.
DIAGNOSED = f"""{MODES}, d AS (SELECT l_orderkey, mode, l_quantity AS n, l_tax >= 0.02 AS plausible, CASE WHEN l_tax >= 0.02 THEN round(l_discount * 10 - 0.3, 6) ELSE 0.0::DOUBLE END AS ncc, CASE WHEN l_tax >= 0.02 THEN l_discount ELSE 0.0::DOUBLE END AS overlap FROM m WHERE l_quantity >= 25)"""


def diagnosed(spark, sf) -> DataFrame:
    m = modes(spark, sf).select("l_orderkey", "mode", F.col("l_quantity").alias("n"), "l_tax", F.round(F.col("l_discount") * 10 - 0.3, 6).alias("ncc"), F.col("l_discount").alias("overlap"))
    return enumerated(m, F.col("l_tax") >= 0.02, n_inliers="n")


@query(f"WITH {DIAGNOSED} SELECT l_orderkey, mode, n, plausible, ncc, overlap FROM d")
def enumerated_modes(spark, sf):
    """All modes of 25 inliers, implausible ones as 0."""
    return diagnosed(spark, sf).select("l_orderkey", "mode", "n", "plausible", "ncc", "overlap")


@query(f"""WITH {DIAGNOSED}, r AS (SELECT *, min(mode) OVER (PARTITION BY l_orderkey) AS f, row_number() OVER (PARTITION BY l_orderkey ORDER BY ncc DESC, mode) AS k FROM d)
SELECT l_orderkey, mode, CASE WHEN mode = f THEN ' [top-inliers]' ELSE '' END || CASE WHEN k = 1 AND ncc > 0.25 THEN ' [best-ncc]' ELSE '' END AS mark FROM r""")
def mode_listing(spark, sf):
    return marked_modes(diagnosed(spark, sf), ["l_orderkey"], "mode", "ncc").select("l_orderkey", "mode", "mark")


@query(f"""WITH {DIAGNOSED}, g AS (SELECT l_orderkey, arg_min(ncc, mode) AS c0, arg_min(n, mode) AS n0, min(mode) AS m0, max(ncc) AS c1, bool_or(plausible) AS ok FROM d GROUP BY 1), h AS (SELECT g.*, (SELECT min(d.mode) FROM d WHERE d.l_orderkey = g.l_orderkey AND d.ncc = g.c1) AS m1 FROM g WHERE ok),
p AS (SELECT l_orderkey, n0 AS first_inliers, c1 - c0 AS gap, m1 <> m0 AND c1 - c0 > 0.05 AS split FROM h)
SELECT l_orderkey, first_inliers, round(gap, 6) AS gap, CASE WHEN split THEN 'inliers and pixels disagree' ELSE 'strongest pair' END AS why FROM p ORDER BY split DESC, CASE WHEN split THEN gap END DESC NULLS LAST, first_inliers DESC, l_orderkey LIMIT 1""")
def demo_pairs(spark, sf):
    """The pair that shows best how pixels overrule inliers."""
    d = demo_pair(diagnosed(spark, sf), ["l_orderkey"], "mode", "ncc", "n")
    return d.select("l_orderkey", "first_inliers", r6("gap").alias("gap"), "why")


@query("SELECT o_orderkey, o_custkey FROM orders ORDER BY md5('5:' || o_orderkey::VARCHAR), o_orderkey LIMIT 200")
def sampled_matches(spark, sf):
    """200 matches to draw, without replacement."""
    return sampled(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), 200, F.col("o_orderkey"), 5)


@query("SELECT p_partkey, p_name FROM part WHERE substr(p_name, 1, 8) = (SELECT min(substr(p_name, 1, 8)) FROM part)")
def short_names(spark, sf):
    """Look-up by the short name that reports give."""
    p = table(spark, sf, "part").select("p_partkey", "p_name")
    least = p.agg(F.min(F.substring("p_name", 1, 8)).alias("least"))
    return by_short_name(p.join(F.broadcast(least)), F.col("least"), "p_name").select("p_partkey", "p_name")  # one row meets all


@query("SELECT p_partkey, round(CASE WHEN (p_partkey % 5) * 40 > 0 THEN (p_size * 30 * 40)::DOUBLE / ((p_partkey % 5) * 40)::DOUBLE END, 2) AS ratio FROM part")
def area_ratios(spark, sf):
    p = table(spark, sf, "part")
    return p.select("p_partkey", area_ratio(F.col("p_size") * 30, F.lit(40), F.col("p_partkey") % 5, F.lit(40)).alias("ratio"))
