"""Embedding near-duplicates by p-stable hashing, checked by exact cosines.

Normalised vectors at cosine c are sqrt(2 - 2 c) apart. A table hashes a vector by m
Gaussian projections, cut into cells of `width` with a random shift each; vectors with
equal cells in one of L tables meet. m grows with the logarithm of the rows, so that
vectors far apart seldom meet (a row has less than one of them a table, on average, at
any number of rows), and L so that a pair at the threshold is missed with a chance below
1 in 500; pairs nearer than that are missed less often.

Equal vectors of a label are one class. Classes that meet in a bucket are compared there
and nowhere else, all with all in tiles of bounded size, in double precision; a pair that
meets in several tables counts in the first. Buckets of one row, and buckets with the same
members as an earlier table's, are not worked on.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from mosaiq.llm.ngram_join import forest
from mosaiq.llm.shared import NULL_ID, back, components, groups, met, small_batches, staged
from mosaiq.llm.tiles import tiled

TILE = 2048


def _meets(distance: float, width: float) -> float:
    """The chance that one projection puts two points at this distance into one cell."""
    r = width / distance
    return 1 - math.erfc(r / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def plan(rows: int, cosine: float, miss: float = 0.002, width: float = 2.0) -> tuple[int, int]:
    """(projections a table, tables)."""
    m = max(4, math.ceil(math.log(max(rows, 2)) / -math.log(_meets(math.sqrt(2), width))) + 2)
    hit = _meets(max(math.sqrt(2 - 2 * cosine), 1e-6), width) ** m
    return m, max(1, math.ceil(math.log(miss) / math.log1p(-hit)))


def unit(column: pa.Array) -> tuple[np.ndarray, list[np.ndarray]]:
    """For each length of vectors: (rows, their normalised vectors in double precision); no vector is null, zero or holds nulls or non-finite numbers."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat, sizes = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64), column.value_lengths().to_numpy(zero_copy_only=False)
    starts = np.cumsum(sizes) - sizes
    for n in np.unique(sizes):
        at = np.flatnonzero(sizes == n)
        x = flat[starts[at][:, None] + np.arange(n)]
        x = x / np.abs(x).max(1, keepdims=True)  # so that squares neither overflow nor vanish
        yield at, x / np.sqrt((x * x).sum(1, keepdims=True))


class Hash:
    """The keys of vectors of one length in each table."""

    def __init__(self, length: int, m: int, tables: int, width: float, seed: int):
        rng = np.random.default_rng([seed, length])
        self.planes, self.shift = rng.standard_normal((length, tables * m)) / width, rng.random(tables * m)
        self.mult = rng.integers(1, 2**63, (tables, m), np.int64).view(np.uint64) | np.uint64(1)
        self.salt = rng.integers(1, 2**63, tables, np.int64).view(np.uint64)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        cells = np.floor(x @ self.planes + self.shift).astype(np.int64).view(np.uint64).reshape(len(x), *self.mult.shape)
        keys = (cells * self.mult).sum(2, dtype=np.uint64)
        keys ^= keys >> np.uint64(29)
        return (keys * np.uint64(0xBF58476D1CE4E5B9) + self.salt).view(np.int64)


def hashed(classes: DataFrame, cosine: float, rows: int, seed: int, width: float = 2.0) -> DataFrame:
    """id, label, v with `keys`: one long a table."""
    m, tables = plan(rows, cosine, width=width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_length: dict[int, Hash] = {}
        for batch in batches:
            if batch.num_rows:
                keys = np.empty((batch.num_rows, tables), np.int64)
                for at, x in unit(batch.column("v")):
                    n = x.shape[1]
                    keys[at] = by_length.setdefault(n, by_length.get(n) or Hash(n, m, tables, width, seed))(x)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1, dtype=np.int32) * tables), pa.array(keys.ravel()))], [*batch.schema.names, "keys"])

    from pyspark.sql import types as T

    return classes.mapInArrow(run, T.StructType([*classes.schema.fields, T.StructField("keys", T.ArrayType(T.LongType()))]))


def vector_links(vectors: DataFrame, *, cosine: float = 0.98, seed: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, n_links, component_id, kept: links between vectors of equal labels at `cosine` or more.

    Null labels, null, empty and zero vectors and those with null or non-finite components
    link with nothing; nor do vectors of different lengths. Equal vectors link. A row is a
    vector of its own: rows that share an id link like others, and count. A component's id
    is the smallest of its rows' ids; null ids come last, as null. A row is kept if its id
    is its component's. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    small_batches(spark, 2000)
    v = F.col("v")
    fine = F.col("label").isNotNull() & v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("id"), F.col(vector_col).alias("v"), F.col(label_col).alias("label"))
    # equal vectors, by 128 bits of label and components
    same = F.concat(F.hex(F.xxhash64("label", "v")), F.lit("-"), F.hex(F.xxhash64(F.lit(17), "v", "label")))
    rows = rows.withColumn("ok", F.coalesce(fine, F.lit(False))).withColumn("same", F.when(F.col("ok"), same))
    classes = rows.where("ok").groupBy("same").agg(F.min("id").alias("first"), F.count("*").alias("copies"), F.any_value("v").alias("v"), F.any_value("label").alias("label"))
    # `id` tells classes apart where ids repeat; it ascends with nothing
    classes = staged(classes.withColumn("id", F.monotonically_increasing_id()), "vector_classes")
    n = classes.count()
    held = staged(hashed(classes.select("id", "v", "label", "copies"), cosine, n, seed), "vector_keys")
    posts = held.select("id", "label", F.posexplode("keys").alias("tab", "key"))
    # members of the buckets where rows meet; of buckets with the same members, those of the first table
    name = ["label", "tab", "key"]
    buckets = posts.groupBy(*name).agg(F.count("*").alias("size"), F.bit_xor(F.xxhash64("id")).alias("h1"), F.bit_xor(F.xxhash64(F.lit(1), "id")).alias("h2")).where("size > 1")
    buckets = buckets.groupBy("size", "h1", "h2").agg(F.min(F.struct("tab", "label", "key")).alias("b")).select("b.*")
    buckets = staged(buckets.withColumn("grp", F.monotonically_increasing_id()), "vector_buckets")
    members = met(posts, name, buckets, n * plan(n, cosine)[1]).where("grp is not null").select("id", "grp", F.lit(0).alias("band"), "tab")
    members = staged(members, "vector_members")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups(batches, ["grp", "ti", "tj"]):
            ids, side, copies = (t.column(c).to_numpy() for c in ("id", "side", "copies"))
            keys = np.stack(t.column("keys").to_numpy())
            tab, ti, tj = t["tab"][0].as_py(), t["ti"][0].as_py(), t["tj"][0].as_py()
            edges, links = [], np.zeros(len(ids), np.int64)
            for at, x in unit(t.column("v")):
                a, b = np.flatnonzero(side[at] == ti), np.flatnonzero(side[at] == tj)
                linked = x[a] @ x[b].T >= cosine
                a, b = at[a], at[b]
                if ti == tj:
                    np.fill_diagonal(linked, False)
                for k in range(tab if linked.any() else 0):  # pairs that met in an earlier table were counted there
                    linked &= keys[a, k][:, None] != keys[b, k][None, :]
                links[a] += (linked @ copies[b].astype(float)).astype(np.int64)
                if ti != tj:
                    links[b] += (copies[a].astype(float) @ linked).astype(np.int64)
                edges += [(int(ids[a[r]]), int(ids[b[c]])) for r, c in forest(linked)]
            some = np.flatnonzero(links)
            if len(some):
                out = np.concatenate([np.array(edges, np.int64).reshape(-1, 2), np.stack([ids[some], ids[some]], 1)])
                yield pa.RecordBatch.from_arrays([pa.array(out[:, 0]), pa.array(out[:, 1]), pa.array(np.r_[np.zeros(len(edges), np.int64), links[some]])], ["a", "b", "n"])

    blocks = tiled(members, held, TILE).select("id", "v", "keys", "copies", "tab", "grp", "ti", "tj", "side")
    found = staged(blocks.mapInArrow(check, "a long, b long, n long"), "vector_links")
    roots = components(found.where("a != b").select("a", "b"), "vector_linked")
    others = found.where("a = b").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("others"))
    known = classes.select("id", "same", "first", "copies").join(roots.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    known = staged(known.join(others, "id", "left").select("same", "root", "first", (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "vector_known")
    least = known.groupBy("root").agg(F.min("first").alias("component"))
    known = staged(met(known, "root", least, n).select("same", "component", "n_links"), "vector_classed")
    slim = staged(rows.select("id", F.coalesce("same", F.concat(F.lit("-"), F.monotonically_increasing_id().cast("string"))).alias("same")), "vector_rows")
    out = met(slim, "same", known, slim.count())
    root = F.coalesce("component", "id")
    return out.select(back(F.col("id")).alias(id_col), F.coalesce("n_links", F.lit(0)).alias("n_links"), back(root).alias("component_id"), (root == F.col("id")).alias("kept"))


def op7_vector_dedup(spark, sf_dir: str) -> DataFrame:
    return vector_links(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP7_SQL = """
WITH v AS (SELECT row_number() OVER () AS k, vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
u AS (SELECT k, label, e, len(e) AS d, sqrt(list_dot_product(e, e)) AS n FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
l AS (SELECT a.k AS a, b.k AS b FROM u a JOIN u b ON a.label = b.label AND a.d = b.d AND a.k <> b.k AND a.n > 0 AND b.n > 0 AND list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.98),
r AS (WITH RECURSIVE w(a, b) AS (SELECT a, b FROM l UNION SELECT w.a, l.b FROM w JOIN l ON w.b = l.a) SELECT w.a, min(v.vec_id) AS m FROM w JOIN v ON v.k = w.b GROUP BY w.a)
SELECT v.vec_id, coalesce(c.n, 0)::BIGINT AS n_links, coalesce(least(v.vec_id, r.m), r.m, v.vec_id)::BIGINT AS component_id, coalesce(v.vec_id = coalesce(least(v.vec_id, r.m), r.m, v.vec_id), r.m IS NULL) AS kept
FROM v LEFT JOIN (SELECT a, count(*) AS n FROM l GROUP BY a) c ON v.k = c.a LEFT JOIN r ON v.k = r.a
"""
