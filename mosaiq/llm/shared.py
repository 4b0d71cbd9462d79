"""What the corpus operators share: the shared folder, staged tables, Arrow
streaming, word hashing and connected components.

A *staged* table is Parquet in the folder that all executors share. Writing it
cuts the lineage, so an executor lost later costs a re-read, not a re-run, and
the shuffle files behind it can go at once.
"""

from __future__ import annotations

import contextlib
import itertools
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

#: Stands for a null id inside an operator: ids sort with null last. No row may have this id itself.
NULL_ID = 2**63 - 1
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: `spark.checkpoint.dir`; in local mode one of this machine where it is unset."""
    path = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = "file:///tmp/checkpoints"
    return path.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder, removed when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/mosaiq-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    return path


def remove(spark: SparkSession, path: str) -> None:
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


@contextlib.contextmanager
def setting(spark: SparkSession, name: str, value: str):
    """A setting of the session, for what is planned and run inside."""
    old = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        if old is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, old)


def dropping_shuffles(spark: SparkSession):
    """Shuffle files of the actions inside go as soon as the action has ended."""
    return setting(spark, CLEANUP, "true")


def stage(df: DataFrame, name: str, codec: str = "zstd") -> tuple[DataFrame, str]:
    """Write df to the shared folder; the table read from there, and its path."""
    spark = df.sparkSession
    path = scratch(spark, name)
    with dropping_shuffles(spark):
        df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def staged(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write df to the shared folder and read it from there."""
    return stage(df, name, codec)[0]


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Fewer rows in an Arrow batch (unless the session has its own number): texts and packed columns are large."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, str(rows))


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text) only: null ids become NULL_ID (2**63 - 1, which no row may have itself), null texts empty. Other columns can't clash."""
    small_batches(docs.sparkSession)
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def back(col) -> "Column":  # noqa: F821
    """The outer form of an inner id: NULL_ID is null again."""
    return F.when(col != NULL_ID, col)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts of a column as one byte array, with the offsets of each text; nulls are empty."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


class WordHash(dict):
    """64-bit hash of each word, kept while there is room."""

    ROOM = 300_000

    def __missing__(self, word: bytes) -> int:
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > self.ROOM:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit integers (the splitmix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Runs of rows with equal (long) keys, from batches sorted by them. One run is in memory at a time."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        ks = [batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in keys]
        cut = np.flatnonzero(np.logical_or.reduce([k[1:] != k[:-1] for k in ks])) + 1
        edges = np.r_[0, cut, batch.num_rows]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            now = tuple(int(k[a]) for k in ks)
            if held and now != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = now
    if held:
        yield pa.Table.from_batches(held)


#: Rows that are broadcast or joined up in one task at most: some ten MB.
FEW = 500_000


def met(rows: DataFrame, key: str | list[str], table: DataFrame, total: int, few: int = FEW) -> DataFrame:
    """rows with the columns of table (one row a key at most) by `key`, nulls where it has none; keys are never null.

    total: how many rows there are; table has no more. `few` rows at most: table is
    broadcast. Else a key of more than a thousandth of the rows is hot: of these there are
    at most a thousand, so they are broadcast, and their rows stay where they are. All
    others shuffle. So no task gets one key's rows, however many they are.
    """
    keys = [key] if isinstance(key, str) else key
    if total <= few:
        return rows.join(F.broadcast(table), keys, "left").select(*rows.columns, *[c for c in table.columns if c not in keys])
    hot = rows.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") * 1000 > total).select(*keys, F.lit(True).alias("_hot"))
    there = rows.join(F.broadcast(hot.join(table, keys, "left")), keys, "left")
    names = [*rows.columns, *[c for c in table.columns if c not in keys]]
    return there.where("_hot").select(names).unionByName(there.where("_hot is null").select(rows.columns).join(table.hint("merge"), keys, "left").select(names))


def spanning(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of a graph's edges: (node, the smallest node it is joined with), for all nodes but the smallest ones."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y, root = at[: len(a)], at[len(a) :], np.arange(len(nodes))
    while True:
        lo, hi = np.minimum(root[x], root[y]), np.maximum(root[x], root[y])
        if not (lo < hi).any():
            k = np.flatnonzero(root < np.arange(len(nodes)))
            return nodes[k], nodes[root[k]]
        np.minimum.at(root, hi, lo)
        while (root[root] != root).any():
            root = root[root]


def _spanned(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b, held = [], [], 0
        for batch in batches:
            a.append(batch.column("a").to_numpy())
            b.append(batch.column("b").to_numpy())
            held += batch.num_rows
            if held > most:
                x, y = spanning(np.concatenate(a), np.concatenate(b))
                yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], ["a", "b"])
                a, b, held = [], [], 0
        if held:
            x, y = spanning(np.concatenate(a), np.concatenate(b))
            yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], ["a", "b"])

    return run


def components(edges: DataFrame, name: str = "components", rounds: int | None = None, few: int = FEW) -> DataFrame:
    """(node, root): the smallest node reachable from each node that has an edge.

    edges: columns a, b (long). First each task joins up its own edges, a million at a time,
    which leaves an edge a node at most. `few` edges at most are then joined up in one task.
    More go through alternating rounds over edges a > b. Large star: a's edge to b moves to
    b's least neighbour. Small star: all smaller neighbours of a, and a, go to a's least.
    Least neighbours are partial minima, and edges get them from met(), so a hub of any
    degree is never in one task. Every round is staged, and the one before removed. No
    edges: no rows. Loops and repeats are fine. Rounds go on until every node points at a
    root; it is an error if they don't end within `rounds` (if given, there is no joining up
    in one task).
    """
    spark = edges.sparkSession
    least = lambda df: df.groupBy("a").agg(F.min("b").alias("low"))
    now, path = stage(edges.select("a", "b").mapInArrow(_spanned(1 << 20), "a long, b long"), name)
    total = now.count()
    if total <= few and rounds is None:
        now, after = stage(now.coalesce(1).mapInArrow(_spanned(few), "a long, b long"), name)
        remove(spark, path)
        return _rooted(now)
    for done in itertools.count():
        ends = now.select(F.explode(F.array(F.struct(F.col("a").alias("v"), F.lit(1).alias("up")), F.struct(F.col("b").alias("v"), F.lit(0).alias("up")))).alias("e")).select("e.v", "e.up")
        moving = ends.groupBy("v").agg(F.sum("up").alias("up"), F.count("*").alias("n")).where("up > 1 or (up = 1 and n > 1)").limit(1).count()
        if not moving:
            return _rooted(now)
        if done == rounds:
            raise RuntimeError(f"{name}: the edges still change after {rounds} rounds")
        large, between = stage(met(now, "b", least(now).withColumnRenamed("a", "b"), total, few).select("a", F.coalesce("low", "b").alias("b")).distinct(), name)
        low = least(large)
        small = met(large, "a", low, total, few).where("b != low").select(F.col("b").alias("a"), F.col("low").alias("b")).unionByName(low.select("a", F.col("low").alias("b")))
        now, after = stage(small.distinct(), name)
        remove(spark, path)
        remove(spark, between)
        path, total = after, now.count()


def _rooted(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def prefix_sums(counts: DataFrame, key: str, value: str, span: int = 4096) -> DataFrame:
    """counts with `base`: the sum of `value` over smaller keys (whole numbers from 0).

    Two levels, so that no task orders all keys: sums inside spans of keys, then over
    the spans' totals, of which there are `span` times fewer.
    """
    block = counts.withColumn("_span", F.floor(F.col(key) / F.lit(span)))
    totals = block.groupBy("_span").agg(F.sum(value).alias("_total"))
    totals = totals.select("_span", (F.sum("_total").over(W.orderBy("_span")) - F.col("_total")).alias("_before"))
    inner = block.withColumn("_inner", F.sum(value).over(W.partitionBy("_span").orderBy(key)) - F.col(value))
    return inner.join(totals, "_span").withColumn("base", F.col("_before") + F.col("_inner")).drop("_span", "_inner", "_before")
