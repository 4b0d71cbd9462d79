"""Graphs of any size: tables in the shared folder, look-ups that no hot key slows, components."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

#: Rows that are broadcast or joined up in one task at most, and edges that a task joins up together.
FEW, CHUNK = 500_000, 1 << 20


def both_ways(edges: DataFrame, i: str, j: str, keep: list) -> DataFrame:
    """Each edge and its reverse; `keep`: (name, forward column, reverse column)."""
    there = edges.select(F.col(i).alias("a"), F.col(j).alias("b"), *[f.alias(n) for n, f, _ in keep])
    return there.unionByName(edges.select(F.col(j).alias("a"), F.col(i).alias("b"), *[r.alias(n) for n, _, r in keep]))


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: `spark.checkpoint.dir`; in local mode one of this machine where it is unset."""
    path = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not path and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return (path or "file:///tmp/checkpoints").rstrip("/")


def kept(df: DataFrame) -> tuple[DataFrame, object]:
    """df written to the shared folder and read from there, and its path; the path goes when the driver's JVM ends."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/mosaiq-{spark.sparkContext.applicationId}/kept-{uuid.uuid4().hex[:12]}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    df.write.parquet(path.toString())
    return spark.read.schema(df.schema).parquet(path.toString()), path


def _kept(df: DataFrame) -> DataFrame:
    """Cut the lineage in the folder that all executors share."""
    return kept(df)[0]


def gone(spark: SparkSession, path) -> None:
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """rows spread over tasks by keys: for few rows of much work each, which Spark would put together by their bytes."""
    return rows.repartition(4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def looked_up(rows: DataFrame, keys: list[str], table: DataFrame, few: int = FEW, n: int | None = None) -> DataFrame:
    """rows with what table (staged; one row a key at most) has for them, nulls where it has nothing; keys are never null.

    A table of up to `few` rows is broadcast. Of a larger one, the rows of keys that come in
    over a thousandth of all rows are (a thousand keys at most), and their rows stay where
    they are; all others shuffle. So no task gets all rows of a key. n: the table's rows, if they were counted.
    """
    more = [c for c in table.columns if c not in keys]
    if (table.count() if n is None else n) <= few:
        return rows.join(F.broadcast(table), keys, "left").select(*rows.columns, *more)
    total = rows.count()
    hot = rows.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") * 1000 > max(total, 1000)).select(*keys, F.lit(True).alias("_hot"))
    told = rows.join(F.broadcast(hot.join(table, keys, "left")), keys, "left")
    rest = told.where("_hot is null").select(*rows.columns).join(table.hint("merge"), keys, "left")
    return told.where("_hot").select(*rows.columns, *more).unionByName(rest.select(*rows.columns, *more))


def roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of some edges, and the smallest node that each is joined with."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y, low = at[: len(a)], at[len(a) :], np.arange(len(nodes))
    while (low[x] != low[y]).any():
        np.minimum.at(low, np.maximum(low[x], low[y]), np.minimum(low[x], low[y]))
        while (low != low[low]).any():
            low = low[low]
    return nodes, nodes[low]


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b) to (a, the smallest node that a task's edges join it with), a chunk of edges at a time."""
    a, b, n = [], [], 0

    def out() -> pa.RecordBatch:
        x, y = roots(np.concatenate(a), np.concatenate(b))
        return pa.RecordBatch.from_arrays([pa.array(x[x != y]), pa.array(y[x != y])], ["a", "b"])

    for batch in batches:
        a.append(batch.column(0).to_numpy())
        b.append(batch.column(1).to_numpy())
        n += batch.num_rows
        if n > CHUNK:
            yield out()
            a, b, n = [], [], 0
    if n:
        yield out()


def components(nodes: DataFrame, edges: DataFrame, few: int = FEW) -> DataFrame:
    """node, component (its smallest node): nodes has `node`; edges a, b. Isolated nodes stand alone.

    Each task joins up its own edges, which leaves an edge a node at most. What is left, up
    to `few` edges, is joined up in one task. More goes through rounds: labels take the
    smallest label of the neighbours, then the label's own label, so long chains need few
    rounds. A step is a partial minimum, and look-ups spread hot keys, so a hub's edges are
    never in one task. Rounds are staged, and what one replaces is removed.
    """
    spark = nodes.sparkSession
    near, old = kept(edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).mapInArrow(_joined, "a long, b long"))
    total = near.count()
    if total <= few:
        table, path = kept(near.coalesce(1).mapInArrow(_joined, "a long, b long").select(F.col("a").alias("node"), F.col("b").alias("root")))
        gone(spark, old)
        return looked_up(nodes.select("node"), ["node"], table, max(few, total)).select("node", F.coalesce("root", "node").alias("component"))
    near, path = kept(both_ways(near, "a", "b", []).distinct())
    gone(spark, old)
    label, before = kept(nodes.select("node", F.col("node").alias("component")))
    while True:
        seen = label.select(F.col("node").alias("b"), F.col("component").alias("seen"))
        low, low_path = kept(looked_up(near, ["b"], seen, few).groupBy(F.col("a").alias("node")).agg(F.min("seen").alias("low")))
        step = looked_up(label, ["node"], low, few).select("node", F.least("component", F.coalesce("low", "component")).alias("up"), F.col("component").alias("was"))
        root = label.select(F.col("node").alias("up"), F.col("component").alias("root"))
        now, after = kept(looked_up(step, ["up"], root, few).select("node", F.col("root").alias("component"), (F.col("root") < F.col("was")).alias("moved")))
        gone(spark, before)
        gone(spark, low_path)
        label, before = now.select("node", "component"), after
        if not now.where("moved").limit(1).count():
            gone(spark, path)
            return label


def numbered(rows: DataFrame, keys: list[str], name: str = "node") -> DataFrame:
    """Distinct keys with a number each, staged: what stands for them in graphs."""
    return kept(rows.select(*keys).distinct().withColumn(name, F.monotonically_increasing_id()))[0]



def ranked(rows: DataFrame, by: list, name: str = "place") -> DataFrame:
    """rows with their place (from 0) in the order of some columns: ranges of rows are sorted each for itself, and counts of ranges give their starts.

    Rows that tie go in any order. Only the counts, a row a range, are summed in one task.
    """
    held, _ = kept(rows.orderBy(*by).withColumn("_at", F.monotonically_increasing_id()))
    # the number of a range in the high bits, the place in it in the low 33
    held = held.withColumn("_range", F.shiftright("_at", 33)).withColumn("_in", F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)))
    sizes = held.groupBy("_range").agg(F.count("*").alias("_n"))
    starts = sizes.select("_range", (F.sum("_n").over(W.orderBy("_range")) - F.col("_n")).alias("_start"))
    return held.join(F.broadcast(starts), "_range").withColumn(name, F.col("_start") + F.col("_in")).drop("_at", "_range", "_in", "_start")


def ranked_within(rows: DataFrame, key: str, by: list, name: str = "place", few: int = FEW) -> DataFrame:
    """rows with their place (from 0) among those of their key; a key may have any number of rows."""
    every, _ = kept(ranked(rows, [key, *by], "_place"))
    first, _ = kept(every.groupBy(key).agg(F.min("_place").alias("_first")))
    return looked_up(every, [key], first, few).withColumn(name, F.col("_place") - F.col("_first")).drop("_place", "_first")
