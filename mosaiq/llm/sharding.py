"""Sharding by a two-pass external shuffle, in DataFrame functions only.

Pass 1 scatters rows uniformly over memory-sized buckets by a seeded hash. Pass 2
holds one bucket at a time, shuffles it (Spark's `shuffle` is Fisher-Yates) and
writes it. The buckets in order are a random permutation of the table; cut into
equal runs it gives the shards, whose row counts differ by one at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from mosaiq.llm.shared import prefix_sums, setting, staged


def external_shuffle(df: DataFrame, size, key, *, bucket_bytes: int = 16 << 20, seed: int = 7, most: int = 16_384, most_heavy: int = 100_000) -> DataFrame:
    """All rows in random order: columns row (struct of df's columns), bucket, pos (0.. in the bucket).

    size: a column of bytes a row takes; key: a column that is hashed first. A row's bucket
    follows from hashes of the key and of all its columns, and its place in it from those
    and the seed, so the order hangs on rows, sizes, seed, bucket_bytes and `most` alone,
    not on files, splits or the cluster. Rows alike in all columns share a bucket, unless
    they would fill a quarter of one: such rows are counted, dealt anew by number, so they
    spread over all buckets. The number of buckets follows the bytes, so a bucket's memory
    does not grow with the input; `most` partitions at most hold them, one bucket in memory
    at a time. Nulls anywhere are values like others; an empty table gives no rows; the
    input's columns live in `row`, so none can clash. Columns are of types that Spark can
    hash and compare (no maps).
    """
    spark = df.sparkSession
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), size.cast("long").alias("size"), key.alias("key"))
    rows = rows.select(F.xxhash64(F.lit(seed), "key", "row").alias("h"), F.xxhash64(F.lit(seed + 1), "row", "key").alias("g"), "key", "size", "row")
    total = rows.agg(F.sum("size")).first()[0] or 0
    n = max(1, -(-total // bucket_bytes))
    bucket = lambda *c: F.pmod(F.xxhash64(F.lit(seed + 2), "h", "g", *c), F.lit(n))
    heavy = rows.groupBy("h", "g").agg(F.count("*").alias("copies"), F.max("size").alias("each")).where(f"copies > 1 and copies * each * 4 > {bucket_bytes}").select("h", "g")
    heavy = staged(heavy, "heavy")
    many = heavy.count()
    dealt = rows.withColumn("bucket", bucket())
    if many:
        small = F.broadcast(heavy) if many <= most_heavy else heavy.hint("merge")
        copied = rows.join(small, ["h", "g"]).groupBy("h", "g").agg(F.any_value("key").alias("key"), F.any_value("size").alias("size"), F.any_value("row").alias("row"), F.count("*").alias("copies"))
        runs = copied.withColumn("run", F.explode(F.expr("sequence(0L, (copies - 1) div 4096)"))).repartition("h", "g", "run")
        copies = runs.withColumn("copy", F.explode(F.expr("sequence(run * 4096, least(copies, (run + 1) * 4096) - 1)")))
        dealt = rows.join(small, ["h", "g"], "left_anti").withColumn("bucket", bucket()).unionByName(copies.select(*rows.columns, bucket("copy").alias("bucket")))
    # sorted by bucket, so that one bucket's rows are in memory at a time, not those of all buckets of a partition
    with setting(spark, "spark.sql.execution.useObjectHashAggregateExec", "false"):
        buckets = dealt.repartition(min(n, most), "bucket").groupBy("bucket").agg(F.collect_list(F.struct("h", "g", "key", "size", "row")).alias("rows"))
        # the order in which rows arrive is chance: sort first, then permute by the seed
        shuffled = buckets.sortWithinPartitions("bucket").select("bucket", F.shuffle(F.array_sort("rows"), F.lit(seed)).alias("rows"))
        out = shuffled.select("bucket", F.posexplode("rows").alias("pos", "r")).select("r.row", "bucket", F.col("pos").cast("long").alias("pos"), "r.size")
        return staged(out, "shuffled")


def shard(df: DataFrame, size, key, n_shards: int, **options) -> DataFrame:
    """row, size, shard (0 to n_shards - 1), slot (gapless from 0 in each shard).

    Fewer rows than shards leave shards empty. Else as external_shuffle.
    """
    rows = external_shuffle(df, size, key, **options)
    n = rows.count()
    bases = prefix_sums(rows.groupBy("bucket").agg(F.count("*").alias("n")), "bucket", "n").select("bucket", "base")
    bases = staged(bases, "bases")  # its size is known then: rows need no shuffle to meet a small table
    ranked = rows.join(bases, "bucket").withColumn("rank", F.col("base") + F.col("pos"))
    at = F.expr(f"rank * {n_shards} div {max(n, 1)}")
    first = F.expr(f"(shard * {n} + {n_shards - 1}) div {n_shards}")
    return ranked.withColumn("shard", at).select("row", "size", F.col("shard").cast("int").alias("shard"), (F.col("rank") - first).alias("slot"))


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder a shard, rows by slot inside each file; files of one shard are cut by slot ranges."""
    sharded.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op10_sharding(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    size = F.coalesce(F.octet_length("text"), F.lit(0)) + 16
    out = shard(docs, size, F.col("doc_id"), 40)
    return out.select("row.doc_id", "size", F.crc32(F.coalesce("row.text", F.lit("")).cast("binary")).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
