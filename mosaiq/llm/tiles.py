"""All pairs inside groups of any size, in tiles.

A group's members are dealt over tiles of bounded size; each two tiles that can hold a
pair are one block of work, so no task holds more than two tiles and no pair is ever a
row. Members may have a band (a size class): only pairs of one band or of neighbouring
bands count, and a large group is cut into its bands first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from mosaiq.llm.shared import met


def tiled(members: DataFrame, data: DataFrame, tile: int) -> DataFrame:
    """members (id, grp, band, ...) with data (id, ...), once for each block (grp, ti, tj), ti <= tj, that a member is in.

    `side` is the member's tile, ti or tj. Rows are dealt and sorted by the block, for a
    stream over blocks. A group of up to `tile` members is one block. members is a staged table.
    """
    spark = members.sparkSession
    counts = members.groupBy("grp", "band").agg(F.count("*").alias("n")).withColumn("all", F.sum("n").over(W.partitionBy("grp")))
    big = counts.where(F.col("all") > tile).select("grp", "band", F.expr(f"(n + {tile - 1}) div {tile}").alias("tiles"))
    by_band = W.partitionBy("grp").orderBy("band")
    near = lambda f, d: F.when(f("band").over(by_band) == F.col("band") + d, f("tiles").over(by_band)).otherwise(0)
    big = big.withColumn("below", near(F.lag, -1)).withColumn("above", near(F.lead, 1))
    placed = met(members, ["grp", "band"], big, members.count()).withColumn("tiles", F.coalesce("tiles", F.lit(0)))
    own = F.when(F.col("tiles") > 0, F.col("band").cast("long") * (1 << 32) + F.pmod(F.xxhash64("id"), F.col("tiles"))).otherwise(F.lit(0))
    runs = [F.expr(f"case when {n} > 0 then transform(sequence(0, {n} - 1), t -> (cast(band as long) + {d}) * {1 << 32} + t) else array() end") for n, d in (("tiles", 0), ("below", -1), ("above", 1))]
    others = F.when(F.col("tiles") > 0, F.concat(*runs)).otherwise(F.array(F.lit(0).cast("long")))
    more = [c for c in members.columns if c not in ("id", "grp", "band")]
    blocks = placed.withColumn("side", own).withColumn("other", F.explode(others)).select("id", "grp", *more, "side", F.least("side", "other").alias("ti"), F.greatest("side", "other").alias("tj"))
    # nothing bounds the members: a plan that guessed them small would not hold for more of them
    rows = data.join(blocks.hint("merge"), "id")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, "grp", "ti", "tj").sortWithinPartitions("grp", "ti", "tj")
