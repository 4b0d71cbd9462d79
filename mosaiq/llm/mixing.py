"""Mixing sources to target weights by a low-discrepancy schedule.

Each source's documents are shuffled (order of a seeded hash) and laid end to end as
one stream of words, cut into blocks of equal length; the stream starts again from its
beginning when it ends, as often as documents may repeat. The points frac(t * golden
ratio), t = 0, 1, 2, ..., are mapped through the cumulated shares of the targets to
sources; the r-th point of a source takes the r-th block of its stream. Points go on until
every source has its target, and pass over sources that have it (these differ from their
share of the points by a few blocks only). The points that take a block, in order, are the
slots 0, 1, 2, ... of the mix: any run of them keeps the shares to within a few blocks.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from mosaiq.llm.shared import NULL_ID, back, met, prefix_sums, staged

#: Words: runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: frac(golden ratio) and the interval [0, 1), in units of 2**-31; products stay below 2**62.
GOLDEN, UNIT, CELL = 1327217885, 1 << 31, 1 << 19
#: Words of a block: the most, and how many blocks a small mix has at least.
BLOCK, BLOCKS = 1024, 1 << 16


@dataclass
class Mix:
    documents: DataFrame  # sid, id, tie (hash of the row), source, size, source_size, target, begin (in the source's stream), taken, first_slot, n_pieces
    segments: DataFrame  # slot, sid, id, tie, begin, size, epoch, word_from, word_to
    sources: DataFrame  # sid, source, source_size, weight, target, take
    block_words: int


def _targets(sizes: DataFrame, weights: tuple[float, ...], share: float, repeats: int) -> DataFrame:
    """Sources by code point, null last, with targets: water-filling under repeats * size.

    A source is full if its cap is no more than its part of what is left once all
    sources with a smaller cap by weight are full.
    """
    every = W.orderBy(F.col("source").asc_nulls_last())
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("sid", F.row_number().over(every).cast("long") - 1)
    s = s.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("sid") % len(weights) + 1).cast("int")))
    s = s.withColumn("cap", F.lit(float(repeats)) * F.col("source_size")).withColumn("total", F.lit(float(share)) * F.sum("source_size").over(W.partitionBy()))
    order = W.orderBy(F.col("cap") / F.col("weight"), "sid")
    upto = order.rowsBetween(W.unboundedPreceding, W.currentRow)
    s = s.withColumn("before", F.sum("cap").over(upto) - F.col("cap")).withColumn("left", F.sum("weight").over(W.partitionBy()) - F.sum("weight").over(upto) + F.col("weight"))
    s = s.withColumn("full", F.col("cap") * F.col("left") <= F.col("weight") * (F.col("total") - F.col("before")))
    full = F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0.0)).over(W.partitionBy())
    free = F.sum(F.when(F.col("full"), 0.0).otherwise(F.col("weight"))).over(W.partitionBy())
    target = F.when(F.col("full"), F.col("cap")).otherwise(F.col("weight") * (F.col("total") - full) / free)
    s = s.withColumn("target", target).withColumn("take", F.floor(F.col("target") + 0.5))
    return s.select("sid", "source", "source_size", "weight", "target", "take")


def _bases(counts: DataFrame, fine: str, coarse: Column) -> DataFrame:
    """counts (sid, fine, n) with `base`: the sum of n over smaller `fine` of the source; two levels, so no task orders a whole source."""
    c = counts.withColumn("_c", coarse)
    totals = c.groupBy("sid", "_c").agg(F.sum("n").alias("_t"))
    totals = totals.select("sid", "_c", (F.sum("_t").over(W.partitionBy("sid").orderBy("_c")) - F.col("_t")).alias("_before"))
    inner = c.withColumn("_in", F.sum("n").over(W.partitionBy("sid", "_c").orderBy(fine)) - F.col("n"))
    return inner.join(totals, ["sid", "_c"]).select("sid", fine, (F.col("_before") + F.col("_in")).alias("base"))


def _points(sources: DataFrame, n: int, first: int, end: int) -> DataFrame:
    """(t, sid, need): golden-ratio points `first` to `end` through the cumulated needs (blocks; n of all sources) that fall on a source of these."""
    cells = sources.where("hi > lo").select("sid", "need", "lo", "hi", F.explode(F.expr(f"sequence(lo div {CELL}, (hi - 1) div {CELL})")).alias("cell"))
    points = sources.sparkSession.range(first, end).withColumn("u", (F.col("id") % UNIT) * GOLDEN % UNIT).withColumn("cell", F.expr(f"u div {CELL}"))
    return points.join(cells, "cell").where("u >= lo and u < hi").select(F.col("id").alias("t"), "sid", "need")


def _schedule(sources: DataFrame, block: int) -> DataFrame:
    """(slot, sid, rank): each source's first points, as many as its target has blocks, ranked; slots number all of them in order."""
    s = sources.withColumn("need", F.expr(f"(take + {block - 1}) div {block}"))
    n = s.agg(F.sum("need")).first()[0] or 0
    upto = W.orderBy("sid").rowsBetween(W.unboundedPreceding, W.currentRow)
    s = s.withColumn("hi", F.floor(F.sum("need").over(upto) / F.lit(float(max(n, 1))) * UNIT)).withColumn("lo", F.coalesce(F.lag("hi").over(W.orderBy("sid")), F.lit(0)))
    s = staged(s.select("sid", "need", "lo", "hi"), "shares")
    chunk = F.shiftright("t", 12)
    points = _points(s, n, 0, n)
    have = points.groupBy("sid").agg(F.count("*").alias("have"))
    late = staged(s.join(have, "sid", "left").where("need > coalesce(have, 0)").select(s.columns), "late_sources")
    # a golden-ratio point falls into an interval of length 1 / n in any 2.62 n in a row
    points = points.unionByName(_points(late, n, n, 3 * n + 16)).withColumn("chunk", chunk)
    counts = staged(points.groupBy("sid", "chunk").agg(F.count("*").alias("n")), "point_counts")
    inside = F.row_number().over(W.partitionBy("sid", "chunk").orderBy("t")) - 1
    ranked = points.join(_bases(counts, "chunk", F.shiftright("chunk", 8)), ["sid", "chunk"]).withColumn("rank", F.col("base") + inside)
    ranked = ranked.where("rank < need").select("t", "sid", "rank")
    # intervals too short for the points' 31 bits (past some billion blocks): the rest comes last
    have = counts.groupBy("sid").agg(F.sum("n").alias("have"))
    rest = late.join(have, "sid", "left").withColumn("have", F.coalesce("have", F.lit(0))).where("have < need")
    rest = rest.select("sid", F.explode(F.expr("sequence(have, need - 1)")).alias("rank")).select((F.lit(3 * n + 16) + F.col("rank")).alias("t"), "sid", "rank")
    kept = staged(ranked.unionByName(rest).withColumn("chunk", chunk), "points")
    bases = prefix_sums(kept.groupBy("chunk").agg(F.count("*").alias("n")), "chunk", "n").select("chunk", "base")
    place = F.row_number().over(W.partitionBy("chunk").orderBy("t", "sid")) - 1
    return kept.join(bases, "chunk").select((F.col("base") + place).alias("slot"), "sid", "rank")


def mix(docs: DataFrame, *, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, repeats: int = 2, block_words: int | None = None, seed: int = 1, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> Mix:
    """Mix sources (weights repeat over them, in code point order, null last) to `share` of all words.

    A source's target is at most `repeats` times its size; the excess goes to the others
    by weight. Each source's taken words equal its target, rounded. block_words: 1024, or a 65,536th of the mix where that is
    less. A null source is a source; null and empty texts have no words and are never
    taken, but are listed. Rows that repeat are documents of their own; rows of one id and
    size go in the order of a hash of all their columns. An empty table gives empty
    results. No task orders a whole source.
    """
    every = F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns])
    sizes = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("id"), every.alias("tie"), F.col(source_col).cast("string").alias("source"), F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    sizes = staged(sizes, "sizes")
    sources = staged(_targets(sizes, weights, share, repeats), "sources")
    b = block_words or max(1, min(BLOCK, (sources.agg(F.sum("take")).first()[0] or 0) // BLOCKS))
    name = F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("name")
    named, n = sources.select(name, *[c for c in sources.columns if c != "source"]), sources.count()
    rows = sizes.select("*", name)
    rows = rows.join(F.broadcast(named), "name") if n <= 100_000 else met(rows, "name", named, sizes.count())
    # rows without an id come last, by a hash of the row (after all hexadecimal digits), so they are not one bucket
    told = lambda c: F.md5(F.concat(F.lit(f"{seed}:"), c.cast("string")).cast("binary"))
    key = F.when(F.col("id") == NULL_ID, F.concat(F.lit("g"), told(F.col("tie")))).otherwise(told(F.col("id")))
    rows = rows.drop("name").withColumn("key", key).withColumn("bucket", F.substring("key", 1, 4))
    bases = _bases(rows.groupBy("sid", "bucket").agg(F.sum("size").alias("n")), "bucket", F.substring("bucket", 1, 2))
    before = F.sum("size").over(W.partitionBy("sid", "bucket").orderBy("key", "id", "size", "tie").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("size")
    placed = rows.join(bases, ["sid", "bucket"]).withColumn("begin", F.col("base") + before)
    placed = staged(placed.select("sid", "id", "tie", "source", "size", "source_size", "target", "take", "begin"), "placed")
    passes = placed.where("size > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1)))).withColumn("at", F.col("epoch") * F.col("source_size") + F.col("begin")).withColumn("end", F.least(F.col("at") + F.col("size"), F.col("take"))).where("at < end")
    parts = passes.withColumn("rank", F.explode(F.expr(f"sequence(at div {b}, (end - 1) div {b})"))).withColumn("word_from", F.greatest("at", F.col("rank") * b) - F.col("at")).withColumn("word_to", F.least("end", (F.col("rank") + 1) * b) - F.col("at"))
    segments = staged(parts.join(_schedule(sources, b), ["sid", "rank"]).select("slot", "sid", "id", "tie", "begin", "size", "epoch", "word_from", "word_to"), "segments")
    # a document with words has its place in its source's stream to itself
    taken = segments.groupBy(F.col("sid").alias("s2"), F.col("begin").alias("b2")).agg(F.sum(F.col("word_to") - F.col("word_from")).alias("taken"), F.min("slot").alias("first_slot"), F.count("*").alias("n_pieces"))
    documents = placed.join(taken, (F.col("sid") == F.col("s2")) & (F.col("begin") == F.col("b2")) & (F.col("size") > 0), "left")
    documents = documents.select("sid", back(F.col("id")).alias("id"), "tie", "source", "size", "source_size", "target", "begin", F.coalesce("taken", F.lit(0)).alias("taken"), "first_slot", F.coalesce("n_pieces", F.lit(0)).alias("n_pieces"))
    return Mix(documents, segments.withColumn("id", back(F.col("id"))), sources, b)


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs as often as the mix takes them: a row stands for each pass that takes over half of its words.

    Whole documents, so a source is off its target by half a document at most. Rows are in
    the order of their first slots: partitions are ranges of slots, one after the other, so
    each is a run of the schedule, and a file that is written of it has the mix's shares.
    Null ids, texts and sources, repeats and empty tables are as for mix().
    """
    m = mix(docs, **options)
    passes = m.segments.groupBy("sid", "begin", "id", "tie", "size", "epoch").agg(F.sum(F.col("word_to") - F.col("word_from")).alias("n"), F.min("slot").alias("slot")).where("2 * n > size")
    passes = passes.select(F.coalesce("id", F.lit(NULL_ID)).alias("_id"), F.col("tie").alias("_tie"), "slot")
    slots = staged(passes.groupBy("_id", "_tie").agg(F.collect_list("slot").alias("_slots")), "slots")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    held = docs.select(F.struct(*columns).alias("row"), F.coalesce(F.col(options.get("id_col", "doc_id")).cast("long"), F.lit(NULL_ID)).alias("_id"), F.xxhash64(*columns).alias("_tie"))
    total = m.documents.count()
    if m.documents.groupBy("id", "tie").count().where("count > 1").limit(1).count():  # rows alike in all columns: one stands for all
        held = held.dropDuplicates(["_id", "_tie"])
    taken = met(held, ["_id", "_tie"], slots, total).select("row", F.explode("_slots").alias("_slot"))
    n = max(docs.rdd.getNumPartitions(), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return taken.repartitionByRange(n, "_slot").sortWithinPartitions("_slot").select("row.*")


def op1_mixing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return mix(docs).documents.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken", "first_slot", "n_pieces")


#: The same points, ranked by source; what they give a document follows from its place in its source's stream.
OP1_SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS sid FROM d GROUP BY source),
w AS (SELECT *, CASE sid % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight, 2.0::DOUBLE * source_size AS cap, 1.5::DOUBLE * sum(source_size) OVER () AS total FROM s),
o AS (SELECT *, sum(cap) OVER (ORDER BY cap / weight, sid) - cap AS before, sum(weight) OVER () - sum(weight) OVER (ORDER BY cap / weight, sid) + weight AS rest FROM w),
f AS (SELECT *, cap * rest <= weight * (total - before) AS is_full FROM o),
t AS (SELECT sid, source, source_size, CASE WHEN is_full THEN cap ELSE weight * (total - sum(CASE WHEN is_full THEN cap ELSE 0 END) OVER ()) / sum(CASE WHEN is_full THEN 0 ELSE weight END) OVER () END AS target FROM f),
n AS (SELECT greatest(1, least(1024, sum(floor(target + 0.5)::BIGINT)::BIGINT // 65536)) AS b FROM t),
a AS (SELECT sid, source, source_size, target, floor(target + 0.5)::BIGINT AS take, b, (floor(target + 0.5)::BIGINT + b - 1) // b AS need FROM t, n),
k AS (SELECT sid, need, floor(sum(need) OVER (ORDER BY sid)::DOUBLE / greatest(sum(need) OVER (), 1)::DOUBLE * 2147483648.0::DOUBLE)::BIGINT AS hi FROM a),
l AS (SELECT sid, need, coalesce(lag(hi) OVER (ORDER BY sid), 0) AS lo, hi FROM k),
g AS (SELECT t, t % 2147483648 * 1327217885 % 2147483648 AS u FROM (SELECT unnest(range(0, 3 * sum(need)::BIGINT + 16)) AS t FROM a)),
j AS (SELECT sid, need, t, row_number() OVER (PARTITION BY sid ORDER BY t) - 1 AS rank FROM g JOIN l ON u >= lo AND u < hi),
h AS (SELECT sid, rank, row_number() OVER (ORDER BY t) - 1 AS slot FROM j WHERE rank < need),
p AS (SELECT d.doc_id, d.size, a.sid, a.b, a.source_size, a.target, a.take AS given,
 (sum(d.size) OVER (PARTITION BY a.sid ORDER BY coalesce(md5('1:' || d.doc_id::VARCHAR), 'g'), d.doc_id, d.size ROWS UNBOUNDED PRECEDING))::BIGINT - d.size AS x FROM d JOIN a ON d.source IS NOT DISTINCT FROM a.source),
q AS (SELECT *, greatest(0, least(x + size, given) - x) AS one, greatest(0, least(x + source_size + size, given) - x - source_size) AS two FROM p)
SELECT doc_id, size, source_size, target, (one + two)::BIGINT AS taken, h.slot AS first_slot,
 (CASE WHEN one > 0 THEN (x + one - 1) // b - x // b + 1 ELSE 0 END + CASE WHEN two > 0 THEN (x + source_size + two - 1) // b - (x + source_size) // b + 1 ELSE 0 END)::BIGINT AS n_pieces
FROM q LEFT JOIN h ON q.sid = h.sid AND q.one > 0 AND h.rank = x // b
"""
