"""How corpus filters interact: what each removes in any order, and what only it removes.

A document's failures are a mask with a bit a filter. Four filters look at the document
alone. The fifth, exact copies, is found by partition refinement: classes of equal
code-point length are split by the hash of the texts' first block, then by that of each
next block; a class of one row is dropped as soon as it is one. Blocks grow 16-fold, so the
rounds follow the logarithm of the longest text. Full texts of the classes that survive are
compared, and all but the smallest id of each are marked. Then masks are counted, and every
order of the filters is worked out from the counts, of which there are 2**n a part at most.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations
from math import factorial

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from mosaiq.llm.shared import FEW, NULL_ID, met, remove, small_batches, stage, staged

# Fixed values of the filters: letters by bit, what D looks for.
LETTERS = "ABCDE"
SIGNS = b"#$%&*|"
UPPER, INNER = bytes(range(65, 91)), bytes(range(0x80, 0xC0))  # A-Z; UTF-8 bytes that begin no code point
BLOCK, GROWTH = 64, 16


def failures(text: bytes) -> int:
    """The bits of A to D: under 200 words; under half of the words distinct; over 3 % of A-Z; any of SIGNS."""
    words = text.split()  # at ASCII white space
    upper, chars = len(text) - len(text.translate(None, UPPER)), len(text.translate(None, INNER))
    return (len(words) < 200) | (100 * len(set(words)) < 50 * len(words)) << 1 | (100 * upper > 3 * chars) << 2 | (len(text.translate(None, SIGNS)) < len(text)) << 3


def blocks(text: bytes, bits: int = 64) -> list[int]:
    """A hash of each block, as signed 64-bit integers. bits: how many of each hash are kept (tests make them collide)."""
    out, view, at, size = [], memoryview(text), 0, BLOCK
    while at < len(text):
        out.append((xxhash.xxh3_64_intdigest(view[at : at + size]) >> (64 - bits)) - (1 << bits - 1))
        at, size = at + size, size * GROWTH
    return out


def _seen(rows: DataFrame, columns: list[str], bits: int) -> DataFrame:
    """Of rows (text, ...) these columns: own ones, `blocks`, `key` (a number for the length in code points and all blocks), `mask` (of A to D)."""
    new = {"blocks": T.ArrayType(T.LongType()), "key": T.LongType(), "mask": T.IntegerType()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            each = [blocks(t, bits) for t in texts]
            made = {"blocks": pa.array(each, pa.list_(pa.int64()))}
            made["key"] = pa.array([xxhash.xxh3_64_intdigest(repr((len(t.translate(None, INNER)), b)).encode()) - (1 << 63) for t, b in zip(texts, each, strict=True)], pa.int64())
            if "mask" in columns:
                made["mask"] = pa.array([failures(t) for t in texts], pa.int32())
            yield pa.RecordBatch.from_arrays([made[c] if c in made else batch.column(c) for c in columns], columns)

    return rows.mapInArrow(run, T.StructType([T.StructField(c, new[c]) if c in new else rows.schema[c] for c in columns]))


def refined(rows: DataFrame, total: int, few: int = FEW) -> DataFrame:
    """Distinct keys of rows (key, size, blocks) whose size and all blocks another row has too.

    Rows are put into classes by size, then by one block more each round; rows alone in
    their class go. Counts are partial sums, and rows get them from met(), so the rows of
    a class are never together. Rounds end when no text has a block left.
    """
    spark = rows.sparkSession

    def shared(df: DataFrame, n: int) -> DataFrame:
        many = df.groupBy("class").agg(F.count("*").alias("rows")).where("rows > 1")
        return met(df, "class", many, n, few).where("rows is not null").drop("rows")

    now, path = stage(shared(rows.select("key", F.col("size").cast("long").alias("class"), "blocks"), total), "refined")
    found, r = [], 0
    while n := now.count():
        # an empty text has no block; one that ends here is apart from one that goes on
        split = now.withColumn("class", F.xxhash64("class", F.get("blocks", F.lit(r)), F.size("blocks") > r + 1))
        after, later = stage(shared(split, n), "refined")
        found.append(staged(after.where(F.size("blocks") <= r + 1).select("key").distinct(), "survivors"))
        now, old = stage(after.where(F.size("blocks") > r + 1), "refined")
        remove(spark, path)
        remove(spark, later)
        path, r = old, r + 1
    out = rows.select("key").limit(0)
    for f in found:
        out = out.unionByName(f)
    return out.distinct()


def _copies(texts: DataFrame, survivors: DataFrame, most_keys: int) -> tuple[DataFrame, DataFrame | None]:
    """Of surviving keys: (key, first: the smallest id) where all texts are equal; (key, text, first) of the other keys, if there are any.

    Texts are compared as wholes, by grouping: each task sends a text that it has once.
    """
    keys = survivors.count()
    hint = F.broadcast(survivors) if keys <= most_keys else survivors.hint("merge")
    same = texts.join(hint, "key", "left_semi").groupBy("key", "text").agg(F.min("id").alias("first"))
    known, path = stage(same, "copies")
    classes = known.groupBy("key").agg(F.count("*").alias("texts"), F.min("first").alias("first"))
    classes = staged(classes, "copy_classes")
    mixed = classes.where("texts > 1").select("key")
    if mixed.limit(1).count():
        return classes.where("texts = 1").select("key", "first"), known.join(mixed.hint("merge"), "key", "left_semi")
    remove(classes.sparkSession, path)
    return classes.select("key", "first"), None


def failed(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang", bits: int = 64, most_keys: int = 1_000_000, few: int = FEW) -> DataFrame:
    """id, part, mask: a row a document; bit i of the mask is set if it fails the filter LETTERS[i].

    Null texts are empty, null parts the empty string. A copy is a text that a smaller id
    has; null ids (NULL_ID here) come last, and of rows that share an id none is smaller,
    so such rows alone are no copies. An empty table gives no rows. Surviving classes of up
    to most_keys are broadcast (16 bytes each); more meet texts in a shuffle.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part")).withColumn("size", F.length("text"))
    narrow = staged(_seen(rows, ["id", "part", "size", "blocks", "key", "mask"], bits), "judged")
    total = narrow.count()
    survivors = staged(refined(narrow.select("key", "size", "blocks"), total, few), "surviving_keys")
    one, several = _copies(_seen(rows.select("id", "text"), ["key", "id", "text"], bits), survivors, most_keys)
    copy = F.when(F.col("id") > F.col("first"), 1 << LETTERS.index("E")).otherwise(0)
    marked = met(narrow.select("id", "part", "key", "mask"), "key", one, total, few).withColumn("mask", F.col("mask") + copy).select("id", "part", "key", "mask")
    if several is None:
        return marked.drop("key")
    # different texts of one key: these rows are told apart by their texts
    keys = staged(several.select("key").distinct(), "mixed_keys")
    again = _seen(rows, ["id", "part", "text", "key", "mask"], bits).join(several.hint("merge"), ["key", "text"]).withColumn("mask", F.col("mask") + copy)
    return marked.join(keys.hint("merge"), "key", "left_anti").drop("key").unionByName(again.select("id", "part", "mask"))


def interactions(masks: DataFrame, letters: str = LETTERS) -> DataFrame:
    """part, filter_order, step and the counts of a step, for every order of the filters.

    masks: part, mask, and booleans good and toxic. kept: fail none up to this step.
    removed: fail this filter and none before. redundant: fail it and one before.
    unique_fails: fail it alone. good_lost, toxic_lost: removed ones that are good, toxic.
    shapley: what the filter removes, summed over all orders (a mask of k bits counts in a
    k-th of them for each of its filters). Every part has all orders and steps.
    """
    n = factorial(len(letters))
    counted = masks.groupBy("part", "mask").agg(F.count("*").alias("n"), F.sum(F.col("good").cast("long")).alias("good"), F.sum(F.col("toxic").cast("long")).alias("toxic"))
    counted = staged(counted, "masks")
    orders = F.explode(F.array(*[F.lit("".join(p)) for p in permutations(letters)]))
    rows = counted.withColumn("filter_order", orders).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(letters)))))

    def bits(s):
        return sum((F.when(F.instr(s, c) > 0, 1 << i).otherwise(0) for i, c in enumerate(letters)), F.lit(0))

    rows = rows.withColumn("own", bits(F.substring(F.col("filter_order"), F.col("step"), F.lit(1)))).withColumn("before", bits(F.substring(F.col("filter_order"), F.lit(1), F.col("step") - 1)))
    fails, earlier = F.col("mask").bitwiseAND(F.col("own")) > 0, F.col("mask").bitwiseAND(F.col("before")) > 0
    added = lambda when, what="n": F.sum(F.when(when, F.col(what)).otherwise(F.lit(0).cast("long")))
    return rows.groupBy("part", "filter_order", "step").agg(
        added(~fails & ~earlier).alias("kept"), added(fails & ~earlier).alias("removed"), added(fails & earlier).alias("redundant"), added(F.col("mask") == F.col("own")).alias("unique_fails"),
        added(fails & ~earlier, "good").alias("good_lost"), added(fails & ~earlier, "toxic").alias("toxic_lost"),
        F.sum(F.when(fails, F.expr(f"n * ({n} div bit_count(mask))")).otherwise(F.lit(0).cast("long"))).alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame, *, few: int = FEW, **options) -> DataFrame:
    """interactions() of the filters on docs; labels (doc_id, quality, toxic): a document is good (toxic) if any row of its id says 1.

    Labels without an id label nothing; nor are documents without an id labelled. Else as failed().
    """
    masks = failed(docs, few=few, **options)
    said = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    said = staged(said.where("good or toxic"), "labelled")
    masks = staged(masks, "failed")
    both = met(masks, "id", said, max(masks.count(), said.count()), few)
    return interactions(both.select("part", "mask", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic")))


def op11_filter_audit(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    return audit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality", "toxic"))


OP11_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(lang, '') AS part FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words FROM d),
g AS (SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
f AS (SELECT part, len(words) < 200 AS A, 100 * len(list_distinct(words)) < 50 * len(words) AS B, 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) AS C, regexp_matches(t, '[#$%&*|]') AS D,
 coalesce(coalesce(doc_id, 9223372036854775807) > min(coalesce(doc_id, 9223372036854775807)) OVER (PARTITION BY t), false) AS E, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic FROM w LEFT JOIN g USING (doc_id)),
m AS (SELECT part, A::INT + 2 * B::INT + 4 * C::INT + 8 * D::INT + 16 * E::INT AS mask, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic FROM f GROUP BY ALL),
l AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) AS v(c, b)),
o AS (SELECT a.c || b.c || c.c || d.c || e.c AS filter_order, [a.b, b.b, c.b, d.b, e.b] AS bits FROM l a, l b, l c, l d, l e WHERE a.b + b.b + c.b + d.b + e.b = 31 AND a.b | b.b | c.b | d.b | e.b = 31),
s AS (SELECT filter_order, step, bits[step] AS own, coalesce(list_sum(bits[1:step - 1]), 0)::INT AS before FROM o, range(1, 6) AS r(step)),
c AS (SELECT part, filter_order, step, own, coalesce(sum(n) FILTER (WHERE mask & (own | before) = 0), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (WHERE mask & own > 0 AND mask & before = 0), 0)::BIGINT AS removed,
 coalesce(sum(n) FILTER (WHERE mask & own > 0 AND mask & before > 0), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (WHERE mask = own), 0)::BIGINT AS unique_fails,
 coalesce(sum(good) FILTER (WHERE mask & own > 0 AND mask & before = 0), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (WHERE mask & own > 0 AND mask & before = 0), 0)::BIGINT AS toxic_lost FROM m, s GROUP BY part, filter_order, step, own)
SELECT part, filter_order, step::INT AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM c
"""
