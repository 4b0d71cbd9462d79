"""Line deduplication with two Bloom filters.

One filter holds the hashes of lines seen once, the other of those seen twice or more.
Both are cut into slices of 65,536 bits by a hash's high bits; all of a hash's places are
in its slice. Each task sends the places of its lines to their slices; merging a slice puts
into `twice` what either has there and what two `once` filters share, so no repeated line
is missed. The filters grow with the number of lines. Up to `max_bits`, `twice` goes to all
tasks; beyond, slices stay where they are and lines' hashes meet them there (those that a
task has seen twice itself need not). Only lines that `twice` suspects are counted exactly,
by 128-bit digests of their keys, and have their first place chosen.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from mosaiq.llm.shared import NULL_ID, keyed, met, mixed, staged

SPACE = b" \t\n\x0b\x0c\r"
SLICE, HASHES = 1 << 16, 3
#: Lines that a task looks at together.
CHUNK = 2_000_000


def _keys(text: str | None) -> list[bytes]:
    """The key of each line: stripped of ASCII white space, A-Z lower-cased (bytes.lower() leaves other letters)."""
    return [line.strip(SPACE).lower() for line in (text or "").encode().split(b"\n")]


def _hashes(keys) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, keys), np.uint64)


def _slice(h: np.ndarray, slices: int) -> np.ndarray:
    """The slice of each hash; slices: a power of two."""
    return (h >> np.uint64(32)) & np.uint64(slices - 1)


def _places(h: np.ndarray) -> np.ndarray:
    """HASHES places in its slice for each hash, (HASHES, n)."""
    x = mixed(h)
    return np.stack([(x >> np.uint64(16 * i)) & np.uint64(SLICE - 1) for i in range(HASHES)])


def _sliced(h: np.ndarray, slices: int) -> dict[int, bytes]:
    places = np.unique((_slice(h, slices) * np.uint64(SLICE) + _places(h)).ravel())
    which = places // np.uint64(SLICE)
    cut = np.flatnonzero(np.diff(which)) + 1
    return {int(p[0]) // SLICE: (p % np.uint64(SLICE)).astype("<u2").tobytes() for p in np.split(places, cut) if len(p)}


def _filter(rows: DataFrame, slices: int) -> DataFrame:
    """slice, bits: the (packed) bits of the filter of lines that were seen twice; a slice without lines has no row."""

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out() -> pa.RecordBatch:
            h, n = np.unique(np.concatenate(held), return_counts=True)
            once, twice = _sliced(h, slices), _sliced(h[n > 1], slices)
            return pa.RecordBatch.from_arrays([pa.array(list(once), pa.int64()), pa.array(list(once.values()), pa.binary()), pa.array([twice.get(k, b"") for k in once], pa.binary())], ["slice", "once", "twice"])

        for batch in batches:
            for text in batch.column("text").to_pylist():
                held.append(_hashes({k for k in _keys(text) if k}))
                size += len(held[-1])
                if size > CHUNK:
                    yield out()
                    held, size = [], 0
        if size:
            yield out()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, once, twice = None, None, None
        for b in batches:
            for s, o, t in zip(b.column("slice").to_pylist(), b.column("once").to_pylist(), b.column("twice").to_pylist(), strict=True):
                if s != now:
                    if now is not None:
                        yield _row(now, twice)
                    now, once, twice = s, np.zeros(SLICE, bool), np.zeros(SLICE, bool)
                o, t = np.frombuffer(o, "<u2"), np.frombuffer(t, "<u2")
                twice[o[once[o]]] = True
                twice[t] = True
                once[o] = True
        if now is not None:
            yield _row(now, twice)

    def _row(s: int, twice: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([s]), pa.array([np.packbits(twice).tobytes()], pa.binary())], ["slice", "bits"])

    parts = rows.mapInArrow(local, "slice long, once binary, twice binary")
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return parts.repartition(n, "slice").sortWithinPartitions("slice").mapInArrow(merge, "slice long, bits binary")


def _set(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether all of each column's places are set in packed bits."""
    return ((bits[(at >> np.uint64(3)).astype(np.int64)] >> (np.uint8(7) - (at & np.uint64(7)).astype(np.uint8))) & 1).all(0)


def _suspected(h: np.ndarray, bits: np.ndarray, slices: int) -> np.ndarray:
    return _set(bits, _slice(h, slices) * np.uint64(SLICE) + _places(h))


SUSPECT = "key binary, id long, mark long, line long"


class Suspects:
    """The lines of rows (id, mark, text) that the filter suspects."""

    def __init__(self, rows: DataFrame, max_bits: int):
        self.rows, spark = rows, rows.sparkSession
        n = rows.agg(F.sum(F.length("text") - F.length(F.translate("text", "\n", "")) + 1)).first()[0] or 0
        self.slices = max(1, (1 << int(12 * n).bit_length()) // SLICE)
        self.table, self.shared = _filter(rows.select("text"), self.slices), None
        if self.slices * SLICE <= max_bits:
            out = np.zeros(self.slices * SLICE // 8, np.uint8)
            for row in self.table.toLocalIterator():  # max_bits / 8 bytes at most
                out[row["slice"] * SLICE // 8 :][: SLICE // 8] = np.frombuffer(row["bits"], np.uint8)
            self.shared = spark.sparkContext.broadcast(out.tobytes())
        else:
            self.met = staged(self._met(), "suspects")

    def _met(self) -> DataFrame:
        """Lines' hashes at their slices: each key once a chunk of lines, unless the chunk has it in two documents, which is suspicion enough."""
        slices = self.slices

        def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[tuple] = []

            def out() -> pa.RecordBatch:
                keys, ids, marks, lines = zip(*held, strict=True)
                h = _hashes(keys)
                n = np.unique(h, return_inverse=True, return_counts=True)
                sure = n[2][n[1]] > 1
                # those that are sure pass by any slice
                slice_ = np.where(sure, np.arange(len(h)) % slices, _slice(h, slices).astype(np.int64))
                return pa.RecordBatch.from_arrays([pa.array(slice_), pa.array(sure), pa.array(h.view(np.int64)), pa.array(map(xxhash.xxh3_128_digest, keys), pa.binary()), pa.array(ids, pa.int64()), pa.array(marks, pa.int64()), pa.array(lines, pa.int64())], ["slice", "sure", "h", "key", "id", "mark", "line"])

            for b in batches:
                for doc, mark, text in zip(b.column("id").to_pylist(), b.column("mark").to_pylist(), b.column("text").to_pylist(), strict=True):
                    held += [(k, doc, mark, i) for i, k in enumerate(_keys(text)) if k]
                    if len(held) > CHUNK // 8:
                        yield out()
                        held.clear()
            if held:
                yield out()

        def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, bits = None, None
            for b in batches:
                which = b.column("slice").to_numpy()
                keep = np.zeros(len(which), bool)
                cut = np.flatnonzero(np.diff(which)) + 1
                for x, y in zip(np.r_[0, cut], np.r_[cut, len(which)], strict=True):
                    part = b.slice(x, y - x)
                    if which[x] != now:
                        now, bits = which[x], None
                    own = part.column("bits").drop_null()
                    if len(own):
                        bits = np.frombuffer(own[0].as_py(), np.uint8)
                    asked = part.column("h").is_valid().to_numpy(zero_copy_only=False)
                    sure = part.column("sure").fill_null(False).to_numpy(zero_copy_only=False)
                    ok = sure & asked
                    test = np.flatnonzero(asked & ~sure)
                    if bits is not None and len(test):
                        ok[test] = _set(bits, _places(part.column("h").take(pa.array(test)).to_numpy().view(np.uint64)))
                    keep[x:y] = ok
                yield b.select(["key", "id", "mark", "line"]).take(pa.array(np.flatnonzero(keep)))

        asked = self.rows.mapInArrow(ask, "slice long, sure boolean, h long, key binary, id long, mark long, line long")
        both = asked.withColumn("bits", F.lit(None).cast("binary")).unionByName(self.table, allowMissingColumns=True)
        n = int(self.rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        # a slice's bits come first: their h is null
        return both.repartition(n, "slice").sortWithinPartitions("slice", "h").mapInArrow(answer, SUSPECT)

    def counted(self) -> DataFrame:
        """key (digest), n_docs, first (id, line) of each suspected key, exactly."""
        if self.shared is None:
            each = self.met.groupBy("key", "id", "mark").agg(F.min("line").alias("line"))
            rows = self.rows.groupBy("id", "mark").agg(F.count("*").alias("rows"))  # rows alike in id and text are documents each
            repeated = rows.where("rows > 1")
            each = each.join(repeated, ["id", "mark"], "left").select("key", F.coalesce("rows", F.lit(1)).alias("n"), F.struct(F.col("id").alias("first_id"), F.col("line").alias("first_line")).alias("first"))
            return each.groupBy("key").agg(F.sum("n").alias("n_docs"), F.min("first").alias("first"))
        shared, slices = self.shared, self.slices

        def suspects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bits, found = np.frombuffer(shared.value, np.uint8), {}

            def out() -> pa.RecordBatch:
                n_, i, k = zip(*found.values(), strict=True)
                return pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(n_, pa.int64()), pa.array(i, pa.int64()), pa.array(k, pa.int64())], ["key", "n", "first_id", "first_line"])

            for batch in batches:
                for doc, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                    keys: dict[bytes, int] = {}
                    for i, k in enumerate(_keys(text)):
                        if k:
                            keys.setdefault(k, i)
                    if not keys:
                        continue
                    for (k, i), hit in zip(keys.items(), _suspected(_hashes(keys), bits, slices), strict=True):
                        if hit:
                            k = xxhash.xxh3_128_digest(k)
                            m, d, j = found.get(k, (0, doc, i))
                            found[k] = (m + 1, *min((d, j), (doc, i)))
                if len(found) > 200_000:
                    yield out()
                    found.clear()
            if found:
                yield out()

        return self.rows.select("id", "text").mapInArrow(suspects, "key binary, n long, first_id long, first_line long").groupBy("key").agg(F.sum("n").alias("n_docs"), F.min(F.struct("first_id", "first_line")).alias("first"))

    def lines(self) -> DataFrame:
        """key, id, mark, line of all suspected lines."""
        if self.shared is None:
            return self.met
        shared, slices = self.shared, self.slices

        def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bits = np.frombuffer(shared.value, np.uint8)
            for batch in batches:
                rows_ = []
                for doc, mark, text in zip(batch.column("id").to_pylist(), batch.column("mark").to_pylist(), batch.column("text").to_pylist(), strict=True):
                    keys = _keys(text)
                    rows_ += [(xxhash.xxh3_128_digest(k), doc, mark, i) for i, (k, s) in enumerate(zip(keys, _suspected(_hashes(keys), bits, slices), strict=True)) if s and k]
                if rows_:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows_, strict=True), (pa.binary(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["key", "id", "mark", "line"])

        return self.rows.mapInArrow(places, SUSPECT)


def drop_lines(docs: DataFrame, *, min_docs: int = 2, keep: str = "first", id_col: str = "doc_id", text_col: str = "text", broadcast_keys: int = 1_000_000, max_bits: int = 1 << 28) -> DataFrame:
    """docs as `row` (a struct of its columns), text (what stays), n_lines, n_dropped.

    Lines whose key (stripped, lower-cased) is in min_docs documents or more go; with
    keep="first", each key's first line (smallest id, then place) stays, with "none" no
    line. Blank lines always stay. Null and empty texts are one empty line; null stays
    null. Rows that repeat count as documents of their own; of rows with one id, each
    keeps a first line. The input's columns live in `row`, so none can clash. An empty
    table gives no rows. A filter of up to max_bits (32 MB) is broadcast; a larger one stays
    cut over tasks, where lines meet it. The keys to drop are broadcast (as 128-bit hashes) if they are
    no more than broadcast_keys; else documents meet their lines in a join.
    """
    spark = docs.sparkSession
    rows = keyed(docs, id_col, text_col).withColumn("mark", F.xxhash64("text"))  # tells rows of one id apart
    suspects = Suspects(rows, max_bits)
    drops = suspects.counted().where(F.col("n_docs") >= min_docs).select("key", "n_docs", "first.first_id", "first.first_line")
    drops = staged(drops, "lines")
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("id"), F.col(text_col).alias("text"))
    from pyspark.sql import types as T

    schema = T.StructType([held.schema["row"], T.StructField("text", T.StringType()), T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])
    digest = xxhash.xxh3_128_digest

    def cut(text, drop) -> tuple:
        lines = (text or "").split("\n")
        kept = [x for i, x in enumerate(lines) if i not in drop] if drop else lines
        return ("\n".join(kept) if drop else text), len(lines), len(lines) - len(kept)

    def emit(batch, results) -> pa.RecordBatch:
        t, n, d = zip(*results, strict=True)
        return pa.RecordBatch.from_arrays([batch.column("row"), pa.array(t, pa.string()), pa.array(n, pa.int64()), pa.array(d, pa.int64())], ["row", "text", "n_lines", "n_dropped"])

    if drops.count() <= broadcast_keys:
        firsts = spark.sparkContext.broadcast({bytes(r["key"]): (r["first_id"], r["first_line"]) if keep == "first" else None for r in drops.toLocalIterator()})

        def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = firsts.value
            for batch in batches:
                if batch.num_rows:
                    out = []
                    for doc, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                        out.append(cut(text, {i for i, k in enumerate(_keys(text)) if k and (f := known.get(digest(k), 0)) != 0 and f != (doc, i)}))
                    yield emit(batch, out)

        return held.mapInArrow(apply, schema)

    def apply_joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield emit(batch, [cut(t, set(x or ())) for t, x in zip(batch.column("text").to_pylist(), batch.column("drop").to_pylist(), strict=True)])

    lines = staged(suspects.lines(), "suspected_lines")
    lines = met(lines, "key", drops.select("key", "first_id", "first_line"), lines.count()).where("first_id is not null")
    if keep == "first":
        lines = lines.where("not (id = first_id and line = first_line)")
    lines = staged(lines.groupBy("id", "mark").agg(F.collect_set("line").alias("drop")), "dropped_lines")
    marked = held.withColumn("mark", F.xxhash64(F.coalesce("text", F.lit(""))))
    return met(marked, ["id", "mark"], lines, docs.count()).select("row", "text", "drop").mapInArrow(apply_joined, schema)


def op8_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = drop_lines(docs.select("doc_id", "text"), min_docs=10, keep="none")
    return out.select("row.doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


#: Rows that repeat are documents of their own, so lines belong to a row's number.
OP8_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, string_split(coalesce(text, ''), chr(10)) AS x FROM documents),
l AS (SELECT k, doc_id, i, x[i] AS line, translate(trim(x[i], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w FROM (SELECT k, doc_id, x, unnest(range(1, len(x) + 1)) AS i FROM d)),
r AS (SELECT w FROM l WHERE w <> '' GROUP BY w HAVING count(DISTINCT k) >= 10)
SELECT any_value(l.doc_id) AS doc_id, count(*)::BIGINT AS n_lines, count(r.w)::BIGINT AS n_dropped, sha256(coalesce(string_agg(l.line, chr(10) ORDER BY l.i) FILTER (WHERE r.w IS NULL), '')) AS kept_sha256
FROM l LEFT JOIN r ON l.w = r.w GROUP BY l.k
"""
