"""Duplicate passages by prefix doubling on a sparse suffix array.

A position's rank stands for the string of the round's length that starts there. Each
round makes pairs of a position's rank and the rank at the round's offset, Spark sorts
them, equal pairs get one new rank (their number in the order), and positions whose pair
is in one document only are dropped. Ranks are numbers of exact pairs, so equal ranks are
equal strings; the ranks of 8 bytes are the bytes.

Ranking every byte would carry a row a byte through all rounds, many times the input. So
anchors are ranked: in every window of `length` bytes the positions at which a hash of 8
bytes is least, of those where 16 bytes fit (one position in 17). Strings of `length`
bytes that are equal have equal anchors, so no repeat is missed. As windows lie around
their anchor, ranks grow to both sides. For the default of 50:

Round 1, offset 8: 16 bytes at each anchor.
Round 2, offset 16: 32 bytes at the anchor, and 32 bytes from 16 before it. Every window
  with this anchor covers one of the two.
Round 3, offset 16: the ranks of both, and the 18 bytes on either side (by 128 bits): all
  that windows with this anchor can cover. If a smaller document has the same, all of them
  are repeats; the smallest document stands for it.
Round 4, the threshold: of what is left, documents of one rank of 32 bytes are put
  together, and each window is told by that rank, its place and its other 18 bytes; those
  that a smaller document has too are repeats.

Of documents that are copies as wholes, the one of the smallest id takes part; of rows
alike in id and text one takes part, and its result is given for each.

Tasks stream through sorted pairs and hold one position's document at a time, never all
that share a rank. Only round 4 holds the windows of one rank; of a rank in more than
CLASS positions they become rows that Spark sorts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from mosaiq.llm.shared import FEW, back, keyed, met, mixed, remove, stage, staged, text_bytes

SEED, HALF = 16, 32
M1, M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
#: Text a batch of work holds (so that what is worked out of it stays in the cache), and text that a partition of pairs stands for; partitions at most.
WORK, BUCKET, MOST = 1 << 17, 16 << 20, 16_384
#: Positions of one rank whose windows are compared in memory at most; rows that are worked on at once.
CLASS, CHUNK = 50_000, 1 << 16
#: Rows of a run of one document id that are held back at most.
PENDING = 1 << 20


def words_at(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position as an integer (zeros past the end): a view that overlaps itself, byte by byte."""
    padded = np.concatenate([data, np.zeros(16, np.uint8)])
    return np.ndarray(len(data), "<u8", padded, 0, (1,))


def _order(w: np.ndarray) -> np.ndarray:
    """What anchors are the least of."""
    return ((w * M1) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


def _sliding(x: np.ndarray, w: int, f) -> np.ndarray:
    """f over each w neighbours; len(x) - w + 1 values."""
    done = 1
    while done * 2 <= w:
        x = f(x[:-done], x[done:])
        done *= 2
    return f(x[: len(x) - (w - done)], x[w - done :]) if w > done else x


def anchors(w: np.ndarray, ends: np.ndarray, length: int) -> np.ndarray:
    """Anchors of texts laid end to end (ends: each one's end): the places that are least in a window; windows do not cross texts.

    A window start is owned by its first least place (owned() tells which); of equal places
    one may own none.
    """
    n, span = len(w), length - SEED + 1
    if n < length:
        return np.zeros(0, np.int64)
    order = _order(w)
    # the place itself in the low bits would not be the same in other texts: ties go to the first place of a window
    top = _sliding(order, span, np.minimum)[: n - length + 1]
    for a, b in zip(np.r_[0, ends[:-1]].tolist(), ends.tolist(), strict=True):  # of windows that cross an end
        top[max(a, b - length + 1) : b] = 0
    pad = np.zeros(span - 1, np.uint32)
    most = _sliding(np.concatenate([pad, top, pad]), span, np.maximum)
    m = min(len(most), n)
    return np.flatnonzero((most[:m] == order[:m]) & (most[:m] > 0))


def owned(w: np.ndarray, x: np.ndarray, begin: np.ndarray, end: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The first and last window start that each of some anchors x owns, from what lies around x alone; the last is before the first if there is none."""
    span = length - SEED + 1
    own, lo, hi = _order(w[x]), np.maximum(x - span + 1, begin), np.minimum(x, end - length)
    for d in range(1, span):
        j = x - d
        # an equal or lesser place before it takes the windows that hold both, and a lesser one behind it
        np.maximum(lo, j + 1, out=lo, where=(j >= begin) & (_order(w[np.maximum(j, 0)]) <= own))
        j = x + d
        np.minimum(hi, j - span, out=hi, where=(j < end) & (_order(w[np.minimum(j, len(w) - 1)]) < own))
    return lo, hi


def _work(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Runs of rows of about WORK bytes, with their bytes and the texts' ends."""
    data, offsets = text_bytes(batch.column("text"))
    a = 0
    while a < batch.num_rows:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + WORK)))
        b = min(b, batch.num_rows)
        yield batch.slice(a, b - a), data[offsets[a] : offsets[b]], offsets[a + 1 : b + 1] - offsets[a]
        a = b


REPEAT, LEFT, RIGHT, START, BIG = range(5)
PLACES = "id long, mark long, kind int, pos binary, val binary"


def _by_doc(kind: int, ids: np.ndarray, marks: np.ndarray, pos: np.ndarray, *vals: np.ndarray) -> pa.RecordBatch:
    """(id, mark, kind, pos, val): a row a document, its places packed, and their values (8 bytes each, place by place)."""
    order = np.lexsort((pos, marks, ids))
    ids, marks, pos = ids[order], marks[order], pos[order].astype("<u4")
    val = np.stack([v[order] for v in vals], 1) if vals else np.zeros((len(pos), 0), np.int64)
    cut = np.flatnonzero(np.r_[True, (ids[1:] != ids[:-1]) | (marks[1:] != marks[:-1])]) if len(ids) else np.zeros(0, np.int64)
    ends = np.r_[cut[1:], len(ids)]
    blobs = [pa.array([x[a:b].tobytes() for a, b in zip(cut, ends, strict=False)], pa.binary()) for x in (pos, val)]
    return pa.RecordBatch.from_arrays([pa.array(ids[cut], pa.int64()), pa.array(marks[cut], pa.int64()), pa.array(np.full(len(cut), kind, np.int32)), *blobs], ["id", "mark", "kind", "pos", "val"])


class _Out:
    """Collects places and gives them by document, a million at a time."""

    def __init__(self):
        self.held, self.n = {}, 0

    def add(self, kind: int, *cols: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(cols[0]):
            self.held.setdefault(kind, []).append(cols)
            self.n += len(cols[0])
        if self.n > 1 << 20:
            yield from self.end()

    def end(self) -> Iterator[pa.RecordBatch]:
        for kind, parts in self.held.items():
            yield _by_doc(kind, *map(np.concatenate, zip(*parts, strict=True)))
        self.held, self.n = {}, 0


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, np.ndarray]]:
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= CHUNK:
            t = pa.Table.from_batches(held)
            yield {c: t.column(c).to_numpy() for c in t.column_names}
            held, n = [], 0
    if n:
        t = pa.Table.from_batches(held)
        yield {c: t.column(c).to_numpy() for c in t.column_names}


class Run:
    """Runs of equal keys in rows that come sorted by keys and id: streams through them, of any length.

    shared(): the rows of runs in two documents or more, with the run's number; runs of
    more than PENDING rows of one id pass too, so that none is held (a later round drops
    them: ranks of one id alone never make a repeat). later(): the rows of larger documents
    than the run's first.
    """

    def __init__(self, keys: list[str]):
        self.keys, self.last, self.first, self.many, self.number, self.pending = keys, None, None, False, 0, []

    def _cut(self, c: dict[str, np.ndarray]):
        """Of each row: how many runs after the one before this chunk it is; of these runs: first id and whether there is another."""
        n, ids = len(c["id"]), c["id"]
        new = np.zeros(n, bool)
        for k in self.keys:
            new[1:] |= c[k][1:] != c[k][:-1]
        new[0] = self.last is None or any(c[k][0] != v for k, v in zip(self.keys, self.last, strict=True))
        run, starts = np.cumsum(new), np.flatnonzero(new)
        first = np.r_[ids[0] if self.first is None else self.first, ids[starts]]
        end = np.r_[starts, n] - 1  # of the runs before each start, and the last
        many = np.r_[self.many or (end[0] >= 0 and self.last is not None and ids[end[0]] > first[0]), ids[end[1:]] > first[1:]]
        self.last = tuple(c[k][-1] for k in self.keys)
        return run, first, many

    def later(self, batches) -> Iterator[dict[str, np.ndarray]]:
        for c in _chunks(batches):
            run, first, many = self._cut(c)
            at = c["id"] > first[run]
            self.first, self.many = first[run[-1]], many[run[-1]]
            yield {k: v[at] for k, v in c.items()}

    def shared(self, batches) -> Iterator[dict[str, np.ndarray]]:
        for c in _chunks(batches):
            run, first, many = self._cut(c)
            if many[0] and self.pending:
                for p in self.pending:
                    yield p | {"run": np.full(len(p["id"]), self.number)}
                self.pending = []
            at, top = many[run], run[-1]
            yield {k: v[at] for k, v in c.items()} | {"run": self.number + run[at]}
            if top:
                self.pending = []
            if not many[top]:  # of one document so far
                self.pending.append({k: v[run == top] for k, v in c.items()})
            self.first, self.many, self.number = first[top], many[top], self.number + int(top)
            if sum(len(p["id"]) for p in self.pending) > PENDING:
                for p in self.pending:
                    yield p | {"run": np.full(len(p["id"]), self.number)}
                self.pending, self.many = [], True


def _number() -> int:
    """What a task's numbers of runs start from: no two tasks' numbers meet."""
    from pyspark import TaskContext

    return (TaskContext.get().partitionId() << 40) + 1


def _round_1(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out, base = _Out(), _number()
    for c in Run(["a", "b"]).shared(batches):
        yield from out.add(RIGHT, c["id"], c["mark"], c["pos"], c["run"] + base)
    yield from out.end()


def _round_2(side: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Ranks of the two sides differ: they are odd to the right."""
        out, base = _Out(), _number()
        for c in Run(["r", "a", "b"]).shared(batches):
            yield from out.add(side, c["id"], c["mark"], c["pos"], (c["run"] + base) * 2 + (side == RIGHT), *((c["o1"], c["o2"]) if side == RIGHT else ()))
        yield from out.end()

    return run


def _round_3(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out = _Out()
    for c in Run(["a", "b", "o1", "o2"]).later(batches):
        yield from out.add(REPEAT, c["id"], c["mark"], c["pos"])
    yield from out.end()


def _round_5(names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Out()
        for c in Run(["r", *names]).later(batches):
            yield from out.add(START, c["id"], c["mark"], c["pos"])
        yield from out.end()

    return run


def _windows(c: dict[str, np.ndarray], length: int) -> tuple[np.ndarray, ...]:
    """Of positions with their bytes on both sides: the row, the start and the telling bytes (3 words) of each window."""
    over = length - HALF
    least, most = c["least"].astype(np.int64), c["most"].astype(np.int64)  # bytes of a window before the ranked string
    n = np.maximum(most - least + 1, 0)
    row = np.repeat(np.arange(len(n)), n)
    e = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + least[row]
    sides = np.frombuffer(b"".join(c["sides"]), np.uint8)  # `over` bytes before the ranked string and after it
    told = np.zeros((len(row), -(-(over + 1) // 8) * 8), np.uint8)
    for k in range(0, len(row), CHUNK):
        told[k : k + CHUNK, :over] = sides[((row * 2 + 1) * over - e)[k : k + CHUNK, None] + np.arange(over)]
    told[:, over] = e
    return row, c["pos"].astype(np.int64)[row] - e, told.view("<i8")


def _round_4(length: int, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Windows of positions of one rank (rows come sorted by rank and id) that a smaller document has too."""
        out, held, big = _Out(), None, False

        def spread(c) -> Iterator[pa.RecordBatch]:
            """Of a rank in very many positions: its windows, to become rows."""
            row, at, told = _windows(c, length)
            yield from out.add(BIG, c["id"][row], c["mark"][row], at, c["r"][row], *told.T)

        def small(c) -> Iterator[pa.RecordBatch]:
            starts = np.flatnonzero(np.r_[True, c["r"][1:] != c["r"][:-1]])
            ends = np.r_[starts[1:], len(c["r"])]
            some = np.repeat(c["id"][ends - 1] > c["id"][starts], ends - starts)  # ranks of two documents or more
            c = {k: v[some] for k, v in c.items()}
            if not len(c["id"]):
                return
            row, at, told = _windows(c, length)
            keys = [c["r"][row], *told.T]
            h = np.zeros(len(row), np.uint64)
            for k in keys:
                h = mixed((h + M2) * M1 ^ k.view(np.uint64))
            order = np.argsort(h, kind="stable")  # rows of one rank are sorted by id, and stay so
            same = h[order][1:] == h[order][:-1]
            differ = np.logical_or.reduce([k[order][1:] != k[order][:-1] for k in keys]) if len(row) else same
            if (same & differ).any():  # one hash for two windows
                order = np.lexsort((c["id"][row], *keys))
                differ = np.logical_or.reduce([k[order][1:] != k[order][:-1] for k in keys])
            new = np.r_[True, differ] if len(row) else differ
            ids = c["id"][row][order]
            again = ids > ids[np.flatnonzero(new)][np.cumsum(new) - 1]
            k = order[again]
            yield from out.add(START, c["id"][row[k]], c["mark"][row[k]], at[k])

        for c in _chunks(batches):
            if held is not None:
                c = {k: np.concatenate([held[k], v]) for k, v in c.items()}
                held = None
            last = int(np.searchsorted(c["r"], c["r"][-1]))  # the last rank may go on in the next chunk
            if big:  # the rank before this chunk is being spread
                a = int(np.searchsorted(c["r"], big, "right"))
                yield from spread({k: v[:a] for k, v in c.items()})
                c = {k: v[a:] for k, v in c.items()}
                if not len(c["id"]):
                    continue
                last, big = last - a, False
            if last:
                yield from small({k: v[:last] for k, v in c.items()})
            held = {k: v[last:] for k, v in c.items()}
            if len(held["id"]) > most:
                yield from spread(held)
                big, held = held["r"][0], None
        if held is not None:
            yield from small(held)
        yield from out.end()

    return run


def _listed(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a column of lists of (pos, val): the row of each place, the place, and its values (n, width), by row and place."""
    each, sizes = column.flatten(), column.value_lengths().fill_null(0).to_numpy()
    blobs, ends = text_bytes(each.field("pos"))
    pos = blobs.view("<u4").astype(np.int64)
    values = text_bytes(each.field("val"))[0].view("<i8").reshape(len(pos), width) if width else np.zeros((len(pos), 0), np.int64)
    n = np.diff(ends[np.r_[0, np.cumsum(sizes)]] // 4)
    row = np.repeat(np.arange(len(n)), n)
    order = np.lexsort((pos, row))
    row, pos = row[order], pos[order]
    new = np.r_[True, (row[1:] != row[:-1]) | (pos[1:] != pos[:-1])][: len(pos)]
    return row[new], pos[new], values[order[new]]


def _batch(names: list[str], *cols: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names)


def _with(rows: DataFrame, keys: list[str], table: DataFrame, total: int) -> DataFrame:
    """rows with the columns of a staged table by keys: broadcast where it is small, else no task gets all rows of a key."""
    return rows.join(F.broadcast(table), keys, "left") if table.count() <= FEW else met(rows, keys, table, total)


def remove_repeats(docs: DataFrame, *, length: int = 50, most: int = CLASS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, spans (array of begin, end), kept (binary).

    A byte goes if a string of `length` (48 to 128) bytes over it also starts in a document
    of smaller id; what stays may not be valid UTF-8. Null and empty texts have no bytes;
    shorter texts lose nothing. Of rows that share an id none is smaller; each keeps its own
    result, worked out once for rows alike in id and text. Null ids come last. An empty table gives no rows. most: positions of one rank
    whose windows are compared in memory.
    """
    assert 48 <= length <= 128
    spark = docs.sparkSession
    # of whole copies (by 128 bits) the smallest id stands for all; the others are repeats from end to end
    rows = keyed(docs, id_col, text_col).withColumn("mark", F.xxhash64("text")).withColumn("mark2", F.xxhash64(F.lit(1), "text"))
    keys = staged(rows.select("id", "mark", "mark2", (F.octet_length("text") >= length).alias("long")), "keys")
    copied = staged(keys.where("long").groupBy("mark", "mark2").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"), "copied")
    # rows alike in id and text: one stands for all of them until the end
    alike = staged(keys.groupBy("id", "mark", "mark2").agg(F.count("*").alias("n")).where("n > 1"), "alike")
    repeats = alike.count()
    n_rows = keys.count()
    rows = _with(rows, ["mark", "mark2"], copied, n_rows)
    copy = F.coalesce(F.col("id") > F.col("first"), F.lit(False))
    copies = rows.where(copy).select("id", F.octet_length("text").cast("long").alias("n"))
    copies = copies.select("id", F.col("n").alias("n_bytes"), F.col("n").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), F.array(F.array(F.lit(0).cast("long"), "n")).alias("spans"), F.lit(b"").alias("kept"))
    marked = rows.where(~copy).select("id", "mark", "mark2", "text").withColumn("n", F.lit(1).cast("long"))  # `mark` tells rows of one id apart
    if repeats:
        held = _with(marked.drop("n"), ["id", "mark", "mark2"], alike, n_rows)
        single = held.where("n is null").withColumn("n", F.lit(1).cast("long"))
        marked = staged(single.unionByName(held.where("n > 1").groupBy("id", "mark", "mark2").agg(F.any_value("text").alias("text"), F.any_value("n").alias("n"))), "distinct_rows")
    # different texts of one id and one mark are told apart by the other half of the 128 bits
    clash = staged(keys.groupBy("id", "mark").agg(F.min("mark2").alias("least"), F.max("mark2").alias("most")).where("least < most").select("id", "mark", F.lit(True).alias("clash")), "clashes")
    if clash.limit(1).count():
        marked = _with(marked, ["id", "mark"], clash, n_rows).withColumn("mark", F.when(F.col("clash"), F.xxhash64("mark2", "mark")).otherwise(F.col("mark"))).drop("clash")
    marked = marked.select("id", "mark", "text", "n")
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = min(MOST, max(64, -(-total // BUCKET)))
    over = length - HALF

    def sorted_by(df: DataFrame, *keys: str) -> DataFrame:
        return df.repartition(parts, *keys).sortWithinPartitions(*keys, "id")

    def gathered(df: DataFrame, name: str, **kinds: int) -> tuple[DataFrame, str]:
        lists = [F.collect_list(F.when(F.col("kind") == k, F.struct("pos", "val"))).alias(c) for c, k in kinds.items()]
        return stage(df.groupBy("id", "mark").agg(*lists), name)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, ends in _work(batch):
                w = words_at(data)
                at = anchors(w, ends, length)
                if len(at):
                    row = np.searchsorted(ends, at, "right")
                    yield _batch(["a", "b", "id", "mark", "pos"], w[at].view(np.int64), w[at + 8].view(np.int64), part.column("id").to_numpy()[row], part.column("mark").to_numpy()[row], (at - np.r_[0, ends[:-1]][row]).astype(np.int32))

    one = sorted_by(marked.mapInArrow(find, "a long, b long, id long, mark long, pos int"), "a", "b").mapInArrow(_round_1, PLACES)
    one, old = gathered(one, "ranks_of_16", ranked=RIGHT)

    def pair_32(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pairs at offset 16 to both sides; `r` is twice the rank, and one more to the right. o1, o2: what lies further out, 0 where the text ends before."""
        for batch in batches:
            for part, data, ends in _work(batch):
                w, begins = words_at(data), np.r_[0, ends[:-1]]
                row, pos, rank = _listed(part.column("ranked"), 1)
                at, rank, pos, o = pos + begins[row], rank[:, 0] * 2, pos.astype(np.int32), np.zeros((2, len(pos)), np.uint64)
                whole = (at - SEED - over >= begins[row]) & (at + HALF + over <= ends[row])
                x, h = at[whole], np.stack([np.full(whole.sum(), m) for m in (M1, M2)])
                for k in [*range(0, over - 7, 8), over - 8]:
                    for base in (x - SEED - over, x + HALF):
                        h = mixed((h ^ w[base + k]) * np.stack([M2 | np.uint64(1), M1 | np.uint64(1)])[:, None] + h)
                o[:, whole] = h | np.uint64(1)
                o, ids, marks = o.view(np.int64), part.column("id").to_numpy()[row], part.column("mark").to_numpy()[row]
                for side, ok, y in ((1, at + HALF <= ends[row], at + SEED), (0, at - SEED >= begins[row], at - SEED)):
                    y = y[ok]
                    yield _batch(["r", "a", "b", "id", "mark", "pos", "o1", "o2"], rank[ok] + side, w[y].view(np.int64), w[y + 8].view(np.int64), ids[ok], marks[ok], pos[ok], *(o[:, ok] if side else np.zeros((2, ok.sum()), np.int64)))

    # staged, and one side after the other, so that texts, pairs and ranks aren't all on disk together
    pairs, pairs_at = stage(marked.join(one, ["id", "mark"]).select("id", "mark", "text", "ranked").mapInArrow(pair_32, "r long, a long, b long, id long, mark long, pos int, o1 long, o2 long"), "pairs")
    remove(spark, old)
    right, right_at = gathered(sorted_by(pairs.where("r % 2 = 1"), "r", "a", "b").mapInArrow(_round_2(RIGHT), PLACES), "right_ranks", right=RIGHT)
    left, left_at = gathered(sorted_by(pairs.where("r % 2 = 0"), "r", "a", "b").mapInArrow(_round_2(LEFT), PLACES), "left_ranks", left=LEFT)
    remove(spark, pairs_at)
    two = left.join(right, ["id", "mark"], "full")

    def pair_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                (rl, pl, vl), (rr, pr, vr) = _listed(batch.column("left"), 1), _listed(batch.column("right"), 3)
                _, kl, kr = np.intersect1d(rl << 32 | pl, rr << 32 | pr, assume_unique=True, return_indices=True)
                whole = vr[kr, 1] != 0
                kl, kr = kl[whole], kr[whole]
                yield _batch(["a", "b", "o1", "o2", "id", "mark", "pos"], vl[kl, 0], vr[kr, 0], vr[kr, 1], vr[kr, 2], batch.column("id").to_numpy()[rr[kr]], batch.column("mark").to_numpy()[rr[kr]], pr[kr].astype(np.int32))

    three = sorted_by(two.mapInArrow(pair_all, "a long, b long, o1 long, o2 long, id long, mark long, pos int"), "a", "b", "o1", "o2").mapInArrow(_round_3, PLACES)
    three, _ = gathered(three, "repeats", repeat=REPEAT)

    def positions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """What rounds 2 and 3 left: rank of 32 bytes, how many bytes of a window lie before these, `over` bytes on both sides, place of the 32 bytes."""
        for batch in batches:
            for part, data, ends in _work(batch):
                begins, w = np.r_[0, ends[:-1]], words_at(data)
                row, pos, _ = _listed(part.column("repeat"), 0)
                gone = pos + begins[row]
                padded = np.concatenate([np.zeros(over, np.uint8), data, np.zeros(HALF + over, np.uint8)])
                # to the right of the anchor: windows that start `over` or fewer bytes before it; the others cover the 32 bytes from 16 before it
                for c, back_ in (("right", 0), ("left", SEED)):
                    row, x, val = _listed(part.column(c), 3 if c == "right" else 1)
                    x = x + begins[row]
                    ok = ~np.isin(x, gone)
                    x, row, val = x[ok], row[ok], val[ok]
                    lo, hi = owned(w, x, begins[row], ends[row], length)
                    start, most = x - back_, np.minimum(x - lo, over if c == "right" else length)
                    least = np.maximum(x - hi, 0 if c == "right" else over + 1)
                    ok = least <= most
                    x, row, val, start, least, most = x[ok], row[ok], val[ok], start[ok], least[ok] - back_, most[ok] - back_
                    if len(x):
                        near = padded[start[:, None] + np.r_[np.arange(over), over + HALF + np.arange(over)]]
                        yield _batch(["r", "least", "most", "sides", "id", "mark", "pos"], val[:, 0], least.astype(np.int32), most.astype(np.int32), [b.tobytes() for b in near], part.column("id").to_numpy()[row], part.column("mark").to_numpy()[row], (start - begins[row]).astype(np.int32))

    four = marked.join(two.join(three, ["id", "mark"], "left"), ["id", "mark"]).select("id", "mark", "text", "left", "right", "repeat").mapInArrow(positions, "r long, least int, most int, sides binary, id long, mark long, pos int")
    four, _ = gathered(sorted_by(four, "r").mapInArrow(_round_4(length, most), PLACES), "starts", start=START, big=BIG)
    remove(spark, left_at)
    remove(spark, right_at)

    words = -(-(over + 1) // 8)
    names = ["a", "b", "c", "d", "e", "f", "g", "h", "i", "j", "k", "l", "m"][:words]

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                row, pos, val = _listed(batch.column("big"), 1 + words)
                yield _batch(["r", *names, "id", "mark", "pos"], *val.T, batch.column("id").to_numpy()[row], batch.column("mark").to_numpy()[row], pos.astype(np.int32))

    big = four.where(F.size("big") > 0)
    starts_ = four.select("id", "mark", "start")
    if big.limit(1).count():
        five = big.mapInArrow(unpack, f"r long, {', '.join(n + ' long' for n in names)}, id long, mark long, pos int")
        five, _ = gathered(sorted_by(five, "r", *names).mapInArrow(_round_5(names), PLACES), "more_starts", more=START)
        starts_ = starts_.join(five, ["id", "mark"], "full").select("id", "mark", F.concat(F.coalesce("start", F.array().cast(starts_.schema["start"].dataType)), F.coalesce("more", F.array().cast(starts_.schema["start"].dataType))).alias("start"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, ends in _work(batch):
                begins = np.concatenate([[0], ends[:-1]])
                gone = np.zeros(len(data) + 1, np.int32)
                row, pos, _ = _listed(part.column("repeat"), 0)
                if len(pos):
                    lo, hi = owned(words_at(data), pos + begins[row], begins[row], ends[row], length)
                    lo, hi = lo[lo <= hi], hi[lo <= hi]
                    np.add.at(gone, lo, 1)
                    np.add.at(gone, hi + length, -1)
                row, pos, _ = _listed(part.column("start"), 0)
                s = pos + begins[row]
                np.add.at(gone, s, 1)
                np.add.at(gone, s + length, -1)
                gone = np.cumsum(gone[:-1]) > 0
                out = []
                for a, b in zip(begins, ends, strict=True):
                    g = gone[a:b]
                    edges = np.flatnonzero(np.diff(np.r_[False, g, False])).astype(np.int64)
                    out.append((int(b - a), int(g.sum()), len(edges) // 2, edges.reshape(-1, 2).tolist(), data[a:b][~g].tobytes()))
                cols = zip(*out, strict=True)
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.list_(pa.int64())), pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("n"), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], ["id", "n", "n_bytes", "n_removed", "n_spans", "spans", "kept"])

    places = three.join(starts_, ["id", "mark"], "full")
    joined = marked.join(places, ["id", "mark"], "left").select("id", "n", "text", "repeat", "start")
    out = joined.mapInArrow(cut, "id long, n long, n_bytes long, n_removed long, n_spans long, spans array<array<long>>, kept binary")
    if repeats:  # each result as often as its row comes; very many are dealt over tasks
        out = staged(out, "results")
        runs = out.where("n > 1").withColumn("run", F.explode(F.expr("sequence(0L, (n - 1) div 4096)"))).repartition("id", "n_bytes", "run")
        many = runs.withColumn("each", F.explode(F.expr("sequence(run * 4096, least(n, (run + 1) * 4096) - 1)")))
        out = out.where("n = 1").unionByName(many.select(out.columns))
    out = out.drop("n")
    return out.unionByName(copies).select(back(F.col("id")).alias("doc_id"), "n_bytes", "n_removed", "n_spans", "spans", "kept")


def op2_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return remove_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
