"""N-gram Jaccard join: a blocked sparse product of documents by n-grams.

The matrix has a row a document and a column an n-gram. Its product with itself holds
all overlaps; a pair links if its overlap reaches what the two sizes ask for.

Which rows can meet: if two sets of at most m n-grams link, they differ in at most
h(m) = floor(2 m (100 - p) / (100 + p)) n-grams. Each row posts digests of parts of its
set, chosen so that two linked rows post one in common; rows that share a digest are put
into one row block. This bound loses no pair and sends no pairs.

* h = 0: the sets are equal; the digest is that of the whole set.
* h = 1 to 4 (small sets): columns are dealt by hash to k strips, and each k - h strips have
  a digest: h n-grams touch h strips at most, so two linked rows agree on all others.
* above: columns are dealt into more than h / 2 column blocks of three strips each, so two
  linked rows differ in one n-gram at most on one block at least, and agree wholly on two of
  its strips. Each two strips of a block have a digest.

Empty strips say nothing and are never posted. A set that would need them is dealt again by
another hash (both of two linked sets that need it are), up to LEVELS times; a set that needs
them at every level posts its n-grams one by one, and two linked ones share one of these.
All of a digest's n-grams must agree, so frequent n-grams (lines, passages) bring hardly any
rows together. Rows of one batch that share a digest are joined there and post it once, so
a digest that very many rows have comes once a batch to the task that joins it.

Digests are most of what an input asks of the disk, so they are on it once, as they travel:
packed by ranges, 8 bytes each and about one for the id (sketches, below, are also staged). The task of a range has it in
memory, so ranges grow in number with the texts, and only pairs of ids leave.

Two rows that are much alike share many digests, which lie in as many ranges, and each range
would tell of them. So a first pass posts a few digests a row (its sketch), and what shares
one of these is joined up; then all rows post all digests, under the smallest id that theirs
is joined with. What is joined already is told by no range, however many there are. The
first pass need not find any pair: what it misses meets in the second.

What meets is decided exactly: the product of a row block accumulates overlap counts
(rare columns pair by pair, frequent ones as dense slabs), in tiles of bounded size,
and pairs below their bound are discarded. Only a spanning forest of the links leaves.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window as W, functions as F

from mosaiq.llm.shared import NULL_ID, WordHash, back, components, groups, keyed, met, mixed, staged
from mosaiq.llm.tiles import tiled

TILE, DENSE = 2048, 8
#: Strips for sets that differ in at most 0 to 4 n-grams, and how often a set is dealt again.
COVER, LEVELS = (1, 3, 5, 7, 8), 8
#: Characters of text a range of digests: a digest comes to 8 characters in long texts, to 2 in short ones.
RANGE = 1 << 24
#: A sketch has so many digests of a small set, and those of so many blocks of a larger one, a size class.
SKETCH, FIRST = 8, 4
#: N-grams of larger sets that are dealt together, rows of a tile whose links are told at once, and n-grams of a block that are multiplied at once: all bound a task's memory.
TOGETHER, AT_ONCE, COLUMNS = 1 << 16, 256, 1 << 18


def shingles(words: np.ndarray, n: int) -> np.ndarray:
    """The distinct n-word shingles of a text's word hashes, sorted; a shorter text is one shingle, no words none."""
    if not len(words):
        return np.zeros(0, np.uint64)
    k = min(n, len(words))
    h = np.full(len(words) - k + 1, 0x5851F42D4C957F2D * k & 0xFFFFFFFFFFFFFFFF, np.uint64)
    for i in range(k):
        h = (h ^ words[i : len(words) - k + 1 + i]) * np.uint64(0x9FB21C651E98DF25)
        h ^= h >> np.uint64(32)
    return np.unique(mixed(h))


def text_sets(texts: list[str], known: WordHash, n: int) -> Iterator[np.ndarray]:
    """bytes.lower() changes A-Z alone and bytes.split() cuts at ASCII white space alone."""
    for t in texts:
        yield shingles(known.of((t or "").encode().lower().split()), n)


class Columns:
    """The digests of sets, by size class, for a threshold of `percent`."""

    STRIPS = ((0, 1), (0, 2), (1, 2))

    def __init__(self, percent: int):
        self.percent, self.tops = percent, []
        while self.differ(self._next()) < len(COVER) and (not self.tops or self.tops[-1] < 1000):  # a class for each h
            self.tops.append(self._next())
        self.few = len(self.tops)
        self.parts = [np.array(list(combinations(range(k), k - h)), np.int64) for h, k in enumerate(COVER)]

    def _next(self) -> int:
        """The largest size above all classes' at which h is still that of the size after the last class."""
        size = self.tops[-1] + 1 if self.tops else 1
        while self.differ(size + 1) == self.differ(size) and size < 1000:
            size += 1
        return size

    def _class(self, size: int) -> int:
        while not self.tops or self.tops[-1] < size:
            self.tops.append(max(self.tops[-1] * 4 // 3, self.tops[-1] + 1) if self.tops else 1)
        return int(np.searchsorted(self.tops, size))

    def differ(self, size: int) -> int:
        """How many n-grams two linked sets of at most this size can differ in."""
        return 2 * size * (100 - self.percent) // (100 + self.percent)

    def digests(self, s: np.ndarray) -> np.ndarray:
        """Digests for a set's own size class and those that a larger partner can be in; s is sorted."""
        return self.of([s])[0]

    def of(self, sets: list[np.ndarray], few: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """The digests of many sets, and the place of the set that each is of.

        few: their sketches, some of these digests; sets much alike probably have one of them in common.
        """
        out, place, large = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], []

        def keep(some: np.ndarray, at: np.ndarray | int) -> None:
            out.append(some)
            place.append(np.full(len(some), at, np.int64))

        for i, s in enumerate(sets):
            for c in range(self._class(len(s)), self._class(len(s) * 100 // self.percent) + 1) if len(s) else ():
                seed, h = self.tops[c] * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF, self.differ(self.tops[c])
                if h >= len(COVER):
                    large.append((i, h, seed))
                elif few:
                    keep(np.sort(self._covers(s, h, seed)[0])[:SKETCH], i)
                else:
                    keep(self._levels(s, h, seed), i)
        held_to = np.cumsum([len(sets[i]) for i, _, _ in large]) // TOGETHER
        cuts = np.r_[0, np.flatnonzero(np.diff(held_to)) + 1, len(large)] if large else [0]
        for k, end in zip(cuts[:-1], cuts[1:], strict=True):
            some = large[k:end]
            digest, both, job = self._many_blocks([sets[i] for i, _, _ in some], np.array([self._dealt(h) for _, h, _ in some]).sum(1), np.array([x for _, _, x in some], np.uint64), few)
            spare, least = np.array([self._dealt(h)[1] for _, h, _ in some]), both.min(1)
            floor = np.zeros(len(some), np.int64)
            for f in (1, 2, 3):
                floor[np.bincount(job[least < f], minlength=len(some)) <= spare] = f
            held = both >= (3 if few else np.maximum(floor, 1)[job][:, None])
            out.append(digest[held])
            place.append(np.array([i for i, _, _ in some])[np.broadcast_to(job[:, None], held.shape)[held]])
            for j in () if few else np.flatnonzero(floor == 0):
                keep(self._levels(sets[some[j][0]], *some[j][1:], 1), some[j][0])
        return np.concatenate(out), np.concatenate(place)

    def _levels(self, s: np.ndarray, h: int, seed: int, level: int = 0) -> np.ndarray:
        """A set's digests for one class from this level on."""
        out, t = [], s
        for k in range(LEVELS):
            if k:
                t = np.sort(mixed(t + np.uint64(0x2545F4914F6CDD1D)))
                seed = (seed + 0xD1342543DE82EF95) & 0xFFFFFFFFFFFFFFFF
            if k >= level:
                some, whole = self._covers(t, h, seed) if h < len(COVER) else self._blocks(t, h, seed)
                out.append(some)
                if whole:
                    return np.concatenate(out)
        return np.concatenate([*out, mixed(t + np.uint64(seed))])

    def _many_blocks(self, sets: list[np.ndarray], n: np.ndarray, seeds: np.ndarray, few: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """_pairs of each set in n blocks (few: of the first ones), a row a block, and each row's set."""
        m = np.minimum(n, FIRST) if few else n
        if few:
            sets = [s if k <= FIRST else s[: s.searchsorted(np.uint64(-(-(FIRST << 32) // k) << 32))] for s, k in zip(sets, n.tolist(), strict=True)]
        every, of = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        base = np.cumsum(3 * m) - 3 * m
        at = base[of] + (((every >> np.uint64(32)) * (3 * n).astype(np.uint64)[of]) >> np.uint64(32)).astype(np.int64)
        starts = np.flatnonzero(np.r_[True, at[1:] != at[:-1]][: len(at)])
        sums, held = np.zeros(3 * m.sum(), np.uint64), np.zeros(3 * m.sum(), np.int64)
        if len(at):
            sums[at[starts]] = np.add.reduceat(mixed(every + np.uint64(0x2545F4914F6CDD1D)), starts)
            held[at[starts]] = np.diff(np.r_[starts, len(at)])
        job = np.repeat(np.arange(len(sets)), m)
        sums = mixed(sums + (np.arange(len(sums)) - np.repeat(base, 3 * m)).astype(np.uint64))
        digest, both = self._pairs(sums, held, (np.arange(len(job)) - base[job] // 3).astype(np.uint64) + seeds[job])
        return digest.T, both.T, job

    @staticmethod
    def _strips(s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Of k strips of equal ranges: a hash of each one's n-grams, and their number."""
        strip = ((s >> np.uint64(32)) * np.uint64(k)) >> np.uint64(32)  # s is sorted, so strips are runs
        starts = np.flatnonzero(np.r_[True, strip[1:] != strip[:-1]])
        at = strip[starts].astype(np.int64)
        sums, held = np.zeros(k, np.uint64), np.zeros(k, np.int64)
        sums[at] = np.add.reduceat(mixed(s + np.uint64(0x2545F4914F6CDD1D)), starts)
        held[at] = np.diff(np.r_[starts, len(s)])
        return mixed(sums + np.arange(k, dtype=np.uint64)), held

    def _covers(self, s: np.ndarray, h: int, seed: int) -> tuple[np.ndarray, bool]:
        """Digests of each k - h of k strips that hold any n-gram, and whether all do."""
        sums, held = self._strips(s, COVER[h])
        digest = mixed((sums * np.uint64(3))[self.parts[h]].sum(1, dtype=np.uint64) + np.arange(len(self.parts[h]), dtype=np.uint64) + np.uint64(seed))
        full = held[self.parts[h]].sum(1) > 0
        return digest[full], bool(full.all())

    def _blocks(self, s: np.ndarray, h: int, seed: int) -> tuple[np.ndarray, bool]:
        """Digests of each two strips of each block, and whether they are enough.

        Two linked sets agree on two strips in more than `spare` blocks. All sets post
        strips that hold 3 n-grams or more. A set with more than `spare` blocks where some
        two strips hold fewer posts those with 2 as well; with too many still, those with 1.
        The fuller of two linked sets so posts enough for the pair, unless both are short of
        n-grams even then.
        """
        need, spare = self._dealt(h)
        digest, both = self._pairs(*self._strips(s, 3 * (need + spare)), np.arange(need + spare, dtype=np.uint64) + np.uint64(seed))
        least = both.min(0)
        floor = next((f for f in (3, 2, 1) if (least < f).sum() <= spare), 0)
        return digest[both >= max(floor, 1)], floor > 0

    @staticmethod
    def _dealt(h: int) -> tuple[int, int]:
        """How many blocks two linked sets need, and how many more there are."""
        need = h // 2 + 1
        return need, -(-need * 3 // 20) if need >= 4 else 0

    def _pairs(self, sums: np.ndarray, held: np.ndarray, salt: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of blocks of three strips: a digest of each two strips, and how many n-grams these hold."""
        sums, held = sums.reshape(-1, 3), held.reshape(-1, 3)
        digest = np.stack([mixed(sums[:, i] * np.uint64(3) + sums[:, j] + mixed(salt * np.uint64(3) + np.uint64(k))) for k, (i, j) in enumerate(self.STRIPS)])
        return digest, np.stack([held[:, i] + held[:, j] for i, j in self.STRIPS])


def posted_once(every: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each digest of a batch's rows once, one row that has it, and pairs (another row that has it, this row)."""
    first, back_ = np.unique(every, return_index=True, return_inverse=True)[1:]
    again = first[back_] != np.arange(len(every))
    links = np.unique(np.stack([owner[again], owner[first[back_]][again]], 1), axis=0)
    return every[~again], owner[~again], links[links[:, 0] != links[:, 1]]


def overlaps(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray | None) -> np.ndarray:
    """Overlap counts of the rows `a` with the rows `b` (None: with a itself); sets are sorted.

    Overlaps add up over columns, so these come by ranges, with about COLUMNS n-grams of all rows each.
    """
    counts = np.zeros((len(a), len(a if b is None else b)), np.float32)
    place_a, place_b = np.full(len(sets), -1), np.full(len(sets), -1)
    place_a[a] = np.arange(len(a))
    place_b[a if b is None else b] = np.arange(len(a if b is None else b))
    ranges = max(1, -(-sum(map(len, sets)) // COLUMNS))
    tops = np.array([(k << 64) // ranges for k in range(1, ranges)], np.uint64)
    cuts = np.array([[0, *s.searchsorted(tops), len(s)] for s in sets])
    for k in range(ranges):
        _add_overlaps(counts, [s[x:y] for s, x, y in zip(sets, cuts[:, k], cuts[:, k + 1], strict=True)], place_a, None if b is None else place_b)
    return counts


def _add_overlaps(counts: np.ndarray, sets: list[np.ndarray], place_a: np.ndarray, place_b: np.ndarray | None) -> None:
    """Add the overlaps of sets at their places in counts, or at none (-1)."""
    every = np.concatenate(sets)
    order = np.argsort(every)
    every, rows = every[order], np.repeat(np.arange(len(sets), dtype=np.int32), [len(s) for s in sets])[order]
    starts = np.flatnonzero(np.r_[True, every[1:] != every[:-1]][: len(every)])
    lens = np.diff(np.r_[starts, len(every)])
    for d in range(2, DENSE + 1):
        at = starts[lens == d]
        if len(at):
            r = rows[at[:, None] + np.arange(d)]
            for i in range(d):
                for j in range(d):
                    if i != j:
                        x, y = place_a[r[:, i]], (place_a if place_b is None else place_b)[r[:, j]]
                        ok = (x >= 0) & (y >= 0)
                        np.add.at(counts, (x[ok], y[ok]), 1)
    many = np.flatnonzero(lens > DENSE)
    slab = max(64, (4 << 20) // max(len(sets), 1))

    def dense(place: np.ndarray, n: int) -> np.ndarray:
        m, at = np.zeros((n, len(some)), np.float32), place[r]
        m[at[at >= 0], c[at >= 0]] = 1
        return m

    for i in range(0, len(many), slab):
        some = many[i : i + slab]
        r = np.concatenate([rows[starts[k] : starts[k] + lens[k]] for k in some])
        c = np.repeat(np.arange(len(some)), lens[some])
        m = dense(place_a, counts.shape[0])
        counts += m @ (m if place_b is None else dense(place_b, counts.shape[1])).T


def forest(linked: np.ndarray) -> list[tuple[int, int]]:
    """Edges (row, column) that span the components of a matrix of links between rows and columns."""
    n_rows, n_cols = linked.shape
    row_new, col_new, out = np.ones(n_rows, bool), np.ones(n_cols, bool), []
    for start in range(n_rows):
        if not row_new[start]:
            continue
        row_new[start] = False
        rows = [start]
        while rows:
            r = rows.pop()
            cols = np.flatnonzero(linked[r] & col_new)
            col_new[cols] = False
            for c in cols:
                out.append((r, int(c)))
                more = np.flatnonzero(linked[:, c] & row_new)
                row_new[more] = False
                out += [(int(x), int(c)) for x in more]
                rows += more.tolist()
    return out


def links_of_block(ids: np.ndarray, side: np.ndarray, block: tuple[int, int], sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the links in a block of one tile, or between the two tiles of a block."""
    sizes = np.array([len(s) for s in sets], np.int64)
    a = np.flatnonzero(side == block[0])
    b = None if block[0] == block[1] else np.flatnonzero(side == block[1])
    counts = overlaps(sets, a, b)
    other = a if b is None else b
    linked = np.empty(counts.shape, bool)
    for k in range(0, len(a), AT_ONCE):
        c = counts[k : k + AT_ONCE].astype(np.int64)
        linked[k : k + AT_ONCE] = 100 * c >= percent * (sizes[a[k : k + AT_ONCE]][:, None] + sizes[other][None, :] - c)
    return [(int(ids[a[i]]), int(ids[other[j]])) for i, j in forest(linked)]


def jaccard_components(docs: DataFrame, *, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id: the smallest id reachable by links, itself included.

    Texts' sets are their distinct shingles of `words` words; two link if 100 * overlap
    >= percent * union (percent from 1 to 100). Null, empty and blank texts have empty
    sets and link with nothing. Rows that share an id count as one document: a link of
    one is a link of all; null ids are one document, listed with the smallest other id
    reachable, or null. Rows with equal sets are one class. An empty table: no rows.

    Where ids repeat, rows are numbered first and linked by their numbers, so that rows of
    one id are dealt over tiles like others.
    """
    rows = keyed(docs, id_col, text_col)
    if not rows.groupBy("id").count().where("count > 1").limit(1).count():
        out = _linked(rows, words, percent)
        return out.select(back(F.col("id")).alias("doc_id"), F.col("n").alias("n_shingles"), back(F.col("root")).alias("component_id"))
    # by id and a hash of the text, then by row: a staged number that ascends with ids
    held = rows.select("id", "text", F.xxhash64("text").alias("_hash"), F.monotonically_increasing_id().alias("_at"))
    numbered = staged(held.orderBy("id", "_hash", "_at").select(F.monotonically_increasing_id().alias("_n"), "id", "text"), "numbered_rows")
    linked = staged(_linked(numbered.select(F.col("_n").alias("id"), "text"), words, percent), "linked_rows")
    every, total = numbered.select(F.col("_n").alias("id"), F.col("id").alias("doc")), numbered.count()
    linked = staged(linked.join(every.hint("merge"), "id"), "linked_documents")
    tops = staged(linked.select(F.col("root").alias("id")).distinct().join(every.hint("merge"), "id").select(F.col("id").alias("root"), F.col("doc").alias("top")), "roots")
    known = staged(met(linked, "root", tops, total).select("doc", "n", "top"), "known_documents")
    roots = staged(components(known.where("doc <> top").select(F.col("doc").alias("a"), F.col("top").alias("b")), "documents").select(F.col("node").alias("doc"), "root"), "document_roots")
    return met(known, "doc", roots, total).select(back(F.col("doc")).alias("doc_id"), F.col("n").alias("n_shingles"), back(F.coalesce("root", "doc")).alias("component_id"))


def packed_ids(ids: np.ndarray) -> bytes:
    """Ids as differences, the bytes of one place side by side: ids that hardly change compress to hardly anything."""
    return np.diff(ids.astype("<i8"), prepend=np.int64(0)).view(np.uint8).reshape(-1, 8).T.tobytes()


def unpacked_ids(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view("<i8").ravel().cumsum()


def hubs_of(digests: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(id, the smallest id that has a digest with it), each pair once."""
    order = np.argsort(digests)
    digests, ids = digests[order], ids[order]
    starts = np.flatnonzero(np.r_[True, digests[1:] != digests[:-1]])
    hub = np.repeat(np.minimum.reduceat(ids, starts), np.diff(np.r_[starts, len(ids)]))
    other = ids != hub
    pairs = np.unique(np.stack([ids[other], hub[other]], 1), axis=0)
    return pairs[:, 0], pairs[:, 1]


def _sketched(rows: DataFrame, words: int, percent: int) -> DataFrame:
    """id, lead: the smallest id reachable through sketches, for rows that share a digest of theirs; rows: id (each once), text."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(id, digest), and (id, hub) for what rows of one batch share and for sets that come again."""
        known, columns, seen = WordHash(), Columns(percent), {}
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, sets, copies = batch.column("id").to_numpy(), [], []
            for i, s in zip(ids.tolist(), text_sets(batch.column("text").to_pylist(), known, words), strict=True):
                first = seen.setdefault(xxhash.xxh3_128_digest(s.tobytes()), i) if len(s) else i
                if first != i:
                    copies.append((i, first))
                sets.append(s if first == i else s[:0])
            every, owner, links = posted_once(*columns.of(sets, few=True))
            near = np.concatenate([ids[links], np.array(copies, np.int64).reshape(-1, 2)])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.r_[ids[owner], near[:, 0]]),
                    pa.concat_arrays([pa.array(every.view(np.int64)), pa.nulls(len(near), pa.int64())]),
                    pa.concat_arrays([pa.nulls(len(every), pa.int64()), pa.array(np.ascontiguousarray(near[:, 1]))]),
                ],
                ["id", "sketch", "hub"],
            )
            if len(seen) > 200_000:
                seen.clear()

    told = staged(rows.mapInArrow(sketch, "id long, sketch long, hub long"), "sketches")
    shared = told.where("hub is null").select(F.col("id").alias("a"), F.min("id").over(W.partitionBy("sketch")).alias("b")).where("a <> b")
    found = shared.unionByName(told.where("hub is not null").select(F.col("id").alias("a"), F.col("hub").alias("b"))).distinct()
    return components(found, "sketched").select(F.col("node").alias("id"), F.col("root").alias("lead"))


def _linked(rows: DataFrame, words: int, percent: int) -> DataFrame:
    """id, n, root: the size of each row's set, and the smallest id reachable; rows: id (each once), text."""
    chars, total = rows.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)), F.count("*")).first()
    ranges = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-chars // RANGE))
    told_as = pa.schema([("range", pa.int32()), ("id", pa.int64()), ("same", pa.int64()), ("near", pa.list_(pa.int64())), ("n", pa.int64()), ("digests", pa.binary()), ("ids", pa.binary())])

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row a set, and one a range of a batch's digests: its digests and the ids that have them, packed."""
        known, columns, seen = WordHash(), Columns(percent), {}
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, n, near, sets = batch.column("id").to_pylist(), [], [], []
            lead = [i if x is None else x for i, x in zip(ids, batch.column("lead").to_pylist(), strict=True)]
            for i, s in zip(ids, text_sets(batch.column("text").to_pylist(), known, words), strict=True):
                first = seen.setdefault(xxhash.xxh3_128_digest(s.tobytes()), i) if len(s) else i
                n.append(len(s))
                near.append((first,) if first != i else ())
                sets.append(s if first == i else s[:0])
            # what rows of this batch share is posted once; the others point at the lead of the row that does, and at their own
            every, owner, links = posted_once(*columns.of(sets))
            told = [[x] if x != i and not y else [] for i, x, y in zip(ids, lead, near, strict=True)]
            for i, j in links.tolist():
                if lead[i] != lead[j]:
                    told[i].append(lead[j])
            at = (((every >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)).astype(np.int32)
            owner = np.array(lead, np.int64)[owner]
            order = np.lexsort((owner, at))  # owners of a range ascend
            at, every, owner = at[order], every[order], owner[order]
            starts = np.flatnonzero(np.r_[True, at[1:] != at[:-1]]) if len(at) else np.zeros(0, np.int64)
            runs = list(zip(starts.tolist(), [*starts[1:].tolist(), len(at)], strict=False))
            rest, none = len(ids), [None] * len(runs)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.r_[np.arange(rest) % ranges, at[starts]], pa.int32()),
                    pa.array(ids + none, pa.int64()),
                    pa.array([x[0] if x else None for x in near] + none, pa.int64()),
                    pa.array(told + none, pa.list_(pa.int64())),
                    pa.array(n + none, pa.int64()),
                    pa.array([None] * rest + [every[a:b].astype("<u8").tobytes() for a, b in runs], pa.binary()),
                    pa.array([None] * rest + [packed_ids(owner[a:b]) for a, b in runs], pa.binary()),
                ],
                schema=told_as,
            )
            if len(seen) > 200_000:  # a set that comes again later posts again
                seen.clear()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The sets' rows as they come, then pairs (id, hub) of the ranges of this task."""
        digests, owner = [], []
        for batch in batches:
            some = batch.filter(batch.column("digests").is_valid())
            digests += [np.frombuffer(x, "<u8") for x in some.column("digests").to_pylist()]
            owner += [unpacked_ids(x) for x in some.column("ids").to_pylist()]
            sets = batch.filter(batch.column("digests").is_null())
            yield pa.RecordBatch.from_arrays([*[sets.column(c) for c in ("id", "same", "near", "n")], pa.nulls(sets.num_rows, pa.int64())], ["id", "same", "near", "n", "hub"])
        if digests:
            ids, hub = hubs_of(np.concatenate(digests), np.concatenate(owner))
            for k in range(0, len(ids), 1 << 16):
                m = len(ids[k : k + (1 << 16)])
                yield pa.RecordBatch.from_arrays([pa.array(ids[k : k + m]), pa.nulls(m, pa.int64()), pa.nulls(m, pa.list_(pa.int64())), pa.nulls(m, pa.int64()), pa.array(hub[k : k + m])], ["id", "same", "near", "n", "hub"])

    posts = met(rows, "id", _sketched(rows, words, percent), total).mapInArrow(post, "range int, id long, same long, near array<long>, n long, digests binary, ids binary")
    told = staged(posts.repartitionById(ranges, "range").mapInArrow(meet, "id long, same long, near array<long>, n long, hub long"), "sets")
    sets = told.where("hub is null").drop("hub")
    hubs = told.where("hub is not null").select(F.col("id").alias("a"), F.col("hub").alias("b"))
    hubs = hubs.unionByName(sets.select(F.col("id").alias("a"), F.explode("near").alias("b")))
    blocks = components(hubs, "blocks").select(F.col("node").alias("id"), F.col("root").alias("grp"))
    # sets of linked rows are of one size class (of ratio 100 / percent) or of neighbouring ones
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100.0 / min(percent, 99) * 1.000001))).cast("int")
    sizes = sets.where("n > 0 and same is null").select("id", band.alias("band")).distinct()
    members = staged(blocks.join(sizes.hint("merge"), "id").select("id", "grp", "band"), "members")

    def product(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, out = WordHash(), []
        for t in groups(batches, ["grp", "ti", "tj"]):
            block = [s for part in t.column("text").chunks for s in text_sets(part.to_pylist(), known, words)]
            out += links_of_block(t.column("id").to_numpy(), t.column("side").to_numpy(), (t["ti"][0].as_py(), t["tj"][0].as_py()), block, percent)
            del t, block  # before the next ones come
            if len(out) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], ["a", "b"])
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], ["a", "b"])

    found = tiled(members, rows, TILE).select("id", "text", "grp", "ti", "tj", "side").mapInArrow(product, "a long, b long")
    links = staged(found, "links").unionByName(sets.where("same is not null").select(F.col("id").alias("a"), F.col("same").alias("b")))
    roots = components(links, "linked")
    out = sets.select("id", "n").join(roots, sets["id"] == roots["node"], "left")
    return out.select("id", "n", F.coalesce("root", "id").alias("root"))


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs that are the smallest of their component; rows without words all stay.

    Each row is linked by its own text alone, so where ids are null or repeat, a row goes
    only if a smaller row is reachable from this text. Rows go by id (null last), those of
    one id by a hash of all their columns; of rows that repeat one stays.
    """
    id_col, text_col = options.get("id_col", "doc_id"), options.get("text_col", "text")
    inner = F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(NULL_ID))
    if not docs.groupBy(inner.alias("_id")).count().where("count > 1").limit(1).count():
        c = jaccard_components(docs, **options)
        gone = c.where(F.col("component_id") < F.coalesce("doc_id", F.lit(NULL_ID))).select(F.coalesce("doc_id", F.lit(NULL_ID)).alias("_gone"))
        return docs.join(gone, F.coalesce(docs[id_col].cast("long"), F.lit(NULL_ID)) == gone["_gone"], "left_anti")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    # the last key spreads rows that come very often; staged, so that a row has one number in both reads
    held = docs.select(inner.alias("_id"), F.xxhash64(*columns).alias("_hash"), F.monotonically_increasing_id().alias("_at"), F.struct(*columns).alias("_row"))
    numbered = staged(held.orderBy("_id", "_hash", "_at").select(F.monotonically_increasing_id().alias("_n"), "_row"), "numbered")
    c = jaccard_components(numbered.select("_n", F.col(f"_row.`{text_col}`").alias("_text")), **options | {"id_col": "_n", "text_col": "_text"})
    gone = c.where("component_id < doc_id").select(F.col("doc_id").alias("_gone"))
    return numbered.join(gone, F.col("_n") == F.col("_gone"), "left_anti").select("_row.*")


def op3_ngram_join(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return jaccard_components(docs, words=4, percent=85)
