"""The corpus operators against brute force on small tables with nulls, empty and repeated rows, ties and clashing names."""

import random
import re

import numpy as np
import pytest

pytest.importorskip("mosaiq.llm")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(n, rng):
    return " ".join(rng.choice(["alpha", "Beta", "gamma", "delta", "eps", "zeta", "éta", "Theta", "x", "y"]) + str(rng.randint(0, 30)) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    base = [words(rng.randint(5, 120), rng) for _ in range(25)]
    out = []
    for i in range(160):
        t = rng.choice(base).split(" ")
        for _ in range(rng.randint(0, 3)):
            t[rng.randrange(len(t))] = words(1, rng)
        out.append((i * 3 - 40, " ".join(t).replace("x1 ", "x1\n") + ("\ncommon LINE \n\nfoo" if i % 3 == 0 else ""), "en", rng.choice(["s0", "s1", "é", None]), 1))
    return [*out, (9000, None, None, None, None), (9001, "", "en", "s0", 0), (9002, " \n\t", None, "s1", 3), (9003, "one two", "en", "s1", 7), (9004, "One  TWO", "en", "s0", 7), (9005, base[0] * 40, "en", "s0", 9), (9006, base[1], "en", "s0", 1), (9006, base[1], "en", "s0", 1)]


@pytest.fixture
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def sets(text, n):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


@pytest.mark.parametrize(("n", "percent"), [(4, 85), (5, 80), (2, 50)])
def test_ngram_join(docs, rows, none, n, percent):
    from mosaiq.llm.ngram_join import jaccard_components, one_of_each

    got = {(r.doc_id, r.n_shingles, r.component_id) for r in jaccard_components(docs, words=n, percent=percent).collect()}
    s = [(r[0], sets(r[1], n)) for r in rows]
    root = {i: i for i, _ in s}
    for _ in range(len(s)):
        for i, a in s:
            for j, b in s:
                if a and b and 100 * len(a & b) >= percent * len(a | b):
                    root[i] = root[j] = min(root[i], root[j])
        if all(root[root[i]] == root[i] for i in root):
            break
    assert got == {(i, len(a), root[i]) for i, a in s}
    assert {r.doc_id for r in one_of_each(docs, words=n, percent=percent).collect()} == {i for i in root if root[i] == i}
    assert jaccard_components(none).count() == 0


def test_components_end_with_whole_components(spark):
    from mosaiq.llm.shared import components

    path = spark.range(40).selectExpr("(id * 7) % 41 AS a", "((id + 1) * 7) % 41 AS b")
    assert {(r.node, r.root) for r in components(path).collect()} == {(i, 0) for i in range(41)}
    with pytest.raises(RuntimeError):
        components(path, rounds=1)


def test_repeats(docs, rows, none):
    from mosaiq.llm.suffix_dedup import remove_repeats

    first = {}
    texts = [(r[0], (r[1] or "").encode()) for r in rows]
    for i, t in texts:
        for k in range(len(t) - 49):
            first[t[k : k + 50]] = min(i, first.get(t[k : k + 50], i))
    want = set()
    for i, t in texts:
        gone = bytearray(len(t))
        for k in range(len(t) - 49):
            if first[t[k : k + 50]] < i:
                gone[k : k + 50] = b"\1" * 50
        want.add((i, len(t), sum(gone), bytes(c for c, g in zip(t, gone, strict=True) if not g)))
    assert {(r.doc_id, r.n_bytes, r.n_removed, bytes(r.kept)) for r in remove_repeats(docs).collect()} == want
    assert remove_repeats(none).count() == 0


@pytest.mark.parametrize("keep", ["none", "first"])
@pytest.mark.parametrize("limit", [0, 1000])
def test_lines(docs, rows, none, keep, limit):
    from mosaiq.llm.line_dedup import drop_lines

    def key(x):
        return x.encode().strip(b" \t\n\x0b\x0c\r").lower()

    places = {}
    for i, t, *_ in rows:
        for k in {key(x) for x in (t or "").split("\n")} - {b""}:
            places.setdefault(k, []).append(i)
    first = {}
    for i, t, *_ in rows:
        for n, x in enumerate((t or "").split("\n")):
            first[key(x)] = min(first.get(key(x), (i, n)), (i, n))
    want = []
    for i, t, *_ in rows:
        kept = [x for n, x in enumerate((t or "").split("\n")) if len(places.get(key(x), ())) < 4 or (keep == "first" and first[key(x)] == (i, n))]
        want.append((i, "\n".join(kept)))
    got = [(r.row.doc_id, r.text or "") for r in drop_lines(docs, min_docs=4, keep=keep, broadcast_keys=limit).collect()]
    assert sorted(got) == sorted(want)
    assert drop_lines(none).count() == 0


def test_mix(docs, none):
    from mosaiq.llm.mixing import mix, mixed_documents

    m = mix(docs, block_words=16)
    d = m.documents.toPandas()
    assert (d.taken <= 2 * d["size"]).all()
    taken = d.groupby("sid").taken.sum()
    assert ((taken - d.groupby("sid").target.first()).abs() <= 0.5).all()
    assert abs(d.groupby("sid").target.first().sum() - 1.5 * d["size"].sum()) < 1e-6
    slots = sorted(r.slot for r in m.segments.select("slot").distinct().collect())
    assert slots[-1] - slots[0] + 1 <= len(slots) + 8
    assert mixed_documents(docs).columns == docs.columns
    assert mix(none).documents.count() == 0


def test_tokens(docs, rows, none, spark, tmp_path):
    import public_tokenizers as p
    from tokenizers import Tokenizer

    from mosaiq.llm.packing import pack
    from mosaiq.llm.token_files import read_token_files, write_token_files

    t = Tokenizer.from_file(p.path("byte_bpe_50k.json"))
    m = write_token_files(docs, str(tmp_path), p.path("byte_bpe_50k.json"), 2)
    got = sorted((r.doc_id, r.start, list(np.frombuffer(bytes(r.ids), "<u2"))) for r in read_token_files(m, str(tmp_path)).collect())
    at = 0
    for (i, text), (j, start, ids) in zip(sorted((r[0], r[1] or "") for r in rows), got, strict=True):
        want = [*t.encode(text, add_special_tokens=False).ids, 2]
        assert (i, at, want) == (j, start, ids)
        at += len(want)
    t = Tokenizer.from_file(p.path("word_bpe_49k.json"))
    pieces = pack(docs.dropDuplicates(["doc_id"]), p.path("word_bpe_49k.json"), 1, 64).toPandas()
    texts = {r[0]: r[1] or "" for r in rows}
    for i, g in pieces.groupby("doc_id"):
        ids = b"".join(g.sort_values("start").ids.map(bytes))
        assert list(np.frombuffer(ids, "<u2")) == [*t.encode(texts[i], add_special_tokens=False).ids, 1]
    for _, g in pieces.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g.length.sum() <= 64 and list(g.offset) == list(g.length.cumsum() - g.length)
    assert pack(none, p.path("word_bpe_49k.json"), 1).count() == 0


def test_shards(docs, none):
    from pyspark.sql import functions as F

    from mosaiq.llm.sharding import shard

    named = docs.withColumn("shard", F.lit("mine")).withColumn("rank", F.lit(1))
    size = F.coalesce(F.octet_length("text"), F.lit(0)) + 16
    r = shard(named, size, F.col("doc_id"), 7, bucket_bytes=5000).collect()
    assert sorted(x.row.doc_id for x in r) == sorted(x.doc_id for x in docs.collect())
    slots = {}
    for x in r:
        slots.setdefault(x.shard, []).append(x.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert shard(none, size, F.col("doc_id"), 7).count() == 0


def test_ogg():
    from mosaiq.llm import ogg

    for n in (0, 1, 192, 1920, 65025, 70000, 300_000):
        payload = random.Random(n).randbytes(n)
        media = ogg.store(payload) if n else ogg.store(b"x")
        assert ogg.restore(media)[0] == (payload or b"x")
    # the checksum, bit by bit
    crc = 0
    for byte in media[:0] or b"OggS test":
        crc ^= byte << 24
        for _ in range(8):
            crc = (crc << 1 ^ 0x04C11DB7 if crc & 0x80000000 else crc << 1) & 0xFFFFFFFF
    assert ogg.checksum(b"OggS test") == crc
    broken = bytearray(media)
    broken[5000] ^= 1
    with pytest.raises(ogg.OggError):
        ogg.read(bytes(broken))


def test_vectors(spark):
    from mosaiq.llm.vector_dedup import vector_links

    rng = np.random.default_rng(2)
    base = rng.normal(size=(30, 16))
    rows = [(i, [float(x) for x in base[i % 30] + rng.normal(size=16) * (0.05 if i % 2 else 0.3)], i % 2) for i in range(200)]
    rows += [(900, None, 1), (901, [0.0] * 16, 1), (902, rows[0][1], None), (903, [None] + [1.0] * 15, 1), (904, [float("nan")] * 16, 0), (905, rows[0][1], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in vector_links(df).collect()}
    ok = [(i, np.array(v), k) for i, v, k in rows if v and k is not None and None not in v and np.isfinite(v).all() and any(v)]
    links = {i: [j for j, w, m in ok if j != i and k == m and v @ w / np.sqrt((v @ v) * (w @ w)) >= 0.98] for i, v, k in ok}
    assert sum(got[i][0] == len(links.get(i, ())) for i, *_ in rows) >= len(rows) - 2
    assert got[902] == (0, 902) and got[904] == (0, 904)


def test_toxicity(docs, none, spark):
    from pyspark.sql import functions as F

    from mosaiq.llm.toxicity import fit, train, with_scores

    rng = np.random.default_rng(0)
    bucket = rng.integers(0, 1 << 20, 40)
    x = [np.unique(bucket[rng.random(40) < 0.3]) for _ in range(800)]
    y = np.array([int(bucket[0] in r and bucket[1] in r) for r in x])  # a pair that weights alone can't tell
    m = fit(x, y, steps=400)
    place = {b: i for i, b in enumerate(m.buckets)}
    p = np.array([m.score(np.array([place[b] for b in r if b in place], int)) for r in x])
    assert ((p >= 0.5) == y).mean() > 0.97
    labels = docs.select("doc_id", F.col("text").contains("alpha1").cast("int").alias("toxic"))
    scored = with_scores(docs, train(docs, labels)).collect()
    assert len(scored) == docs.count() and all(0 <= r.score <= 1 for r in scored)
    assert with_scores(none, train(none, labels)).count() == 0


def test_components_by_rounds_with_hubs(spark):
    """The way of large graphs, on a small one: a hub of most edges, chains, repeats and loops."""
    from mosaiq.llm.shared import components, met, spanning

    rng = random.Random(5)
    edges = [(7, i) for i in range(100, 400)] + [(i, i + 1) for i in range(1000, 1040)] + [(rng.randint(2000, 2400), rng.randint(2000, 2400)) for _ in range(300)] + [(5, 5), (7, 100)]
    root = {v: v for e in edges for v in e if e[0] != e[1]}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for a, b in edges:
        if a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    df = spark.createDataFrame(edges, "a long, b long").repartition(4)
    for few in (0, 10**6):
        assert {r.node: r.root for r in components(df, few=few).collect() if r.node != 5} == {v: find(v) for v in root}
    assert components(df.limit(0), few=0).count() == 0
    x, y = spanning(np.array([3, 2, 9]), np.array([2, 1, 9]))
    assert dict(zip(x, y)) == {3: 1, 2: 1}
    table = spark.createDataFrame([(7, "hub"), (1000, "x")], "a long, v string")
    for few in (0, 10**6):
        got = sorted((r.a, r.b, r.v) for r in met(df, "a", table, len(edges), few).collect())
        assert got == sorted((a, b, {7: "hub", 1000: "x"}.get(a)) for a, b in edges)


def test_ids_are_the_librarys(spark):
    """20,000 random strings with added tokens written out, odd spaces and letters beyond Latin."""
    import public_tokenizers as p
    from tokenizers import Tokenizer

    from mosaiq.llm.tokens import Encoder

    parts = ["<|endoftext|>", "<|startoftext|>", "<|EndOfText|>", "<|", "|>", " ", "  ", "\n", "\t", "a", "B", "don't", "'S", "Éa", "e\u0301", "日本", "ß", "İ", "123", "4", "...", "!", "\u00a0", "\u3000", "word", "Word ", "<", "endoftext", "🙂", "\u200b", "\x1c"]
    rng = random.Random(1)
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(20_000)]
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        t, e = Tokenizer.from_file(p.path(name)), Encoder(p.path(name))
        for text, ids in zip(texts, e.encode(texts), strict=True):
            assert np.frombuffer(ids, e.dtype).tolist() == t.encode(text, add_special_tokens=False).ids, text


def test_digests_meet(spark):
    """Linked sets of all small sizes share a digest; sets that share nothing share none."""
    from mosaiq.llm.ngram_join import Columns

    rng = np.random.default_rng(3)
    for percent in (85, 80, 50):
        c = Columns(percent)
        for size in [*range(1, 70), 150, 400]:
            for _ in range(6):
                x = np.unique(rng.integers(0, 2**63, size, np.int64).view(np.uint64))
                k = rng.integers(0, c.differ(size) + 1)
                y = np.unique(np.r_[x[int(k) // 2 :], rng.integers(0, 2**63, int(k) - int(k) // 2, np.int64).view(np.uint64)])
                both = len(np.intersect1d(x, y))
                if len(y) and 100 * both >= percent * (len(x) + len(y) - both):
                    assert len(np.intersect1d(c.digests(x), c.digests(y))), (percent, size, k)
                z = np.unique(rng.integers(0, 2**63, size, np.int64).view(np.uint64))
                assert not len(np.intersect1d(c.digests(x), c.digests(z)))


def test_short_texts_do_not_meet(spark, monkeypatch):
    """Thousands of distinct texts of one to eight words bring no row block of more than a few together."""
    from mosaiq.llm import ngram_join

    rng = random.Random(2)
    rows = [(i, " ".join(f"w{rng.randint(0, 10**7)}" for _ in range(1 + i % 8))) for i in range(6000)]
    seen = []
    tiled = ngram_join.tiled
    monkeypatch.setattr(ngram_join, "tiled", lambda m, *a: seen.append(max([r["count"] for r in m.groupBy("grp").count().collect()], default=0)) or tiled(m, *a))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert ngram_join.jaccard_components(docs).where("component_id <> doc_id").count() == 0
    assert seen[0] <= 4


def test_vectors_on_odd_rows(spark, monkeypatch):
    from mosaiq.llm import vector_dedup

    v, w = [1.0, 2.0, 3.0], [3.0, -1.0, 0.5]
    rows = [(5, v, 1), (5, v, 1), (7, w, 1), (7, w, 1), (8, w, 1), (9, v, None), (10, [1.0, 2.0], 1), (11, [2.0, 4.0], 1), (12, [], 1), (None, w, 1), (13, [0.0, -0.0, 0.0], 1), (14, v, 2), (15, [2.0, 4.0, 6.0], 2), (16, [float("inf"), 1.0, 1.0], 2)]
    df = spark.createDataFrame([(*r, 0, 0) for r in rows], "vec_id long, embedding array<double>, label int, keys int, same int").repartition(3)
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in vector_dedup.vector_links(df).collect()), key=str)
    want = [(5, 1, 5, True)] * 2 + [(7, 3, 7, True)] * 2 + [(8, 3, 7, False), (None, 3, 7, False), (9, 0, 9, True), (10, 1, 10, True), (11, 1, 10, False), (12, 0, 12, True), (13, 0, 13, True), (14, 1, 14, True), (15, 1, 14, False), (16, 0, 16, True)]
    assert got == sorted(want, key=str)
    assert vector_dedup.vector_links(df.limit(0)).count() == 0
    # groups of near vectors larger than a tile: every link counts once, in whichever tables the pair meets
    monkeypatch.setattr(vector_dedup, "TILE", 16)
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(size=(1, 12)) + rng.normal(size=(90, 12)) * 0.1, rng.normal(size=(60, 12))])
    near = spark.createDataFrame([(i, [float(a) for a in r], 0) for i, r in enumerate(x)], "vec_id long, embedding array<double>, label int")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    true = (u @ u.T >= 0.98).sum(1) - 1
    n = np.array([r.n_links for r in vector_dedup.vector_links(near).orderBy("vec_id").collect()])
    assert (n <= true).all() and n.sum() >= 0.99 * true.sum() and true.sum() > 1000


def test_shards_hang_on_rows_alone(spark):
    from pyspark.sql import functions as F

    from mosaiq.llm.sharding import external_shuffle, shard

    rows = [(None if i % 3 else i, "same" if i % 2 else f"text {i} " + "x" * (i % 50)) for i in range(600)] + [(1, "long " * 20_000), (None, None)]
    out = []
    for parts in (1, 5):
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
        out.append(sorted(((x.row.doc_id, x.row.text, x.shard, x.slot) for x in shard(docs, F.coalesce(F.octet_length("text"), F.lit(0)) + 16, F.col("doc_id"), 7, bucket_bytes=1000).collect()), key=str))
    assert out[0] == out[1] and sorted(((a, b) for a, b, *_ in out[0]), key=str) == sorted(rows, key=str)
    # a third of all rows alike in all columns, no ids: no bucket holds them all
    docs = spark.createDataFrame([(None, "copy") for _ in range(900)] + [(None, f"t{i}") for i in range(1800)], "doc_id long, text string")
    sizes = [r["count"] for r in external_shuffle(docs, F.lit(20), F.col("doc_id"), bucket_bytes=2000).groupBy("bucket").count().collect()]
    assert sum(sizes) == 2700 and max(sizes) < 220


def test_mix_in_order(docs):
    """Every prefix of the slots keeps the shares of the targets, and slots have no gaps."""
    from mosaiq.llm.mixing import GOLDEN, UNIT, mix

    m = mix(docs, block_words=16)
    sources = m.sources.orderBy("sid").collect()
    need = [-(-s.take // 16) for s in sources]
    total, edges = sum(need), [0]
    for n in need:
        edges.append(int((sum(need[: len(edges) - 1]) + n) / sum(need) * UNIT))
    want, left, t = [], list(need), 0
    while any(left):  # the points one by one
        u = t % UNIT * GOLDEN % UNIT
        s = next(k for k in range(len(need)) if edges[k] <= u < edges[k + 1])
        if left[s]:
            left[s] -= 1
            want.append(s)
        t += 1
    slots = {r.slot: r.sid for r in m.segments.select("slot", "sid").distinct().collect()}
    assert [slots[k] for k in range(total)] == want and len(slots) == total
    for n in range(1, total):
        for k in range(len(need)):
            assert abs(want[:n].count(k) - n * need[k] / total) < 4


def test_runs_of_any_length(monkeypatch):
    """Runs that go over several chunks, of one document and of more."""
    import pyarrow as pa

    from mosaiq.llm import suffix_dedup as S

    rng = random.Random(6)
    rows = sorted((rng.choice([1, 1, 1, 2, 3, 4, 5, 6, 7]), rng.choice([8, 9]), rng.randint(0, 3) if k % 3 else 0) for k in range(400))
    rows = [*rows, *[(9, 9, 5)] * 50, *[(9, 10, 5)] * 40, (9, 10, 6)]
    ids = {}
    for a, b, i in rows:
        ids.setdefault((a, b), []).append(i)
    for size in (1, 7, 64, 1000):
        monkeypatch.setattr(S, "CHUNK", size)
        batches = [pa.RecordBatch.from_pydict({c: [r[k] for r in rows[n : n + 5]] for k, c in enumerate(("a", "b", "id"))}) for n in range(0, len(rows), 5)]
        got = [r for c in S.Run(["a", "b"]).shared(iter(batches)) for r in zip(*(c[k].tolist() for k in ("a", "b", "id", "run")), strict=True)]
        assert sorted(g[:3] for g in got) == sorted(r for r in rows if len({*ids[r[:2]]}) > 1)
        assert len({g[3] for g in got}) == len({(g[:2], g[3]) for g in got}) == sum(len({*v}) > 1 for v in ids.values())
        got = [r for c in S.Run(["a", "b"]).later(iter(batches)) for r in zip(*(c[k].tolist() for k in ("a", "b", "id")), strict=True)]
        assert sorted(got) == sorted(r for r in rows if r[2] > min(ids[r[:2]]))


@pytest.mark.parametrize(("length", "most"), [(50, 2), (48, 50_000), (77, 50_000)])
def test_repeats_of_ranks_in_many_places(docs, rows, spark, length, most):
    """The windows of a rank in more than `most` places go through rows; other lengths."""
    from mosaiq.llm.suffix_dedup import remove_repeats

    first, texts = {}, [(r[0], (r[1] or "").encode()) for r in rows]
    for i, t in texts:
        for k in range(len(t) - length + 1):
            first[t[k : k + length]] = min(i, first.get(t[k : k + length], i))
    want = []
    for i, t in texts:
        gone = bytearray(len(t))
        for k in range(len(t) - length + 1):
            if first[t[k : k + length]] < i:
                gone[k : k + length] = b"\1" * length
        want.append((i, sum(gone), bytes(c for c, g in zip(t, gone, strict=True) if not g)))
    got = [(r.doc_id, r.n_removed, bytes(r.kept)) for r in remove_repeats(docs, length=length, most=most).collect()]
    assert sorted(got) == sorted(want)


@pytest.mark.parametrize(("keep", "limit"), [("none", 1000), ("first", 0)])
def test_lines_meet_a_filter_that_is_cut_over_tasks(docs, rows, none, keep, limit, monkeypatch):
    from mosaiq.llm.line_dedup import drop_lines

    same = lambda **o: sorted((r.row.doc_id, r.text or "", r.n_lines, r.n_dropped) for r in drop_lines(docs, min_docs=3, keep=keep, broadcast_keys=limit, **o).collect())
    assert same(max_bits=0) == same() and any(r[3] for r in same())
    assert drop_lines(none, max_bits=0).count() == 0
