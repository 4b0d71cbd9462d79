"""Exact values on repeated and null ids, null and empty texts and ties, where test_odd.py counts rows."""

import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

pytest.importorskip("mosaiq.llm")

from test_odd import ROWS, folder, run  # noqa: E402, F401


def words(text):
    return (text or "").encode().lower().split()


def grams(text, n):
    w = words(text)
    return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} or ({tuple(w)} if w else set())


def jaccard(rows, n, percent):
    """Counter of (id, set size, smallest id reachable): rows of one id are one document, null is the last id."""
    sets = [(2**63 if i is None else i, grams(t, n)) for i, t in rows]
    root = {i: i for i, _ in sets}
    moved = True
    links = [(i, j) for i, a in sets for j, b in sets if i != j and a and b and 100 * len(a & b) >= percent * len(a | b)]
    while moved:
        moved = False
        for i, j in links:
            low = min(root[i], root[j])
            if root[i] != low or root[j] != low:
                root[i] = root[j] = low
                moved = True
    out = lambda v: None if v == 2**63 else v
    return Counter((out(i), len(s), out(root[i])) for i, s in sets)


def test_op3_on_odd_rows(spark, folder):  # noqa: F811
    got = Counter(map(tuple, (r[:3] for r in run(spark, folder, "op3_ngram_join"))))
    assert got == jaccard([(i, t) for i, t, _ in ROWS], 4, 85)


def test_op3_where_ids_repeat(spark):
    from mosaiq.llm.ngram_join import jaccard_components

    rng = random.Random(2)
    base = [[f"w{rng.randint(0, 400)}" for _ in range(rng.choice([3, 30, 60]))] for _ in range(8)]
    rows = []
    for _ in range(70):
        t = list(rng.choice(base))
        if rng.random() < 0.5:
            t[rng.randrange(len(t))] = "changed"
        rows.append((rng.choice([None, 1, 2, 3, 4, 5, 6, 7, 8, 9, 30]), rng.choice([" ".join(t), " ".join(t), None, "", f"alone {rng.random()}"])))
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, n int").repartition(3)
    assert Counter(map(tuple, jaccard_components(docs, words=5, percent=80).collect())) == jaccard(rows, 5, 80)


def test_rows_of_one_id_are_dealt_over_tiles(spark, monkeypatch):
    """Many near copies without an id: no block is larger than two tiles."""
    from mosaiq.llm import ngram_join

    sizes, real = [], ngram_join.tiled

    def watched(members, data, tile):
        out = real(members, data, 64)
        sizes.extend(r["count"] for r in out.groupBy("grp", "ti", "tj").count().collect())
        return out

    monkeypatch.setattr(ngram_join, "tiled", watched)
    text = " ".join(f"word{k}" for k in range(60))
    docs = spark.range(900).selectExpr("if(id = 5, 5, null) AS doc_id", f"concat('{text} end', id) AS text")
    got = Counter(map(tuple, ngram_join.jaccard_components(docs).collect()))
    assert got == {(5, 57, 5): 1, (None, 57, 5): 899} and 0 < max(sizes) < 4 * 64


def test_op4_and_op9_on_odd_rows(spark, folder):  # noqa: F811
    import public_tokenizers as p
    from tokenizers import Tokenizer

    def ids(name, text, end):
        return [*Tokenizer.from_file(p.path(name)).encode(text or "", add_special_tokens=False).ids, end]

    crc = lambda x: zlib.crc32(np.array(x, "<u4").tobytes())
    each = [(i, ids("byte_bpe_50k.json", t, 2)) for i, t, _ in ROWS]
    rows = run(spark, folder, "op4_token_files")
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in rows) == Counter((i, len(x), crc(x)) for i, x in each)
    packed = run(spark, folder, "op9_packing")
    wanted = [(i, ids("word_bpe_49k.json", t, 1)) for i, t, _ in ROWS]
    assert {r.doc_tokens for r in packed} == {len(x) for _, x in wanted}
    for i in {r.doc_id for r in packed}:
        mine = [x for j, x in wanted if j == i]
        # pieces of rows that share an id: each is a piece of one of them, and together they have all their ids
        assert sum(r.length for r in packed if r.doc_id == i) == sum(map(len, mine))
        for r in (r for r in packed if r.doc_id == i):
            assert any(r.doc_tokens == len(x) and crc(x[r.start : r.start + r.length]) == r.ids_crc32 for x in mine)
    at = Counter()
    for r in sorted(packed, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == at[r.sequence_id]
        at[r.sequence_id] += r.length
    assert max(at.values()) <= 2048


def test_packing_stage_on_odd_rows(spark, folder):  # noqa: F811
    import public_tokenizers as p
    from tokenizers import Tokenizer

    import corpus_pipeline

    t = Tokenizer.from_file(p.path("word_bpe_49k.json"))
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = dict(corpus_pipeline.STAGES)["packing"](spark, docs, folder).collect()
    wanted = [(i, [*t.encode(x or "", add_special_tokens=False).ids, 1]) for i, x, _ in ROWS]
    for r in rows:
        assert any(i == r.doc_id and len(x) == r.doc_tokens and list(np.frombuffer(bytes(r.ids), "<u2")) == x[r.start : r.start + r.length] for i, x in wanted)
    assert Counter(r.doc_id for r in rows if r.start == 0) == Counter(i for i, _ in wanted)
    assert sum(r.length for r in rows) == sum(len(x) for _, x in wanted)


def test_op8_sql_counts_rows(spark, tmp_path):
    from mosaiq.llm.line_dedup import OP8_SQL, drop_lines, op8_line_dedup

    rows = [(1, "same line\nown")] * 10 + [(None, "Same Line \nother")] * 3 + [(2, None), (None, ""), (3, "own\n\nown")]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(2).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    cols = "doc_id, n_lines, n_dropped, kept_sha256"
    want = Counter(con.execute(f"select {cols} from ({OP8_SQL})").fetchall())
    assert Counter(map(tuple, op8_line_dedup(spark, str(tmp_path)).select(*cols.split(", ")).collect())) == want
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    joined = drop_lines(docs, min_docs=10, keep="none", broadcast_keys=0)
    assert Counter((r.row.doc_id, r.n_lines, r.n_dropped) for r in joined.collect()) == Counter({k[:3]: 0 for k in want}) + Counter([k[:3] for k in want.elements()])


def test_mixed_rows_are_in_slot_order(spark):
    """Partitions are runs of the schedule: any run of rows has the sources' shares."""
    from mosaiq.llm.mixing import mix, mixed_documents

    docs = spark.range(3000).selectExpr("if(id % 7 = 0, null, id) AS doc_id", "concat('some words of document ', id) AS text", "concat('s', id % 3) AS source").repartition(5)
    out = mixed_documents(docs, block_words=5)
    parts = [p for p in out.select("source").rdd.glom().map(lambda rows: [r.source for r in rows]).collect() if p]
    target = {r.source: r.target for r in mix(docs, block_words=5).sources.collect()}
    total = sum(target.values())
    assert len(parts) > 1 and sum(map(len, parts)) == pytest.approx(total / 5, rel=0.02)
    for p in parts:
        for s, t in target.items():
            assert abs(p.count(s) / len(p) - t / total) < 0.02


def test_rows_without_an_id_share_no_bucket(spark):
    """Null ids are mixed like others: taken words reach the targets, and SQL agrees on tables without them."""
    from mosaiq.llm.mixing import mix

    docs = spark.range(2000).selectExpr("if(id % 3 < 2, null, id) AS doc_id", "repeat('word ', cast(1 + id % 9 AS int)) AS text", "'one' AS source")
    d = mix(docs, share=0.5).documents.toPandas()
    assert len(d) == 2000 and d.begin[d["size"] > 0].nunique() == 2000 and abs(d.taken.sum() - d.target.iloc[0]) <= 0.5
    again = mix(docs.repartition(7), share=0.5).documents.toPandas()
    assert Counter(zip(d.tie, d.begin, d.taken, strict=True)) == Counter(zip(again.tie, again.begin, again.taken, strict=True))


def test_digests_travel_packed_and_are_not_staged(spark, monkeypatch):
    """What a set posts is on disk once, as it travels; ranges of digests grow in number with the texts."""
    import numpy as np

    from mosaiq.llm import ngram_join

    tables, real = [], ngram_join.staged
    monkeypatch.setattr(ngram_join, "staged", lambda df, name, *a: tables.append((name, df)) or real(df, name, *a))
    monkeypatch.setattr(ngram_join, "RANGE", 300)  # some 90 ranges, of 4 partitions otherwise
    rng = random.Random(4)
    base = [[f"w{rng.randint(0, 400)}" for _ in range(rng.choice([3, 30, 60]))] for _ in range(20)]
    rows = []
    for i in range(150):
        t = list(rng.choice(base))
        if rng.random() < 0.5:
            t[rng.randrange(len(t))] = f"changed{i}"
        rows.append((rng.choice([-1, 1]) * (i + 1) * 7_000_000_007, " ".join(t)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert Counter(map(tuple, ngram_join.jaccard_components(docs).collect())) == jaccard(rows, 5, 80)
    sets = dict(tables)["sets"]
    assert "digests" not in {c for _, df in tables for c in df.columns} and sets.rdd.getNumPartitions() > 40
    ids = np.array([2**63 - 1, -(2**62), 5, 5, 6, 10**12], np.int64)
    assert ngram_join.unpacked_ids(ngram_join.packed_ids(ids)).tolist() == ids.tolist()
    a, b = ngram_join.hubs_of(np.array([9, 2**64 - 1, 9, 4, 9, 2**64 - 1], np.uint64), np.array([5, 8, 3, 1, 5, -2]))
    assert sorted(zip(a.tolist(), b.tolist(), strict=True)) == [(5, 3), (8, -2)]


def test_what_ranges_tell_does_not_grow_with_their_number(spark, monkeypatch):
    """Near copies share digests in every range; a range tells of two rows only where nothing has joined them before."""
    from mosaiq.llm import ngram_join

    tables, real = {}, ngram_join.staged
    monkeypatch.setattr(ngram_join, "staged", lambda df, name, *a: tables.setdefault(name, real(df, name, *a)))
    rng = random.Random(6)
    base = [[f"w{rng.randint(0, 10**6)}" for _ in range(400)] for _ in range(3)]
    rows = []
    for i in range(120):
        t = list(base[i % 3])
        for _ in range(4):
            t[rng.randrange(len(t))] = f"changed{i}"
        rows.append((i, " ".join(t)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(20)
    told = []
    for chars in (1 << 24, 2000):  # 4 ranges, some 160
        tables.clear()
        monkeypatch.setattr(ngram_join, "RANGE", chars)
        assert Counter(map(tuple, ngram_join.jaccard_components(docs, words=4, percent=85).collect())) == jaccard(rows, 4, 85)
        told.append(tables["sets"].count())
    assert told[0] <= told[1] <= 2 * len(rows)


def test_digests_of_many_sets_are_those_of_each():
    """Larger sets' blocks are worked on together; sketches are some of a set's digests."""
    from mosaiq.llm.ngram_join import COVER, Columns

    rng = np.random.default_rng(8)
    for percent in (85, 80, 50):
        c = Columns(percent)
        # uneven ones leave strips empty, so they are dealt again
        sets = [np.unique(rng.integers(0, 2**63, n, np.int64).view(np.uint64) >> np.uint64(rng.integers(0, 4))) for n in [*range(0, 90), 150, 400, 1500]]
        every, place = c.of(sets)
        few, few_place = c.of(sets, few=True)
        for i, s in enumerate(sets):
            want = [np.zeros(0, np.uint64)]
            for k in range(c._class(len(s)), c._class(len(s) * 100 // percent) + 1) if len(s) else ():
                want.append(c._levels(s, c.differ(c.tops[k]), c.tops[k] * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
            assert np.array_equal(np.sort(every[place == i]), np.sort(np.concatenate(want))), (percent, len(s))
            assert np.isin(few[few_place == i], every[place == i]).all() and (c.differ(max(len(s), 1)) >= len(COVER) or (few_place == i).any() == (len(s) > 0))


def test_a_block_is_multiplied_in_bounded_memory():
    """What a product of a block holds beside its sets does not grow with their n-grams."""
    import tracemalloc

    from mosaiq.llm.ngram_join import overlaps

    rng = np.random.default_rng(9)
    base = rng.integers(0, 2**64, (4, 3000), np.uint64)
    # near copies, and n-grams of one row or of a few
    sets = [np.unique(np.r_[base[i % 4][rng.random(3000) < 0.95], base[(i + 1) % 4][: i % 7], rng.integers(0, 2**64, 900, np.uint64), np.arange(i // 3, i // 3 + 5, dtype=np.uint64)]) for i in range(400)]
    sets[7] = sets[7][:0]
    for a, b in ((np.arange(400), None), (np.arange(0, 400, 2), np.arange(1, 400, 2))):
        tracemalloc.start()
        counts = overlaps(sets, a, b)
        held = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert held < 2 * sum(s.nbytes for s in sets)
        for i in range(0, len(a), 9):
            for j in range(0, len(a if b is None else b), 7):
                if b is not None or i != j:
                    assert counts[i, j] == len(np.intersect1d(sets[a[i]], sets[(a if b is None else b)[j]], assume_unique=True))


def test_pipeline_drops_what_its_next_stage_has_read(spark, folder, monkeypatch):  # noqa: F811
    import corpus_pipeline

    gone, real = [], corpus_pipeline.remove
    monkeypatch.setattr(corpus_pipeline, "STAGES", [(f"s{k}", lambda s, docs, d: docs) for k in range(4)])
    monkeypatch.setattr(corpus_pipeline, "remove", lambda s, path: gone.append(path) or real(s, path))
    assert corpus_pipeline.run(spark, folder).count() == spark.read.parquet(f"{folder}/documents.parquet").count()
    assert [p.split("/")[-1].split("-")[0] for p in gone] == ["s0", "s1", "s2"]
