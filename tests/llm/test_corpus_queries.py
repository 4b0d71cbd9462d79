"""Every query of the corpus operators, on the given tables: against its SQL, or against brute force."""

import hashlib
import zlib

import duckdb
import numpy as np
import pandas as pd
import pytest

pytest.importorskip("mosaiq.llm")

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("documents", "embeddings", "labels"):
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.fixture(scope="module")
def texts(con):
    return {i: t or "" for i, t in con.execute("select doc_id, text from documents").fetchall()}


@pytest.mark.parametrize("name", ["op1_mixing", "op7_vector_dedup", "op8_line_dedup"])
def test_against_sql(spark, con, name):
    from mosaiq.llm.registry import QUERIES, SQL

    got, want = QUERIES[name](spark, SF).toPandas(), con.execute(SQL[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    a, b = (x[cols].sort_values(cols).reset_index(drop=True) for x in (got, want))
    pd.testing.assert_frame_equal(a, b, check_dtype=False)


def test_op2(spark, texts):
    from mosaiq.llm.suffix_dedup import op2_suffix_dedup

    raw, first = {i: t.encode() for i, t in texts.items()}, {}
    for i in sorted(raw):
        for k in range(len(raw[i]) - 49):
            first.setdefault(raw[i][k : k + 50], i)
    want = set()
    for i, t in raw.items():
        gone = np.zeros(len(t), bool)
        for k in range(len(t) - 49):
            if first[t[k : k + 50]] < i:
                gone[k : k + 50] = True
        runs = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        want.add((i, len(t), int(gone.sum()), runs, hashlib.sha256(np.frombuffer(t, np.uint8)[~gone].tobytes()).hexdigest()))
    assert {(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in op2_suffix_dedup(spark, SF).collect()} == want


def test_op3(spark, texts):
    from mosaiq.llm.ngram_join import op3_ngram_join

    def grams(t):
        w = t.encode().lower().split()
        return {tuple(w[k : k + 4]) for k in range(len(w) - 3)} if len(w) > 3 else {tuple(w)} if w else set()

    sets, root = {i: grams(t) for i, t in texts.items()}, {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            a, b = sets[i], sets[j]
            if a and b and 100 * min(len(a), len(b)) >= 85 * max(len(a), len(b)) and 100 * len(a & b) >= 85 * len(a | b):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in op3_ngram_join(spark, SF).collect()} == {(i, len(sets[i]), find(i)) for i in ids}


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_op4(spark, texts):
    import public_tokenizers as p
    from tokenizers import Tokenizer

    from mosaiq.llm.token_files import op4_token_files

    t, at, want = Tokenizer.from_file(p.path("byte_bpe_50k.json")), 0, []
    for i in sorted(texts):
        ids = [*t.encode(texts[i], add_special_tokens=False).ids, 2]
        want.append((i, at, len(ids), crc(ids)))
        at += len(ids)
    assert sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in op4_token_files(spark, SF).collect()) == want


def test_op5(spark, texts):
    from mosaiq.llm import ogg

    got = {r.doc_id: r for r in ogg.op5_ogg(spark, SF).collect()}
    assert set(got) == set(texts)
    for i, t in texts.items():
        raw = t.encode()
        payload = raw + b" " * (max(192, -(-len(raw) // 192) * 192) - len(raw))
        media, r = ogg.store(payload), got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        assert (r.media_bytes, r.media_sha256) == (len(media), hashlib.sha256(media).hexdigest())
    assert len({r.feature for r in got.values()}) > len({*texts.values()}) / 2


def test_op6(spark, con, texts, monkeypatch):
    """Scores against an explicit sum over pairs of the learned machine's terms."""
    from mosaiq.llm import toxicity

    kept = []
    train = toxicity.train
    monkeypatch.setattr(toxicity, "train", lambda *a, **k: kept.append(train(*a, **k)) or kept[-1])
    got = {r.doc_id: r for r in toxicity.op6_toxicity(spark, SF).collect()}
    m = kept[0]
    place = {int(b): k for k, b in enumerate(m.buckets)}
    assert set(got) == set(texts)
    for i, t in texts.items():
        r = got[i]
        cols = sorted({place[b] for w in t.encode().lower().split() for b in toxicity.terms(w) if b in place})
        z = m.bias + sum(m.weights[c] for c in cols) + sum(float(m.factors[a] @ m.factors[b]) for k, a in enumerate(cols) for b in cols[:k])
        assert abs(r.score - 1 / (1 + np.exp(-np.clip(z, -30, 30)))) < 2e-6
        assert r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and r.predicted == int(r.score >= 0.3)


def test_op9(spark, texts):
    import public_tokenizers as p
    from tokenizers import Tokenizer

    from mosaiq.llm.packing import op9_packing

    t, rows = Tokenizer.from_file(p.path("word_bpe_49k.json")), op9_packing(spark, SF).collect()
    ids = {i: [*t.encode(x, add_special_tokens=False).ids, 1] for i, x in texts.items()}
    seen = {i: 0 for i in ids}
    for r in sorted(rows, key=lambda r: (r.doc_id, r.start)):
        assert r.start == seen[r.doc_id] and r.doc_tokens == len(ids[r.doc_id]) and r.ids_crc32 == crc(ids[r.doc_id][r.start : r.start + r.length])
        seen[r.doc_id] += r.length
    assert seen == {i: len(x) for i, x in ids.items()}
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in bins.values():
        b.sort()
        assert [o for o, _ in b] == [sum(n for _, n in b[:k]) for k in range(len(b))] and sum(n for _, n in b) <= 2048
    assert sum(2048 - sum(n for _, n in b) for b in bins.values()) <= 0.03 * sum(map(len, ids.values())) + 2048


def test_op10(spark, texts):
    from mosaiq.llm.sharding import op10_sharding

    rows = op10_sharding(spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    slots = {s: [] for s in range(40)}
    for r in rows:
        raw = texts[r.doc_id].encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(raw) + 16, zlib.crc32(raw), "rows", None)
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
