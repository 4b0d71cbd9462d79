"""Repeated passages among rows that repeat, share an id or have none: against brute force, and at size."""

import hashlib
import random
from collections import Counter

import pytest

pytest.importorskip("mosaiq.llm")


def brute(rows):
    """Counter of (id, n_bytes, n_removed, n_spans, sha256 of what stays) for rows (id, text)."""
    last = 2**63
    texts = [(last if i is None else i, (t or "").encode()) for i, t in rows]
    first = {}
    for i, t in texts:
        for k in range(len(t) - 49):
            s = t[k : k + 50]
            first[s] = min(i, first.get(s, i))
    out = Counter()
    for i, t in texts:
        gone = bytearray(len(t))
        for k in range(len(t) - 49):
            if first[t[k : k + 50]] < i:
                gone[k : k + 50] = b"\1" * 50
        spans = sum(1 for k, g in enumerate(gone) if g and (k == 0 or not gone[k - 1]))
        out[None if i == last else i, len(t), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(t, gone, strict=True) if not g)).hexdigest()] += 1
    return out


def told(df):
    return Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(bytes(r.kept)).hexdigest()) for r in df.collect())


def scene():
    rng = random.Random(11)
    word = lambda: "".join(rng.choices("abcdefg", k=rng.randint(1, 7)))
    passage = [" ".join(word() for _ in range(rng.choice([8, 14, 40]))) for _ in range(6)]
    rows = []
    for _ in range(60):
        own = [" ".join(word() for _ in range(20)) for _ in range(rng.randint(0, 4))]
        parts = own + rng.choices(passage, k=rng.randint(0, 3))
        rng.shuffle(parts)
        rows.append((rng.choice([None, 1, 1, 2, 3, 4, 5, 50]), rng.choice([" ", "\n", "é"]).join(parts)))
    return rows + rng.choices(rows, k=40) + [(None, None), (None, None), (4, ""), (4, "x" * 300), (None, "x" * 300), (None, "x" * 300)]


@pytest.mark.parametrize("most", [50_000, 3])
def test_against_brute_force(spark, most):
    from mosaiq.llm import suffix_dedup

    rows = scene()
    docs = spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], "doc_id long, text string, mark string, n int").repartition(3)
    assert told(suffix_dedup.remove_repeats(docs, most=most)) == brute(rows)


def test_runs_of_one_id_are_not_held():
    """A run of one id of any length passes on, and rows of runs in two ids are all there."""
    import numpy as np
    import pyarrow as pa

    from mosaiq.llm import suffix_dedup

    n = suffix_dedup.CHUNK + 10
    batches = [pa.RecordBatch.from_pydict({"a": np.full(n, k // 20), "id": np.full(n, 5)}) for k in range(40)]
    batches += [pa.RecordBatch.from_pydict({"a": np.full(3, 9), "id": np.array([5, 6, 6])})]
    run, most, rows = suffix_dedup.Run(["a"]), 0, 0
    for c in run.shared(iter(batches)):
        rows += len(c["id"])
        most = max(most, sum(len(p["id"]) for p in run.pending))
    assert most <= suffix_dedup.PENDING + 2 * n and rows >= 40 * n - 2 * suffix_dedup.PENDING


def test_very_many_equal_rows(spark):
    """Work follows the distinct texts: 100,000 rows of one null id and text beside one document that shares a passage."""
    from mosaiq.llm.suffix_dedup import remove_repeats

    text = " ".join(str(k * k) for k in range(180))
    docs = spark.range(100_000).selectExpr("cast(null AS long) AS doc_id", f"'{text}' AS text").unionByName(spark.createDataFrame([(1, "begin " + text[100:400] + " end"), (2, text[:90])], "doc_id long, text string"))
    out = remove_repeats(docs)
    found = {(r.doc_id, r.n_bytes, r.n_removed, r.n_spans): r.n for r in out.groupBy("doc_id", "n_bytes", "n_removed", "n_spans").count().withColumnRenamed("count", "n").collect()}
    both = brute([(None, text), (1, "begin " + text[100:400] + " end"), (2, text[:90])])
    assert found == {k[:4]: 100_000 if k[0] is None else 1 for k in both}
