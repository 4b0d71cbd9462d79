"""Vector codes against SQL, brute force and odd vectors."""

import hashlib
import math
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pytest

pytest.importorskip("mosaiq.llm")

SF = "/root/testdata/sf0.001"


def brute(rows, entries=256, rounds=4):
    """rows: (id, list of floats, label), all of one length that 4 divides, without odd values."""
    rows = sorted(((i, [math.floor(1024 * x) for x in v], label) for i, v, label in rows), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    d = len(rows[0][1]) // 4
    cut = [[v[p * d : (p + 1) * d] for _, v, _ in rows] for p in range(4)]
    books = [[list(x) for x in c[:entries]] for c in cut]

    def nearest(x, book):
        dist = [sum((a - b) ** 2 for a, b in zip(x, y, strict=True)) for y in book]
        return dist.index(min(dist)), min(dist)

    for _ in range(rounds):
        for p in range(4):
            given = [nearest(x, books[p])[0] for x in cut[p]]
            for e in set(given):
                own = [x for x, g in zip(cut[p], given, strict=True) if g == e]
                books[p][e] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    found = [[nearest(cut[p][k], books[p]) for p in range(4)] for k in range(len(rows))]
    sha = hashlib.sha256(",".join(str(x) for b in books for y in b for x in y).encode()).hexdigest()
    by_label = Counter()
    for (_, _, label), f in zip(rows, found, strict=True):
        by_label[label] += sum(e for _, e in f)
    return Counter((i, "".join(f"{e:02x}" for e, _ in f), sum(e for _, e in f), by_label[label], sha) for (i, _, label), f in zip(rows, found, strict=True))


def told(df):
    return Counter((r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256) for r in df.collect())


SCHEMA = "vec_id long, embedding array<float>, label int, code string, v int"


def table(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA)


def test_against_sql(spark):
    from mosaiq.llm.vector_codes import OP13_SQL, op13_vector_codes

    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{SF}/embeddings.parquet'")
    got, want = op13_vector_codes(spark, SF).toPandas(), con.execute(OP13_SQL).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    a, b = (x[cols].sort_values(cols).reset_index(drop=True) for x in (got, want))
    pd.testing.assert_frame_equal(a, b, check_dtype=False)


@pytest.mark.parametrize("bits", [1, 4, 7])
def test_va_file(bits):
    from mosaiq.llm.vector_codes import VAFile

    rng = np.random.default_rng(2)
    entries = rng.integers(-600, 600, (200, 16))
    entries[50] = entries[40]
    entries[60:70] = entries[60]
    x = np.concatenate([rng.integers(-700, 700, (1500, 16)), entries, entries + rng.integers(-2, 3, entries.shape)])
    file = VAFile(entries, bits)
    lower, upper = file.bounds(x)
    exact = ((x[:, None] - entries[None]) ** 2).sum(2)
    assert (lower <= exact).all() and (exact <= upper).all()
    index, best = file.nearest(x)
    assert (index == exact.argmin(1)).all() and (best == exact.min(1)).all()
    assert file.refined < file.asked * {1: 1.01, 4: 0.25, 7: 0.02}[bits]


def test_brute_force_with_many_rows(spark):
    from mosaiq.llm.vector_codes import vector_codes

    rng = np.random.default_rng(8)
    rows = [(i if i % 11 else None, [float(x) for x in rng.choice([-0.3, 0.0, 0.11, 0.5], 8) + rng.normal(0, 0.02, 8).astype(np.float32)], [0, 1, None][i % 3]) for i in range(400)]
    rows = [(i, [float(np.float32(x)) for x in v], label) for i, v, label in rows] + [(5, [0.25] * 8, 1), (5, [0.125] * 8, 1), (5, [0.25] * 8, None)]
    assert told(vector_codes(table(spark, rows).repartition(5), entries=40)) == brute(rows, 40)
    assert told(vector_codes(table(spark, rows).repartition(3), entries=40, few=0)) == brute(rows, 40)
    hot = [(i, [0.5, -0.5, 0.25, 0.0] * 2, 3) for i in range(1000)]
    assert told(vector_codes(table(spark, rows + hot), entries=8, rounds=1, few=0)) == brute(rows + hot, 8, 1)


def test_odd_vectors(spark):
    from mosaiq.llm.vector_codes import vector_codes

    nan, inf = float("nan"), float("inf")
    good = [(7, [0.5, -0.25, 0.0, -0.0004] * 2, None), (3, [0.0] * 8, 1), (None, [-1.0] * 8, 1), (3, [0.0] * 8, 1), (9, [2.0] * 8, None)]
    bad = [(1, None, 1), (2, [], 1), (2, [nan] + [0.0] * 7, 1), (2, [0.0] * 7 + [inf], None), (2, [None] + [0.0] * 7, 1), (2, [1.0] * 7, 1), (20, [1.0] * 4, 1), (2, [3e38] * 8, 1)]
    assert told(vector_codes(table(spark, good + bad))) == brute(good)
    assert vector_codes(table(spark, bad[:3])).collect() == [] and vector_codes(table(spark, good).limit(0)).collect() == []
