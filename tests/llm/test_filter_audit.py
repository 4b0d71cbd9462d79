"""The filter audit against its SQL, brute force and texts whose hashes collide."""

import random
import re
from collections import Counter
from itertools import permutations

import duckdb
import pandas as pd
import pytest

pytest.importorskip("mosaiq.llm")

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, mask int, key string"
COLUMNS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def brute(rows, labels):
    """rows: (id, text, lang); labels: (id, quality, toxic)."""
    good, toxic = ({i for i, q, t in labels if i is not None and (q, t)[k] == 1} for k in (0, 1))
    out = Counter()
    fails = []
    for i, t, lang in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        smaller = any((u or "") == t and j is not None and (i is None or j < i) for j, u, _ in rows)
        f = (len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), bool(re.search(r"[#$%&*|]", t)), smaller)
        fails.append((lang or "", {c for c, x in zip("ABCDE", f, strict=True) if x}, i in good, i in toxic))
    parts, shapley = {f[0] for f in fails}, Counter()
    for order in permutations("ABCDE"):
        for part in parts:
            for step, c in enumerate(order, 1):
                for k in COLUMNS:
                    out[part, "".join(order), step, k] += 0
                for p, f, g, x in fails:
                    if p != part:
                        continue
                    before = f & set(order[: step - 1])
                    here = c in f and not before
                    for k, v in zip(COLUMNS, (not before and c not in f, here, c in f and bool(before), f == {c}, here and g, here and x), strict=False):
                        out[part, "".join(order), step, k] += v
                    shapley[part, c] += here
    for part, order, step, k in out:
        if k == "shapley":
            out[part, order, step, k] = shapley[part, order[step - 1]]
    return out


def as_counts(rows):
    return Counter({(r.part, r.filter_order, r.step, k): r[k] for r in rows for k in COLUMNS})


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    words = ["alpha", "Beta", "GAMMA", "d#", "e|", "zulu", "é", "日本"]
    base = [" ".join(rng.choices(words, k=rng.choice([1, 3, 150, 250, 900]))) for _ in range(12)]
    near = [b[:-1] + "!" for b in base]  # as long, and the first blocks are the same
    out = [(i, rng.choice(base + near), rng.choice(["en", "fr", "", None])) for i in range(60)]
    return out + [(7, base[0], "en"), (None, base[0], "en"), (None, base[0], None), (None, "only here", "fr"), (None, "only here", "fr"), (80, None, "en"), (81, "", "fr"), (82, "\t \n", None), (83, "x " * 90_000, "en"), (84, "x " * 89_999 + "y ", "en"), (85, "x " * 90_000, "fr")]


LABELS = [(i, i % 3 % 2, i % 5 % 2) for i in range(0, 70, 2)] + [(4, 1, None), (4, None, 1), (None, 1, 1), (999, 1, 1)]


@pytest.mark.parametrize("bits,few,most_keys", [(64, 500_000, 1_000_000), (64, 0, 0), (2, 0, 1_000_000)])
def test_audit(spark, rows, bits, few, most_keys):
    """bits: at two of each hash most keys stand for several texts. few, most_keys: 0 takes the ways of large tables."""
    from mosaiq.llm.filter_audit import audit

    docs = spark.createDataFrame([(*r, 1, "clash") for r in rows], SCHEMA).repartition(3)
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    assert as_counts(audit(docs, labels, bits=bits, few=few, most_keys=most_keys).collect()) == brute(rows, LABELS)


def test_empty_tables(spark, rows):
    from mosaiq.llm.filter_audit import audit, failed

    docs = spark.createDataFrame([(*r, 1, "clash") for r in rows[:5]], SCHEMA)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit(docs.limit(0), labels).collect() == []
    assert as_counts(audit(docs, labels).collect()) == brute(rows[:5], [])
    assert sorted(r.id for r in failed(docs).collect()) == [0, 1, 2, 3, 4]


def test_copies_of_very_many_rows(spark):
    from mosaiq.llm.filter_audit import failed

    docs = spark.range(30_000).selectExpr("id AS doc_id", "if(id % 3 = 0, repeat('same words ', 30), concat('text ', id)) AS text", "'en' AS lang")
    marked = failed(docs, few=0).where("mask >= 16")
    assert marked.count() == 9_999 and marked.where("id % 3 != 0 or id = 0").count() == 0


def test_against_sql(spark):
    from mosaiq.llm.filter_audit import OP11_SQL, op11_filter_audit

    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got, want = op11_filter_audit(spark, SF).toPandas(), con.execute(OP11_SQL).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns) and len(got) % 600 == 0
    a, b = (x[cols].sort_values(cols).reset_index(drop=True) for x in (got, want))
    pd.testing.assert_frame_equal(a, b, check_dtype=False)
