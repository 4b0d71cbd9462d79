"""Lempel-Ziv fingerprints against a plain parse, and their neighbours and edits against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

pytest.importorskip("mosaiq.llm")

SF = "/root/testdata/sf0.001"


def plain_phrases(data: bytes) -> set[bytes]:
    known, at = set(), 0
    for to in range(1, len(data) + 1):
        if data[at:to] not in known:
            known.add(data[at:to])
            at = to
    return known


def plain_print(data: bytes) -> list[int]:
    out: list[int | None] = [None] * 128
    for p in plain_phrases(data):
        h = xxhash.xxh3_64_intdigest(p)
        k = h >> 57
        out[k] = h if out[k] is None else min(out[k], h)
    return [0 if h is None else h % 65535 + 1 for h in out]


def plain_near(a: list[int], b: list[int]) -> float:
    both = [(x, y) for x, y in zip(a, b, strict=True) if x or y]
    return sum(x == y for x, y in both) / len(both) if both else 1.0


def brute(rows, tie):
    """What with_edits gives for rows (id, text)."""
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is None, r[0] or 0, tie[r[1]]))
    out = []
    for k, (i, t) in enumerate(rows):
        u = rows[(k + 1) % len(rows)][1]
        q = len(t) // 4
        e = (t[: len(t) - q] + u[:q]).encode()
        a, b, c = plain_print(t.encode()), plain_print(e), plain_print(u.encode())
        out.append((i, len(t), hashlib.sha256(e).hexdigest(), "".join(f"{x:04x}" for x in a), "".join(f"{x:04x}" for x in b), round(plain_near(a, b), 9), round(plain_near(a, c), 9)))
    return Counter(out)


def told(df):
    return Counter((r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, round(r.near_edited, 9), round(r.near_next, 9)) for r in df.collect())


def ties(spark, texts):
    df = spark.createDataFrame([(t,) for t in {x or "" for x in texts}], "t string").selectExpr("t", "xxhash64(t) AS h")
    return {r.t: r.h for r in df.collect()}


def test_parse_is_the_plain_one():
    from mosaiq.llm.lz_fingerprint import parse

    rng = random.Random(3)
    for n in [0, 1, 2, 7, 60, 500, 5000]:
        for letters in (b"a", b"ab", bytes(range(97, 117))):
            data = bytes(rng.choices(letters, k=n))
            known, at = set(), 0
            cut = rng.randint(0, n)
            at = parse(data, 0, cut, known)
            parse(data, at, n, known)
            assert known == plain_phrases(data)


def test_whole_table(spark):
    from mosaiq.llm.lz_fingerprint import op12_lz_fingerprint

    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = op12_lz_fingerprint(spark, SF)
    assert told(got) == brute(rows, ties(spark, [t for _, t in rows]))
    near = np.array([(r.near_edited, r.near_next) for r in got.where("n_chars >= 200").collect()])
    assert (near[:, 0] > near[:, 1]).mean() > 0.95 and ((near >= 0) & (near <= 1)).all()


ODD = [(3, "alpha beta gamma " * 9), (3, "alpha beta gamma " * 9), (3, "other"), (None, "no id"), (None, "no id"), (None, None), (5, None), (6, ""), (7, " \n\t "), (9, "x y z " * 30_000), (-4, "é日本語 " * 40), (12, "a"), (13, "日"), (2**62, "last one")]


@pytest.mark.parametrize("parts", [1, 4, 40])
def test_odd_rows(spark, parts):
    """Null and repeated ids, null, empty and very long texts, more ranges than rows."""
    from mosaiq.llm.lz_fingerprint import with_edits

    docs = spark.createDataFrame([(i, t, 1, "clash") for i, t in ODD], "doc_id long, text string, part int, fingerprint string").repartition(3)
    got = with_edits(docs, parts=parts)
    assert got.columns == ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    assert told(got) == brute(ODD, ties(spark, [t for _, t in ODD]))


def test_one_row_and_none(spark):
    from mosaiq.llm.lz_fingerprint import with_edits

    docs = spark.createDataFrame([(1, "only this one text")], "doc_id long, text string")
    assert told(with_edits(docs)) == brute([(1, "only this one text")], ties(spark, ["only this one text"]))
    assert with_edits(docs.limit(0)).collect() == []


def test_a_hot_id_fills_no_task(spark):
    """A third of all rows without an id, a third alike: no range has much more than its share."""
    from mosaiq.llm.lz_fingerprint import ranges, with_edits

    docs = spark.range(6000).selectExpr("if(id % 3 = 0, null, if(id % 3 = 1, 7, id)) AS doc_id", "if(id % 3 = 1, 'the same text here', concat('text of ', id)) AS text")
    sizes = [r["count"] for r in ranges(docs, parts=20).groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 6000 and max(sizes) < 2 * 6000 / 20
    assert with_edits(docs, parts=20).count() == 6000


def test_fingerprints_and_likeness(spark):
    from mosaiq.llm.lz_fingerprint import fingerprints, likeness_of

    text = " ".join(f"word{k % 90} next{k % 31}" for k in range(400))
    docs = spark.createDataFrame([(1, text, "x"), (2, text, "y"), (3, text[:-40] + "quite another end of it all", None), (4, "0123456789" * 50, ""), (5, None, ""), (6, "", None)], "doc_id long, text string, other string")
    made = fingerprints(docs)
    prints = {r.doc_id: r.fingerprint for r in made.collect()}
    assert prints[1] == prints[2] and prints[5] == prints[6] == "0" * 512 and made.columns == ["doc_id", "text", "other", "fingerprint"]
    pairs = made.alias("a").join(made.alias("b"), F.expr("a.doc_id < b.doc_id"))
    near = {(r.a, r.b): r.near for r in pairs.select(pairs["a.doc_id"].alias("a"), pairs["b.doc_id"].alias("b"), likeness_of(pairs["a.fingerprint"], pairs["b.fingerprint"]).alias("near")).collect()}
    assert near[1, 2] == near[5, 6] == 1 and near[1, 3] > 0.8 and near[1, 4] < 0.1 and near[1, 5] == 0
    assert all(abs(v - plain_near(list(np.frombuffer(bytes.fromhex(prints[a]), ">u2")), list(np.frombuffer(bytes.fromhex(prints[b]), ">u2")))) < 1e-12 for (a, b), v in near.items())
