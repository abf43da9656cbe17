import hashlib
import random

import pytest
import xxhash
from pyspark.sql import functions as F

from quarryline.llm.sketches import add_sketch, fingerprint_edits


def lines(t):
    return {x for x in t.split("\n") if x.strip(" \t\n\x0b\f\r")}


def jaccard(a, b):
    a, b = lines(a), lines(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def brute(rows):
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    for k, (i, t) in enumerate(order):
        t, nxt = t or "", order[(k + 1) % len(order)][1] or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + nxt[:half]
        yield i, len(t), hashlib.sha256(edited.encode()).hexdigest(), jaccard(t, edited), jaccard(t, nxt)


def rows(seed, n=150):
    rng = random.Random(seed)
    pool = [" ".join(rng.choice("lorem ipsum dolor sit amet é漢".split()) for _ in range(rng.randint(1, 9))) for _ in range(60)]
    out = [(i * 3, "\n".join(rng.choice(pool) for _ in range(rng.choice([0, 1, 2, 5, 8, 40])))) for i in range(n)]
    out += [(None, None), (None, "x\ny"), (7, "tie b"), (7, "tie a"), (9, "rep"), (9, "rep"), (1000, ""), (1001, " \n \n"), (1002, "\n".join(map(str, range(700)))), (1003, "\n".join(map(str, range(350, 1100))))]
    return out


@pytest.mark.parametrize("bucket", [4000, 10])
def test_against_brute_force(spark, bucket):
    data = rows(bucket)
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(3).withColumn("near_next", F.lit("clash"))
    got = fingerprint_edits(df, bucket).collect()
    key = lambda x: (x[0] is None, x[0] or 0, *x[1:3], round(x[3], 9), round(x[4], 9))
    assert sorted((key((r["doc_id"], r["n_chars"], r["edited_sha256"], r["near_edited"], r["near_next"])) for r in got)) == sorted(map(key, brute(data)))
    assert all(r["fingerprint"].count(";") == 31 for r in got)
    by_text = {}
    for r in got:
        if r["near_edited"] == 1.0:
            assert r["fingerprint"] == r["edited_fingerprint"]


def test_cells_are_the_contracted_sums(spark):
    r = add_sketch(spark.createDataFrame([("a\nb\na\n\n",)], "t string"), "t", "k", "c").first()
    keys = [xxhash.xxh64_intdigest(x.encode(), 42) for x in ("a", "b")]
    assert sorted(k & (1 << 64) - 1 for k in r["k"]) == sorted(keys)
    for t in range(4):
        total = 0
        for cell in r["c"][8 * t : 8 * t + 8]:
            total ^= cell["k"] & (1 << 64) - 1
        assert total == keys[0] ^ keys[1] and sum(c["n"] for c in r["c"][8 * t : 8 * t + 8]) == 2


def test_one_row_and_none(spark):
    df = spark.createDataFrame([(5, "only\none")], "doc_id long, text string")
    r = fingerprint_edits(df).first()
    assert r["near_next"] == 1.0 and r["edited_sha256"] == hashlib.sha256(b"onlyonly").hexdigest()
    assert fingerprint_edits(df.limit(0)).count() == 0
