"""What is found in rounds or over ranges equals what one pass in order finds."""

import random

import pytest
from pyspark.sql import functions as F

from quarryline.operators.catalogue import assign_names
from quarryline.operators.choose import running_progress
from quarryline.operators.compare import collisions, refused_entries


def one_pass(rows, scoped):
    taken, out = set(), {}
    for i, sha, name, scope in sorted(rows, key=lambda r: (r[1], r[2])):
        stem = name.rsplit(".", 1)[0]
        tries = (stem if k == 0 else f"{stem}_{sha[:8]}" if k == 1 else f"{stem}_{sha[:8]}-{k}" for k in range(10**6))
        pick = next(t for t in tries if (scoped and scope.lower(), t.lower()) not in taken)
        taken.add((scoped and scope.lower(), pick.lower()))
        out[i] = pick
    return out


@pytest.mark.parametrize("seed,scoped", [(1, False), (2, True), (3, False)])
def test_names_in_rounds(spark, seed, scoped):
    rng = random.Random(seed)
    digests = [f"{rng.randrange(6):08x}{rng.randrange(1 << 60):056x}" for _ in range(300)]
    stems = ["a", "A", "b_00000001", "a_00000001", "a_00000001-2", "a_00000001-3", "a_00000001_00000001", "B", "c"]
    rows = [(i, sha, rng.choice(stems) + ".fpx", rng.choice(["x", "X", "y"])) for i, sha in enumerate(digests)]
    df = spark.createDataFrame(rows, "i int, sha256 string, name string, scope string").repartition(5)
    got = {r["i"]: r["given"] for r in assign_names(df, scope="scope" if scoped else None).collect()}
    assert got == one_pass(rows, scoped)


def test_one_popular_stem_and_copies(spark):
    rows = [(i, f"{i:08x}".ljust(64, "0"), "IMG.fpx", "") for i in range(2000)] + [(5000 + i, "f" * 64, "IMG.fpx", "") for i in range(40)]
    df = spark.createDataFrame(rows, "i int, sha256 string, name string, scope string")
    got = assign_names(df).collect()
    assert len({r["given"] for r in got}) == len(rows)
    assert sorted(r["given"] for r in got) == sorted(one_pass(rows, False).values())
    assert assign_names(df.limit(0)).count() == 0


def test_prefix_scan_equals_one_pass(spark):
    rng = random.Random(4)
    # One run has nearly all lines.
    rows = [("big" if k < 3000 else rng.choice(["x", "y"]), k, rng.choice([None, rng.randrange(500)]), rng.choice([None, None, rng.randrange(9)]), rng.choice([True, False, None]), k == 2500) for k in range(3200)]
    df = spark.createDataFrame(rows, "run string, seq long, done int, total int, failed boolean, interrupted boolean").repartition(7)
    state, want = {}, set()
    for run, seq, done, total, failed, stop in rows:
        d, t, f, s = state.get(run, (None, None, 0, False))
        d = done if d is None else d if done is None else max(d, done)
        state[run] = d, total if total is not None else t, f + bool(failed), s or stop
        want.add((run, seq, *state[run]))
    out = running_progress(df, "run", ["seq"])
    assert {tuple(r) for r in out.select("run", "seq", "done", "total", "failed", "interrupted").collect()} == want
    assert running_progress(df.limit(0), "run", ["seq"]).count() == 0


def test_a_long_run_spreads_over_tasks(spark):
    df = spark.range(20000).select(F.lit("r").alias("run"), F.col("id").alias("seq"), F.col("id").cast("int").alias("done"), F.lit(None).cast("int").alias("total"), F.lit(True).alias("failed"), F.lit(False).alias("interrupted"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = running_progress(df, "run", ["seq"])
        sizes = [r["n"] for r in out.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
        assert out.agg(F.max("failed")).first()[0] == 20000 and max(sizes) < 20000
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_refusals_equal_one_pass(spark):
    rng = random.Random(6)
    rows = [(e, rng.choice("abAB") + str(rng.randrange(60))) for e in range(80) for _ in range(rng.randint(1, 3))]
    taken, left = {"a1", "b2"}, {}
    for e, p in rows:
        left.setdefault(e, set()).add(p.lower())
    refused, claimed = set(), set(taken)
    for e in sorted(left):
        if left[e] & claimed:
            refused.add(e)
        else:
            claimed |= left[e]
    got = refused_entries(spark.createDataFrame(rows, "entry int, path string"), spark.createDataFrame([("A1",), ("b2",)], "path string")).collect()
    assert {r["entry"] for r in got} == refused and len(got) == len(refused)
    assert refused_entries(spark.createDataFrame([], "entry int, path string")).count() == 0


def test_the_first_claimant_keeps_its_path(spark):
    df = spark.createDataFrame([(2, "a/X"), (1, "A/x"), (3, "b")], "k int, path string")
    assert [tuple(r) for r in collisions(df, ["k"]).collect()] == [(2, "a/X")]
