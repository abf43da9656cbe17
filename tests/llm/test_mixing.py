import pytest
from pyspark.sql import functions as F

from quarryline.llm.mixing import by_rank, mix_sources, source_targets, training_order


def brute_targets(sizes, weights, cap=3):
    total, target, full = sum(sizes.values()), {}, set()
    while True:
        rest = total - sum(cap * sizes[s] for s in full)
        w = sum(weights[s] for s in sizes if s not in full)
        target = {s: cap * sizes[s] if s in full else rest * weights[s] / w for s in sizes}
        over = {s for s in sizes if s not in full and target[s] > cap * sizes[s]}
        if not over:
            return target
        full |= over


@pytest.mark.parametrize("sizes", [[100, 100, 100], [1000, 10, 10], [5, 500, 1, 0, 60], [7]])
def test_targets(spark, sizes):
    names = [f"s{k}" for k in range(len(sizes))]
    df = spark.createDataFrame(list(zip(names, sizes, strict=True)), "source string, source_size long")
    got = {r["source"]: r["target"] for r in source_targets(df).collect()}
    want = brute_targets(dict(zip(names, sizes, strict=True)), {n: k % 3 + 1 for k, n in enumerate(names)})
    assert got == pytest.approx(want)


def docs(spark):
    rows = [(i, "w " * (i % 17 + 1), ["a", "b", "c", None][i % 4 if i < 300 else 0]) for i in range(500)]
    rows += [(7, None, "a"), (None, "x y", None), (9, "", "b"), (3, "dup dup", "a"), (3, "dup dup", "a")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("taken", F.lit("clash"))


def test_mix_reaches_targets_and_repeats_itself(spark):
    d = docs(spark)
    rows = mix_sources(d).collect()
    assert len(rows) == d.count() and sorted(map(str, rows)) == sorted(map(str, mix_sources(d).collect()))
    for s in {r["source"] for r in rows}:
        own = [r for r in rows if r["source"] == s]
        assert sum(r["size"] for r in own) == own[0]["source_size"]
        assert sum(r["taken"] for r in own) == int(own[0]["target"])
        assert all(0 <= r["taken"] <= 3 * r["size"] for r in own)
        assert all(p == sorted(p) and len(p) == r["copies"] and all(0 <= x <= 1 for x in p) for r in own for p in [r["positions"]])
    assert mix_sources(d.limit(0)).count() == 0


def test_curriculum_follows_the_phases(spark):
    """A source that weighs nothing in the first half has its positions in the second."""
    d = docs(spark).where("source in ('a', 'b')")
    late = F.when(F.col("source") == "b", 0.0).otherwise(1.0)
    rows = mix_sources(d, [(0.5, late), (1.0, by_rank())]).collect()
    b = [p for r in rows if r["source"] == "b" for p in r["positions"]]
    a = [p for r in rows if r["source"] == "a" for p in r["positions"]]
    assert b and min(b) >= 0.5 and min(a) < 0.5 and max(a) > 0.5


def test_training_order(spark):
    d = docs(spark)
    mix = mix_sources(d)
    out = training_order(d)
    assert out.columns == d.columns and out.count() == mix.agg(F.sum("copies")).first()[0]
    where = {(r["doc_id"], r["source"]): r["positions"] for r in mix.collect()}
    first = [where[(r["doc_id"], r["source"])][0] for r in out.limit(20).collect() if len(where[(r["doc_id"], r["source"])]) == 1]
    assert first == sorted(first)


def test_training_order_keeps_rows_that_differ_in_any_column(spark):
    rows = [(1, "a b c", "s", "en", "x"), (1, "a b c", "s", "fr", "y"), (1, "a b c", "s", None, "x"), (2, None, None, "en", None), (None, "d e f", "s", "en", "z"), (None, "d e f", "s", "en", "z")]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, _key string").withColumn("_position", F.col("lang")).withColumn("a.b", F.lit(1))
    out = training_order(d, max_repeat=1)
    assert out.columns == d.columns
    got = [tuple(r)[:5] for r in out.collect()]
    assert set(got) == {r for r in rows if r[1]} and got == [tuple(r)[:5] for r in training_order(d, max_repeat=1).collect()]
    assert got.count((None, "d e f", "s", "en", "z")) == 2
