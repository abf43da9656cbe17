import math
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarryline.llm.near_texts import CELLS, PIECE, STEPS, alike_groups, cell_of, drop_near_duplicates, parities, shared_at_most, shingle_counts, spread
from quarryline.llm.simhash import shingle_hashes


def shingles(text):
    w = (text or "").encode().lower().split()
    return {b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a or b else 1.0


def brute(rows, similarity=0.8):
    """Groups of row numbers that are alike, also by others."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in combinations(range(len(rows)), 2):
        if jaccard(sets[a], sets[b]) >= similarity - 1e-9:
            root[find(b)] = find(a)
    out = {}
    for i in range(len(rows)):
        out.setdefault(find(i), set()).add(i)
    return sorted(map(sorted, out.values()))


def planted():
    """Texts, copies of them at 0.7 to 0.95, and texts that share most but not enough of their words."""
    rng = np.random.default_rng(7)
    word = lambda: f"w{rng.integers(0, 10**9)}"
    texts = [None, "", " ", "one", "One", "a b c d", "a b c d e", "x " * 50]
    passage = [word() for _ in range(60)]
    for k in range(60):
        base = [word() for _ in range(int(rng.integers(20, 150)))]
        texts.append(" ".join(base))
        for want in (0.7, 0.78, 0.8, 0.82, 0.85, 0.9, 0.95)[k % 7 :]:
            # Words added at the end leave all shingles and add one each: the Jaccard index is n / (n + added).
            n = len(base) - 4
            texts.append(" ".join([*base, *(word() for _ in range(math.floor(n / want + 1e-9) - n))]))
        for _ in range(2):
            edited = list(base)
            edited[int(rng.integers(0, len(base)))] = word()
            texts.append(" ".join(edited))
    texts += [" ".join([*passage, *(word() for _ in range(30))]) for _ in range(40)]
    return [(i, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("cells", [CELLS, PIECE])
def test_groups_are_those_of_brute_force(spark, monkeypatch, cells):
    monkeypatch.setattr("quarryline.llm.near_texts.shingle_counts", lambda docs, shingle: shingle_counts(docs, shingle, cells))
    rows = planted()
    got = {}
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).withColumn("_key", F.col("doc_id"))
    for r in alike_groups(docs, 0.8).collect():
        got.setdefault(r["root"], set()).add(r["doc_id"])
    assert sorted(map(sorted, got.values())) == brute(rows)


def test_pipeline_stage_keeps_the_least_of_each_group(spark):
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    kept = sorted(r["doc_id"] for r in corpus_pipeline.simhash(spark, docs, "").collect())
    assert kept == sorted(min(rows[i][0] for i in g) for g in brute(rows))
    assert drop_near_duplicates(docs.limit(0)).count() == 0


def test_one_row_of_each_group_stays_whatever_its_id(spark):
    words = lambda k, n=30: " ".join(f"{k}x{i}" for i in range(n))
    rows = [(None, words(k), "s") for k in range(6)]  # unlike texts without an id
    rows += [(5, words(k), "s") for k in range(10, 14)]  # unlike texts of one id
    rows += [(None, words(20), "s"), (8, words(20), None), (9, words(20) + " tail", "s")]  # a group with and without ids
    rows += [(None, words(30), "s"), (None, words(30), "s"), (None, words(30), None)]  # a group without ids, a row twice
    rows += [(7, words(40), "s"), (7, words(40), "s")]  # a row twice
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = drop_near_duplicates(df.repartition(4))
    assert got.columns == df.columns
    got = [tuple(r) for r in got.collect()]
    assert sorted(t for _, t, _ in got) == sorted({t for _, t, _ in rows} - {words(20) + " tail"})
    assert (8, words(20), None) in got and (7, words(40), "s") in got and set(got) <= set(rows)


def test_spreads_bound_what_sets_share():
    rng = np.random.default_rng(1)
    for a, b, both in ((0, 0, 0), (1, 1, 1), (500, 500, 0), (500, 300, 200), (5000, 4000, 100), (70_000, 90_000, 10)):
        h = rng.integers(0, 2**63, a + b, dtype=np.uint64) * np.uint64(2)
        x, y = h[:a], np.r_[h[:both], h[a : a + b - both]]
        assert both <= shared_at_most(spread(x), spread(y)) <= min(a, b)
        if both == 0 and a:
            assert shared_at_most(spread(x), spread(y)) < 0.8 * (a + b) / 1.8  # unlike sets aren't compared by their texts
    assert shared_at_most(b"", spread(h)) == math.inf


def test_counts_cover_all_texts(spark):
    texts = [t for _, t in planted()]
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(5)
    want = np.zeros(PIECE, dtype=np.int64)
    for t in texts:
        np.add.at(want, cell_of(np.unique(shingle_hashes(t, 5)), PIECE), 1)
    assert (shingle_counts(df, 5, PIECE) == np.rint(STEPS * np.log2(1 + want))).all()
    assert not shingle_counts(df.limit(0), 5, PIECE).any()


def test_parities_bound_how_much_sets_differ():
    rng = np.random.default_rng(2)
    for a, b, both in ((0, 0, 0), (1, 1, 1), (300, 300, 290), (300, 200, 150), (5000, 4000, 100)):
        h = rng.integers(0, 2**63, a + b, dtype=np.uint64) * np.uint64(2)
        x, y = h[:a], np.r_[h[:both], h[a : a + b - both]]
        bits = sum(int(k).bit_count() for k in (parities(x) ^ parities(y)).view("<u8"))
        assert bits <= a + b - 2 * both and (bits > 0) == (a + b > 2 * both)


def test_clashing_names_stay(spark):
    rows = [(2, "a b c d e f", 1, "x"), (2, "a b c d e f", 2, "x"), (1, "other words stand here now", 3, None), (None, None, 4, "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, _key long, root string")
    got = drop_near_duplicates(df)
    assert got.columns == df.columns
    kept = {tuple(r) for r in got.collect()}
    assert kept <= set(rows) and len(kept) == 3 and rows[2] in kept and rows[3] in kept
