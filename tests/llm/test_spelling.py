"""Spelling variants against every pair of words."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import pytest

from quarryline.llm.q_spelling import counted_words
from quarryline.llm.spelling import near_words, spelling_forms


def near(a: str, b: str) -> bool:
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(a) + 1 == len(b) and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_forms(counts: dict[str, int], ratio: int = 2) -> set[tuple]:
    out, forms = [], {}
    for w, n in counts.items():
        others = [v for v in counts if near(w, v) and min(len(v), len(w)) >= 4]
        best = min(others, key=lambda v: (-counts[v], v), default=None)
        forms[w] = best if best is not None and counts[best] >= ratio * n else None
        out.append((w, n, len(others)))

    def root(w: str) -> str:
        while forms[w] is not None:
            w = forms[w]
        return w

    return {(w, n, k, forms[w], forms[w] and counts[forms[w]], root(w)) for w, n, k in out}


def rows(df) -> set[tuple]:
    got = [tuple(r) for r in df.select("word", "n", "n_near", "form", "form_n", "root").collect()]
    assert len(got) == len(set(got))
    return set(got)


@pytest.mark.parametrize("letters,longest", [("ab", 7), ("aab", 12), ("abcdé", 6), ("a😀b", 6)])
def test_forms_equal_all_pairs(spark, letters, longest):
    rng = random.Random(letters)
    counts = {"".join(rng.choice(letters) for _ in range(rng.randint(3, longest))): 0 for _ in range(250)}
    counts = {w: rng.choice([1, 2, 3, 6, 12, 50]) for w in counts}
    got = rows(spelling_forms(spark.createDataFrame(list(counts.items()), "word string, n long")))
    assert got == brute_forms(counts)


def test_long_words_and_chains(spark):
    base = "x" * 400
    counts = {base: 1, base[:-1]: 3, base[:-1] + "y": 9, "z" + base[:-1] + "y": 40, "lonely": 5, "q": 9}
    got = rows(spelling_forms(spark.createDataFrame(list(counts.items()), "word string, n long")))
    assert got == brute_forms(counts)
    assert {r[5] for r in got} == {"z" + base[:-1] + "y", "lonely", "q"}


def test_one_very_common_bigram(spark):
    rng = random.Random(5)
    words = {"th" * 3 + "".join(rng.choice("eai") for _ in range(5)) for _ in range(150)}
    pairs = {(r["word"], r["other"]) for r in near_words(spark.createDataFrame([(w, 1) for w in words], "word string, n long")).collect()}
    assert {tuple(sorted(p)) for p in pairs} == {(a, b) for a in words for b in words if a < b and near(a, b)}


def test_counts_of_edited_runs(spark):
    docs = [(1, "Thing thing, THING\x00Éthing éthing " * 60, "a"), (2, None, "b"), (3, "", "c"), (None, "thing " * 40, "d"), (1, "Thing thing", "e"), (5, "four ab " * 9, "f")]
    df = spark.createDataFrame([(a, b, c, "w", 1) for a, b, c in docs], "doc_id long, text string, word string, run string, n int")
    counts = Counter()
    for i, text, _ in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            low = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{low}".encode())
            counts[low[: h % len(low)] + low[h % len(low) + 1 :] if h % 97 == 0 else low] += 1
    assert {(r["word"], r["n"]) for r in counted_words(df).collect()} == {(w, n) for w, n in counts.items() if len(w) >= 5 and n >= 3}
    assert counted_words(df.limit(0)).count() == 0


def test_empty_table_and_ratio(spark):
    none = spark.createDataFrame([], "word string, n long")
    assert spelling_forms(none).count() == 0
    with pytest.raises(ValueError):
        spelling_forms(none, ratio=1)


def test_filed_words_are_not_broadcast(spark):
    words = spark.createDataFrame([(w, 3) for w in ("letter", "lettre", "better", "letters")], "word string, n long")
    assert int(spark.conf.get("spark.sql.autoBroadcastJoinThreshold").rstrip("b")) >= 10 << 20
    for df in (near_words(words), spelling_forms(words)):
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
