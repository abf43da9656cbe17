import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarryline.llm import q_repeats, repeats
from quarryline.llm.repeats import anchors, merge, remove_repeats, repeated_windows, shared_prefixes, suffix_order


def brute(texts, length):
    """(n_bytes, n_removed, n_spans, kept) of each text."""
    raw = [(t or "").encode() for t in texts]
    times = {}
    for r in raw:
        for q in range(len(r) - length + 1):
            times[r[q : q + length]] = times.get(r[q : q + length], 0) + 1
    out = []
    for r in raw:
        spans = merge([(q, q + length) for q in range(len(r) - length + 1) if times[r[q : q + length]] > 1])
        kept, at = b"", 0
        for a, b in spans:
            kept, at = kept + r[at:a], b
        kept += r[at:]
        out.append((len(r), len(r) - len(kept), len(spans), kept))
    return out


@pytest.mark.parametrize("seed", range(60))
def test_suffix_order(seed):
    rng = random.Random(seed)
    n, letters = rng.randint(1, 120), rng.choice([1, 2, 3, 30])
    text = [rng.randrange(letters) for _ in range(n)]
    if seed % 3 == 0:
        text = (text[: max(1, n // 5)] * 6)[:n]
    order = suffix_order(text)
    assert order == sorted(range(len(text)), key=lambda i: text[i:])
    for r, k in enumerate(shared_prefixes(text, order)):
        if r:
            a, b = text[order[r - 1] :], text[order[r] :]
            assert k == next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))


def test_anchors_own_all_windows_and_agree():
    rng = random.Random(4)
    shared = bytes(rng.randrange(97, 123) for _ in range(900))
    for data in (shared, b"a" * 1000, b"ab cd " * 200, bytes(rng.randrange(256) for _ in range(2000))):
        h, at, q0, q1 = anchors(data, 400)
        assert q0[0] == 0 and q1[-1] == len(data) - 400 and (q0[1:] == q1[:-1] + 1).all()
        assert ((at >= q0) & (at + repeats.GRAM <= q0 + 400)).all() and (q1 <= at).all()
    own = lambda d: {d[q : q + 400]: (int(x), int(p - q)) for x, p, a, b in zip(*anchors(d, 400), strict=True) for q in range(a, b + 1)}
    a, b = own(b"xyz" * 50 + shared + b"tail" * 40), own(b"other" * 77 + shared)
    assert all(a[w] == b[w] for w in a.keys() & b.keys()) and len(a.keys() & b.keys()) >= 501


def corpus(seed, docs=40):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passages = [prose(rng.randint(60, 160)) for _ in range(6)]
    out = [None, "", "short", "a" * 3000, "ab" * 700, "Der " * 300]
    for _ in range(docs):
        parts = [prose(rng.randint(5, 150))]
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            cut = rng.randint(0, len(p) // 2) if rng.random() < 0.5 else 0
            parts += [p[cut : len(p) - rng.randint(0, len(p) // 4)], prose(rng.randint(0, 20))]
        out.append(" ".join(parts))
    out += [out[10], out[11], out[11] + "x", out[12][:900], out[13] + out[13]]
    near = out[14] * 2
    for _ in range(6):
        k = rng.randrange(len(near))
        out.append(near[:k] + "Q" + near[k + 1 :])
    return out


@pytest.mark.parametrize(("seed", "length", "limit"), [(1, 400, 50_000), (2, 400, 50_000), (3, 400, 2), (4, 128, 50_000)])
def test_against_brute_force(spark, seed, length, limit):
    texts = corpus(seed)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3).withColumn("kept", F.lit("clash"))
    got = {r["doc_id"]: r for r in remove_repeats(df, length, limit).collect()}
    assert len(got) == len(texts)
    for i, want in enumerate(brute(texts, length)):
        r = got[i]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) == want, i
        assert r["kept_sha256"] == hashlib.sha256(want[3]).hexdigest()


def test_windows_at_run_ends():
    rng = np.random.default_rng(8)
    core = bytes(rng.integers(97, 123, 480, dtype=np.uint8))
    a, b, c = (bytes(rng.integers(97, 123, 150, dtype=np.uint8)) for _ in range(3))
    contexts = [a + core + b, b + core + c, c[:-9] + core[9:430] + a]
    offsets = [len(a) + 200, len(b) + 200, len(c) - 9 + 191]
    flags = repeated_windows(contexts, offsets, [False] * 3, 400)
    for k, ctx in enumerate(contexts):
        for q in range(len(ctx) - 399):
            w = ctx[q : q + 400]
            assert flags[k][q] == (sum(x.count(w) for x in contexts) > 1)


def test_null_ids_and_empty_table(spark):
    df = spark.createDataFrame([(None, "x" * 401), (None, None), (1, "y" * 399), (1, "y" * 399)], "doc_id long, text string")
    got = sorted((r["n_bytes"], r["n_removed"], r["n_spans"]) for r in remove_repeats(df).collect())
    assert got == [(0, 0, 0), (399, 0, 0), (399, 0, 0), (401, 401, 1)]
    assert remove_repeats(df.limit(0)).count() == 0


def test_columns_with_any_name_stay(spark):
    rows = [(1, "passage " * 80, "x", 1), (2, "other words, then " + "passage " * 80, None, 2), (3, None, "y", 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _key string, spans long").withColumn("s1", F.lit(7))
    out = remove_repeats(df)
    assert out.columns[:5] == df.columns
    assert {tuple(r)[:4] for r in out.collect()} == set(rows)


def brute_words(texts, length, words):
    """Kept bytes where strings of so many words go too."""
    raw = [(t or "").encode() for t in texts]
    times, at = {}, [[m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", r)] for r in raw]
    windows = [[(a, b) for a, b in [(q, q + length) for q in range(len(r) - length + 1)]] for r in raw]
    keyed = [[(r[a:b], a, b) for a, b in w] for r, w in zip(raw, windows, strict=True)]
    for r, p, k in zip(raw, at, keyed, strict=True):
        k += [(tuple(r[a:b] for a, b in p[i : i + words]), p[i][0], p[i + words - 1][1]) for i in range(len(p) - words + 1)]
        for key, _, _ in k:
            times[key] = times.get(key, 0) + 1
    out = []
    for r, k in zip(raw, keyed, strict=True):
        kept, at = b"", 0
        for a, b in merge([(a, b) for key, a, b in k if times[key] > 1]):
            kept, at = kept + r[at:a], b
        out.append(kept + r[at:])
    return out


@pytest.mark.parametrize(("seed", "words", "limit"), [(5, 51, 50_000), (6, 16, 50_000), (7, 30, 2)])
def test_words_against_brute_force(spark, seed, words, limit):
    texts = corpus(seed)
    rng = random.Random(seed)
    passage = [f"p{rng.randrange(999)}" for _ in range(words)]
    texts += ["x " + " ".join(passage) + " y", " z\n" + "\n\t".join(passage), "v " + " ".join(passage[1:]) + " w", " ".join(passage[:-1]) + "s t"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: bytes(r["kept"]) for r in remove_repeats(df, 400, limit, words=words).collect()}
    want = brute_words(texts, 400, words)
    assert want[-4:-2] == [b"x  y", " z\n".encode()] and want[-2] == texts[-2].encode()
    assert got == dict(enumerate(want))


def test_query_counts_by_bytes_and_text_lacks_passages_of_over_50_words(spark, tmp_path):
    passage = " ".join(f"w{i}" for i in range(51))
    assert len(passage) < 400
    texts = [*corpus(9, 12), f"one {passage} ends", f"another {passage} stops", f"third {passage[:-1]}", f"é {passage} " + "é" * 250, "é" * 250]
    spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in q_repeats.op9_repeats(spark, str(tmp_path)).collect()}
    assert len(got) == len(texts)
    for i, (want, left) in enumerate(zip(brute(texts, 400), brute_words(texts, 400, 51), strict=True)):
        r = got[i]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == (*want[:3], hashlib.sha256(want[3]).hexdigest()), i
        assert r["text"] == left.decode("utf-8", "ignore"), i
    assert [got[len(texts) - k]["text"] for k in (5, 4, 3, 2, 1)] == ["one  ends", "another  stops", texts[-3], "é  ", ""]
    assert got[len(texts) - 5]["n_removed"] == 0
