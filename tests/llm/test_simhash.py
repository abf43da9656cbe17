from itertools import combinations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quarryline.llm.simhash import fingerprint, forest, near_groups, planes, shifted, within


def brute_fp(text):
    w = (text or "").encode().lower().split()
    sh = [b" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    hs = [xxhash.xxh64_intdigest(x, 42) for x in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)) if hs else 0


def brute_components(fps, radius=4):
    fps = sorted(set(fps))
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(fps, 2):
        if (a ^ b).bit_count() <= radius:
            root[find(a)] = find(b)
    return {f: find(f) for f in fps}


def clusters(rng, centres=12, members=40, noise=60):
    out = [int(x) for x in rng.integers(0, 2**63, noise)]
    for c in rng.integers(0, 2**63, centres):
        for _ in range(members):
            x = int(c)
            for b in rng.integers(0, 64, rng.integers(0, 6)):
                x ^= 1 << int(b)
            out.append(x)
    return out


@pytest.mark.parametrize("text", ["", None, "One", "a b c", "A b C d", "é b\tc\nd e f A b c d", "x " * 500, " a b c"])
def test_fingerprint_is_the_contracts(text):
    assert fingerprint(text) & (2**64 - 1) == brute_fp(text)


def test_planes_shift_and_distance():
    rng = np.random.default_rng(1)
    fps = np.array(clusters(rng, 3, 50, 10), dtype="<u8")
    p = planes(fps)
    for d in (1, 5, 63, 64, 65, 130):
        lanes = np.zeros(p.shape[1] * 64, dtype=np.uint8)
        lanes[: len(fps) - d] = 1
        for r in (0, 1, 3, 4, 5, 7):
            hit = np.unpackbits(within(p, shifted(p, d), np.packbits(lanes, bitorder="little").view("<u8"), r).view(np.uint8), bitorder="little")
            want = [int((int(a) ^ int(b)).bit_count() <= r) for a, b in zip(fps, fps[d:], strict=False)]
            assert hit[: len(want)].tolist() == want and not hit[len(want) :].any()


def test_forest_joins_as_brute_force():
    fps = sorted(set(clusters(np.random.default_rng(2))))
    u, v = forest(np.zeros(len(fps), dtype=int), np.array(fps, dtype="<u8"), 4)
    want = brute_components(fps)
    assert len(u) == len(fps) - len(set(want.values()))
    assert all(want[int(a)] == want[int(b)] for a, b in zip(u, v, strict=True))


@pytest.mark.parametrize("block", [10_000, 7])
def test_links_with_and_without_blocks(spark, block):
    from quarryline.llm.graph import connected_components
    from quarryline.llm.simhash import near_links

    fps = clusters(np.random.default_rng(3))
    signed = [(f - 2**64 if f >= 2**63 else f,) for f in set(fps)]
    rows = connected_components(near_links(spark.createDataFrame(signed, "fp long"), 4, block)).collect()
    want = brute_components(fps)
    groups = {}
    for f, r in want.items():
        groups.setdefault(r, set()).add(f)
    got = {}
    for r in rows:
        got.setdefault(r["root"], set()).add(r["node"] & (2**64 - 1))
    assert sorted(map(sorted, got.values())) == sorted(sorted(g) for g in groups.values() if len(g) > 1)


def test_documents_edge_cases(spark):
    long = " ".join(f"w{i}" for i in range(3000))
    rows = [(5, long), (3, long), (9, long + " tail"), (1, None), (2, ""), (2, ""), (None, "x y"), (4, "y z q"), (7, long.upper())]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit("clash")).withColumn("component_id", F.lit(0))
    got = sorted(map(tuple, near_groups(df).select("doc_id", "fp", "component_id").collect()), key=str)
    by = {f - 2**64 if f >= 2**63 else f: r for f, r in brute_components([brute_fp(t) for _, t in rows]).items()}
    least = {}
    for i, t in rows:
        r = by[fingerprint(t)]
        least[r] = min([x for x in (least.get(r), i) if x is not None], default=None)
    assert got == sorted(((i, fingerprint(t), least[by[fingerprint(t)]]) for i, t in rows), key=str)
    assert near_groups(df.limit(0)).count() == 0
