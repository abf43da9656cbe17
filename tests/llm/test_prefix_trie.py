"""The trie against one built in memory."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

from pyspark.sql import functions as F

from quarryline.llm import prefix_trie as module
from quarryline.llm.prefix_trie import dense_names, named_blocks, ordered_turns, prefix_trie
from quarryline.llm.q_prefix_trie import rebuilt

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def key(role: str, text: str) -> bytes:
    return hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()


def brute_rebuilt(rows: list[tuple]) -> dict[int, tuple]:
    own: dict[int, list] = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, key(role or "", text or ""), role or "", text or ""))
    turns = {c: [x[3:] for x in sorted(t)] for c, t in own.items()}
    out = {}
    for c, t in turns.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (c % 20 if c >= 0 else -(-c % 20))
        out[c] = tuple(turns.get(base, [])[:h] + t[h:])
    return out


def brute_trie(convs: dict[int, tuple]) -> set[tuple]:
    members: dict[tuple, list[int]] = {}
    for c, s in convs.items():
        for d in range(len(s) + 1):
            members.setdefault(s[:d], []).append(c)
    children: dict[tuple, int] = {}
    for p in members:
        if p:
            children[p[:-1]] = children.get(p[:-1], 0) + 1
    leaves, saved = dict.fromkeys(members, 0), dict.fromkeys(members, 0)
    for p, cs in members.items():
        words = len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        for d in range(len(p) + 1):
            saved[p[:d]] += (len(cs) - 1) * words
            leaves[p[:d]] += p not in children
    ends = {p: ",".join(map(str, sorted(c for c in cs if len(convs[c]) == len(p)))) for p, cs in members.items()}
    return {(min(cs), len(p), min(members[p[:-1]]) if p else None, len(cs), children.get(p, 0), leaves[p], saved[p], hashlib.sha256(ends[p].encode()).hexdigest()) for p, cs in members.items()}


def nodes(df) -> set[tuple]:
    got = [tuple(r) for r in df.select(*COLUMNS).collect()]
    assert len(got) == len(set(got))
    return set(got)


def table(spark, rows):
    return spark.createDataFrame([(*r, r[0], "x") for r in rows], "conv_id long, turn long, role string, text string, node long, depth string")


def some(rng: random.Random) -> list[tuple]:
    rows = []
    for c in [*range(-25, 70), 10**12, 10**12 + 7]:
        rows += [(c, t, rng.choice(["user", "assistant", None]), rng.choice(["a b", "c", "", None, "a  b c"])) for t in range(rng.randint(1, 7))]
    rows += [(41, t % 5 if t % 3 else None, "user", rng.choice("xy")) for t in range(90)]  # ties, null turns
    rows += [(43, 1, "user", "same")] * 9 + [(None, 1, "user", "none"), (None, None, None, None)]
    rng.shuffle(rows)
    return rows


def test_rebuilt_conversations_equal_brute_force(spark):
    rows = some(random.Random(4))
    got = nodes(prefix_trie(*rebuilt(table(spark, rows))))
    assert got == brute_trie(brute_rebuilt(rows))


def test_long_copies_and_digests_of_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(module, "IDS_A_BLOCK", 7)
    long = [("user", f"t{k % 3}") for k in range(300)]
    convs = {c: tuple(long) if c < 40 else tuple(long[: c % 37]) for c in range(120)}
    turns = spark.createDataFrame([(c, k, key(*t), 1) for c, s in convs.items() for k, t in enumerate(s)], "conv_id long, place long, key binary, words long")
    ids = spark.createDataFrame([(c,) for c in convs], "conv_id long")
    assert nodes(prefix_trie(turns, ids)) == brute_trie(convs)


def test_block_names_tell_blocks_apart(spark):
    s = "abababcabab" * 3
    turns = spark.createDataFrame([(1, k, x.encode(), 1) for k, x in enumerate(s)], "conv_id long, place long, key binary, words long")
    names: dict[tuple, str] = {}
    for r in named_blocks(turns).collect():
        size = 2 ** r["power"]
        text = s[r["block"] * size : (r["block"] + 1) * size]
        assert len(text) == size and names.setdefault((r["power"], r["name"]), text) == text
    assert len(names) == sum(len({s[i : i + 2**p] for i in range(0, len(s) - 2**p + 1, 2**p)}) for p in range(6))
    got = sorted(r["name"] for r in dense_names(spark.range(500).select((F.col("id") % 77).alias("k")), ["k"]).collect())
    assert got == list(range(77))


def test_places_in_a_conversation_dealt_over_tasks(spark):
    rows = [(5, 999 - t, "user", str(t)) for t in range(1000)]
    got = ordered_turns(table(spark, rows)).collect()
    assert {r["place"]: bytes(r["key"]) for r in got} == {t: key("user", str(999 - t)) for t in range(1000)}


def test_empty_and_turnless(spark):
    assert nodes(prefix_trie(*rebuilt(table(spark, [])))) == set()
    assert nodes(prefix_trie(*rebuilt(table(spark, [(None, 1, "a", "b")])))) == set()
    h = next(c for c in range(1, 20) if zlib.crc32(str(c).encode()) % 4)
    rows = [(h, 1, "user", "gone")]
    assert nodes(prefix_trie(*rebuilt(table(spark, rows)))) == brute_trie({h: ()})
