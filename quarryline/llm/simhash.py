"""Operator 2: SimHash near-duplicates by bit-sliced comparison.

Fingerprints are compared only where they can be near: 64 bits are cut into ``radius + 2`` bands, and two fingerprints that
differ in at most ``radius`` bits agree in at least two bands, so each is filed under every pair of bands. A file's rows
stand in bit planes, 64 fingerprints to a machine word; the distances of all rows to the rows d places further are counted
together by carry-save adders over the planes, and a block of words is left as soon as none of its lanes can be a link.

No pair list is made: a file gives each fingerprint's link to its component within that file, a forest. Files beyond
``block`` fingerprints are cut into blocks and every two blocks meet in a task of their own, so no file is too large for
one. Copies share a fingerprint and collapse before. Components follow by star rounds on the shared folder.

Defined results: null or empty text has fingerprint zero and links like any other; repeated rows and ties keep the smallest
doc_id as their component; null doc_ids are ignored for that minimum; an empty table gives no rows; extra columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarryline.llm.graph import connected_components
from quarryline.llm.shared import materialize, small_batches, tidy

SEED = 42
#: Fingerprints of one file that are compared in one task.
BLOCK = 16_384
#: Rows of files that are compared together: lanes of many small files fill the words.
TOGETHER = 60_000
ONES = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingle_hashes(text: str | None, shingle: int = 4) -> np.ndarray:
    """64-bit hashes of the word shingles as they stand; words are ASCII-lowered runs of non-space."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.zeros(0, dtype="<u8")
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    n = max(1, len(words) - shingle + 1)
    starts = [0, *(ends[: n - 1] + 1).tolist()]
    stops = ends[min(shingle, len(words)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(line[a:b], SEED) for a, b in zip(starts, stops, strict=True)], dtype="<u8")


def fold(h: np.ndarray) -> int:
    """64-bit SimHash of shingle hashes, as a signed integer."""
    if not len(h):
        return 0
    ones = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<i8")[0])


def fingerprint(text: str | None, shingle: int = 4) -> int:
    """64-bit SimHash of the word shingles, as a signed integer."""
    return fold(shingle_hashes(text, shingle))


def with_fingerprints(docs: DataFrame, shingle: int = 4, text_col: str = "text", out: str = "fp") -> DataFrame:
    small_batches(docs.sparkSession)

    @F.pandas_udf(T.LongType())
    def fp(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t, shingle) for t in texts], dtype="int64")

    return docs.withColumn(out, fp(F.col(text_col)))


def planes(fps: np.ndarray) -> np.ndarray:
    """(64, words) bit planes: bit i of plane b is bit b of fingerprint i."""
    n = -(-len(fps) // 64) * 64
    padded = np.zeros(n, dtype="<u8")
    padded[: len(fps)] = fps
    bits = np.unpackbits(padded.view(np.uint8).reshape(n, 8), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view("<u8")


def shifted(p: np.ndarray, d: int) -> np.ndarray:
    """The planes with lane i holding what was in lane i + d."""
    words, bits = divmod(d, 64)
    out = np.zeros_like(p)
    if words < p.shape[1]:
        out[:, : p.shape[1] - words] = p[:, words:] >> np.uint64(bits)
        if bits and words + 1 < p.shape[1]:
            out[:, : p.shape[1] - words - 1] |= p[:, words + 1 :] << np.uint64(64 - bits)
    return out


def within(a: np.ndarray, b: np.ndarray, active: np.ndarray, radius: int) -> np.ndarray:
    """Lanes, as a word mask, of a and b that differ in at most radius (under 8) bits and are active.

    Ones, twos and fours are the carry-save counter of each lane and ``over`` what has run past it. Two planes enter a full
    adder at once. After every eighth pair the words without a living lane are dropped.
    """
    found = np.zeros_like(active)
    at = np.flatnonzero(active)
    a, b, live = a[:, at], b[:, at], active[at]
    one, two, four, over = (np.zeros(len(at), dtype=np.uint64) for _ in range(4))
    limit = [ONES if radius >> k & 1 else np.uint64(0) for k in range(3)]

    def beyond():
        more, same = over, ~over
        for counter, bit in ((four, limit[2]), (two, limit[1]), (one, limit[0])):
            more = more | same & counter & ~bit
            same = same & ~(counter ^ bit)
        return more

    for k in range(0, 64, 2):
        x, y = a[k] ^ b[k], a[k + 1] ^ b[k + 1]
        half = one ^ x
        carry = (one & x) | (half & y)
        one = half ^ y
        into_four = two & carry
        two = two ^ carry
        over = over | (four & into_four)
        four = four ^ into_four
        if k % 16 == 14:
            alive = live & ~beyond()
            keep = np.flatnonzero(alive)
            if len(keep) == 0:
                return found
            if len(keep) < len(at):
                at, a, b, live = at[keep], a[:, keep], b[:, keep], alive[keep]
                one, two, four, over = one[keep], two[keep], four[keep], over[keep]
    found[at] = live & ~beyond()
    return found


def forest(group: np.ndarray, fps: np.ndarray, radius: int, side: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Rows sorted by group -> links (fingerprint, fingerprint) that join each group's components.

    With ``side`` (0 or 1), only rows of different sides are compared: the meeting of two blocks.
    """
    us, vs = [], []
    rows = np.arange(len(fps))
    roots = rows.copy()
    step, changed, p = 0, True, None
    while len(rows):
        step += 1
        g = group[rows]
        same = g[step:] == g[:-step] if step < len(rows) else np.zeros(0, dtype=bool)
        if not same.any():
            break
        pairs = same if side is None else same & (side[rows][step:] != side[rows][:-step])
        lanes = np.zeros(-(-len(rows) // 64) * 64, dtype=np.uint8)
        lanes[: len(pairs)] = pairs
        p = planes(fps[rows]) if changed else p
        hit = within(p, shifted(p, step), np.packbits(lanes, bitorder="little").view("<u8"), radius)
        left = np.flatnonzero(np.unpackbits(hit.view(np.uint8), bitorder="little"))
        for i in left[roots[rows[left]] != roots[rows[left + step]]].tolist():
            a, b = rows[i], rows[i + step]
            if roots[a] != roots[b]:
                us.append(fps[a])
                vs.append(fps[b])
                lo, hi = np.searchsorted(g, g[i]), np.searchsorted(g, g[i], "right")
                own = rows[lo:hi]
                roots[own[roots[own] == roots[b]]] = roots[a]
        # A group goes on while some of its rows have a partner further on and it isn't one component yet.
        first = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
        size = np.diff(np.r_[first, len(g)])
        r = roots[rows]
        joined = np.minimum.reduceat(r, first) == np.maximum.reduceat(r, first)
        stays = np.repeat((size > step + 1) & ~joined, size)
        changed = not stays.all()
        rows = rows[stays]
    return np.array(us, dtype="<u8"), np.array(vs, dtype="<u8")


def _link_files(batches: Iterator[pd.DataFrame], radius: int) -> Iterator[pd.DataFrame]:
    """Rows sorted by file, part: forests of the files; a file that a batch border cuts waits for the rest."""
    held: list[pd.DataFrame] = []

    def links(d: pd.DataFrame) -> pd.DataFrame:
        key = (d["file"].to_numpy("i8"), d["part"].to_numpy("i8"))
        change = np.r_[True, (key[0][1:] != key[0][:-1]) | (key[1][1:] != key[1][:-1])]
        group = np.cumsum(change)
        size = np.bincount(group)[group]
        keep = size > 1
        fps = d["fp"].to_numpy("i8").view("<u8")[keep]
        # A part below zero is one block against itself; else two blocks meet, as the rows' sides say.
        part, sides = key[1][keep], d["side"].to_numpy("i8")[keep]
        out = []
        for mask, side in ((part < 0, None), (part >= 0, sides[part >= 0])):
            if mask.any():
                out.append(forest(group[keep][mask], fps[mask], radius, side))
        u = np.concatenate([x[0] for x in out]) if out else np.zeros(0, "<u8")
        v = np.concatenate([x[1] for x in out]) if out else np.zeros(0, "<u8")
        return pd.DataFrame({"u": u.view("<i8"), "v": v.view("<i8")})

    size = 0
    for d in batches:
        if not len(d):
            continue
        held.append(d)
        size += len(d)
        if size < TOGETHER:
            continue
        whole = pd.concat(held, ignore_index=True)
        last = ((whole["file"] == whole["file"].iloc[-1]) & (whole["part"] == whole["part"].iloc[-1])).to_numpy()
        if last.all():
            continue
        yield links(whole[~last])
        held = [whole[last]]
        size = int(last.sum())
    if held:
        yield links(pd.concat(held, ignore_index=True))


def near_links(fps: DataFrame, radius: int = 4, block: int = BLOCK) -> DataFrame:
    """Distinct fingerprints (fp long) -> links (u, v) that join all fingerprints reachable within radius bits a step."""
    if not 0 <= radius <= 7:
        raise ValueError("radius must be 0 to 7")
    bands = radius + 2
    width = [64 // bands + (k < 64 % bands) for k in range(bands)]
    start = [sum(width[:k]) for k in range(bands)]
    fp = F.col("fp")

    def band(k: int):
        return F.shiftrightunsigned(fp, start[k]).bitwiseAND((1 << width[k]) - 1)

    files = [F.shiftleft(F.lit(t).cast("long"), 48).bitwiseOR(F.shiftleft(band(i), width[j])).bitwiseOR(band(j)) for t, (i, j) in enumerate(combinations(range(bands), 2))]
    filed = fps.select("fp", F.explode(F.array(*files)).alias("file"))
    large = filed.groupBy("file").count().where(F.col("count") > block).select("file", F.ceil(F.col("count") / block).cast("long").alias("blocks"))
    filed = filed.join(large, "file", "left").withColumn("own", F.when(F.col("blocks").isNotNull(), F.pmod(F.xxhash64("fp"), "blocks")))
    # Block i meets block j in part i * blocks + j; parts of one block alone, and whole files, are negative.
    meets = F.when(F.col("blocks").isNull(), F.array(F.struct(F.lit(-1).cast("long").alias("part"), F.lit(0).cast("long").alias("side")))).otherwise(
        F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda o: F.struct(
            F.when(o == F.col("own"), -1 - o).otherwise(F.least(o, F.col("own")) * F.col("blocks") + F.greatest(o, F.col("own"))).alias("part"),
            (F.col("own") > o).cast("long").alias("side"))))
    rows = filed.select("fp", "file", F.explode(meets).alias("m")).select("fp", "file", "m.part", "m.side")
    rows = rows.repartition("file", "part").sortWithinPartitions("file", "part", "fp")
    return rows.mapInPandas(tidy(lambda it: _link_files(it, radius)), "u long, v long").distinct()


def near_groups(docs: DataFrame, radius: int = 4, shingle: int = 4, block: int = BLOCK, text_col: str = "text") -> DataFrame:
    """(doc_id, fp, component_id) of every document."""
    small_batches(docs.sparkSession)
    own = materialize(with_fingerprints(docs.select("doc_id", F.col(text_col).cast("string").alias("text")), shingle).select("doc_id", "fp"), "simhash")
    fps = own.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    comps = connected_components(near_links(fps.select("fp"), radius, block))
    named = fps.join(comps.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    labels = named.join(least, "root").select(F.col("fp").alias("label_fp"), "component_id")
    return own.join(labels, F.col("fp") == F.col("label_fp")).select("doc_id", "fp", "component_id")
