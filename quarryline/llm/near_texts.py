"""Near copies by their texts: every two documents whose sets of word shingles have a Jaccard index of ``similarity`` or more.

SimHash alone can't tell them: at 0.8 fingerprints differ in some 10 bits of 64 and now and then in over 14, where unlike
texts stand too. So no pair is linked or given up by its fingerprint. Fingerprints that are near, and the least text of
each shared shingle, give first pairs, which join large groups at little cost. The other pairs come from a prefix of each
set: its shingles stand in one order for all sets, rare ones first, and two sets that are alike share one among the first
``n - similarity * n + 1`` of both. The order comes from counts over all texts, in a table of a fixed number of cells: any
order finds all pairs, rare ones first makes them few. Pairs whose parities of hash buckets differ too often go as they are
formed (an exact bound of how much two sets differ).
Every pair is compared by its texts before it is linked. Before that, pairs whose shingles fall into hash buckets so
unequally that they can't be alike go: what two sets share is at most the sum of the lesser counts of all buckets. Texts
don't stand in any table of the search; those of the pairs that are left are fetched from the documents by row key.

Defined results: null, empty and blank texts are copies of one another; texts of fewer words than a shingle are one shingle.
Of a group the row of the least doc_id stays, null last; of equal ids the one of the least hash of all columns, so reruns agree.
Extra columns stay, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryline.llm.graph import connected_components
from quarryline.llm.shared import fresh, materialize, row_key, small_batches, tidy
from quarryline.llm.simhash import BLOCK, SEED, fold, near_links, shingle_hashes

#: Cells that shingles of all texts are counted in, a byte each when they are broadcast; how many go in a piece of the table.
CELLS, PIECE = 1 << 24, 1 << 16
#: Steps of a byte for each doubling of a count, and the most that a partition counts.
STEPS, MOST = 8, (1 << 32) - 1
#: About so many hashes of a set to a bucket of its spread.
BUCKET_HASHES = 8
SLACK = 1e-9


def shingle_counts(docs: DataFrame, shingle: int, cells: int = CELLS) -> np.ndarray:
    """How often shingles fall into each cell, counted over all (text), as steps of a logarithm in a byte.

    Every partition sums its own table and gives it out in compressed pieces, which are added up as they arrive.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(cells, dtype="<u4")
        for d in batches:
            own = [cell_of(np.unique(shingle_hashes(t, shingle)), cells) for t in d["text"]]
            at, times = np.unique(np.concatenate([np.zeros(0, "<i8"), *own]), return_counts=True)
            total[at] = np.minimum(total[at] + times, MOST)
        for k, part in enumerate(total.reshape(-1, PIECE)):
            if part.any():
                yield pd.DataFrame({"piece": [k], "counts": [zlib.compress(part.tobytes(), 1)]})

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for d in batches:
            for k, packed in zip(d["piece"], d["counts"], strict=True):
                sums[k] = sums.get(k, 0) + np.frombuffer(zlib.decompress(packed), "<u4").astype("<i8")
        for k, total in sums.items():
            yield pd.DataFrame({"piece": [k], "counts": [np.minimum(np.rint(STEPS * np.log2(1 + total)), 255).astype(np.uint8).tobytes()]})

    parts = docs.select("text").mapInPandas(tidy(count), "piece int, counts binary").repartition("piece").mapInPandas(tidy(add), "piece int, counts binary")
    table = np.zeros(cells, dtype=np.uint8)
    for r in parts.collect():  # a byte a cell at most, whatever the corpus
        table[r["piece"] * PIECE :][:PIECE] = np.frombuffer(r["counts"], np.uint8)
    return table


def cell_of(h: np.ndarray, cells: int) -> np.ndarray:
    return (h & np.uint64(cells - 1)).astype("<i8")


def prefix(h: np.ndarray, counts: np.ndarray, similarity: float) -> np.ndarray:
    """Distinct hashes -> those of which a set that is alike must share one, in the order of all sets."""
    return h[np.lexsort((h, counts[cell_of(h, len(counts))]))][: len(h) - math.ceil(similarity * len(h) - SLACK) + 1]


def parities(h: np.ndarray) -> np.ndarray:
    """Four longs of bits that tell whether an odd number of the distinct hashes falls on them.

    Two sets differ in as many hashes at least as their parities differ in bits.
    """
    odd = np.bincount((h >> np.uint64(32) & np.uint64(255)).astype("<i8"), minlength=256) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def spread(h: np.ndarray) -> bytes:
    """How many of the distinct hashes fall into each of a power of two of buckets; empty if a count is too large to store."""
    bits = max(6, int(max(1, len(h) // BUCKET_HASHES)).bit_length())
    counts = np.bincount((h >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
    return counts.astype("<u2").tobytes() if counts.max(initial=0) < 1 << 16 else b""


def shared_at_most(a: bytes, b: bytes) -> float:
    """An upper bound of the hashes that two sets share."""
    x, y = (np.frombuffer(k, "<u2").astype(np.int64) for k in (a, b))
    if not len(x) or not len(y):
        return math.inf
    n = min(len(x), len(y))
    return float(np.minimum(x.reshape(n, -1).sum(axis=1), y.reshape(n, -1).sum(axis=1)).sum())


def with_sets(docs: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """Adds set_id (the same for equal sets), n (shingles), fp (SimHash), odd (parities), spread and prefix to rows with a text."""
    counts = docs.sparkSession.sparkContext.broadcast(shingle_counts(docs, shingle))

    @F.pandas_udf("set_id long, n int, fp long, odd array<long>, spread binary, prefix array<long>")
    def of(texts: pd.Series) -> pd.DataFrame:
        out = []
        for t in texts:
            all_h = shingle_hashes(t, shingle)
            h = np.unique(all_h)
            name = np.uint64(xxhash.xxh64_intdigest(h.tobytes(), SEED)).view("<i8")
            out.append((int(name), len(h), fold(all_h), parities(h), spread(h), prefix(h, counts.value, similarity).view("<i8")))
        return pd.DataFrame(out, columns=["set_id", "n", "fp", "odd", "spread", "prefix"])

    return docs.withColumn("_set", of("text")).select("*", "_set.*").drop("_set")


def alike(pairs: DataFrame, sets: DataFrame, docs: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """The pairs (u, v) of set_ids whose texts reach the similarity; materialized.

    ``sets``: set_id, n, spread and _key, the key of a row of ``docs`` (_key, text) that has the set.
    """

    @F.pandas_udf("boolean")
    def may_be(nu: pd.Series, nv: pd.Series, su: pd.Series, sv: pd.Series) -> pd.Series:
        both = np.array([shared_at_most(a, b) for a, b in zip(su, sv, strict=True)], float)
        return pd.Series(both >= similarity * (nu + nv).to_numpy() / (1 + similarity) - SLACK)

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in batches:
            known: dict[int, np.ndarray] = {}
            for i, t in (*zip(d["u"], d["u_text"], strict=True), *zip(d["v"], d["v_text"], strict=True)):
                if i not in known:
                    known[i] = np.unique(shingle_hashes(t, shingle))
            good = []
            for u, v in zip(d["u"], d["v"], strict=True):
                a, b = known[u], known[v]
                both = len(np.intersect1d(a, b, assume_unique=True))
                good.append(both >= similarity * (len(a) + len(b) - both) - SLACK)
            yield d.loc[np.array(good, dtype=bool), ["u", "v"]]

    sides = [sets.select(F.col("set_id").alias(k), F.col("n").alias(f"n{k}"), F.col("spread").alias(f"s{k}")) for k in "uv"]
    likely = materialize(pairs.join(sides[0], "u").join(sides[1], "v").where(may_be("nu", "nv", "su", "sv")).select("u", "v"), "near-likely")
    ids = likely.select(F.col("u").alias("set_id")).unionByName(likely.select(F.col("v").alias("set_id"))).distinct()
    wanted = sets.select("set_id", "_key").join(ids, "set_id")
    texts = materialize(docs.select("_key", "text").join(wanted, "_key").select("set_id", "text").dropDuplicates(["set_id"]), "near-texts")
    ends = [texts.select(F.col("set_id").alias(k), F.col("text").alias(f"{k}_text")) for k in "uv"]
    return materialize(likely.join(ends[1], "v").join(ends[0], "u").select("u", "v", "u_text", "v_text").mapInPandas(tidy(compare), "u long, v long"), "near-links")


def alike_components(sets: DataFrame, docs: DataFrame, similarity: float, radius: int, shingle: int, block: int = BLOCK) -> DataFrame:
    """One row a set (set_id, n, fp, odd, spread, prefix, _key) -> (node, root) of the sets that are linked; docs: _key, text."""

    def can(a: str, b: str):
        """Sizes and places allow the similarity; true at least at the first shingle that two alike sets share."""
        na, nb = F.col(f"{a}.n"), F.col(f"{b}.n")
        left = F.least(na - F.col(f"{a}.at"), nb - F.col(f"{b}.at"))
        return (F.least(na, nb) >= similarity * F.greatest(na, nb) - SLACK) & (left * (1 + similarity) >= similarity * (na + nb) - SLACK)

    def pair(a, b):
        return F.least(a, b).alias("u"), F.greatest(a, b).alias("v")

    # One shuffle by shingle serves the groups and their rows.
    rows = sets.select("set_id", "n", F.posexplode("prefix").alias("at", "h")).repartition("h")
    groups = rows.groupBy("h").agg(F.min(F.struct("set_id", "n", "at")).alias("least"), F.count("*").alias("sets")).where("sets > 1").drop("sets")
    shared = materialize(rows.join(groups, "h").select("h", F.struct("set_id", "n", "at").alias("own"), "least"), "near-shared")
    stars = shared.where(F.col("own.set_id") != F.col("least.set_id")).where(can("own", "least")).select(*pair(F.col("own.set_id"), F.col("least.set_id")))
    fps = sets.groupBy("fp").agg(F.min("set_id").alias("first"))
    same = sets.select("set_id", "fp").join(fps, "fp").where(F.col("set_id") != F.col("first")).select(*pair(F.col("set_id"), F.col("first")))
    ends = [fps.select(F.col("fp").alias(k), F.col("first").alias(f"{k}_set")) for k in "ab"]
    near = near_links(fps.select("fp"), radius, block).toDF("a", "b").join(ends[0], "a").join(ends[1], "b").select(*pair(F.col("a_set"), F.col("b_set")))
    tried = materialize(stars.unionByName(same).unionByName(near).distinct(), "near-tried")
    links = alike(tried, sets, docs, shingle, similarity)
    roots = connected_components(links)
    # What is left: pairs that share a shingle and aren't of one component yet.
    rooted = shared.select("h", "own").join(roots, F.col("own.set_id") == F.col("node"), "left").select("h", "own", F.coalesce("root", "own.set_id").alias("root"))
    open_groups = rooted.groupBy("h").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("h")
    odd = sets.select(F.col("set_id").alias("node"), *(F.col("odd")[k].alias(f"odd{k}") for k in range(4)))
    opened = rooted.join(open_groups, "h", "left_semi").join(odd, F.col("own.set_id") == F.col("node"))
    opened = materialize(opened.select("h", "own", "root", *(f"odd{k}" for k in range(4))), "near-open")
    x, y = (opened.select("h", F.col("own").alias(k), *(F.col(c).alias(f"{k}_{c}") for c in opened.columns[2:])) for k in "xy")
    differ = sum(F.bit_count(F.col(f"x_odd{k}").bitwiseXOR(F.col(f"y_odd{k}"))) for k in range(4))
    near_enough = differ * (1 + similarity) <= (1 - similarity) * (F.col("x.n") + F.col("y.n")) + SLACK
    rest = x.join(y, "h").where((F.col("x_root") != F.col("y_root")) & (F.col("x.set_id") < F.col("y.set_id"))).where(can("x", "y") & near_enough)
    rest = rest.select(F.col("x.set_id").alias("u"), F.col("y.set_id").alias("v")).distinct().join(tried, ["u", "v"], "left_anti")
    return connected_components(links.unionByName(alike(rest, sets, docs, shingle, similarity)))


def alike_groups(docs: DataFrame, similarity: float, radius: int = 7, shingle: int = 5, block: int = BLOCK) -> DataFrame:
    """Adds root, the same number for all rows of a group of near copies, to rows of doc_id, text and _key (by row, of any type)."""
    small_batches(docs.sparkSession)
    docs = docs.withColumn("text", F.col("text").cast("string"))
    own = materialize(with_sets(docs, shingle, similarity).drop("text"), "near-own")
    sets = own.select("set_id", "n", "fp", "odd", "spread", "prefix", "_key").dropDuplicates(["set_id"])
    roots = alike_components(sets, docs, similarity, radius, shingle, block)
    return own.drop("n", "fp", "odd", "spread", "prefix").join(roots, F.col("set_id") == F.col("node"), "left").withColumn("root", F.coalesce("root", "set_id")).drop("node", "set_id")


def drop_near_duplicates(docs: DataFrame, similarity: float = 0.8, radius: int = 7, shingle: int = 5, block: int = BLOCK) -> DataFrame:
    """One row of each group stays: that of the least doc_id, null last; of the same id, the least by hash of its columns."""
    key = fresh(docs, "_key")
    keyed = docs.withColumn(key, row_key(docs))
    groups = alike_groups(keyed.select("doc_id", "text", F.col(key).alias("_key")), similarity, radius, shingle, block)
    least = groups.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "_key")).alias("least"))
    return keyed.dropDuplicates([key]).join(least.select(F.col("least._key").alias(key)), key, "left_semi").select(*(F.col(f"`{c}`") for c in docs.columns))
