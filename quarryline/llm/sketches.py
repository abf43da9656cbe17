"""Operator 3: document fingerprints as invertible Bloom lookup sketches (DataFrame functions only).

A text's paragraphs (its lines that hold more than white space, as a set) become 64-bit digests. Each digest is added to
one cell in each of four tables: cells count, and XOR the digests and their checksums. The sketches of two versions
subtract cell by cell, which cancels what they share; then peeling finds a cell with a single digest, takes that digest out
of its other cells, and so on, until the cells are empty and the differing digests are known. Where it gets stuck, it tries
again on a sketch of four times as many blocks, with other places. With d differing digests of sets of sizes m and n, the
likeness is (m + n - d) / (m + n + d), the sets' Jaccard index; of two empty sets it is 1.

``with_next`` gives each document its successor in descending doc_id order without a global sort: documents fall into
buckets by quantiles of doc_id, each bucket is ordered by itself, and the first document of the next bucket, one a bucket,
joins it as a sentinel. Texts are shuffled once.

Defined results: null text is empty; null doc_ids come last; equal doc_ids are ordered by text, so repeated rows follow
each other; a single document is its own next; an empty table gives no rows; extra columns stay.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TABLES, WIDTH = 4, 8
CELLS = TABLES * WIDTH
#: Documents of a bucket, about, and buckets at most.
BUCKET_DOCS, MOST_BUCKETS = 4000, 16_384


def digests(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n"), lambda p: p.rlike(r"\S"))
    return F.array_distinct(F.transform(lines, lambda p: F.xxhash64(p)))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value worked out once: it is bound as the element of a one-element array."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _placed(keys: Column, salt: Column) -> Column:
    """Digests with their hash: places from its low bits, the checksum from its high ones."""
    return F.transform(keys, lambda k: F.struct(k.alias("k"), F.xxhash64(k, salt).alias("h")))


def _hits(h: Column, cell: Column) -> Column:
    """Whether a digest of this hash has its place in the cell: three bits of the hash for each table."""
    place = F.call_function("shiftrightunsigned", h, F.shiftright(cell, 3) * 3)
    return place.bitwiseAND(WIDTH - 1) == cell.bitwiseAND(WIDTH - 1)


def cells_of(keys: Column, salt: Column) -> Column:
    """The sketch of a set of digests: array of (count, XOR of digests, XOR of checksums)."""
    empty = F.struct(F.lit(0).alias("n"), F.lit(0).cast("long").alias("k"), F.lit(0).cast("long").alias("c"))

    def add(s: Column, x: Column) -> Column:
        return F.struct((s["n"] + 1).alias("n"), s["k"].bitwiseXOR(x["k"]).alias("k"), s["c"].bitwiseXOR(F.shiftrightunsigned(x["h"], 32)).alias("c"))

    every = F.lit(list(range(CELLS)))
    return let(_placed(keys, salt), lambda placed: F.transform(every, lambda cell: F.aggregate(F.filter(placed, lambda x: _hits(x["h"], cell)), empty, add)))


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: F.struct((x["n"] - y["n"]).alias("n"), x["k"].bitwiseXOR(y["k"]).alias("k"), x["c"].bitwiseXOR(y["c"]).alias("c")))


def peel(cells: Column, salt: Column, most: Column) -> Column:
    """struct(found, whole): digests recovered from a difference of sketches, and whether that emptied it.

    ``most``: digests that it may hold at most, which bounds the steps.
    """

    def step(s: Column, _: Column) -> Column:
        pure = F.get(F.filter(s["cells"], lambda x: F.when(F.abs(x["n"]) == 1, F.shiftrightunsigned(F.xxhash64(x["k"], salt), 32) == x["c"]).otherwise(F.lit(False))), F.lit(0))
        stuck = F.struct(s["cells"].alias("cells"), s["found"].alias("found"), F.lit(False).alias("go"))

        def taken(p: Column) -> Column:
            def without(x: Column, i: Column) -> Column:
                less = F.struct((x["n"] - p["n"]).alias("n"), x["k"].bitwiseXOR(p["k"]).alias("k"), x["c"].bitwiseXOR(p["c"]).alias("c"))
                return F.when(_hits(p["h"], i), less).otherwise(x)

            return F.struct(F.transform(s["cells"], without).alias("cells"), (s["found"] + 1).alias("found"), F.lit(True).alias("go"))

        def tried(p: Column) -> Column:
            return F.when(p["n"].isNull(), stuck).otherwise(taken(p))

        hashed = let(pure, lambda x: F.struct(x["n"].alias("n"), x["k"].alias("k"), x["c"].alias("c"), F.xxhash64(x["k"], salt).alias("h")))
        return F.when(s["go"], let(hashed, tried)).otherwise(s)

    start = F.struct(cells.alias("cells"), F.lit(0).alias("found"), F.lit(True).alias("go"))
    steps = F.sequence(F.lit(0), F.least(most, F.lit(2 * CELLS)))
    return F.aggregate(steps, start, step, lambda s: F.struct(s["found"].alias("found"), (~F.exists(s["cells"], lambda x: (x["n"] != 0) | (x["k"] != 0))).alias("whole")))


def difference(a: Column, b: Column, cells_a: Column, cells_b: Column) -> Column:
    """How many digests differ between two sets, by their sketches, larger ones where a size fails."""
    first = peel(subtract(cells_a, cells_b), F.lit(1), F.size(a) + F.size(b))
    nothing = F.struct(F.lit(0).alias("found"), F.lit(False).alias("whole"))

    def larger(s: Column, blocks: Column) -> Column:
        def block(t: Column, i: Column) -> Column:
            def part(keys: Column) -> Column:
                return F.filter(keys, lambda k: F.pmod(F.shiftright(F.xxhash64(k, blocks, F.lit(5)), 7), blocks) == i)

            got = let(F.struct(part(a).alias("a"), part(b).alias("b")), lambda p: peel(subtract(cells_of(p["a"], blocks), cells_of(p["b"], blocks)), blocks, F.size(p["a"]) + F.size(p["b"])))
            added = let(got, lambda g: F.struct((t["found"] + g["found"]).alias("found"), g["whole"].alias("whole")))
            return F.when(t["whole"], added).otherwise(t)

        whole = F.aggregate(F.sequence(F.lit(0), blocks - 1), F.struct(F.lit(0).alias("found"), F.lit(True).alias("whole")), block)
        return F.when(s["whole"], s).otherwise(whole)

    # From blocks of some 48 digests up to far more blocks than digests.
    need = F.size(a) + F.size(b)
    sizes = F.filter(F.lit([4**k for k in range(1, 12)]), lambda g: (g * 48 >= need) & (g <= 32 * need + 64))
    # No size worked (two digests with one hash): the sets themselves tell.
    exact = F.size(F.array_except(a, b)) + F.size(F.array_except(b, a))
    retried = let(F.aggregate(sizes, nothing, larger), lambda g: F.when(g["whole"], g["found"]).otherwise(exact))
    return let(first, lambda f: F.when(f["whole"], f["found"]).otherwise(retried))


def likeness(a: Column, b: Column, cells_a: Column, cells_b: Column) -> Column:
    total = F.size(a) + F.size(b)
    return let(difference(a, b, cells_a, cells_b), lambda d: F.when(total == 0, F.lit(1.0)).otherwise((total - d).cast("double") / (total + d)))


def text_of(keys: Column, cells: Column) -> Column:
    """The sketch as text: the set's size, then count, digests and checksums of each cell in hexadecimal."""
    return F.concat(F.size(keys).cast("string"), F.lit(":"), F.array_join(F.transform(cells, lambda c: F.concat(F.hex(c["n"]), F.lit("."), F.hex(c["k"]), F.lit("."), F.hex(c["c"]))), ";"))


def add_sketch(df: DataFrame, text: str, keys: str, cells: str) -> DataFrame:
    return df.withColumn(keys, digests(F.col(text))).withColumn(cells, cells_of(F.col(keys), F.lit(1)))


def with_next(docs: DataFrame, bucket_docs: int = BUCKET_DOCS) -> DataFrame:
    """Add next_text, the text of the next document in descending doc_id order; after the last comes the first."""
    d = docs.withColumn("text", F.coalesce(F.col("text").cast("string"), F.lit("")))
    n = d.agg(F.count("doc_id")).first()[0]
    buckets = min(MOST_BUCKETS, max(1, n // bucket_docs))
    bounds = []
    if buckets > 1:
        at = [k / buckets for k in range(1, buckets)]
        bounds = sorted(set(d.agg(F.percentile_approx("doc_id", F.lit(at), F.lit(10 * buckets))).first()[0]))
    # Buckets count downwards; rows without an id have the last. Two levels of bounds keep the search short.
    i = F.col("doc_id")
    chunk = max(1, round(len(bounds) ** 0.5))
    chunks = [bounds[k : k + chunk] for k in range(0, len(bounds), chunk)]
    below = F.lit(0)
    if chunks:
        ahead = F.size(F.filter(F.lit([c[0] for c in chunks]), lambda b: b <= i))
        inside = F.get(F.lit([c + [2**63 - 1] * (chunk - len(c)) for c in chunks]), F.greatest(ahead - 1, F.lit(0)))
        below = (F.greatest(ahead - 1, F.lit(0)) * chunk + F.size(F.filter(inside, lambda b: b <= i))).cast("int")
    d = d.withColumn("_bucket", F.when(i.isNull(), len(bounds) + 1).otherwise(len(bounds) - below).cast("int"))
    heads = d.groupBy("_bucket").agg(F.min(F.struct((-i).alias("o"), "text")).alias("head"))
    order = Window.orderBy("_bucket")
    previous = F.coalesce(F.lag("_bucket").over(order), F.last("_bucket").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    sentinels = heads.select(previous.alias("_bucket"), F.col("head.text").alias("text"), F.lit(1).alias("_sentinel"))
    rows = d.withColumn("_sentinel", F.lit(0)).unionByName(sentinels, allowMissingColumns=True)
    inside = Window.partitionBy("_bucket").orderBy("_sentinel", i.desc_nulls_last(), "text")
    return rows.withColumn("next_text", F.lead("text").over(inside)).where("_sentinel = 0").drop("_sentinel", "_bucket")


def fingerprint_edits(docs: DataFrame, bucket_docs: int = BUCKET_DOCS) -> DataFrame:
    """Sketches of each text, of its edited text (the last half replaced by the next document's first code points), and their likeness."""
    d = with_next(docs, bucket_docs).withColumn("n_chars", F.length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    d = d.withColumn("edited", F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - half), F.substring("next_text", F.lit(1), half)))
    for text, k in (("text", "a"), ("edited", "e"), ("next_text", "x")):
        d = add_sketch(d, text, f"keys_{k}", f"cells_{k}")
    a, e, x = ((F.col(f"keys_{k}"), F.col(f"cells_{k}")) for k in "aex")
    others = F.array(*[F.struct(keys.alias("keys"), cells.alias("cells")) for keys, cells in (e, x)])
    d = d.withColumn("_near", F.transform(others, lambda o: likeness(a[0], o["keys"], a[1], o["cells"])))
    return d.withColumns({
        "edited_sha256": F.sha2(F.col("edited").cast("binary"), 256),
        "fingerprint": text_of(*a), "edited_fingerprint": text_of(*e),
        "near_edited": F.get("_near", F.lit(0)), "near_next": F.get("_near", F.lit(1)),
    }).drop("_near", "edited", "next_text", *[f"{n}_{k}" for n in ("keys", "cells") for k in "aex"])
