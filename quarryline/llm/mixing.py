"""Operator 1: mixing sources to target weights along a time-varying curriculum (DataFrame functions only).

A schedule gives every source a weight in each phase of training. The weights of a phase are shares of its length; their
integral over training is the share of all words that a source should give. Targets follow from the shares, stop at
``max_repeat`` times the source's size, and hand the excess to the others by weight. Within a source the documents stand in
a random but reproducible order; a word's place in that stream is inverted through the source's cumulative demand into a
training position between 0 and 1, and the documents are range-sorted by position.

Scale: documents are shuffled once, as narrow rows, by (source, bucket of the order key). The running size in a source is
the bucket's offset plus the running size in the bucket, so a source with a third of all rows spreads over ``4096`` buckets.
Only the table of sources (one row each) meets in a single window.

Defined results: null text counts as empty, a null source is a source of its own (last), empty documents take 0 words,
repeated rows are documents of their own, an empty table gives no rows, and extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarryline.llm.shared import fresh, materialize, row_key, text_or_empty

WORD = r"[^\x20\x09-\x0D]+"
#: Hex digits of the order key that name a bucket.
BUCKET_DIGITS = 3


def by_rank(cycle: int = 3) -> Column:
    """Weights 1, 2, .. cycle, repeating, over the sources in code point order."""
    return ((F.col("source_rank") - 1) % cycle + 1).cast("double")


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def sized(docs: DataFrame, *more: Column) -> DataFrame:
    """(doc_id, source, size, order_key) of every document, and more columns of it, written once."""
    text = text_or_empty()
    key = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.md5(text)))
    return docs.select("doc_id", F.col("source").cast("string").alias("source"), word_count(text).alias("size"), key.alias("order_key"), *more)


def source_targets(sizes: DataFrame, schedule: Sequence[tuple[float, Column]] | None = None, total_share: float = 1.0, max_repeat: int = 3) -> DataFrame:
    """One row per source: source_size, target, share (integrated) and its phases (start, demand before, share).

    ``sizes`` has source and source_size. ``schedule`` lists (end, weight) of the phases, ends rising to 1; a weight is a
    column over source, source_rank and source_size. Without it, weights are 1, 2, 3, repeating.
    """
    schedule = list(schedule or [(1.0, by_rank())])
    everything = Window.partitionBy()
    s = sizes.withColumn("source_rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    s = s.withColumn("total", F.sum("source_size").over(everything) * F.lit(float(total_share)))
    starts = [0.0, *(end for end, _ in schedule)]
    before = F.lit(0.0)
    phases = []
    for k, (end, weight) in enumerate(schedule):
        s = s.withColumn(f"w{k}", weight.cast("double"))
        s = s.withColumn(f"s{k}", F.coalesce(F.try_divide(F.col(f"w{k}"), F.sum(f"w{k}").over(everything)), F.lit(0.0)))
        phases.append(F.struct(F.lit(starts[k]).alias("start"), before.alias("before"), F.col(f"s{k}").alias("share")))
        before = before + F.col(f"s{k}") * (end - starts[k])
    s = s.withColumn("share", before).withColumn("phases", F.array(*phases)).withColumn("cap", (F.col("source_size") * max_repeat).cast("double"))
    # Sources reach their cap in the order of cap over share. The first that does not sets the level, the largest of its kind.
    order = Window.orderBy(F.when(F.col("share") > 0, F.col("cap") / F.col("share")).asc_nulls_last(), "source_rank")
    full_before = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("share").over(order.rowsBetween(0, Window.unboundedFollowing))
    s = s.withColumn("level", F.try_divide(F.col("total") - full_before, rest))
    s = s.withColumn("full", (F.col("share") > 0) & (F.col("cap") <= F.col("level") * F.col("share")))
    level = F.max(F.when(~F.col("full") & (F.col("share") > 0), F.col("level"))).over(everything)
    s = s.withColumn("target", F.when(F.col("full"), F.col("cap")).otherwise(F.coalesce(level, F.lit(0.0)) * F.col("share")))
    return s.select("source", "source_rank", "source_size", "target", "share", "phases")


def _position(offset: Column) -> Column:
    """The time by which the source's cumulative demand reaches offset words."""
    due = F.least(offset / F.col("target"), F.lit(1.0)) * F.col("share")
    phase = F.element_at(F.filter("phases", lambda p: (p["share"] > 0) & (p["before"] <= due)), -1)
    return phase["start"] + (due - phase["before"]) / phase["share"]


def mix_sources(docs: DataFrame, schedule: Sequence[tuple[float, Column]] | None = None, total_share: float = 1.0, max_repeat: int = 3, key: Column | None = None) -> DataFrame:
    """Plan the mix: one row per document with what the mix takes of it.

    Columns: doc_id, source, order_key, size, source_size, target, taken (words, repeats counted), copies (passes that take
    at least half of the document), positions (of those copies, rising), and row_key if a key
    of rows is given, which also orders rows of one doc_id and text. A pass over a source that the target doesn't
    fill ends inside a document, so the words taken of a source are its target to the word.
    """
    named = [] if key is None else ["row_key"]
    narrow = materialize(sized(docs, *(key.alias(n) for n in named)).withColumn("bucket", F.substring("order_key", 1, BUCKET_DIGITS)), "mix")
    buckets = narrow.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    before = F.sum("bucket_size").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    buckets = buckets.withColumn("bucket_start", F.coalesce(before, F.lit(0)))
    targets = source_targets(narrow.groupBy("source").agg(F.sum("size").alias("source_size")), schedule, total_share, max_repeat)
    plan = buckets.join(targets.withColumnRenamed("source", "src"), F.col("source").eqNullSafe(F.col("src"))).drop("src")
    plan = plan.withColumnsRenamed({"source": "src", "bucket": "b"})
    inside = Window.partitionBy("source", "bucket").orderBy("order_key", "doc_id", "size", *named).rowsBetween(Window.unboundedPreceding, -1)
    d = narrow.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    d = d.join(plan, (F.col("bucket") == F.col("b")) & F.col("source").eqNullSafe(F.col("src")))
    d = d.withColumn("start", F.col("bucket_start") + F.col("inside")).withColumn("goal", F.floor("target").cast("long"))
    whole = F.when(F.col("source_size") > 0, F.expr("goal div nullif(source_size, 0)")).otherwise(F.lit(0)).cast("long")
    d = d.withColumn("passes", whole).withColumn("rest", F.col("goal") - F.col("passes") * F.col("source_size"))
    part = F.greatest(F.lit(0), F.least(F.col("rest") - F.col("start"), F.col("size")))
    d = d.withColumn("taken", (F.col("passes") * F.col("size") + part).cast("long"))
    d = d.withColumn("copies", (F.col("passes") + (F.col("start") * 2 + F.col("size") < F.col("rest") * 2).cast("long")).cast("int"))
    starts = F.transform(F.sequence(F.lit(0), F.col("copies") - 1), lambda k: _position(k * F.col("source_size") + F.col("start")))
    d = d.withColumn("positions", F.when(F.col("copies") > 0, starts).otherwise(F.array().cast("array<double>")))
    return d.select("doc_id", "source", "order_key", "size", "source_size", "target", "taken", "copies", "positions", *named)


def training_order(docs: DataFrame, schedule: Sequence[tuple[float, Column]] | None = None, total_share: float = 1.0, max_repeat: int = 3) -> DataFrame:
    """The documents of the mix with all their columns, a row per copy, range-sorted by training position.

    Rows that agree in all columns are one row here with the positions of all of them, so that documents meet
    their positions in one shuffle; the sort is the other. Extra columns stay, whatever their names.
    """
    key, position = fresh(docs, "_key"), fresh(docs, "_position")
    mix = mix_sources(docs, schedule, total_share, max_repeat, key=row_key(docs))
    copies = mix.select(F.col("row_key").alias(key), F.explode("positions").alias(position))
    own = docs.withColumn(key, row_key(docs)).dropDuplicates([key])
    return own.join(copies, key).orderBy(position, key).select(*(F.col(f"`{c}`") for c in docs.columns))
