"""Spelling variants: words one edit apart, and the form that each rare spelling stands for.

Two words are near if one inserted, deleted or replaced code point makes one of the other. An edit touches at most two
bigrams of a word, and these are neighbours. All bigrams are ordered by how many places of the vocabulary hold them, rare
ones first, equal ones by themselves and by place; of its three rarest bigrams a word files itself under the first two, or
under all three if the first two are neighbours. Of two near words at least one filed bigram then outlives the edit in both,
at the same place or one further on. The edit is on one side of it, so all else of both words is equal: a bigram is filed
with its place, the length of the shorter word, and a hash of the word without a piece of PIECE code points on one side.
What meets is verified by its distance. Nothing is capped. Words of under LEAST_CHARS code points have too few bigrams for
one to outlive any edit: they keep their rows and have no near words.

Null texts and texts without words count as none; a null id counts as an empty one where a caller hashes it. Repeated rows
count as often as they stand there. Of near words with the same count the smaller in code-point order is the form. An empty
table gives an empty result. Only the columns named are read, so other columns can't clash.

Joins of tables that grow with the vocabulary are merge joins by hint: Spark judges a table by its file's bytes, from which explode
makes many times as many rows, and would send these to the driver to broadcast them.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarryline.llm.shared import materialize

#: Of three bigrams in a row an edit leaves one.
LEAST_CHARS = 4
#: Code points of a piece in which the edit may lie.
PIECE = 3
#: Bigrams that a broadcast table may hold; more of them (wide alphabets) are joined by a shuffle.
MOST_BROADCAST = 50_000


def lower_ascii(col: Column) -> Column:
    """A-Z in lower case, all else as it is."""
    return F.translate(col, string.ascii_uppercase, string.ascii_lowercase)


def rarest_bigrams(words: DataFrame) -> DataFrame:
    """(word, n) of words of at least LEAST_CHARS code points -> (word, n, places): where the two or three filed bigrams begin."""
    at = words.select("word", "n", F.explode(F.sequence(F.lit(1), F.length("word") - 1)).alias("place"))
    at = at.withColumn("gram", F.substring(F.col("word"), F.col("place"), F.lit(2)))
    order = materialize(at.groupBy("gram").agg(F.count("*").alias("places_of_gram")), "bigrams")
    ranked = at.join(order.hint("broadcast" if order.count() <= MOST_BROADCAST else "merge"), "gram")
    rare = ranked.groupBy("word").agg(F.max("n").alias("n"), F.slice(F.array_sort(F.collect_list(F.struct("places_of_gram", "gram", "place"))), 1, 3).alias("r"))
    places = F.transform("r", lambda x: x["place"])
    apart = F.abs(F.get(places, F.lit(0)) - F.get(places, F.lit(1))) > 1
    return rare.select("word", "n", F.when(apart, F.slice(places, 1, 2)).otherwise(places).alias("places"))


def _pieces(begin: Column, end: Column, place: Column, longer: int) -> Column:
    """Keys of the word without one piece of what lies between begin and end (of the shorter word), which may be nothing."""

    def key(a: Column) -> Column:
        after = F.least(a + PIECE, end + 1) + longer
        rest = F.substring(F.col("word"), after, F.length("word"))
        return F.xxhash64(F.length("word") - longer, place, a, F.substring(F.col("word"), F.lit(1), a - 1), rest)

    return F.transform(F.sequence(begin, F.greatest(begin, end), F.lit(PIECE)), key)


def _files(rare: DataFrame, longer: int) -> DataFrame:
    """A row for each key that a word is filed under, by its own length, or as the longer of two words."""
    none, size = F.array().cast("array<bigint>"), F.length("word")

    def keys(p: Column) -> Column:
        left, right = _pieces(F.lit(1), p - longer - 1, p - longer, longer), _pieces(p + 2, size - longer, p, longer)
        if not longer:
            return F.concat(left, right)
        return F.concat(F.when(p > 1, left).otherwise(none), F.when(p + 1 < size, right).otherwise(none))

    return rare.select("word", "n", F.lit(bool(longer)).alias("longer"), F.explode(F.flatten(F.transform("places", keys))).alias("key"))


def near_words(words: DataFrame) -> DataFrame:
    """Distinct (word, n) -> (word, n, other, other_n), one row for each pair of words one edit apart."""
    rare = materialize(rarest_bigrams(words.where(F.length("word") >= LEAST_CHARS)), "rare-bigrams")
    own = _files(rare, 0)
    others = own.unionByName(_files(rare, 1)).select("key", F.col("word").alias("other"), F.col("n").alias("other_n"), "longer")
    met = own.select("key", "word", "n").join(others.hint("merge"), "key").where("(longer or word < other) and levenshtein(word, other, 1) = 1")
    return met.groupBy("word", "other").agg(F.min("n").alias("n"), F.min("other_n").alias("other_n"))


def spelling_forms(words: DataFrame, ratio: int = 2) -> DataFrame:
    """Distinct (word, n) -> (word, n, n_near, form, form_n, root).

    A word's form is its near word of the largest n, where that is at least ratio (over 1) times its own; the root is what
    forms lead to at last.
    """
    if ratio <= 1:
        raise ValueError("a form must be used more often than the word, or forms could lead in circles")
    words = words.select("word", F.col("n").cast("long").alias("n"))
    near = materialize(near_words(words), "near-words")
    none = words.select("word", "n", F.lit(None).cast("string").alias("other"), F.lit(None).cast("long").alias("other_n"))
    both = none.unionByName(near).unionByName(near.select(F.col("other").alias("word"), F.col("other_n").alias("n"), F.col("word").alias("other"), F.col("n").alias("other_n")))
    best = F.min(F.when(F.col("other").isNotNull(), F.struct((-F.col("other_n")).alias("less"), "other")))
    grouped = both.groupBy("word").agg(F.max("n").alias("n"), F.count("other").alias("n_near"), best.alias("best"))
    leads = -F.col("best.less") >= ratio * F.col("n")
    formed = grouped.select("word", "n", "n_near", F.when(leads, F.col("best.other")).alias("form"), F.when(leads, -F.col("best.less")).alias("form_n"))
    formed = materialize(formed, "forms")
    roots = _roots(formed.where("form is not null").select("word", F.col("form").alias("root")))
    return formed.join(roots.hint("merge"), "word", "left").withColumn("root", F.coalesce("root", "word"))


def _roots(hops: DataFrame) -> DataFrame:
    """(word, root) with a hop each -> with the last word reached. Every round doubles the hops, until no word moves on."""
    hops = materialize(hops, "hops")
    while True:
        onward = hops.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = hops.join(onward.hint("merge"), "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        moved = materialize(moved, "hops")
        hops = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            return hops
