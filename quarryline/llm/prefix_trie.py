"""Prefix trie of conversations: which turns they begin with in common.

Prefix-doubling naming. Every distinct turn gets a dense name; blocks of two, four, eight turns, at places that are multiples
of their length, get the dense name of the pair of names of their halves, one round a power of two. A prefix of d turns is cut
into blocks by the binary digits of d: its name is composed of the name of the prefix without its last block and that block's
name, in rounds by the number of digits set. The name of a prefix is the smallest conversation that has it, so grouping by
depth and name gives the nodes. Sums over subtrees go to ancestors at a distance of 1, 2, 4 and so on. All rounds are joins
and groupings of as many rows as there are turns; none holds a conversation or a node's members whole. (The digest of a node's
conversations is one sequence by its definition: beyond one block of ids it streams through one task, a block at a time.)

Rows without conv_id belong to no conversation and are left out. A null role or text counts as empty, null turns come first, equal
turns are ordered by their SHA-256, repeated rows are turns of their own. Turns are told apart by SHA-256 of role and text. An empty table gives no node.
Only the columns named are read, so other columns can't clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarryline.llm.shared import materialize

#: Distinct things that are numbered in one window, and the least number of such windows.
NUMBERED_AT_ONCE, LEAST_BUCKETS = 100_000, 32
#: Conversation ids, whether used or not, that one block of a digest covers.
IDS_A_BLOCK = 4096


def turn_key(role: Column, text: Column) -> Column:
    """SHA-256 of a turn; the length of the role tells it from the text."""
    return F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256))


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) -> (conv_id, place from 0, key, words of the text).

    Turns are dealt by ranges of conversation, turn and key; a turn's place is its rank in its range and what the ranges before
    hold of the conversation, so a conversation of any length spreads over tasks.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    words = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    turns = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", turn_key(role, text).alias("key"), words.alias("words"))
    dealt = materialize(turns, "turns").repartitionByRange("conv_id", "turn", "key")
    dealt = materialize(dealt.withColumn("part", F.spark_partition_id()), "turns-dealt")
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = dealt.groupBy("conv_id", "part").agg(F.count("*").alias("here")).select("conv_id", "part", F.coalesce(F.sum("here").over(before), F.lit(0)).alias("before"))
    rank = F.row_number().over(Window.partitionBy("conv_id", "part").orderBy(F.col("turn").asc_nulls_first(), "key")) - 1
    ranked = dealt.withColumn("rank", rank).join(parts, ["conv_id", "part"])
    return materialize(ranked.select("conv_id", (F.col("before") + F.col("rank")).cast("long").alias("place"), "key", "words"), "turns-placed")


def dense_names(things: DataFrame, cols: list[str]) -> DataFrame:
    """Distinct values of cols -> the same with name: numbers from 0 without gaps, dealt out by buckets of a hash."""
    things = materialize(things.select(*cols).distinct(), "things")
    buckets = max(LEAST_BUCKETS, things.count() // NUMBERED_AT_ONCE)
    things = things.withColumn("bucket", F.pmod(F.xxhash64(*cols), F.lit(buckets)))
    sizes = things.groupBy("bucket").agg(F.count("*").alias("size"))
    # One row a bucket.
    first = sizes.select("bucket", F.coalesce(F.sum("size").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("first"))
    number = F.row_number().over(Window.partitionBy("bucket").orderBy(*cols)) - 1
    return things.withColumn("number", number).join(F.broadcast(first) if buckets <= NUMBERED_AT_ONCE else first, "bucket").select(*cols, (F.col("first") + F.col("number")).alias("name"))


def named_blocks(turns: DataFrame) -> DataFrame:
    """(conv_id, place, key) -> (conv_id, power, block, name): the turns from block * 2^power on, for every power that fits."""
    now = materialize(turns.join(dense_names(turns, ["key"]), "key").select("conv_id", F.col("place").alias("block"), "name"), "blocks-0")
    out, power = now.withColumn("power", F.lit(0)), 0
    while True:
        power += 1
        half = F.col("block") % 2
        both = now.groupBy("conv_id", F.floor(F.col("block") / 2).alias("block")).agg(F.max(F.when(half == 0, F.col("name"))).alias("a"), F.max(F.when(half == 1, F.col("name"))).alias("b"))
        pairs = materialize(both.where("a is not null and b is not null"), f"pairs-{power}")
        if pairs.isEmpty():
            return out.select("conv_id", "power", "block", "name")
        now = materialize(pairs.join(dense_names(pairs, ["a", "b"]), ["a", "b"]).select("conv_id", "block", "name"), f"blocks-{power}")
        out = out.unionByName(now.withColumn("power", F.lit(power)))


def named_prefixes(turns: DataFrame) -> DataFrame:
    """(conv_id, place, key, words) -> (conv_id, depth from 1, node, words): node is the smallest conversation with that prefix."""
    low = F.col("depth").bitwiseAND(-F.col("depth"))
    rows = turns.select("conv_id", (F.col("place") + 1).alias("depth"), "words").select("*", (F.col("depth") - low).alias("rest"), F.round(F.log2(low)).cast("int").alias("power"), F.bit_count("depth").alias("digits"))
    rows = rows.withColumn("block", F.expr("shiftright(rest, power)"))
    rows = materialize(rows.join(named_blocks(turns), ["conv_id", "power", "block"]).select("conv_id", "depth", "rest", "digits", "name", "words"), "prefixes")
    most = rows.agg(F.max("digits")).first()[0] or 0
    done = None
    for digits in range(1, most + 1):
        now = rows.where(F.col("digits") == digits)
        if done is None:
            now = now.withColumn("before", F.lit(0).cast("long"))
        else:
            now = now.join(last.select("conv_id", F.col("depth").alias("rest"), F.col("node").alias("before")), ["conv_id", "rest"])
        now = now.select("conv_id", "depth", "before", "name", "words")
        if digits > 1:
            now = materialize(now, f"prefixes-{digits}")
        # The prefix before has the depth without the last digit, so depth, its name and the block's name tell prefixes apart.
        nodes = now.groupBy("depth", "before", "name").agg(F.min("conv_id").alias("node"))
        last = materialize(now.join(nodes, ["depth", "before", "name"]).select("conv_id", "depth", "node", "words"), f"named-{digits}")
        done = last if done is None else done.unionByName(last)
    return done if done is not None else turns.select("conv_id", F.col("place").alias("depth"), F.col("conv_id").alias("node"), "words")


def _digests(ends: DataFrame) -> DataFrame:
    """(node, depth, conv_id) -> (node, depth, ends_sha256) of the ids, ascending, joined by commas."""
    block = F.floor(F.col("conv_id") / IDS_A_BLOCK).alias("block")
    ids = F.array_join(F.array_sort(F.collect_list("conv_id")).cast("array<string>"), ",")
    blocks = materialize(ends.groupBy("node", "depth", block).agg(ids.alias("ids")), "ends")
    counted = blocks.groupBy("node", "depth").agg(F.count("*").alias("n"), F.min("ids").alias("ids"))
    one = counted.where("n = 1").select("node", "depth", F.sha2("ids", 256).alias("ends_sha256"))
    many = blocks.join(counted.where("n > 1").select("node", "depth"), ["node", "depth"]).repartition("node", "depth").sortWithinPartitions("node", "depth", "block")
    return one.unionByName(many.select("node", "depth", "ids").mapInPandas(_streamed, "node long, depth long, ends_sha256 string"))


def _streamed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Digests of rows that come in order, of which only the running one is held."""
    at, digest = None, None
    for batch in batches:
        out = []
        for node, depth, ids in batch.itertuples(index=False, name=None):
            if at == (node, depth):
                digest.update(b",")
            else:
                if at:
                    out.append((*at, digest.hexdigest()))
                at, digest = (node, depth), hashlib.sha256()
            digest.update(ids.encode())
        yield pd.DataFrame(out, columns=["node", "depth", "ends_sha256"])
    if at:
        yield pd.DataFrame([(*at, digest.hexdigest())], columns=["node", "depth", "ends_sha256"])


def prefix_trie(turns: DataFrame, conversations: DataFrame) -> DataFrame:
    """Placed turns (conv_id, place, key, words) and all conv_ids, distinct, those without turns too -> a row a node.

    conv_id and parent_conv_id are the smallest conversations of the node and its parent, depth its number of turns (0 for the
    root), n_convs its conversations, n_children, n_leaves (nodes without children below it, itself if it has none),
    saved_tokens (over it and all below: the words of the last turn times the conversations beyond the first) and ends_sha256
    (the conversations that end here).
    """
    root = conversations.agg(F.min("conv_id")).first()[0]
    at = ["node", "depth"]
    pref = named_prefixes(turns)
    at_root = conversations.select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(root).cast("long").alias("node"), F.lit(0).cast("long").alias("words"))
    pref = materialize(pref.unionByName(at_root), "prefixes-named")
    where = pref.select("conv_id", "depth", F.col("node").alias("above"))
    nodes = pref.groupBy(*at).agg(F.count("*").alias("n_convs"), F.min("words").alias("words"))
    # A node's parent is where its smallest conversation was a turn before.
    nodes = nodes.join(where.select(F.col("conv_id").alias("node"), (F.col("depth") + 1).alias("depth"), F.col("above").alias("parent")), at, "left")
    nodes = materialize(nodes, "nodes")
    children = nodes.where("parent is not null").groupBy(F.col("parent").alias("node"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("n_children"))
    nodes = nodes.join(children, at, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    nodes = materialize(nodes, "nodes-children")
    own = nodes.select(*at, F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved_tokens"))
    sums, step, deepest = own, 1, nodes.agg(F.max("depth")).first()[0] or 0
    while step <= deepest:
        # Sums reach over `step` levels now; those `step` levels further down are added.
        up = sums.where(F.col("depth") >= step).select(F.col("node").alias("conv_id"), (F.col("depth") - step).alias("depth"), "n_leaves", "saved_tokens")
        up = up.join(where, ["conv_id", "depth"]).select(F.col("above").alias("node"), "depth", "n_leaves", "saved_tokens")
        sums = materialize(sums.unionByName(up).groupBy(*at).agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens")), "sums")
        step *= 2
    last = pref.groupBy("conv_id").agg(F.max("depth").alias("depth"))
    ends = _digests(pref.join(last, ["conv_id", "depth"]).select("node", "depth", "conv_id"))
    out = nodes.join(sums, at).join(ends, at, "left")
    empty = F.lit(hashlib.sha256(b"").hexdigest())
    return out.select(F.col("node").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", empty).alias("ends_sha256"))
