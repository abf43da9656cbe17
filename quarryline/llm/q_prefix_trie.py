"""Query and SQL of operator 12."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.llm.prefix_trie import ordered_turns, prefix_trie
from quarryline.llm.shared import materialize, read_table

#: Conversations that share a base, and heads are of fewer turns than this.
FAMILY, HEADS = 20, 4


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The first turns of the base conversation, then the own ones after as many: placed turns, and all conv_ids."""
    turns = ordered_turns(conversations)
    sizes = turns.groupBy("conv_id").agg(F.count("*").alias("size"))
    base = sizes.select(F.col("conv_id").alias("base"), F.col("size").alias("base_size"))
    c = F.col("conv_id")
    convs = sizes.select("conv_id", (c - c % FAMILY).alias("base"), (F.crc32(c.cast("string").cast("binary")) % HEADS).alias("h"))
    convs = materialize(convs.join(base, "base", "left").select("conv_id", "base", "h", F.least("h", F.coalesce("base_size", F.lit(0))).alias("taken")), "conversations")
    first = turns.where(F.col("place") < HEADS - 1).withColumnRenamed("conv_id", "base")
    heads = convs.join(first, "base").where("place < h").select("conv_id", "place", "key", "words")
    tails = turns.join(convs, "conv_id").where("place >= h").select("conv_id", (F.col("taken") + F.col("place") - F.col("h")).alias("place"), "key", "words")
    return materialize(heads.unionByName(tails), "rebuilt"), convs.select("conv_id")


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(*rebuilt(read_table(spark, sf_dir, "conversations")))


SQL = r"""
WITH RECURSIVE crc AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS c
    FROM range(256) r(i))),
given AS (
  SELECT conv_id AS c, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
turns AS (
  SELECT c, role, text, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, sha256(CAST(octet_length(encode(role)) AS VARCHAR) || ':' || role || text)) - 1 AS place FROM given),
convs AS (
  SELECT c, c - c % 20 AS base,
         xor(list_reduce(list_concat([4294967295], list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: CAST(ord(x) AS BIGINT))),
             lambda a, x: xor(t[xor(a, x) % 256 + 1], a >> 8)), 4294967295) % 4 AS h
  FROM (SELECT DISTINCT c FROM given), crc),
rebuilt AS (
  SELECT v.c, t.place AS k, 0 AS own, role, text FROM convs v JOIN turns t ON t.c = v.base AND t.place < v.h
  UNION ALL SELECT v.c, t.place, 1, role, text FROM convs v JOIN turns t ON t.c = v.c AND t.place >= v.h),
lists AS (
  SELECT v.c, coalesce(list({'r': role, 't': text} ORDER BY own, k) FILTER (WHERE role IS NOT NULL), []) AS s FROM convs v LEFT JOIN rebuilt r ON v.c = r.c GROUP BY v.c),
prefixes AS (SELECT c, len(s) AS size, d, s[1:d] AS p FROM (SELECT *, unnest(range(0, len(s) + 1)) AS d FROM lists)),
nodes AS (
  SELECT d, p, min(c) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE size = d), '')) AS ends_sha256,
         CASE WHEN d = 0 THEN 0 ELSE (count(*) - 1) * len(regexp_extract_all(p[d].t, '[^\x20\x09-\x0D]+')) END AS saved
  FROM prefixes GROUP BY d, p),
linked AS (
  SELECT n.*, u.conv_id AS parent_conv_id, (SELECT count(*) FROM nodes k WHERE k.d = n.d + 1 AND k.p[1:n.d] = n.p) AS n_children
  FROM nodes n LEFT JOIN nodes u ON u.d = n.d - 1 AND u.p = n.p[1:n.d - 1]),
below AS (
  SELECT d, p, sum(saved) AS saved_tokens, sum(leaf) AS n_leaves FROM (
    SELECT unnest(range(0, d + 1)) AS a, p AS q, saved, CASE WHEN n_children = 0 THEN 1 ELSE 0 END AS leaf FROM linked) x, LATERAL (SELECT x.a AS d, x.q[1:x.a] AS p)
  GROUP BY d, p)
SELECT l.conv_id, l.d AS depth, l.parent_conv_id, l.n_convs, CAST(l.n_children AS BIGINT) AS n_children, CAST(b.n_leaves AS BIGINT) AS n_leaves,
       CAST(b.saved_tokens AS BIGINT) AS saved_tokens, l.ends_sha256
FROM linked l JOIN below b ON l.d = b.d AND l.p = b.p
"""

QUERIES = {"op12_prefix_trie": op12_prefix_trie}
ORACLES = {"op12_prefix_trie": SQL}
