"""Query and SQL of operator 1."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.llm.mixing import mix_sources
from quarryline.llm.shared import read_table


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mix_sources(read_table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    first = F.round(F.get("positions", F.lit(0)), 9).alias("position")
    out = mix.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken", "copies", first)
    return out.orderBy(F.col("position").asc_nulls_last(), "doc_id")


SQL = r"""
WITH sized AS (
  SELECT doc_id, source,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))) AS order_key
  FROM documents),
src AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS DOUBLE) AS w
  FROM sized GROUP BY source),
shared AS (SELECT *, w / sum(w) OVER () AS share, 3.0 * source_size AS cap, CAST(sum(source_size) OVER () AS DOUBLE) AS total FROM src),
filled AS (
  SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY cap / share, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(share) OVER (ORDER BY cap / share, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM shared),
targets AS (
  SELECT source, source_size,
         CASE WHEN cap <= level * share THEN CAST(cap AS DOUBLE)
              ELSE share * max(CASE WHEN cap > level * share THEN level END) OVER () END AS target
  FROM filled),
placed AS (
  SELECT doc_id, size, source_size, target, CAST(floor(target) AS BIGINT) AS goal,
         CAST(coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY order_key, doc_id, size
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
  FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source),
passes AS (
  SELECT *, CASE WHEN source_size > 0 THEN goal // source_size ELSE 0 END AS k FROM placed),
rests AS (SELECT *, goal - k * source_size AS rest FROM passes),
counted AS (
  SELECT *, CAST(k * size + greatest(0, least(rest - start, size)) AS BIGINT) AS taken,
         CAST(k + CASE WHEN start * 2 + size < rest * 2 THEN 1 ELSE 0 END AS INTEGER) AS copies
  FROM rests)
SELECT doc_id, size, source_size, round(target, 6) AS target, taken, copies,
       CASE WHEN copies > 0 THEN round(least(start / target, 1.0), 9) END AS position
FROM counted
"""

QUERIES = {"op1_mixing": op1_mixing}
ORACLES = {"op1_mixing": SQL}
