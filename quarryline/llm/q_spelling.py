"""Query and SQL of operator 11. The SQL finds near words by their forms with a code point left out, and CRC-32 by its table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.llm.shared import read_table, text_or_empty
from quarryline.llm.spelling import lower_ascii, spelling_forms

LEAST_CHARS, LEAST_COUNT = 5, 3


def counted_words(docs: DataFrame) -> DataFrame:
    """Runs of letters in lower case, one in 97 of them with a code point left out, and how often they occur."""
    found = F.regexp_extract_all(lower_ascii(text_or_empty()), F.lit(rf"[A-Za-zÀ-ÿ]{{{LEAST_CHARS},}}"), F.lit(0))
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(found).alias("run"))
    h = F.crc32(F.concat("id", F.lit(":"), "run"))
    at = (h % F.length("run")).cast("int")
    word = F.when(h % 97 == 0, F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))).otherwise(F.col("run"))
    counted = runs.select(word.alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return counted.where((F.length("word") >= LEAST_CHARS) & (F.col("n") >= LEAST_COUNT))


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_forms(counted_words(read_table(spark, sf_dir, "documents"))).select("word", "form", "root", "n", "n_near", "form_n")


SQL = r"""
WITH RECURSIVE crc AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS c
    FROM range(256) r(i))),
runs AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{C0}-\x{FF}]+')) AS run
  FROM documents),
byted AS (
  SELECT run, list_concat([4294967295], list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), '') || ':', ''), lambda x: CAST(ord(x) AS BIGINT)),
    flatten(list_transform(string_split(run, ''), lambda x: CASE WHEN ord(x) < 128 THEN [CAST(ord(x) AS BIGINT)] ELSE [195, ord(x) - 64] END))) AS b
  FROM runs WHERE length(run) >= 5),
hashed AS (SELECT run, xor(list_reduce(b, lambda a, x: xor(t[xor(a, x) % 256 + 1], a >> 8)), 4294967295) AS h FROM byted, crc),
edited AS (SELECT CASE WHEN h % 97 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM hashed),
words AS (SELECT word, count(*) AS n FROM edited WHERE length(word) >= 5 GROUP BY word HAVING count(*) >= 3),
less AS (SELECT word, n, i, left(word, i) || substr(word, i + 2) AS part FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)),
links AS (
  SELECT a.word AS word, a.n AS n, b.word AS other, b.n AS other_n FROM less a JOIN words b ON a.part = b.word
  UNION SELECT b.word, b.n, a.word, a.n FROM less a JOIN words b ON a.part = b.word
  UNION SELECT a.word, a.n, b.word, b.n FROM less a JOIN less b ON a.part = b.part AND a.i = b.i AND a.word <> b.word),
ranked AS (SELECT *, row_number() OVER (PARTITION BY word ORDER BY other_n DESC, other) AS r, count(*) OVER (PARTITION BY word) AS near FROM links),
formed AS (
  SELECT w.word, w.n, coalesce(k.near, 0) AS n_near, CASE WHEN k.other_n >= 2 * w.n THEN k.other END AS form, CASE WHEN k.other_n >= 2 * w.n THEN k.other_n END AS form_n
  FROM words w LEFT JOIN ranked k ON w.word = k.word AND k.r = 1),
chain AS (
  SELECT word, word AS at FROM formed
  UNION ALL SELECT c.word, f.form FROM chain c JOIN formed f ON c.at = f.word WHERE f.form IS NOT NULL),
roots AS (SELECT c.word, c.at AS root FROM chain c JOIN formed f ON c.at = f.word WHERE f.form IS NULL)
SELECT f.word, f.form, r.root, f.n, CAST(f.n_near AS BIGINT) AS n_near, f.form_n FROM formed f JOIN roots r ON f.word = r.word
"""

QUERIES = {"op11_spelling": op11_spelling}
ORACLES = {"op11_spelling": SQL}
