"""Query of operator 7; SQL has no automata, so the tests hold it against held-out languages and a brute-force parse."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.llm.language import identify, sample_languages
from quarryline.llm.shared import read_table


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    samples = sample_languages(docs.select("doc_id", "text", "lang"), F.col("doc_id").isNotNull() & ~held_out())
    return identify(docs.select("doc_id", "text"), samples).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


QUERIES = {"op7_language": op7_language}
ORACLES: dict = {}
