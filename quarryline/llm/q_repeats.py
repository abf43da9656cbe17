"""Query of operator 9; too slow in SQL on whole tables, so the tests hold it against brute force."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.llm.repeats import remove_repeats
from quarryline.llm.shared import read_table


#: Words of a passage that goes from the column text where it is repeated, also if it has under 400 bytes.
PASSAGE_WORDS = 51


def op9_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and hash are of strings of 400 bytes alone; text is what is left without repeated passages of over 50 words too."""
    cut = remove_repeats(read_table(spark, sf_dir, "documents").select("doc_id", "text"), text=True, words=PASSAGE_WORDS, apart=True)
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", F.col("kept_text").alias("text"))


QUERIES = {"op9_repeats": op9_repeats}
ORACLES: dict = {}
