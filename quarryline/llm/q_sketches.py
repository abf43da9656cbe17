"""Query of operator 3; DuckDB has no XXH64, so a brute-force version in the tests checks it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarryline.llm.shared import read_table
from quarryline.llm.sketches import fingerprint_edits


def op3_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fingerprint_edits(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")


QUERIES = {"op3_sketches": op3_sketches}
ORACLES: dict = {}
