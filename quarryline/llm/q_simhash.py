"""Query of operator 2; SQL has no 64-bit XXH64, so a brute-force version in the tests checks it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.llm.shared import read_table
from quarryline.llm.simhash import near_groups


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = near_groups(read_table(spark, sf_dir, "documents").select("doc_id", "text"), radius=4, shingle=4)
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES = {"op2_simhash": op2_simhash}
ORACLES: dict = {}
