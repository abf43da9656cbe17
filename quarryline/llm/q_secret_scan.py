"""Query of operator 13. SQL can't learn the chain; tests hold the patterns and the decoding against plain versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.llm.secret_scan import FOUND, find_secrets, fit_secrets
from quarryline.llm.shared import read_table


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_secrets(docs, fit_secrets(docs)).select("doc_id", "secrets")
    count = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("secrets", lambda s: s["kind"] != FOUND)
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.col("secrets")).alias("spans"))


QUERIES = {"op13_secret_scan": op13_secret_scan}
ORACLES: dict = {}
