"""Query of operator 5; SQL can't parse HTML, so the tests hold it against texts known by construction."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.llm.html_text import extract_text
from quarryline.llm.shared import read_table


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract_text(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


QUERIES = {"op5_html_text": op5_html_text}
ORACLES: dict = {}
