"""Query of operator 10; SQL has no Ogg, so the tests check it by round trip."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarryline.llm.ogg import decode_media, encode_media
from quarryline.llm.shared import read_table


def op10_ogg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decode_media(encode_media(read_table(spark, sf_dir, "documents").select("doc_id", "text")))


QUERIES = {"op10_ogg": op10_ogg}
ORACLES: dict = {}
