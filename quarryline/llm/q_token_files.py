"""Query of operator 4; SQL has no tokenizer, so the tests check it against the library's own encoding."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.llm.shared import read_table
from quarryline.llm.token_files import token_files

VOCABULARY = "byte_bpe_50k.json"


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = token_files(read_table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path(VOCABULARY))
    return back.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


QUERIES = {"op4_token_files": op4_token_files}
ORACLES: dict = {}
