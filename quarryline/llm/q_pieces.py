"""Query of operator 6; SQL has no tokenizer, so the tests check it against the library and by round trip."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.llm.pieces import round_trip
from quarryline.llm.shared import read_table

VOCABULARY = "piece_bpe_32k.model"


def op6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path(VOCABULARY)
    d = round_trip(read_table(spark, sf_dir, "documents").select("doc_id", "text"), path)
    size = (F.octet_length("piece_ids") / 4).cast("long")
    return d.select("doc_id", size.alias("n_pieces"), F.crc32("piece_ids").alias("ids_crc32"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"), F.col("decoded").eqNullSafe(F.col("text")).alias("round_trip"))


QUERIES = {"op6_pieces": op6_pieces}
ORACLES: dict = {}
