"""The corpus pipeline: documents without toxic ones, near copies and repeated passages, mixed and encoded.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes what a stage returns as Parquet and reads it
back for the next. All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.llm.mixing import training_order
from quarryline.llm.near_texts import drop_near_duplicates
from quarryline.llm.pieces import round_trip
from quarryline.llm.repeats import remove_repeats
from quarryline.llm.shared import fresh, materialize, read_table
from quarryline.llm.toxicity import fit_toxicity, score_toxicity

TOXIC_FROM = 0.7
NEAR_BITS = 7
SHINGLE_WORDS = 5
SIMILARITY = 0.8
#: Words of a passage that goes where it is repeated, also if it has fewer bytes than op9's strings.
PASSAGE_WORDS = 51
VOCABULARY = "piece_bpe_32k.model"


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score toxic go. The models learn from the labels of documents that are there."""
    model = fit_toxicity(docs, read_table(spark, sf_dir, "labels"), F.lit(True))
    score = fresh(docs, "_toxicity")
    return score_toxicity(docs, model, out=score).where(F.col(score) < TOXIC_FROM).drop(score)


def simhash(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays. SimHash finds the first pairs, the texts decide on all."""
    return drop_near_duplicates(docs, SIMILARITY, radius=NEAR_BITS, shingle=SHINGLE_WORDS)


def suffix_array(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages go, by bytes and of over 50 words; a document of which nothing but white space is left goes too. A cut character goes whole."""
    cut = remove_repeats(docs, text=True, words=PASSAGE_WORDS)
    text = F.when(F.col("n_removed") == 0, F.col("text")).otherwise(F.col("kept_text"))
    out = cut.withColumn("text", text).where((F.col("n_removed") == 0) | F.col("text").rlike(r"\S"))
    return out.withColumn("n_chars", F.when(F.col("n_removed") == 0, F.col("n_chars")).otherwise(F.length("text").cast("long"))).select(*docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources come near their targets: documents beyond them go, others come up to three times, in training order."""
    return training_order(docs)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their piece ids, their number, and whether decoding gives the text back."""
    path = public_tokenizers.path(VOCABULARY)
    d = round_trip(docs, path)
    return d.withColumn("n_pieces", (F.octet_length("piece_ids") / 4).cast("long")).withColumn("round_trip", F.col("decoded").eqNullSafe(F.col("text"))).drop("decoded")


STAGES = [("toxicity", toxicity), ("simhash", simhash), ("suffix_array", suffix_array), ("mixing", mixing), ("pieces", pieces)]
#: Neither the models nor the tokenizer can be expressed in SQL; the tests check run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
