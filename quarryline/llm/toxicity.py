"""Operator 8: toxicity by class-conditional Kneser-Ney models.

Words are told by themselves or, if rare, by how they begin. Each class (toxic, ordinary) has its counts of words and word
beginnings; absolute discounting takes from them, and what it takes is given out by one Kneser-Ney continuation model that
both classes share: in how many different lines, of either class, a gram stands. A word goes by its longest gram that the
classes use differently beyond chance (a G-test over lines, and a least ratio). Usual words go by themselves alone. A word without such a gram backs off to
the shared counts in both classes and says nothing. A document's figure is the log-likelihood of its words under the toxic
model less that under the ordinary one, divided by the number of words. A logistic curve, fitted on labelled documents kept
out of the counts, turns it into a score from 0 to 1.

Counting is a Spark aggregation; only grams that pass the tests and the sample's usual words reach the driver. The models learn from at most about
``MAX_DOCS`` labelled documents of each class, chosen by hash: the only bound. Every document is scored over its whole text.

Defined results: null, empty and wordless texts have the score of a figure of zero; rows are scored alone, so repeats and
ties agree; an empty table gives no rows; a doc_id with conflicting labels counts as toxic; null labels and ids are left out;
without labels of both classes every score is 0. Extra columns stay, the score replaces a column of its name.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarryline.llm.shared import materialize, small_batches

DISCOUNT = 0.75
#: Word beginnings of these lengths are grams, and whole words, which end in END.
SHORTEST, LONGEST = 3, 8
END = "$"
#: Labelled documents of each class that are learnt from, about.
MAX_DOCS = 4000
#: One in so many of them is kept for the curve.
KEPT_OUT = 4
#: A gram is used differently from this G and this log ratio on.
LEAST_G, LEAST_RATIO = 22.0, 1.0
#: A word in so many ordinary documents isn't rare, and doesn't go by its beginning.
USUAL = 2
WORD = re.compile(r"[^\W\d_]+")
#: Words that a worker remembers before it starts anew.
CACHED = 50_000


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


@dataclass
class ToxicityModel:
    """Log ratios of the grams that count (zero for usual words), and the curve."""

    ratios: dict[str, float] = field(default_factory=dict)
    slope: float = 0.0
    offset: float = -50.0

    def ratio(self, word: str) -> float:
        """log P(word | toxic) - log P(word | ordinary)."""
        found = self.ratios.get(word + END)
        for size in range(min(LONGEST, len(word)), SHORTEST - 1, -1):
            if found is not None:
                break
            found = self.ratios.get(word[:size])
        return found or 0.0

    def score(self, figures: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.offset + self.slope * figures, -50, 50)))

    def fit_curve(self, figures: np.ndarray, labels: np.ndarray, penalty: float = 1e-4) -> None:
        """Logistic regression by Newton's steps, a small ridge on the slope, both classes weighing the same."""
        if len(set(labels.tolist())) < 2:
            return
        scale = figures.std() or 1.0
        x = np.stack([np.ones(len(figures)), figures / scale], axis=1)
        weight = np.where(labels == 1, 0.5 / (labels == 1).sum(), 0.5 / (labels == 0).sum())
        b = np.zeros(2)
        for _ in range(200):
            p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
            gradient = x.T @ (weight * (p - labels)) + [0, penalty * b[1]]
            hessian = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag([1e-6, penalty])
            step = np.linalg.solve(hessian, gradient)
            b -= np.clip(step, -1, 1)
            if np.abs(step).max() < 1e-6:
                break
        self.offset, self.slope = float(b[0]), float(b[1] / scale)


class Figures:
    """The mean log ratio of texts, with the words' ratios remembered."""

    def __init__(self, model: ToxicityModel):
        self.model, self.known = model, _Ratios(model)

    def of(self, texts) -> np.ndarray:
        if len(self.known) > CACHED:
            self.known.clear()
        get = self.known.__getitem__
        words = map(words_of, texts)
        return np.array([math.fsum(map(get, ws)) / len(ws) if ws else 0.0 for ws in words])


class _Ratios(dict):
    def __init__(self, model: ToxicityModel):
        super().__init__()
        self.model = model

    def __missing__(self, word: str) -> float:
        r = self[word] = self.model.ratio(word)
        return r


def _scorer(spark, model: ToxicityModel, final: bool):
    """A UDF of the figure, or of the score. The model is small: the grams that passed the tests."""
    shared = spark.sparkContext.broadcast(model)
    held: list[Figures] = []

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        if not held:
            held.append(Figures(shared.value))
        figures = held[0].of(texts)
        return pd.Series(shared.value.score(figures) if final else figures)

    return score


def count_grams(lines: DataFrame) -> DataFrame:
    """Lines (label, text) -> gram, kind, in how many lines it stands (d0, d1) in both classes.

    A line's grams are made distinct within its row, so they are summed map-side before the one shuffle.
    """
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+)"), 1))

    def grams(w: Column) -> Column:
        sizes = F.sequence(F.lit(SHORTEST), F.greatest(F.lit(SHORTEST), F.least(F.lit(LONGEST), F.length(w))))
        return F.concat(F.array(F.concat(w, F.lit(END))), F.when(F.length(w) >= SHORTEST, F.transform(sizes, lambda k: F.substring(w, F.lit(1), k))).otherwise(F.array().cast("array<string>")))

    own = lines.select("label", F.explode(F.array_distinct(F.flatten(F.transform(words, grams)))).alias("gram"))
    counted = own.groupBy("gram").agg(F.count_if(F.col("label") == 0).alias("d0"), F.count_if(F.col("label") == 1).alias("d1"))
    # Kind 0 is a whole word, others are the length of a beginning.
    return counted.withColumn("kind", F.when(F.endswith("gram", F.lit(END)), 0).otherwise(F.length("gram")))


def log_ratios(grams: DataFrame, lines: tuple[int, int]) -> dict[str, float]:
    """Kneser-Ney log ratios of the grams that the classes use differently."""
    kinds = grams.groupBy("kind").agg(*[F.sum(f"d{c}").alias(f"n{c}") for c in (0, 1)], *[F.count_if(F.col(f"d{c}") > 0).alias(f"t{c}") for c in (0, 1)])
    g = grams.join(F.broadcast(kinds), "kind")  # one row a kind, nine at most
    shared = (F.col("d0") + F.col("d1")) / (F.col("n0") + F.col("n1"))

    def p(c: int) -> Column:
        return (F.greatest(F.col(f"d{c}") - DISCOUNT, F.lit(0.0)) + DISCOUNT * F.col(f"t{c}") * shared) / F.col(f"n{c}")

    def part(n: Column, of: Column, total: float) -> Column:
        return F.when(n > 0, n * F.ln(n / (of * F.lit(total)))).otherwise(F.lit(0.0))

    n = lines[0] + lines[1]
    row = F.col("d0") + F.col("d1")
    g_test = 2 * (part(F.col("d0"), row, lines[0] / n) + part(F.col("d1"), row, lines[1] / n) + part(F.lit(lines[0]) - F.col("d0"), n - row, lines[0] / n) + part(F.lit(lines[1]) - F.col("d1"), n - row, lines[1] / n))
    ratio = F.ln(p(1) / p(0))
    found = g.where((F.col("t0") > 0) & (F.col("t1") > 0) & (g_test >= LEAST_G) & (F.abs(ratio) >= LEAST_RATIO)).select("gram", ratio.alias("ratio"))
    return {r["gram"]: r["ratio"] for r in found.collect()}


def usual_words(sample: DataFrame) -> dict[str, float]:
    """Words of several ordinary documents: nothing is concluded from how they begin."""
    word = F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+)"), 1))).alias("word")
    n = sample.where("label = 0").select(word).groupBy("word").count().where(F.col("count") >= USUAL)
    return {r["word"] + END: 0.0 for r in n.collect()}


def fit_toxicity(docs: DataFrame, labels: DataFrame, learn_from: Column, max_docs: int = MAX_DOCS) -> ToxicityModel:
    """labels: doc_id, toxic. ``learn_from``: which doc_ids may be learnt from, a condition on doc_id."""
    spark = docs.sparkSession
    small_batches(spark)
    own = labels.where(learn_from & F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("label"))
    n = {r["label"]: r["count"] for r in own.groupBy("label").count().collect()}
    if len(n) < 2:
        return ToxicityModel()
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) / 1_000_000
    few = own.where(F.when(F.col("label") == 1, draw < max_docs / n[1]).otherwise(draw < max_docs / n[0])).withColumnRenamed("doc_id", "label_id")
    # The drawn ids are about 2 * max_docs rows at most, so they may be broadcast. Copies of a text count once.
    picked = docs.select("doc_id", "text").join(F.broadcast(few), F.col("doc_id") == F.col("label_id"))
    sample = materialize(picked.select("label", F.xxhash64("text").alias("sample_id"), F.coalesce("text", F.lit("")).alias("text")).dropDuplicates(["label", "sample_id"]), "toxic-sample")
    kept_out = F.pmod(F.col("sample_id"), F.lit(KEPT_OUT)) == 0
    # Lines count once in a class: copies and shared lines would make their own words look toxic.
    line = F.explode(F.split("text", r"\n")).alias("text")
    learnt = sample.where(~kept_out)
    counted = materialize(learnt.select("label", line).withColumn("sample_id", F.xxhash64("text")).dropDuplicates(["label", "sample_id"]), "toxic-lines")
    sizes = {r["label"]: r["count"] for r in counted.groupBy("label").count().collect()}
    if len(sizes) < 2:
        return ToxicityModel()
    grams = materialize(count_grams(counted), "toxic-grams")
    model = ToxicityModel(usual_words(learnt) | log_ratios(grams, (sizes[0], sizes[1])))
    curve = sample.where(kept_out).select("label", _scorer(spark, model, False)("text").alias("figure")).toPandas()
    model.fit_curve(curve["figure"].to_numpy(), curve["label"].to_numpy())
    return model


def score_toxicity(docs: DataFrame, model: ToxicityModel, text_col: str = "text", out: str = "toxicity") -> DataFrame:
    """Add ``out``, the score from 0 to 1."""
    small_batches(docs.sparkSession)
    return docs.withColumn(out, _scorer(docs.sparkSession, model, True)(F.col(text_col).cast("string")))
