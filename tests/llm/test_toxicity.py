import math

import numpy as np
from pyspark.sql import functions as F

from quarryline.llm.q_toxicity import held_out, op8_toxicity
from quarryline.llm.toxicity import Figures, ToxicityModel, fit_toxicity, score_toxicity, words_of


def test_backoff_of_words():
    m = ToxicityModel({"scum$": 3.0, "vequ": 2.0, "ve": 9.0, "vequil$": 0.0}, slope=1.0, offset=0.0)
    assert [m.ratio(w) for w in ("scum", "scums", "vequance", "vequil", "vent")] == [3.0, 0.0, 2.0, 0.0, 0.0]
    f = Figures(m).of(["You SCUM!", "", None, "12 --", "a b c scum"])
    assert np.allclose(f, [1.5, 0, 0, 0, 0.75])
    assert words_of("Ça_va 3x") == ["ça", "va", "x"]


def test_curve_separates():
    m = ToxicityModel()
    x = np.r_[np.zeros(50), np.full(50, 0.1)]
    m.fit_curve(x, (x > 0).astype(int))
    assert m.score(np.array([0.0]))[0] < 0.3 and m.score(np.array([0.1]))[0] > 0.7


def test_held_out_labels(spark):
    d = "/root/testdata/sf0.01"
    got = op8_toxicity(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("held_out").toPandas()
    toxic = got["toxic"] == 1
    assert (got["predicted"][toxic] == 1).mean() >= 0.7 and (got["predicted"][~toxic] == 1).mean() <= 0.03
    assert got["score"].between(0, 1).all() and ((got["score"] >= 0.7) == (got["predicted"] == 1)).all()


def test_rates_against_brute_force(spark):
    """The log ratio of a word in one class alone follows from the counts of different lines."""
    rows = [(i, "good day\nfine text " + "abcdefghij"[i % 10] * 4) for i in range(60)] + [(100 + i, f"vile{i % 3} scum number{i}") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") >= 100).cast("int").alias("toxic"))
    m = fit_toxicity(docs, labels, F.lit(True))
    assert m.ratio("scum") > 1 and m.ratio("vile7") > 1 and m.ratio("good") == 0.0 and not math.isnan(m.slope)


def test_edge_cases(spark):
    docs = spark.createDataFrame([(1, "fine words"), (2, None), (2, ""), (None, "scum"), (3, "x " * 30000)], "doc_id long, text string").withColumn("score", F.lit("clash"))
    labels = spark.createDataFrame([(1, 0), (2, None), (None, 1), (9, 1)], "doc_id long, toxic int")
    m = fit_toxicity(docs, labels, ~held_out())
    got = score_toxicity(docs, m, out="score").collect()
    assert len(got) == 5 and all(0 <= r["score"] <= 1 for r in got)
    assert fit_toxicity(docs.limit(0), labels.limit(0), F.lit(True)).ratios == {}
    assert score_toxicity(docs.limit(0), m).count() == 0


def test_figures_are_those_of_brute_force(spark):
    """Discounted counts of both classes with shared backoff, as told by plain counting."""
    import math
    from collections import Counter

    from quarryline.llm.toxicity import DISCOUNT, END, LEAST_G, LEAST_RATIO, LONGEST, SHORTEST, count_grams, log_ratios

    rows = [(1, f"you loser{k % 7} and idiot word{k % 5}") for k in range(60)] + [(0, f"the quiet word{k % 5} and lovely{k % 9} day{k}") for k in range(80)]
    grams = count_grams(spark.createDataFrame(rows, "label int, text string"))
    counts = (Counter(), Counter())
    for label, text in rows:
        found = set()
        for w in words_of(text):
            found |= {w + END} | {w[:k] for k in range(SHORTEST, min(LONGEST, len(w)) + 1)}
        counts[label].update(found)
    assert {(r["gram"], r["d0"], r["d1"]) for r in grams.collect()} == {(g, counts[0][g], counts[1][g]) for g in counts[0] | counts[1]}
    kind = lambda g: 0 if g.endswith(END) else len(g)
    n = [Counter(), Counter()]
    types = [Counter(), Counter()]
    for c in (0, 1):
        for g, k in counts[c].items():
            n[c][kind(g)] += k
            types[c][kind(g)] += 1
    lines, want = (80, 60), {}
    for g in counts[0] | counts[1]:
        d, k = (counts[0][g], counts[1][g]), kind(g)
        if not types[0][k] or not types[1][k]:
            continue
        shared = sum(d) / (n[0][k] + n[1][k])
        p = [(max(d[c] - DISCOUNT, 0) + DISCOUNT * types[c][k] * shared) / n[c][k] for c in (0, 1)]
        cells = [(d[c], sum(d) * lines[c] / 140) for c in (0, 1)] + [(lines[c] - d[c], (140 - sum(d)) * lines[c] / 140) for c in (0, 1)]
        if 2 * sum(o * math.log(o / e) for o, e in cells if o) >= LEAST_G and abs(math.log(p[1] / p[0])) >= LEAST_RATIO:
            want[g] = math.log(p[1] / p[0])
    got = log_ratios(grams, lines)
    assert got.keys() == want.keys() and {"loser", "idiot" + END, "the" + END} <= want.keys()
    assert all(math.isclose(got[g], want[g], rel_tol=1e-9) for g in want)
