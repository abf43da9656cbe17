import numpy as np
from pyspark.sql import functions as F

from quarryline.llm.language import LanguageModel, identify, normalise, sample_languages, suffix_automaton
from quarryline.llm.q_language import op7_language


def brute_phrases(sample, text):
    """Longest matches from the current place, one after the other, over the whole text."""
    at = n = 0
    while at < len(text):
        size = 1
        while at + size < len(text) and text[at : at + size + 1] in sample:
            size += 1
        at, n = at + size, n + 1
    return n


def test_automaton_knows_all_substrings():
    text = "abcbcabaab"
    states = suffix_automaton(text)
    subs = {text[i:j] for i in range(len(text)) for j in range(i + 1, len(text) + 1)}

    def walk(s, path):
        for c, t in states[s].items():
            yield path + c
            yield from walk(t, path + c)

    assert set(walk(0, "")) == subs


def test_phrases_are_the_brute_forces():
    rng = np.random.default_rng(5)
    samples = {"a": "".join(rng.choice(list("abcd e"), 700)), "b": "".join(rng.choice(list("efgh a"), 700))}
    texts = ["".join(rng.choice(list("abcdefgh z"), n)) for n in (1, 5, 255, 256, 257, 1200)]
    m = LanguageModel(samples)
    names, scores = m.predict(texts)
    for t, name, score in zip(texts, names, scores, strict=True):
        plain = normalise(t)
        if not plain:
            assert name == "und"
            continue
        bits = {k: brute_phrases(s, plain) * np.log2(len(s) + 1) for k, s in samples.items()}
        assert bits[name] == min(bits.values())
        assert np.isclose(score, (1 / bits[name]) / sum(1 / b for b in bits.values()))


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    got = op7_language(spark, d).join(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (got["lang_pred"] == got["lang"]).mean() > 0.97


def test_edge_cases(spark):
    rows = [(1, "hello there general", "en"), (2, None, "en"), (3, "123 --", None), (4, "", "fr"), (5, "bonjour à tous", "fr"), (5, "bonjour à tous", "fr"), (None, "𝔥𝔢 漢字 hello", "en"), (7, "hello " * 20000, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("clash"))
    got = {(r["doc_id"], r["lang_pred"]) for r in identify(df, sample_languages(df, F.lit(True))).collect()}
    assert {(1, "en"), (2, "und"), (3, "und"), (4, "und"), (5, "fr"), (7, "en")} <= got
    assert {r["lang_pred"] for r in identify(df, ()).collect()} == {"und"}
    assert identify(df.limit(0), ()).count() == 0


def test_every_sampled_character_counts():
    rng = np.random.default_rng(6)
    alphabets = [[chr(0x4E00 + k) for k in range(3000)], [chr(0x20000 + k) for k in range(400)] + [chr(0x4E00 + k) for k in range(40)]]
    samples = {n: normalise("".join(rng.choice(a, 4000))) for n, a in zip("ab", alphabets, strict=True)}
    m = LanguageModel(samples)
    texts = [samples["a"][1000:1900], samples["b"][50:700], "".join(rng.choice(alphabets[0], 600)), "".join(rng.choice(alphabets[1], 600)), samples["a"][:90] + "z" + samples["b"][:90]]
    names, scores = m.predict(texts)
    for t, name, score in zip(texts, names, scores, strict=True):
        bits = {k: brute_phrases(s, normalise(t)) * np.log2(len(s) + 1) for k, s in samples.items()}
        assert bits[name] == min(bits.values())
        assert np.isclose(score, (1 / bits[name]) / sum(1 / b for b in bits.values()))
    # A passage of the sample is one phrase, by characters of any rank.
    assert np.isclose(scores[0], 1 / (1 + 1 / brute_phrases(samples["b"], texts[0])), rtol=1e-3)


def test_letters_go_by_unicode_category():
    assert normalise("½ ² ③ 12 _-") == "" and normalise("\u0301 ½") == ""
    assert normalise("नमस्ते, दुनिया 5") == "नमस्ते दुनिया" and normalise("É1x") == "é x"
    assert LanguageModel({"a": "abc"}).predict(["½ ² ③", None, "", "abc"])[0] == ["und", "und", "und", "a"]


def test_stretches_change_nothing(monkeypatch):
    rng = np.random.default_rng(8)
    samples = {"a": "".join(rng.choice(list("abcd e"), 700)), "b": "".join(rng.choice(list("efgh a漢"), 700)), "c": "x" * 90}
    texts = ["x" + "".join(rng.choice(list("abcdefgh z漢"), int(n))) + "x" for n in rng.integers(1, 400, 150)] + [samples["a"] + "q" + samples["b"][100:400], "x" * 500, "abab" * 99]
    m = LanguageModel(samples)
    want = {k: [brute_phrases(s, normalise(t)) for t in texts] for k, s in zip(m.names, map(samples.get, m.names), strict=True)}
    for block in (1, 3, 16, 256, 10_000):
        monkeypatch.setattr("quarryline.llm.language.BLOCK", block)
        plain = [normalise(t) for t in texts]
        chars = np.frombuffer("".join(plain).encode("utf-32-le"), "<u4")
        for name, a in zip(m.names, m.automata, strict=True):
            assert a.phrases(chars, np.array(list(map(len, plain)))).tolist() == want[name]
