import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from quarryline.llm.pieces import PieceModel, decode_pieces, encode_pieces, model_of, round_trip

PATH = public_tokenizers.path("piece_bpe_32k.model")
LIB = sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def corpus():
    import pyarrow.parquet as pq

    return [t for t in pq.read_table("/root/testdata/sf0.001/documents.parquet")["text"].to_pylist() if t]


def test_corpus_gives_the_librarys_ids(corpus):
    m = model_of(PATH)
    for t, ids, want in zip(corpus, m.encode(corpus), LIB.encode(corpus), strict=True):
        assert ids.tolist() == want
        assert m.decode(ids) == t == LIB.decode(want)


@settings(max_examples=500, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n\taaabcdehilnorst.,é漢<s>▁"), st.characters(exclude_categories=["Cs"], exclude_characters="\0")), max_size=40))
def test_any_text_gives_the_librarys_ids(text):
    assert model_of(PATH).encode([text])[0].tolist() == LIB.encode(text)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="etaoinshr", max_size=30))
def test_hard_merges(text):
    assert model_of(PATH).encode([text])[0].tolist() == LIB.encode(text)


def test_unigram_finds_the_best_sum():
    pieces = ["<unk>", "▁", "a", "b", "c", "ab", "bc", "▁a", "abc", "ca"]
    scores = [0, -3.0, -2.0, -2.5, -2.2, -2.9, -3.3, -3.1, -6.5, -1.7]
    m = PieceModel.__new__(PieceModel)
    m.setup(pieces, scores, {0}, bpe=False)
    score = dict(zip(pieces[1:], scores[1:], strict=True))

    def best(t):
        return max([score[x] for x in [t] if x in score] + [score[t[:k]] + best(t[k:]) for k in range(1, len(t)) if t[:k] in score and best(t[k:]) > -1e9], default=-1e9)

    for word in ("abc", "abcabc", "caab", "bcaabcc", "a"):
        ids = m.encode([word])[0]
        assert "".join(pieces[i] for i in ids) == "▁" + word
        assert np.isclose(sum(scores[i] for i in ids), best("▁" + word))
    assert m.encode(["aéb"])[0].tolist() == [7, 0, 3]


def test_table(spark):
    rows = [(1, None), (2, ""), (2, ""), (3, "x" * 3000), (4, "  two  spaces \n"), (5, "漢字 ok")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'clash' as piece_ids", "0 as decoded")
    got = decode_pieces(encode_pieces(df, PATH), PATH).collect()
    assert sorted((r["doc_id"], r["text"]) for r in got if r["text"]) == sorted((r["doc_id"], r["decoded"]) for r in got if r["decoded"])
    assert sorted(map(str, got)) == sorted(map(str, round_trip(df, PATH).collect()))
    for r in got:
        assert (r["piece_ids"] is None) == (r["text"] is None) and r["decoded"] == r["text"]
    assert encode_pieces(df.limit(0), PATH).count() == 0


def test_long_texts_are_encoded_in_parts(monkeypatch):
    """Parts of a text, small lattices and a small table of pairs give the same ids."""
    monkeypatch.setattr("quarryline.llm.pieces.CHARS", 11)
    monkeypatch.setattr("quarryline.llm.pieces.CELLS", 16)
    monkeypatch.setattr("quarryline.llm.pieces.PAIR_BITS", 3)
    m = PieceModel(PATH)
    for text in ("the quick  brown fox é漢 jumps over ▁ the lazy   dog " * 4, "x" * 300, "a b c d e f g h i j k l m n o p q r s t ", "word " * 40, " lead and trail  "):
        assert m.encode([text, "", text])[2].tolist() == LIB.encode(text)
