import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quarryline.llm.token_files import frame, read_frame, read_shards, write_shards
from quarryline.llm.unit_cache import UnitCache

PATH = public_tokenizers.path("byte_bpe_50k.json")
TOK = Tokenizer.from_file(PATH)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n\t\r\x0b\x1c\x85\xa0 abcX1'.,é漢<|endoftext|>"), st.characters(exclude_categories=["Cs"])), max_size=60))
def test_units_give_the_librarys_ids(text):
    assert UnitCache.of_tokenizer(PATH).encode([text])[0].tolist() == TOK.encode(text, add_special_tokens=False).ids


def test_added_tokens_are_the_librarys():
    assert UnitCache.of_tokenizer(PATH).encode(["a <|endoftext|> b", "x<|endoftext|>y z", " a b"])[0].tolist() == [64, 220, 50256, 275]
    for t in ("<|endoftext|>", "a b<|endoftext|> c", "<|endoftext|> a"):
        assert UnitCache.of_tokenizer(PATH).encode([t])[0].tolist() == TOK.encode(t, add_special_tokens=False).ids


def test_frames_detect_damage():
    data = frame(b"abc") + frame(b"") + frame(b"x" * 1000)
    a, at = read_frame(data)
    b, at = read_frame(data, at)
    c, at = read_frame(data, at)
    assert (a, b, c, at) == (b"abc", b"", b"x" * 1000, len(data))
    for k in range(19):
        bad = bytearray(data)
        bad[k] ^= 1
        with pytest.raises(ValueError):
            read_frame(bytes(bad))
    with pytest.raises(ValueError):
        read_frame(data[:-1], len(frame(b"abc")) * 1 + len(frame(b"")))


def test_written_and_read_back(spark, tmp_path):
    texts = ["hello world", None, "", "it's  two spaces\n\nand <|endoftext|> text", "ünï", "hello world", "w " * 5000]
    rows = [(i * 7 % 11, t) for i, t in enumerate(texts)] + [(None, "zzz"), (3, "dup"), (3, "dup")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as ids", "1 as start")
    manifest = write_shards(df, str(tmp_path / "out"), PATH, shards=3)
    got = sorted(read_shards(spark, str(tmp_path / "out"), manifest, run=2).collect(), key=lambda r: r["start"])
    start = 0
    for r, (i, t) in zip(got, sorted(rows, key=lambda x: (x[0] is None, x[0] or 0, x[1] or "")), strict=True):
        ids = [*TOK.encode(t or "", add_special_tokens=False).ids, 0]
        assert (r["doc_id"], r["start"], r["n_tokens"]) == (i, start, len(ids))
        assert bytes(r["ids"]) == struct.pack(f"<{len(ids)}I", *ids) and zlib.crc32(bytes(r["ids"])) == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    empty = write_shards(df.limit(0), str(tmp_path / "none"), PATH)
    assert read_shards(spark, str(tmp_path / "none"), empty).count() == 0
