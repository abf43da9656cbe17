import hashlib
import random
import zlib

import pytest

from quarryline.llm.ogg import decode_media, demux, encode_media, mux, page_crc, payload_of, read_features


def slow_crc(data):
    crc = 0
    for b in data:
        crc ^= b << 24
        for _ in range(8):
            crc = ((crc << 1) ^ (0x04C11DB7 if crc & 0x80000000 else 0)) & 0xFFFFFFFF
    return crc


def test_crc_is_the_formats():
    for n in (0, 1, 5, 300):
        data = bytes(random.Random(n).randrange(256) for _ in range(n))
        assert page_crc(data) == slow_crc(data)


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 255, 4000, 4001, 65025, 65024, 70_000, 500_001])
def test_round_trip(n):
    text = "".join(random.Random(n).choice("aé \n") for _ in range(n))
    payload, size = payload_of(text)
    media = mux(payload, size)
    x = read_features(media)
    assert x["payload"] == payload and x["n_bytes"] == size == len(text.encode())
    streams = demux(media)
    assert len(streams) == 2 and all(s.ended for s in streams.values())
    sound = streams[zlib.crc32(payload)]
    assert max(sound.granules) == len(payload) and sound.packets[1] == payload[:4000]


def test_damage_is_found():
    media = bytearray(mux(*payload_of("hello " * 2000)))
    for at in (5, 20, 100, len(media) - 1):
        bad = bytearray(media)
        bad[at] ^= 4
        with pytest.raises(ValueError):
            read_features(bytes(bad))
    with pytest.raises(ValueError):
        read_features(bytes(media[:-50]))


def test_table(spark):
    texts = [None, "", "", "a", "a", "x" * 64, "é" * 200_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("nullif(doc_id, 3) as doc_id", "text", "1 as n_bytes")
    rows = decode_media(encode_media(df)).collect()
    assert len(rows) == len(texts) and sum(r["doc_id"] is None for r in rows) == 1
    for r in rows:
        t = (texts[r["doc_id"]] if r["doc_id"] is not None else "a") or ""
        raw = t.encode()
        p = raw + b"\0" * ((-len(raw)) % 64 if raw else 64)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
    assert len({r["media_sha256"] for r in rows}) == len({t or "" for t in texts})
    assert decode_media(encode_media(df.limit(0))).count() == 0
