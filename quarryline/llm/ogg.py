"""Operator 10: media columns in Ogg pages.

``mux`` stores a payload as 8-bit samples in one logical stream and a note about it (the unpadded length) in a second,
interleaved one. ``demux`` reads any sequence of pages back: it verifies each page's checksum and sequence number, puts
packets together from the lacing values (also over page borders), separates the logical streams by serial number and
derives times from the granule positions, which count samples. All values come from the payload alone, so equal texts give
equal media.

Defined results: null and empty text store 64 zero bytes; very long texts take more pages; repeated rows give equal rows;
an empty table gives no rows; extra columns are ignored. A damaged page raises, as the data can't be whole.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryline.llm.shared import small_batches

RATE = 8000
PACKET = 4000
UNIT = 64
CONTINUED, FIRST, LAST = 1, 2, 4
#: Identification packets of the two streams.
PCM_MAGIC = b"\x7fPCM8\x01"
NOTE_MAGIC = b"\x7fNOTE\x01"
#: Each byte with its bits in reverse order.
REVERSED = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))


def page_crc(page: bytes) -> int:
    """CRC-32 of polynomial 04C11DB7, not reflected, from zero: zlib's on reversed bits, without its inversions."""
    crc = zlib.crc32(page.translate(REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(crc.to_bytes(4, "little").translate(REVERSED), "big")


def _page(flags: int, granule: int, serial: int, number: int, lacing: bytes, body: bytes) -> bytes:
    head = b"OggS" + struct.pack("<BBqII", 0, flags, granule, serial, number)
    rest = bytes([len(lacing)]) + lacing + body
    crc = page_crc(head + b"\0\0\0\0" + rest)
    return head + struct.pack("<I", crc) + rest


def _lacing(n: int) -> bytes:
    return b"\xff" * (n // 255) + bytes([n % 255])


def _stream(serial: int, packets: list[bytes], granules: list[int]) -> list[bytes]:
    """Pages of one stream: the first packet alone, then the others, a new page after every 255 lacing values."""
    pages = [_page(FIRST, 0, serial, 0, _lacing(len(packets[0])), packets[0])]
    lacing, body, done, flags = b"", b"", -1, 0
    for k, p in enumerate(packets[1:], 1):
        at = 0
        for value in _lacing(len(p)):
            if len(lacing) == 255:
                pages.append(_page(flags, done, serial, len(pages), lacing, body))
                lacing, body, done, flags = b"", b"", -1, CONTINUED if at else 0
            lacing, body, at = lacing + bytes([value]), body + p[at : at + value], at + value
        done = granules[k]
    pages.append(_page(flags | LAST, granules[-1], serial, len(pages), lacing, body))
    return pages


def mux(payload: bytes, n_bytes: int) -> bytes:
    serial = zlib.crc32(payload)
    cut = [payload[i : i + PACKET] for i in range(0, len(payload), PACKET)]
    ends = np.cumsum([len(x) for x in cut]).tolist()
    sound = _stream(serial, [PCM_MAGIC + struct.pack("<IB", RATE, 1), *cut], [0, *ends])
    note = _stream(serial ^ 0xFFFFFFFF, [NOTE_MAGIC, struct.pack("<QQ", n_bytes, len(payload))], [0, len(payload)])
    return b"".join([sound[0], note[0], *sound[1:2], *note[1:], *sound[2:]])


@dataclass
class Logical:
    """One logical stream as read back."""

    serial: int
    packets: list[bytes] = field(default_factory=list)
    #: Granule position at the end of each packet; -1 where the page doesn't say.
    granules: list[int] = field(default_factory=list)
    pages: int = 0
    ended: bool = False
    part: bytes = b""


def demux(media: bytes) -> dict[int, Logical]:
    """Logical streams by serial number; raises ValueError where a page is damaged, missing or out of place."""
    at, streams = 0, {}
    while at < len(media):
        if media[at : at + 4] != b"OggS" or len(media) < at + 27:
            raise ValueError(f"no page at byte {at}")
        version, flags, granule, serial, number, crc, n = struct.unpack_from("<BBqIIIB", media, at + 4)
        lacing = media[at + 27 : at + 27 + n]
        body_at = at + 27 + n
        end = body_at + sum(lacing)
        page = media[at:end]
        if version or len(lacing) < n or end > len(media) or page_crc(page[:22] + b"\0\0\0\0" + page[26:]) != crc:
            raise ValueError(f"damaged page at byte {at}")
        if flags & FIRST:
            streams[serial] = Logical(serial)
        s = streams.get(serial)
        if s is None or s.ended or number != s.pages or bool(flags & CONTINUED) != bool(s.part):
            raise ValueError(f"page out of place at byte {at}")
        whole = len(s.packets)
        for value in lacing:
            s.part += media[body_at : body_at + value]
            body_at += value
            if value < 255:
                s.packets.append(s.part)
                s.part = b""
        s.granules += [-1] * (len(s.packets) - whole)
        if len(s.packets) > whole:
            s.granules[-1] = granule
        s.pages, s.ended, at = s.pages + 1, bool(flags & LAST), end
    return streams


def payload_of(text: str | None) -> tuple[bytes, int]:
    raw = (text or "").encode("utf-8", "replace")
    return raw + b"\0" * (max(UNIT, -(-len(raw) // UNIT) * UNIT) - len(raw)), len(raw)


def read_features(media: bytes) -> dict:
    """What the stored bytes hold: payload, its unpadded length and the features of the sound."""
    streams = list(demux(media).values())
    sound = next(s for s in streams if s.packets[0].startswith(PCM_MAGIC))
    note = next(s for s in streams if s.packets[0].startswith(NOTE_MAGIC))
    rate, _ = struct.unpack_from("<IB", sound.packets[0], len(PCM_MAGIC))
    n_bytes, n_payload = struct.unpack("<QQ", note.packets[1])
    payload = b"".join(sound.packets[1:])
    if len(payload) != n_payload or sound.granules[-1] != n_payload or not all(s.ended and not s.part for s in streams):
        raise ValueError("a stream is not whole")
    x = np.frombuffer(payload, np.uint8).astype(np.int32) - 128
    bands = np.bincount((x + 128) >> 5, minlength=8)
    stamps = [g / rate for g in sound.granules[1:] if g >= 0]
    feature = f"s={sound.granules[-1] / rate:.3f};pages={sound.pages};packets={len(sound.packets) - 1};stamps={len(stamps)};mean={int(x.sum())};energy={int((x * x).sum(dtype=np.int64))};turns={int(np.count_nonzero(np.diff(np.signbit(x))))};bands={','.join(map(str, bands.tolist()))}"
    return {"n_bytes": n_bytes, "payload": payload, "feature": feature}


def encode_media(docs: DataFrame, text_col: str = "text", out: str = "media") -> DataFrame:
    """Add the column ``out``: the text's payload in Ogg pages."""
    small_batches(docs.sparkSession)

    @F.pandas_udf("binary")
    def store(texts: pd.Series) -> pd.Series:
        return pd.Series([mux(*payload_of(t)) for t in texts], dtype=object)

    return docs.withColumn(out, store(F.col(text_col).cast("string")))


def decode_media(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """(id, media) -> what was read back from the stored bytes of each row."""
    kind = dict(media.dtypes)[id_col]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in batches:
            out = []
            for i, m in zip(d[id_col], d[media_col], strict=True):
                m = bytes(m)
                x = read_features(m)
                out.append((i, x["n_bytes"], len(x["payload"]), hashlib.sha256(x["payload"]).hexdigest(), zlib.crc32(x["payload"][-UNIT:]), len(m), hashlib.sha256(m).hexdigest(), x["feature"]))
            yield pd.DataFrame(out, columns=[id_col, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]).astype({id_col: d[id_col].dtype})

    schema = f"{id_col} {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return media.select(id_col, media_col).mapInPandas(read, schema)
