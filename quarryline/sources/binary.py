"""Binary parts of photographs (SRC-04, SRC-07..10, BIN-01..03, STR-01, PIX-01): readers over bytes, as UDTFs and UDFs.

Errors are values: a reader returns what it could tell and the errors as texts, and no task fails on bad bytes.
"""

from __future__ import annotations

import datetime
import json
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The compound document's marks, the property set's byte order, and type codes.
MAGIC = bytes.fromhex("d0cf11e0a1b11ae1")
END_OF_CHAIN, NO_STREAM = 0xFFFFFFFE, 0xFFFFFFFF
VECTOR, ARRAY = 0x1000, 0x2000
FORMATS = {2: "<h", 3: "<i", 4: "<f", 5: "<d", 7: "<d", 10: "<I", 16: "<b", 17: "<B", 18: "<H", 19: "<I", 20: "<q", 21: "<Q", 22: "<i", 23: "<I"}
TYPE_NAMES = {0: "EMPTY", 1: "NULL", 2: "I2", 3: "I4", 4: "R4", 5: "R8", 6: "CY", 7: "DATE", 8: "BSTR", 10: "ERROR", 11: "BOOL", 12: "VARIANT", 16: "I1", 17: "UI1", 18: "UI2", 19: "UI4", 20: "I8", 21: "UI8", 22: "INT", 23: "UINT", 30: "LPSTR", 31: "LPWSTR", 64: "FILETIME", 65: "BLOB", 66: "STREAM", 67: "STORAGE", 70: "BLOB_OBJECT", 71: "CF", 72: "CLSID"}
CODE_PAGES = {437: "cp437", 850: "cp850", 852: "cp852", 866: "cp866", 932: "cp932", 936: "gbk", 949: "cp949", 950: "cp950", 1200: "utf-16-le", 1250: "cp1250", 1251: "cp1251", 1252: "cp1252", 1253: "cp1253", 1254: "cp1254", 10000: "mac-roman", 28591: "latin-1", 65001: "utf-8"}


def type_name(code: int) -> str:
    base = TYPE_NAMES.get(code & 0x0FFF, f"0x{code & 0x0FFF:04X}")
    return "".join(["VECTOR|" * bool(code & VECTOR), "ARRAY|" * bool(code & ARRAY), base])


def decode_text(raw: bytes, page: int | None) -> str:
    codec = CODE_PAGES.get((page or 1252) & 0xFFFF, "cp1252")
    if codec == "utf-16-le":
        return raw.decode(codec, "replace").split("\0")[0]
    return raw.split(b"\0")[0].decode(codec, "replace")


@dataclass
class Compound:
    """Streams of a compound document by path."""

    streams: dict[str, bytes] = field(default_factory=dict)
    error: str = ""


def read_compound(data: bytes) -> Compound:
    """The streams of a compound document: sector chains, the directory tree and the mini stream. Never raises."""
    out = Compound()
    if data[:8] != MAGIC:
        out.error = "not a compound document"
        return out
    try:
        sector, mini = 1 << struct.unpack_from("<H", data, 30)[0], 1 << struct.unpack_from("<H", data, 32)[0]
        first_dir, cutoff, first_mini = struct.unpack_from("<I4xII", data, 48)
        at = lambda n: data[(n + 1) * sector : (n + 2) * sector]
        fats = list(struct.unpack_from("<109I", data, 76))
        more = struct.unpack_from("<I", data, 68)[0]
        while more < END_OF_CHAIN - 3 and len(fats) < 1 << 20:
            block = struct.unpack(f"<{sector // 4}I", at(more))
            fats += block[:-1]
            more = block[-1]
        table = [x for f in fats if f < END_OF_CHAIN - 3 for x in struct.unpack(f"<{sector // 4}I", at(f).ljust(sector, b"\xff"))]

        def chain(start: int, links: list[int], piece) -> bytes:
            parts, seen = [], set()
            while start < len(links) and start not in seen:
                seen.add(start)
                parts.append(piece(start))
                start = links[start]
            return b"".join(parts)

        directory = chain(first_dir, table, at)
        entries = [directory[k : k + 128] for k in range(0, len(directory) - 127, 128)]
        root_start = struct.unpack_from("<I", entries[0], 116)[0]
        mini_data = chain(root_start, table, at)
        mini_raw = chain(first_mini, table, at)
        mini_table = list(struct.unpack(f"<{len(mini_raw) // 4}I", mini_raw[: len(mini_raw) // 4 * 4]))
        stack, seen = [(struct.unpack_from("<I", entries[0], 76)[0], "")], set()
        while stack:
            k, above = stack.pop()
            if k >= len(entries) or k in seen:
                continue
            seen.add(k)
            e = entries[k]
            name = e[: max(0, struct.unpack_from("<H", e, 64)[0] - 2)].decode("utf-16-le", "replace")
            left, right, child = struct.unpack_from("<III", e, 68)
            stack += [(left, above), (right, above)]
            if e[66] == 1:
                stack.append((child, f"{above}{name}/"))
            elif e[66] == 2:
                start, size = struct.unpack_from("<II", e, 116)
                raw = chain(start, mini_table, lambda n: mini_data[n * mini : (n + 1) * mini]) if size < cutoff else chain(start, table, at)
                out.streams[above + name] = raw[:size]
    except (struct.error, IndexError) as e:
        out.error = f"damaged document: {e}"
    return out


def filetime(ticks: int) -> str | None:
    if ticks <= 0:
        return None
    try:
        return (datetime.datetime(1601, 1, 1) + datetime.timedelta(microseconds=ticks // 10)).isoformat(sep=" ")
    except OverflowError:
        return None


def typed_value(data: bytes, at: int, code: int, page: int | None) -> tuple[object, int]:
    """The value at a place and the place after it. An ARRAY flag is named but its value reads as a bare one."""
    base = code & 0x0FFF
    if code & VECTOR:
        n = struct.unpack_from("<I", data, at)[0]
        at += 4
        if n > len(data):
            raise ValueError(f"vector of {n} values in {len(data)} bytes")
        out = []
        for _ in range(n):
            value, at = typed_value(data, at, base, page)
            if base in (8, 30, 31, 65, 70, 71, 12):
                at += -at % 4
            out.append(value)
        return out, at
    if base in (0, 1):
        return None, at
    if base in FORMATS:
        return struct.unpack_from(FORMATS[base], data, at)[0], at + struct.calcsize(FORMATS[base])
    if base == 6:
        return struct.unpack_from("<q", data, at)[0] / 10000.0, at + 8
    if base == 11:
        return struct.unpack_from("<h", data, at)[0] != 0, at + 2
    if base == 64:
        return filetime(struct.unpack_from("<Q", data, at)[0]), at + 8
    if base == 72:
        return _bytes(data, at, 16).hex(), at + 16
    if base == 12:
        inner = struct.unpack_from("<I", data, at)[0]
        return typed_value(data, at + 4, inner, page)
    if base in (8, 30, 66, 67, 65, 70, 71, 31):
        n = struct.unpack_from("<I", data, at)[0] * (2 if base == 31 else 1)
        raw = _bytes(data, at + 4, n)
        if base == 31:
            return raw.decode("utf-16-le", "replace").split("\0")[0], at + 4 + n
        if base in (65, 70, 71):
            return {"length": n, "head": raw[:64].hex(), **sniff(raw, base)}, at + 4 + n
        return decode_text(raw, page), at + 4 + n
    raise ValueError(f"unknown type {type_name(code)}")


def _bytes(data: bytes, at: int, n: int) -> bytes:
    if at + n > len(data):
        raise ValueError(f"{n} bytes wanted, {max(0, len(data) - at)} there")
    return data[at : at + n]


# Channel numbers of the colour spaces.
CHANNELS = {"NIF_RGB": [0x00030000, 0x00030001, 0x00030002], "PhotoYCC": [0x00020000, 0x00020001, 0x00020002]}


def sniff(raw: bytes, base: int) -> dict:
    """What a blob seems to be."""
    if base == 71:
        return {"kind": "clipboard"} | ({"width": struct.unpack_from("<i", raw, 12)[0], "height": struct.unpack_from("<i", raw, 16)[0]} if len(raw) >= 20 else {})
    if len(raw) == 20:
        free, count, *channels = struct.unpack("<5I", raw)
        space = next((n for n, c in CHANNELS.items() if channels == c), "UNKNOWN")
        return {"kind": "colour", "uncalibrated": bool(free), "channels": count, "channel_ids": [f"0x{c:08X}" for c in channels], "colour_space": space}
    if raw[:2] == b"\xff\xd8":
        return {"kind": "jpeg_tables", "whole": raw.endswith(b"\xff\xd9")}
    return {"kind": "generic"}


def property_rows(data: bytes) -> Iterator[tuple]:
    """(section_ix, fmtid, pid, type_code, type_name, value as JSON, raw, error) of a property set; an error is a row too."""
    bad = lambda ix, why: (ix, None, None, None, None, None, None, why)
    try:
        order, _, _, _, sections = struct.unpack_from("<HHI16sI", data, 0)
    except struct.error:
        yield bad(None, f"header cut at {len(data)} bytes")
        return
    if order != 0xFFFE:
        yield bad(None, f"byte order mark is 0x{order:04X}")
        return
    there = max(0, len(data) - 28) // 20
    if sections > there:
        yield bad(None, f"{sections} sections in {len(data)} bytes")
    for ix in range(min(sections, there)):
        try:
            fmtid, start = data[28 + 20 * ix : 44 + 20 * ix].hex(), struct.unpack_from("<I", data, 44 + 20 * ix)[0]
            size, n = struct.unpack_from("<II", data, start)
            if n > len(data) // 8:
                raise ValueError(f"{n} properties in {len(data)} bytes")
            found = [struct.unpack_from("<II", data, start + 8 + 8 * k) for k in range(n)]
        except (struct.error, ValueError) as e:
            yield bad(ix, f"section {ix}: {e}")
            continue
        section = data[start : start + size] if size else data[start:]
        # The code page first: texts before it need it.
        page = None
        for pid, at in found:
            if pid == 1 and at + 6 <= len(section):
                page = struct.unpack_from("<H", section, at + 4)[0]
        for pid, at in found:
            try:
                code = struct.unpack_from("<I", section, at)[0]
                if pid == 0:
                    continue
                value, end = typed_value(section, at + 4, code, page)
                yield ix, fmtid, pid, code, type_name(code), json.dumps(value), section[at + 4 : end], None
            except (struct.error, ValueError) as e:
                yield ix, fmtid, pid, None, None, None, None, f"property {pid}: {e}"


PROPERTY = "section_ix int, fmtid string, pid long, type_code int, type_name string, value string, raw binary, error string"


# Names of the property sets that a photograph holds.
SETS = ["SummaryInformation", "Global Info", "Extension List", "Operation 000001", "Transform 000001", "Data Object 000001", "Data Object 000002"]
STORE_SETS = ["Image Contents", "Image Info", "SummaryInformation"]
PROPERTY_STREAMS = [*(f"\x05{n}" for n in SETS), *(f"Data Object Store 000001/\x05{n}" for n in STORE_SETS)]


def property_streams(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    """keys and files' bytes -> a row a property set: stream, data, error. Sets of extension storages follow the standard ones."""

    def streams(data: bytes | None) -> Iterator[tuple]:
        if data is None:
            yield None, None, "no content"
            return
        c = read_compound(data)
        if c.error:
            yield None, None, c.error
        for name in PROPERTY_STREAMS:
            if name in c.streams:
                yield name, c.streams[name], None
        for name in sorted(c.streams):
            if name not in PROPERTY_STREAMS and name.rpartition("/")[2].startswith("\x05"):
                yield name, c.streams[name], None

    return _rows(df, keys, column, streams, "stream string, data binary, error string")


def file_properties(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    """keys and files' bytes -> keys, stream and a row a property (PROPERTY), errors of files and sets as rows."""
    found = property_streams(df, keys, column)
    parsed = parse_properties(found.where("stream is not null"), [*keys, "stream"], "data")
    nothing = [F.lit(None).cast(x.split()[1]).alias(x.split()[0]) for x in PROPERTY.split(", ")[:-1]]
    return parsed.unionByName(found.where("stream is null").select(*keys, "stream", *nothing, "error"))


def _each(rows_of, keys: int, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of a reader over the last column, after the first ones, which are kept."""
    for d in batches:
        out = [(*r[:keys], *x) for r in d.itertuples(index=False) for x in rows_of(None if r[keys] is None else bytes(r[keys]))]
        yield pd.DataFrame(out, dtype=object)


def _rows(df: DataFrame, keys: list[str], column: str, reader, schema: str) -> DataFrame:
    kinds = dict(df.dtypes)
    full = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", " + schema
    n = len([x for x in full.split(", ")])

    def shaped(batches):
        for d in _each(reader, len(keys), batches):
            yield d if len(d) else pd.DataFrame({k: [] for k in range(n)})

    return df.select(*keys, column).mapInPandas(lambda it: (d.set_axis([x.split()[0].strip("`") for x in full.split(", ")], axis=1) for d in shaped(it)), full)


def parse_properties(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    """keys and a column of property-set bytes -> keys and a row a property (PROPERTY)."""
    return _rows(df, keys, column, lambda b: property_rows(b or b""), PROPERTY)


def inventory(content: Column) -> Column:
    """struct(is_ole, streams sorted, error) of a file's bytes; null bytes are told apart from what isn't a document."""

    @F.pandas_udf("is_ole boolean, streams array<string>, error string")
    def read(data: pd.Series) -> pd.DataFrame:
        rows = []
        for b in data:
            c = read_compound(bytes(b)) if b is not None else None
            rows.append((None, [], "no content") if c is None else (bytes(b[:8]) == MAGIC, sorted(c.streams), c.error))
        return pd.DataFrame(rows, columns=["is_ole", "streams", "error"])

    return read(content)


def tile_rows(data: bytes | None) -> Iterator[tuple]:
    """(width, height, tiles, tile_ix, offset, size, compression, table_id, error) of a subimage header."""
    data = data or b""
    bad = lambda why: (None, None, None, None, None, None, None, None, why)
    if len(data) < 64:
        yield bad(f"header of {len(data)} bytes")
        return
    if struct.unpack_from("<H", data)[0] != 0xFFFE:
        yield bad("wrong byte order mark")
        return
    width, height, n = struct.unpack_from("<III", data, 32)
    if len(data) < 64 + 16 * n:
        yield bad(f"{n} tiles in {len(data)} bytes")
        return
    for k in range(n):
        offset, size, kind, sub = struct.unpack_from("<IIII", data, 64 + 16 * k)
        yield width, height, n, k, offset, size, kind, sub >> 24, None


def parse_tiles(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    return _rows(df, keys, column, tile_rows, "width long, height long, tiles long, tile_ix long, offset long, size long, compression long, table_id long, error string")


def thumbnail(data: bytes | None) -> tuple[int | None, int | None, bytes | None, str | None]:
    """(width, height, RGB bytes from the top row on, error) of a clipboard value with a 24-bit bitmap."""
    why = None
    if data is None or len(data) < 48:
        why = "too short"
    else:
        kind, head, width, height, _, depth, packing = struct.unpack_from("<4xIIiiHHI", data)
        stride = (3 * width + 3) // 4 * 4
        for ok, text in ((kind == 8, "not a bitmap"), (head == 40, "unknown header"), (depth == 24, "not 24 bits"), (packing == 0, "packed"), (width > 0 and height != 0, "no size"), (len(data) - 48 >= stride * abs(height), "cut")):
            if not ok:
                why = text
                break
    if why:
        return None, None, None, why
    rows = np.frombuffer(data, np.uint8, stride * abs(height), 48).reshape(abs(height), stride)[:, : 3 * width].reshape(abs(height), width, 3)[:, :, ::-1]
    return width, abs(height), (rows[::-1] if height > 0 else rows).tobytes(), None


def parse_thumbnails(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    return _rows(df, keys, column, lambda b: [thumbnail(b)], "width int, height int, rgb binary, error string")


# PhotoYCC's scales and offsets, as in functions.geometry.
LUMA, BLUE, BLUE_ZERO, RED, RED_ZERO, GREEN_BLUE, GREEN_RED = 1.3584, 2.2179, 156, 1.8215, 137, 0.194, 0.509


def ycc_image(ycc: np.ndarray) -> np.ndarray:
    """(h, w, 3) PhotoYCC bytes to RGB bytes: the same rule as functions.geometry.rgb."""
    y, c1, c2 = (ycc[..., k].astype(np.float64) for k in range(3))
    luma, blue, red = y * LUMA, (c1 - BLUE_ZERO) * BLUE, (c2 - RED_ZERO) * RED
    return np.clip(np.stack([luma + red, luma - GREEN_BLUE * blue - GREEN_RED * red, luma + blue], -1), 0, 255).astype(np.uint8)


