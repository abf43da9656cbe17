"""Images as files (SNK-04 for TIFF, SNK-10): Deflate TIFF with its tags, and PNG, by a Python data source that commits.

``df.write.format("image_files").mode("append").option("fmt", "tiff" | "png").save(root)`` takes rows of path (below root), width,
height, rgb and, for TIFF, tags (array of tag and value, named as sources.tags names them). Tasks write to a folder of the job; only
when all tasks are done are the files put in place, each at once. A job that fails, or two rows that claim one path, leaves nothing.
The root must be a folder that driver and executors mount. JPEG needs an image library that isn't here.
"""

from __future__ import annotations

import hashlib
import os
import shutil
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from quarryline.sources.tags import COMPRESSION, EXIF_POINTER, EXIF_TAGS, HEIGHT, IMAGE_TAGS, IPTC_BLOCK, IPTC_TAGS, WIDTH, XMP_PACKET, Directories, TagError

# TIFF's numbers for an RGB image in strips, Deflate, PNG's signature, IPTC's mark for UTF-8.
BITS, PHOTOMETRIC, STRIPS, SAMPLES, ROWS, COUNTS, PLANAR = 258, 262, 273, 277, 278, 279, 284
DEFLATE, RGB, CHUNKY = 8, 2, 1
ASCII, SHORT, LONG, BYTE, UNDEFINED = 2, 3, 4, 1, 7
PNG = b"\x89PNG\r\n\x1a\n"
UTF8_MARK = b"\x1c\x01\x5a\x00\x03\x1b%G"
STRIP_BYTES = 1 << 16


class ImageFileError(ValueError):
    """Rows that make no image file."""


def xmp_packet(title: str | None, subjects: list[str]) -> bytes:
    """A packet with a title (x-default) and a bag of subjects; nothing for neither."""
    if not title and not subjects:
        return b""
    body = f'<dc:title><rdf:Alt><rdf:li xml:lang="x-default">{escape(title)}</rdf:li></rdf:Alt></dc:title>' if title else ""
    if subjects:
        body += "<dc:subject><rdf:Bag>" + "".join(f"<rdf:li>{escape(s)}</rdf:li>" for s in subjects) + "</rdf:Bag></dc:subject>"
    rdf = f'<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#"><rdf:Description rdf:about="" xmlns:dc="http://purl.org/dc/elements/1.1/">{body}</rdf:Description></rdf:RDF>'
    return f'<?xpacket begin="﻿" id="W5M0MpCehiHzreSzNTczkc9d"?><x:xmpmeta xmlns:x="adobe:ns:meta/">{rdf}</x:xmpmeta><?xpacket end="w"?>'.encode()


def iptc_block(tags: list[tuple[str, str]]) -> bytes:
    """IPTC records of the tags that are such, with extended lengths where they are long."""
    number = {name: k for k, name in IPTC_TAGS.items()}
    out = b""
    for name, value in tags:
        if name in number:
            raw = value.encode()
            size = struct.pack(">H", len(raw)) if len(raw) < 0x8000 else struct.pack(">HI", 0x8004, len(raw))
            out += struct.pack(">BBB", 0x1C, *number[name]) + size + raw
    return UTF8_MARK + out if out else b""


def _directory(at: int, entries: dict[int, tuple[int, int, bytes]]) -> bytes:
    """A directory that begins at a byte of the file, and after it the values that don't fit its entries."""
    head, rest = struct.pack("<H", len(entries)), b""
    beyond = at + 2 + 12 * len(entries) + 4
    for tag in sorted(entries):
        kind, count, raw = entries[tag]
        if len(raw) <= 4:
            head += struct.pack("<HHI", tag, kind, count) + raw.ljust(4, b"\0")
        else:
            head += struct.pack("<HHII", tag, kind, count, beyond + len(rest))
            rest += raw + b"\0" * (len(raw) % 2)
    return head + struct.pack("<I", 0) + rest


def _checked(width: int, height: int, rgb: bytes) -> None:
    if not (width and height and width > 0 and height > 0) or rgb is None or len(rgb) != 3 * width * height:
        raise ImageFileError(f"{0 if rgb is None else len(rgb)} bytes are no image of {width} by {height}")


def encode_tiff(width: int, height: int, rgb: bytes, tags: list[tuple[str, str]] = ()) -> bytes:
    """An RGB image in Deflate strips; tags with null values are left out."""
    _checked(width, height, rgb)
    tags = [(t, v) for t, v in tags if v is not None]
    rows = max(1, STRIP_BYTES // (3 * width))
    strips = [zlib.compress(rgb[k : k + 3 * width * rows]) for k in range(0, len(rgb), 3 * width * rows)]
    offsets, at = [], 8
    for s in strips:
        offsets.append(at)
        at += len(s) + len(s) % 2
    short = lambda *v: (SHORT, len(v), struct.pack(f"<{len(v)}H", *v))
    long = lambda *v: (LONG, len(v), struct.pack(f"<{len(v)}I", *v))
    text = lambda v: (ASCII, len(v.encode()) + 1, v.encode() + b"\0")
    image = {
        WIDTH: long(width), HEIGHT: long(height), BITS: short(8, 8, 8), COMPRESSION: short(DEFLATE), PHOTOMETRIC: short(RGB), STRIPS: long(*offsets),
        SAMPLES: short(3), ROWS: long(rows), COUNTS: long(*map(len, strips)), PLANAR: short(CHUNKY),
    }
    by_name = dict(tags)
    image |= {k: text(by_name[name]) for k, name in IMAGE_TAGS.items() if name in by_name}
    exif = {k: text(by_name[name]) for k, name in EXIF_TAGS.items() if name in by_name}
    packet, block = xmp_packet(by_name.get("xmp:title"), [v for t, v in tags if t == "xmp:subject"]), iptc_block(tags)
    for tag, kind, raw in ((XMP_PACKET, BYTE, packet), (IPTC_BLOCK, UNDEFINED, block)):
        if raw:
            image[tag] = (kind, len(raw), raw)
    inner = b""
    if exif:
        inner, image[EXIF_POINTER] = _directory(at, exif), long(at)
        inner += b"\0" * (len(inner) % 2)
    body = b"".join(s + b"\0" * (len(s) % 2) for s in strips) + inner
    return b"II*\0" + struct.pack("<I", 8 + len(body)) + body + _directory(8 + len(body), image)


def tiff_pixels(data: bytes) -> tuple[int, int, bytes]:
    """(width, height, RGB bytes) of an RGB image in Deflate strips."""
    d = Directories(data)
    e = d.entries(d.first, set())
    if e.get(COMPRESSION) not in (DEFLATE, 32946) or e.get(SAMPLES) != 3 or e.get(BITS) != (8, 8, 8):
        raise TagError("not an RGB image in Deflate strips")
    every = lambda v: v if isinstance(v, tuple) else (v,)
    rgb = b"".join(zlib.decompress(data[a : a + n]) for a, n in zip(every(e[STRIPS]), every(e[COUNTS]), strict=True))
    return e[WIDTH], e[HEIGHT], rgb


def encode_png(width: int, height: int, rgb: bytes) -> bytes:
    """An RGB image of 8 bits, lines unfiltered."""
    _checked(width, height, rgb)

    def chunk(kind: bytes, raw: bytes) -> bytes:
        return struct.pack(">I", len(raw)) + kind + raw + struct.pack(">I", zlib.crc32(kind + raw))

    lines = b"".join(b"\0" + rgb[k : k + 3 * width] for k in range(0, len(rgb), 3 * width))
    return PNG + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


def png_pixels(data: bytes) -> tuple[int, int, bytes]:
    """(width, height, RGB bytes) of what encode_png wrote; checksums are held against the chunks."""
    if data[:8] != PNG:
        raise TagError("no PNG")
    at, packed, size = 8, b"", None
    while at < len(data):
        n, kind = struct.unpack_from(">I4s", data, at)
        raw = data[at + 8 : at + 8 + n]
        if struct.unpack_from(">I", data, at + 8 + n)[0] != zlib.crc32(kind + raw):
            raise TagError("a PNG chunk is damaged")
        if kind == b"IHDR":
            size = struct.unpack_from(">II", raw)
        packed += raw if kind == b"IDAT" else b""
        at += 12 + n
    lines, (width, height) = zlib.decompress(packed), size
    return width, height, b"".join(lines[k + 1 : k + 1 + 3 * width] for k in range(0, len(lines), 1 + 3 * width))


def encoded(fmt: str, width: Column, height: Column, rgb: Column, tags: Column | None = None) -> Column:
    """A file's bytes as a column; rows that make no image are null."""

    @F.pandas_udf("binary")
    def encode(width: pd.Series, height: pd.Series, rgb: pd.Series, tags: pd.Series) -> pd.Series:
        out = []
        for w, h, raw, named in zip(width, height, rgb, tags, strict=True):
            try:
                w, h = (None if pd.isna(x) else int(x) for x in (w, h))
                pairs = [] if named is None else [(t["tag"], t["value"]) for t in named]
                out.append(encode_tiff(w, h, raw, pairs) if fmt == "tiff" else encode_png(w, h, raw))
            except ImageFileError:
                out.append(None)
        return pd.Series(out, dtype=object)

    return encode(width, height, rgb, tags if tags is not None else F.lit(None).cast("array<struct<tag:string,value:string>>"))


def stored_pixels(content: Column) -> Column:
    """struct(width, height, pixel_sha256, error) of the pixels that a stored TIFF or PNG gives back."""

    @F.pandas_udf("width int, height int, pixel_sha256 string, error string")
    def read(content: pd.Series) -> pd.DataFrame:
        rows = []
        for b in content:
            try:
                width, height, rgb = (png_pixels if b is not None and bytes(b[:8]) == PNG else tiff_pixels)(bytes(b or b""))
                rows.append((width, height, hashlib.sha256(rgb).hexdigest(), None))
            except (TagError, struct.error, zlib.error, TypeError) as e:
                rows.append((None, None, None, str(e)))
        return pd.DataFrame(rows, columns=["width", "height", "pixel_sha256", "error"]).astype({"width": "Int32", "height": "Int32"})

    return read(content)


@dataclass
class Written(WriterCommitMessage):
    """(staged, target) of the files of a task."""

    files: list[tuple[str, str]]


class ImageWriter(DataSourceWriter):
    def __init__(self, root: str, fmt: str):
        self.root, self.fmt = root, fmt
        self.staged = os.path.join(root, f".staged-{uuid.uuid4().hex}")

    def write(self, iterator: Iterator) -> Written:
        os.makedirs(self.staged, exist_ok=True)
        files = []
        for row in iterator:
            target = os.path.normpath(os.path.join(self.root, row["path"]))
            if not target.startswith(os.path.normpath(self.root) + os.sep):
                raise ImageFileError(f"{row['path']} lies outside the folder")
            if self.fmt == "tiff":
                tags = row.asDict().get("tags") or []
                data = encode_tiff(row["width"], row["height"], row["rgb"] and bytes(row["rgb"]), [(t["tag"], t["value"]) for t in tags])
            else:
                data = encode_png(row["width"], row["height"], row["rgb"] and bytes(row["rgb"]))
            name = os.path.join(self.staged, uuid.uuid4().hex)
            with open(name, "wb") as f:
                f.write(data)
            files.append((name, target))
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        files = [f for m in messages if m is not None for f in m.files]
        claimed: set[str] = set()
        for _, target in files:
            if target.lower() in claimed:
                self.abort(messages)
                raise ImageFileError(f"two images claim {target}")
            claimed.add(target.lower())
        for name, target in files:
            os.makedirs(os.path.dirname(target), exist_ok=True)
            os.replace(name, target)
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        """What is still staged goes, also what lost or repeated tasks left."""
        shutil.rmtree(self.staged, ignore_errors=True)


class ImageFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "image_files"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        fmt = self.options.get("fmt", "tiff")
        if fmt not in ("tiff", "png") or overwrite:
            raise ImageFileError(f"images are appended as tiff or png, not {'overwritten' if overwrite else fmt}")
        if missing := {"path", "width", "height", "rgb"} - set(schema.fieldNames()):
            raise ImageFileError(f"no columns {sorted(missing)}")
        return ImageWriter(self.options["path"], fmt)


def write_images(images: DataFrame, root: str, fmt: str = "tiff") -> None:
    """path, width, height, rgb (and tags) -> files below root."""
    images.sparkSession.dataSource.register(ImageFiles)
    images.write.format("image_files").mode("append").option("fmt", fmt).save(root)
