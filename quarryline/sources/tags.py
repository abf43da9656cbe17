"""Tags read back from written images (VAL-01..04): directories of TIFF and EXIF, XMP packets, IPTC records.

``read_tags`` takes path and content and gives one row a file: facts of its header (for outputs.image_problems), its tags, and an
error if a store of tags is there but can't be read, which is never the same as a file without tags. Directories, segments
and records are byte structures, walked in Python where the bytes are; XMP is parsed by Spark's own XML functions.

Null or empty content and formats that aren't known are errors of their file. A file's error leaves other files alone.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Tag numbers of TIFF and EXIF, and sizes of their value types.
SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8, 13: 4}
FORMATS = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 13: "I"}
WIDTH, HEIGHT, COMPRESSION, XMP_PACKET, IPTC_BLOCK, EXIF_POINTER = 256, 257, 259, 700, 33723, 0x8769
IMAGE_TAGS = {270: "exif:ImageDescription", 271: "exif:Make", 272: "exif:Model", 305: "exif:Software"}
EXIF_TAGS = {36867: "exif:DateTimeOriginal", 36868: "exif:DateTimeDigitized", 36881: "exif:OffsetTimeOriginal", 36882: "exif:OffsetTimeDigitized"}
# Datasets of IPTC's application record, the resource that holds them in a JPEG, names of JPEG segments.
IPTC_TAGS = {(2, 5): "iptc:ObjectName", (2, 25): "iptc:Keywords"}
IPTC_RESOURCE = 0x0404
EXIF_SEGMENT, XMP_SEGMENT, IPTC_SEGMENT = b"Exif\0\0", b"http://ns.adobe.com/xap/1.0/\0", b"Photoshop 3.0\0"
FRAMES = {*range(0xC0, 0xD0)} - {0xC4, 0xC8, 0xCC}

TAG = "struct<tag:string,value:string>"
READ = f"fmt string, width long, height long, compression long, sampling array<struct<h:int,v:int>>, tags array<{TAG}>, xmp binary, error string"
#: What is read of an XMP packet, prefixes left out: a title, subjects, as elements or (short form) as attributes.
_ITEM = "array<struct<_lang:string,_VALUE:string>>"
_SUBJECT, _TITLE = f"struct<Bag:struct<li:{_ITEM}>,Seq:struct<li:{_ITEM}>,_VALUE:string>", f"struct<Alt:struct<li:{_ITEM}>,_VALUE:string>"
XMP = f"RDF struct<Description:array<struct<_title:string,_subject:string,subject:{_SUBJECT},title:{_TITLE}>>>, Description array<struct<_title:string,_subject:string,subject:{_SUBJECT},title:{_TITLE}>>, _bad string"


class TagError(ValueError):
    """A store of tags that is there and can't be read."""


class Directories:
    """The directories of a TIFF structure: entries by number, values where they stand."""

    def __init__(self, data: bytes):
        self.data = data
        order = {b"II": "<", b"MM": ">"}.get(data[:2])
        if order is None or len(data) < 8 or struct.unpack_from(order + "H", data, 2)[0] != 42:
            raise TagError("no TIFF header")
        self.order = order
        self.first = self.number("I", 4)

    def number(self, kind: str, at: int) -> int:
        try:
            return struct.unpack_from(self.order + kind, self.data, at)[0]
        except struct.error as e:
            raise TagError(f"a directory is cut at byte {at}") from e

    def entries(self, at: int, seen: set[int]) -> dict[int, object]:
        """Tag number -> text, bytes, number or tuple of numbers. The first of equal numbers counts."""
        if at in seen:
            raise TagError("directories lead in a circle")
        seen.add(at)
        out: dict[int, object] = {}
        for k in range(self.number("H", at)):
            e = at + 2 + 12 * k
            tag, kind, count = self.number("H", e), self.number("H", e + 2), self.number("I", e + 4)
            size = SIZES.get(kind, 0) * count
            where = e + 8 if size <= 4 else self.number("I", e + 8)
            if where + size > len(self.data):
                raise TagError(f"tag {tag} reaches beyond the file")
            out.setdefault(tag, self.value(kind, count, where, size))
        return out

    def value(self, kind: int, count: int, at: int, size: int) -> object:
        raw = self.data[at : at + size]
        if kind == 2:
            return raw.decode("utf-8", "replace").rstrip("\0")
        if kind in (5, 10):
            pairs = struct.unpack(f"{self.order}{2 * count}{'I' if kind == 5 else 'i'}", raw)
            return tuple(f"{a}/{b}" for a, b in zip(pairs[::2], pairs[1::2], strict=True))
        if kind in FORMATS and not (kind in (1, 6) and count > 4):
            values = struct.unpack(f"{self.order}{count}{FORMATS[kind]}", raw)
            return values[0] if count == 1 else values
        return raw


def text_of(value: object) -> str:
    """A value as text: bytes as UTF-8 without padding at the end, several numbers with spaces between them."""
    if isinstance(value, bytes):
        return value.decode("utf-8", "replace").rstrip("\0")
    return " ".join(map(str, value)) if isinstance(value, tuple) else str(value)


def directory_tags(data: bytes) -> tuple[dict[int, object], list[tuple[str, str]]]:
    """The first directory, and the known tags of it and of its EXIF directory; tags that aren't there are absent."""
    d, seen = Directories(data), set()
    image = d.entries(d.first, seen)
    tags = [(name, text_of(image[k])) for k, name in IMAGE_TAGS.items() if k in image]
    if EXIF_POINTER in image:
        at = image[EXIF_POINTER]
        if not isinstance(at, int):
            raise TagError("the pointer to the EXIF directory is no number")
        exif = d.entries(at, seen)
        tags += [(name, text_of(exif[k])) for k, name in EXIF_TAGS.items() if k in exif]
    return image, tags


def iptc_tags(data: bytes) -> list[tuple[str, str]]:
    """Known datasets of an IIM block, in order, however long; texts are UTF-8, else Latin-1."""
    out, at = [], 0
    while at + 5 <= len(data) and data[at] == 0x1C:
        record, dataset, size = struct.unpack_from(">BBH", data, at + 1)
        at += 5
        if size & 0x8000:
            width = size & 0x7FFF
            if not 0 < width <= 8 or at + width > len(data):
                raise TagError("an IPTC length is cut")
            size = int.from_bytes(data[at : at + width], "big")
            at += width
        if at + size > len(data):
            raise TagError("an IPTC record is cut")
        if (record, dataset) in IPTC_TAGS:
            raw = data[at : at + size]
            try:
                text = raw.decode("utf-8")
            except UnicodeDecodeError:
                text = raw.decode("latin-1")
            out.append((IPTC_TAGS[record, dataset], text))
        at += size
    if data[at:].strip(b"\0"):
        raise TagError("bytes that are no IPTC record")
    return out


def resources(data: bytes) -> Iterator[tuple[int, bytes]]:
    """(number, content) of image resources; names and contents are padded to even lengths."""
    at = 0
    while at + 12 <= len(data) and data[at : at + 4] == b"8BIM":
        number, name = struct.unpack_from(">HB", data, at + 4)
        at += 6 + (name + 2) // 2 * 2
        if at + 4 > len(data):
            raise TagError("an image resource is cut")
        size = struct.unpack_from(">I", data, at)[0]
        if at + 4 + size > len(data):
            raise TagError("an image resource is cut")
        yield number, data[at + 4 : at + 4 + size]
        at += 4 + (size + 1) // 2 * 2


def segments(data: bytes) -> Iterator[tuple[int, bytes]]:
    """(marker, content) of a JPEG's segments before its first scan."""
    at = 2
    while True:
        while at < len(data) and data[at] == 0xFF and at + 1 < len(data) and data[at + 1] == 0xFF:
            at += 1
        if at + 4 > len(data) or data[at] != 0xFF:
            raise TagError("a JPEG without a scan")
        marker = data[at + 1]
        if marker in (0xDA, 0xD9):
            return
        if marker == 0x01 or 0xD0 <= marker <= 0xD7:
            at += 2
            continue
        size = struct.unpack_from(">H", data, at + 2)[0]
        if size < 2 or at + 2 + size > len(data):
            raise TagError("a JPEG segment is cut")
        yield marker, data[at + 4 : at + 2 + size]
        at += 2 + size


def read_image(data: bytes | None) -> tuple:
    """A file's bytes -> READ."""
    facts: dict[str, object] = dict.fromkeys(("fmt", "width", "height", "compression", "sampling", "xmp"))
    tags, error = [], None
    try:
        if not data:
            raise TagError("no content")
        if data[:2] in (b"II", b"MM"):
            facts["fmt"] = "tiff"
            image, tags = directory_tags(data)
            for name, tag in (("width", WIDTH), ("height", HEIGHT), ("compression", COMPRESSION)):
                facts[name] = image[tag] if isinstance(image.get(tag), int) else None
            block, packet = image.get(IPTC_BLOCK), image.get(XMP_PACKET)
            if block is not None:
                # Some writers declare the block as numbers of four bytes, swapped as the file's order asks.
                raw = block if isinstance(block, bytes) else b"".join(struct.pack("<I", x) for x in (block if isinstance(block, tuple) else (block,)))
                tags += iptc_tags(raw)
            facts["xmp"] = packet if isinstance(packet, bytes) else None
        elif data[:2] == b"\xff\xd8":
            facts["fmt"] = "jpeg"
            iptc = b""
            for marker, content in segments(data):
                if marker == 0xE1 and content.startswith(EXIF_SEGMENT):
                    tags += directory_tags(content[len(EXIF_SEGMENT) :])[1]
                elif marker == 0xE1 and content.startswith(XMP_SEGMENT):
                    facts["xmp"] = content[len(XMP_SEGMENT) :]
                elif marker == 0xED and content.startswith(IPTC_SEGMENT):
                    iptc += content[len(IPTC_SEGMENT) :]
                elif marker in FRAMES and len(content) >= 6:
                    _, facts["height"], facts["width"], n = struct.unpack_from(">BHHB", content)
                    facts["sampling"] = [(c >> 4, c & 15) for c in content[7 : 6 + 3 * n : 3]]
            for number, content in resources(iptc):
                if number == IPTC_RESOURCE:
                    tags += iptc_tags(content)
        else:
            raise TagError("neither TIFF nor JPEG")
    except (TagError, struct.error) as e:
        tags, error = [], str(e)
    sampling = facts["sampling"] and [{"h": h, "v": v} for h, v in facts["sampling"]]
    return facts["fmt"], facts["width"], facts["height"], facts["compression"], sampling, [{"tag": t, "value": v} for t, v in tags], facts["xmp"], error


def _read(content: pd.Series) -> pd.DataFrame:
    d = pd.DataFrame([read_image(None if b is None else bytes(b)) for b in content], columns=[c.split()[0] for c in READ.split(", ")], dtype=object)
    return d.astype({c: "Int64" for c in ("width", "height", "compression")})


def xmp_tags(packet: Column) -> Column:
    """Bytes of an XMP packet -> struct(tags, error): title (x-default, else the first) and subjects; an error if it is there and no XML.

    Spark parses it; elements go by their names without prefixes.
    """
    xml = F.regexp_extract(F.trim(F.decode(packet, "UTF-8")), r"(?s)^(?:﻿|\s|<\?.*?\?>)*(.*?)(?:\s|<\?.*?\?>|\u0000)*$", 1)
    parsed = F.from_xml(xml, XMP, {"ignoreNamespace": "true", "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad", "rowTag": "xmpmeta"})
    return F.when(packet.isNotNull() & (F.octet_length(packet) > 0), F.struct(parsed.alias("p"), xml.alias("xml")))


def _texts(items: Column) -> Column:
    return F.filter(F.transform(F.coalesce(items, F.array()), lambda x: x["_VALUE"]), lambda v: v.isNotNull())


def read_tags(files: DataFrame, content: str = "content") -> DataFrame:
    """Adds fmt, width, height, compression, sampling, tags (array of tag and value, several of one tag in order) and error; content goes."""
    kept = [c for c in files.columns if c != content]
    d = files.withColumn("_t", F.pandas_udf(_read, READ)(F.col(content))).select(*kept, "_t.*")
    d = d.withColumn("_x", xmp_tags(F.col("xmp")))
    described = F.coalesce(F.col("_x.p.RDF.Description"), F.col("_x.p.Description"), F.array())
    title = F.flatten(F.transform(described, lambda x: F.coalesce(x["title"]["Alt"]["li"], F.array())))
    default = F.filter(title, lambda i: i["_lang"] == "x-default")
    short = F.filter(F.flatten(F.transform(described, lambda x: F.array(x["title"]["_VALUE"], x["_title"]))), lambda v: v.isNotNull() & (F.trim(v) != ""))
    found = F.coalesce(F.get(_texts(default), F.lit(0)), F.get(_texts(title), F.lit(0)), F.get(short, F.lit(0)))
    listed = F.flatten(F.transform(described, lambda x: F.concat(_texts(x["subject"]["Bag"]["li"]), _texts(x["subject"]["Seq"]["li"]), F.filter(F.array(x["subject"]["_VALUE"], x["_subject"]), lambda v: v.isNotNull() & (F.trim(v) != "")))))
    pair = lambda name, v: F.struct(F.lit(name).alias("tag"), v.alias("value"))
    xmp = F.concat(F.when(found.isNotNull(), F.array(pair("xmp:title", found))).otherwise(F.array().cast(f"array<{TAG}>")), F.transform(listed, lambda v: pair("xmp:subject", v)))
    broken = F.col("_x").isNotNull() & (F.col("_x.p").isNull() | F.col("_x.p._bad").isNotNull() | ~F.col("_x.xml").startswith("<"))
    error = F.coalesce("error", F.when(broken, F.lit("the XMP packet can't be parsed")))
    d = d.withColumn("error", error)
    return d.withColumn("tags", F.when(F.col("error").isNull(), F.concat("tags", xmp)).otherwise(F.array().cast(f"array<{TAG}>"))).drop("xmp", "_x")


def tag_rows(read: DataFrame, *keys: str) -> DataFrame:
    """keys, tag and value, a row a tag of files that could be read."""
    return read.where("error is null").select(*keys, F.explode("tags").alias("_t")).select(*keys, "_t.tag", "_t.value")


def read_back_problems(expected: DataFrame, read: DataFrame) -> DataFrame:
    """Expected (path, tag, value, forbidden) against read files: (path, tag, problem).

    A file that can't be read, or isn't there, has one problem with a null tag, and its other checks are left out.
    """
    from quarryline.operators.compare import tag_problem

    # One row a path on either side: files are read once, and what is expected of a file meets all its tags in a row.
    asked = expected.groupBy("path").agg(F.collect_list(F.struct("tag", "value", "forbidden")).alias("asked"))
    found = read.groupBy("path").agg(F.collect_list(F.concat(F.lit("tags can't be read: "), "error")).alias("failed"), F.count("*").alias("files"), F.flatten(F.collect_list("tags")).alias("tags"))
    d = asked.join(found, "path", "left")
    row = lambda tag, problem: F.struct(tag.alias("tag"), problem.alias("problem"))
    none = F.lit(None).cast("string")
    failed = F.transform(F.when(F.col("files").isNull(), F.array(F.lit("no such file"))).otherwise(F.col("failed")), lambda p: row(none, p))
    # Files that can't be read have no tags.
    values = lambda tag: F.transform(F.filter("tags", lambda t: t["tag"] == tag), lambda t: t["value"])
    checked = F.transform("asked", lambda e: row(e["tag"], tag_problem(e["forbidden"], e["value"], values(e["tag"]))))
    some = F.when(F.col("files") > F.size("failed"), F.filter(checked, lambda r: r["problem"].isNotNull()))
    return d.select("path", F.explode(F.concat(failed, F.coalesce(some, F.array().cast("array<struct<tag:string,problem:string>>")))).alias("_p")).select("path", "_p.*")
