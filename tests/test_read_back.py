"""Tags and pixels read back from what is written, and from what others write."""

import hashlib
import os
import struct

import pytest
from pyspark.sql import functions as F

from quarryline.sinks import image_files as I
from quarryline.sources import tags as T

RGB = bytes(range(256)) * 3 * 25
TAGS = [("exif:Make", "Ko"), ("exif:Model", "é\0"), ("exif:DateTimeOriginal", "2001:02:03 04:05:06"), ("xmp:title", "a < b & c"), ("xmp:subject", "one"), ("xmp:subject", "two"), ("iptc:Keywords", "k"), ("iptc:Keywords", "x" * 40000), ("iptc:ObjectName", "o"), ("exif:Software", None)]


def read(spark, *contents):
    rows = T.read_tags(spark.createDataFrame(list(enumerate(contents)), "k int, content binary")).orderBy("k").collect()
    return [(r["error"], [(t["tag"], t["value"]) for t in r["tags"]]) for r in rows]


def test_tiff_round_trip(spark):
    data = I.encode_tiff(80, 80, RGB, TAGS)
    assert I.tiff_pixels(data) == (80, 80, RGB) and I.png_pixels(I.encode_png(80, 80, RGB)) == (80, 80, RGB)
    plain = I.encode_tiff(2, 1, b"123456")
    [(e, got), (e2, none)] = read(spark, data, plain)
    assert e is None and e2 is None and none == []
    assert sorted(got) == sorted((t, v.rstrip("\0")) for t, v in TAGS if v is not None)
    facts = T.read_tags(spark.createDataFrame([(data,)], "content binary")).first()
    assert (facts["fmt"], facts["width"], facts["height"], facts["compression"]) == ("tiff", 80, 80, 8)


def test_images_that_are_none():
    for w, h, rgb in ((0, 1, b""), (2, 2, b"123"), (None, 1, b"123"), (1, 1, None)):
        with pytest.raises(I.ImageFileError):
            I.encode_tiff(w, h, rgb)
    with pytest.raises(T.TagError):
        I.png_pixels(I.encode_png(1, 1, b"abc").replace(b"IDAT", b"IDAX"))


def directory(order, entries, following=0):
    return struct.pack(order + "H", len(entries)) + b"".join(entries) + struct.pack(order + "I", following)


def entry(order, tag, kind, count, value):
    raw = struct.pack(order + "I", value) if isinstance(value, int) else value
    return struct.pack(order + "HHI", tag, kind, count) + raw.ljust(4, b"\0")


def test_directories_of_either_order_and_their_faults(spark):
    big = b"MM\0*" + struct.pack(">I", 8) + directory(">", [entry(">", 271, 2, 3, b"ab\0"), entry(">", 272, 7, 4, b"m\0\0\0"), entry(">", 305, 3, 1, b"\0\x07"), entry(">", 305, 2, 2, b"x\0")])
    loop = b"II*\0" + struct.pack("<I", 8) + directory("<", [entry("<", T.EXIF_POINTER, 4, 1, 8)])
    beyond = b"II*\0" + struct.pack("<I", 8) + directory("<", [entry("<", 271, 2, 999, 20)])
    cut = b"II*\0" + struct.pack("<I", 8) + struct.pack("<H", 60000)
    text = b"II*\0" + struct.pack("<I", 8) + directory("<", [entry("<", T.EXIF_POINTER, 2, 2, b"a\0")])
    got = read(spark, big, loop, beyond, cut, text, b"II*\0\0\0", b"", None, b"%PDF", b"\xff\xd8\xff\xe1\0\x09")
    assert got[0] == (None, [("exif:Make", "ab"), ("exif:Model", "m"), ("exif:Software", "7")])
    assert [e for e, _ in got[1:]] == [
        "directories lead in a circle", "tag 271 reaches beyond the file", "a directory is cut at byte 10", "the pointer to the EXIF directory is no number", "no TIFF header", "no content", "no content", "neither TIFF nor JPEG", "a JPEG segment is cut",
    ]
    assert all(tags == [] for _, tags in got[1:])


def jpeg(*segments):
    return b"\xff\xd8" + b"".join(bytes([0xFF, m]) + struct.pack(">H", len(c) + 2) + c for m, c in segments) + b"\xff\xda\0\0"


def xmp(body):
    return jpeg((0xE1, T.XMP_SEGMENT + body.encode()))


def test_packets(spark):
    head, tail = '<x:xmpmeta xmlns:x="adobe:ns:meta/"><r:RDF xmlns:r="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:d="http://purl.org/dc/elements/1.1/">', "</r:RDF></x:xmpmeta>"
    got = read(
        spark,
        xmp(head + '<r:Description><d:title><r:Alt><r:li xml:lang="fr">un</r:li><r:li xml:lang="x-default">one</r:li></r:Alt></d:title></r:Description>' + tail),
        xmp(head + "<r:Description><d:subject><r:Bag><r:li>only</r:li></r:Bag></d:subject></r:Description>" + tail + " " * 300),
        xmp(head + '<r:Description d:title="short"/>' + tail),
        xmp("<not xml at all"), xmp("plain"), xmp('<x:xmpmeta xmlns:x="adobe:ns:meta/"></x:xmpmeta>'), jpeg((0xE0, b"JFIF")),
    )
    broken = ("the XMP packet can't be parsed", [])
    assert got == [(None, [("xmp:title", "one")]), (None, [("xmp:subject", "only")]), (None, [("xmp:title", "short")]), broken, broken, (None, []), (None, [])]


def test_records(spark):
    block = b"\x1c\x02\x19\0\x02Gr" + b"\x1c\x02\x19\0\x01\xfc" + b"\x1c\x02\x05\x80\x02\0\x03abc" + b"\x1c\x02\x78\0\x01z\0\0"
    resource = b"8BIM\x04\x04\x03abc" + struct.pack(">I", len(block)) + block
    cut = b"8BIM\x04\x04\0\0" + struct.pack(">I", 7) + b"\x1c\x02\x19\0\x09ab"
    got = read(spark, jpeg((0xED, T.IPTC_SEGMENT + b"8BIM\x04\x0b\0\0\0\0\0\x01x\0" + resource)), jpeg((0xED, T.IPTC_SEGMENT + cut)), jpeg((0xED, T.IPTC_SEGMENT + resource[:30])))
    assert got == [(None, [("iptc:Keywords", "Gr"), ("iptc:Keywords", "ü"), ("iptc:ObjectName", "abc")]), ("an IPTC record is cut", []), ("an image resource is cut", [])]


def test_one_files_failure_leaves_the_others(spark):
    good = I.encode_tiff(1, 1, b"abc", [("exif:Make", "M")])
    files = T.read_tags(spark.createDataFrame([("a", good), ("b", good[:-3]), ("c", xmp("<oops"))], "path string, content binary"))
    want = [(p, t, v, no) for p in "abcd" for t, v, no in (("exif:Make", "M", False), ("exif:Model", "X", False), ("exif:DateTimeOriginal", None, True))]
    got = {tuple(r) for r in T.read_back_problems(spark.createDataFrame(want, "path string, tag string, value string, forbidden boolean"), files).collect()}
    assert {g for g in got if g[0] == "a"} == {("a", "exif:Model", "missing")}
    assert [(p, t) for p, t, _ in sorted(got)[1:]] == [("b", None), ("c", None), ("d", None)] and len(got) == 4
    assert ("d", None, "no such file") in got


def images(spark, n=12):
    rows = [(f"a/{k % 3}/{k}.tif", 80, 80, bytearray(RGB), [("exif:Make", str(k))]) for k in range(n)]
    return spark.createDataFrame(rows, "path string, width int, height int, rgb binary, tags array<struct<tag:string,value:string>>").repartition(4)


@pytest.mark.parametrize("fmt", ["tiff", "png"])
def test_files_are_put_in_place_whole(spark, tmp_path, fmt):
    I.write_images(images(spark), str(tmp_path), fmt)
    found = {os.path.relpath(os.path.join(d, f), tmp_path): open(os.path.join(d, f), "rb").read() for d, _, fs in os.walk(tmp_path) for f in fs}
    assert set(found) == {f"a/{k % 3}/{k}.tif" for k in range(12)} and not any(x.startswith(".staged") for x in os.listdir(tmp_path))
    df = spark.createDataFrame(list(found.items()), "path string, content binary")
    assert {(r["x"]["pixel_sha256"], r["x"]["error"]) for r in df.select(I.stored_pixels(F.col("content")).alias("x")).collect()} == {(hashlib.sha256(RGB).hexdigest(), None)}
    if fmt == "tiff":
        assert {(r["path"], r["value"]) for r in T.tag_rows(T.read_tags(df), "path").collect()} == {(f"a/{k % 3}/{k}.tif", str(k)) for k in range(12)}


def test_a_job_that_fails_leaves_nothing(spark, tmp_path):
    bad = images(spark).withColumn("rgb", F.when(F.col("path").endswith("/7.tif"), F.lit(b"x")).otherwise(F.col("rgb")))
    twice = images(spark).unionByName(images(spark, 1).withColumn("path", F.upper("path")))
    outside = images(spark).withColumn("path", F.concat(F.lit("../"), "path"))
    for df, words in ((bad, "no image of 80 by 80"), (twice, "two images claim"), (outside, "outside")):
        with pytest.raises(Exception, match=words):
            I.write_images(df, str(tmp_path / "out"))
        assert not os.path.exists(tmp_path / "out") or os.listdir(tmp_path / "out") == []


@pytest.mark.parametrize("name", ["iptc_read_back", "read_back_problems", "exif_read_back", "xmp_read_back", "stored_pixels", "header_checks", "stitched_images", "code_pages"])
def test_files_made_of_a_small_table_are_many_tasks(spark, name):
    from quarryline.plans import files, written  # noqa: F401
    from quarryline.plans.bindings import QUERIES

    assert QUERIES[name](spark, "/root/testdata/sf0.001").select(F.spark_partition_id().alias("p")).distinct().count() >= 8


def test_files_are_read_once_and_problems_stay_a_row_each(spark):
    want = [("a", "iptc:Keywords", "x", False)] * 2 + [("a", "exif:Make", None, True), ("b", "exif:Make", "M", False), ("b", "exif:Model", "N", False), ("c", "exif:Make", "M", False), (None, "exif:Make", "M", False)]
    tags = [("exif:Make", "M")]
    read = spark.createDataFrame([("a", tags, None), ("b", [], "one"), ("b", [], "two"), ("b", tags, None), ("d", tags, None)], "path string, tags array<struct<tag:string,value:string>>, error string")
    out = T.read_back_problems(spark.createDataFrame(want, "path string, tag string, value string, forbidden boolean"), read)
    got = sorted((tuple(r) for r in out.collect()), key=str)
    assert got == sorted([("a", "exif:Make", "forbidden"), ("a", "iptc:Keywords", "missing"), ("a", "iptc:Keywords", "missing"), ("b", "exif:Model", "missing"), ("b", None, "tags can't be read: one"), ("b", None, "tags can't be read: two"), ("c", None, "no such file"), (None, None, "no such file")], key=str)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") + out._jdf.queryExecution().optimizedPlan().toString().count("LocalRelation") == 2
