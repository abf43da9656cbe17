import datetime as dt
import hashlib
import json

import pytest
from pyspark.sql import functions as F

from quarryline.functions import properties
from quarryline.sinks import catalogue as sinks
from quarryline.sources import binary
from tests.test_sources import property_set, text


def test_store_copy(spark, tmp_path):
    rows = []
    for name, data in (("a", b"one"), ("b", b"two"), ("c", b"bad")):
        (tmp_path / name).write_bytes(data)
        rows.append((hashlib.sha256(b"x" if name == "c" else data).hexdigest(), 3, str(tmp_path / name), f"{name}.fpx"))
    rows.append(("0" * 64, 1, str(tmp_path / "none"), "d.fpx"))
    df = spark.createDataFrame(rows, "sha256 string, size long, source_path string, store_name string")
    store = str(tmp_path / "store")
    assert tuple(sinks.copy_totals(sinks.copy_to_store(df, store)).first()) == (2, 0, 2, 6)
    assert tuple(sinks.copy_totals(sinks.copy_to_store(df, store)).first()) == (0, 2, 2, 0)
    assert sorted(p.name for p in (tmp_path / "store").iterdir()) == ["a.fpx", "b.fpx"]


def test_manifest_export(spark, tmp_path):
    e = spark.createDataFrame([("h2", ["\x05b"]), ("h1", [])], "sha256 string, streams array<string>")
    sinks.export_manifest(e, e.agg(F.count("*").alias("n")), True, str(tmp_path / "m.json"))
    raw = (tmp_path / "m.json").read_text()
    data = json.loads(raw)
    assert [x["sha256"] for x in data["entries"]] == ["h1", "h2"] and "\\u0005b" in raw and data["counts"] == {"n": 2}
    header = spark.read.option("multiLine", True).json(str(tmp_path / "m.json"))
    assert header.select(sinks.is_verified(header)).first()[0] and not e.select(sinks.is_verified(e)).first()[0]


def test_properties_to_a_row_and_a_sidecar(spark):
    import struct

    data = property_set([(0x01000002, 19, struct.pack("<I", 640)), (0x01000003, 19, struct.pack("<I", 480)), (0x10000000, 4, struct.pack("<f", 1.5)), (0x10000003, 0x1004, struct.pack("<I16f", 16, *range(16))), (0x02010002, 65, text(b"x" * 70000)), (9, 30, struct.pack("<I", 999999))])
    rows = binary.parse_properties(spark.createDataFrame([("s", data)], "sha string, data binary"), ["sha"], "data")
    d = properties.derived(rows, ["sha"]).first()
    assert (d["HighestWidth"], d["HighestHeight"], d["ResultAspectRatio"], d["SpatialOrientation"], len(d["errors"])) == (640, 480, 1.5, [float(k) for k in range(16)], 1)
    names = {r[0] for r in rows.select(properties.property_name(F.col("fmtid"), F.col("pid"))).collect()}
    assert {"HighestWidth", "Res1_SubimageColor", "SpatialOrientation", "PID_0x00000001"} <= names
    doc = json.loads(sinks.sidecars(rows, ["sha"]).first()["sidecar"])
    blob = next(p["blob"] for p in doc["properties"] if p.get("type_name") == "BLOB")
    assert blob["length"] == 70004 and "base64" not in blob and len(blob["sha256"]) == 64


def test_tag_arguments(spark):
    rows = [(dt.datetime(2001, 2, 3, 4, 5, 6), "t", ["a", "b"], "", "scan"), (None, None, None, "M", "scan"), (None, "", ["", None], None, None)]
    df = spark.createDataFrame(rows, "original timestamp_ntz, title string, keywords array<string>, make string, scanner_make string").withColumn("original_offset", F.lit("-06:00")).withColumn("path", F.col("make"))
    got = [r["arguments"] for r in sinks.tag_arguments(df).collect()]
    assert got == [
        ["-EXIF:Make=scan", "-XMP-tiff:Make=scan", "-EXIF:DateTimeOriginal=2001:02:03 04:05:06", "-XMP-photoshop:DateCreated=2001:02:03 04:05:06", "-EXIF:OffsetTimeOriginal=-06:00",
         "-IPTC:Keywords=a", "-XMP-dc:Subject=a", "-IPTC:Keywords=b", "-XMP-dc:Subject=b", "-XMP-dc:Title=t", "-IPTC:ObjectName=t", "-EXIF:ImageDescription=t"],
        ["-EXIF:Make=M", "-XMP-tiff:Make=M"], [],
    ]
    must = {(r["path"], r["tag"], r["value"], r["forbidden"]) for r in sinks.expected_tags(df).collect()}
    assert ("M", "exif:Make", "M", False) in must and ("M", "exif:DateTimeOriginal", None, True) in must and ("", "exif:DateTimeOriginal", None, True) not in must
    assert [(t["tag"], t["value"]) for t in sinks.tags_to_write(df).first()["tags"]][:2] == [("exif:Make", "scan"), ("exif:DateTimeOriginal", "2001:02:03 04:05:06")]


def test_colours_and_dates(spark):
    r = spark.createDataFrame([("PhotoYCC", None, "x"), ("odd", "2001-02-03 04:05:06", "y")], "c string, s string, d string").select(properties.colour_space(F.col("c")), properties.scan_date(F.col("s"), F.col("d")), properties.make_and_model(F.lit(" "), F.col("d"))).collect()
    assert tuple(r[0][0]) == ("PhotoYCC", False) and tuple(r[1][0]) == ("NIF_RGB", True)
    assert r[0][1]["error"] == "unreadable date x" and r[1][1]["scan_date"] == dt.datetime(2001, 2, 3, 4, 5, 6) and r[0][2] == "x"


def test_manifest_is_written_and_read_by_tasks(spark, tmp_path, monkeypatch):
    from pyspark.sql import DataFrame

    n, path = 3000, str(tmp_path / "m.json")
    monkeypatch.setattr(DataFrame, "toLocalIterator", lambda *a, **k: pytest.fail("entries go through the driver"))
    e = spark.range(n).repartition(5).select(F.sha2(F.col("id").cast("string"), 256).alias("sha256"), F.col("id").alias("size"), F.lit('a\n"]}\n,é').alias("preferred_name"), F.array(F.lit("x,"), F.lit(None)).alias("albums"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100k")
    try:
        sinks.export_manifest(e, e.agg(F.count("*").alias("files")), False, path)
        text = (tmp_path / "m.json").read_text()
        data = json.loads(text)
        assert [x["sha256"] for x in data["entries"]] == sorted(r["sha256"] for r in e.collect()) and text.count("\n") == n + 2
        header, back = sinks.read_manifest(spark, path)
        assert not header.select(sinks.is_verified(header)).first()[0] and header.first()["counts"] == {"files": n}
        assert sorted(map(str, back.select(e.columns).collect())) == sorted(map(str, e.collect()))
        assert back.select(F.spark_partition_id().alias("p")).distinct().count() > 1
        # Others' documents are read whole, whatever their lines; an empty one has no entries.
        (tmp_path / "o.json").write_text(json.dumps(data, indent=1))
        assert sinks.read_manifest(spark, str(tmp_path / "o.json"))[1].count() == n
        sinks.export_manifest(e.limit(0), e.agg(F.count("*").alias("files")), True, path)
        assert json.loads((tmp_path / "m.json").read_text())["entries"] == [] and sinks.read_manifest(spark, path)[1].count() == 0
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted(p.name for p in tmp_path.iterdir() if not p.name.startswith(".")) == ["m.json", "o.json"]
