"""Outputs, records, manifests and settings that queries don't cover."""

import json
import os
import struct
import time

import pytest
from pyspark.sql import functions as F

from quarryline.functions.zones import ZoneError, resolve_zone
from quarryline.operators import outputs
from quarryline.sinks import catalogue, records
from quarryline.sources import binary, config
from quarryline.sources.tree import assemble_scan, size_estimate, tree_snapshot


def test_outputs_are_checked():
    assert [o.tree for o in outputs.outputs()] == ["archive", "sharing"]
    assert outputs.outputs(archive=None) == [outputs.Output("sharing", "jpeg", "cropped")]
    with pytest.raises(outputs.OutputError):
        outputs.outputs(None, None)
    for bad in (("attic", "tiff", "full"), ("archive", "gif", "full"), ("archive", "tiff", "half")):
        with pytest.raises(outputs.OutputError):
            outputs.Output(*bad)


def test_real_zones_go_before_aliases():
    assert resolve_zone("US/Eastern") == "US/Eastern" and resolve_zone(" eastern") == "America/New_York" and resolve_zone("america/new york") == "America/New_York"
    with pytest.raises(ZoneError):
        resolve_zone("nowhere")


def test_settings():
    assert config.parse_overrides('{"Trip ": " Europe/London"}') == {"trip": "Europe/London"} and config.parse_overrides("") == {}
    for bad in ("[1]", '{"a": 1}', '{"": "UTC"}', "{"):
        with pytest.raises(config.ConfigError):
            config.parse_overrides(bad)
    assert config.default_zone(None, " ", "UTC") == "UTC" and config.default_zone("Asia/Tokyo", "UTC", None) == "Asia/Tokyo"
    with pytest.raises(config.ConfigError):
        config.default_zone("", None, None)


def test_stop_markers_count_from_the_run_on(tmp_path):
    marker = tmp_path / "stop"
    assert not config.stop_requested(str(marker), 0)
    marker.write_text("")
    assert config.stop_requested(str(marker), time.time() - 60) and not config.stop_requested(str(marker), time.time() + 60)


def property_set(sections):
    """A set of sections that hold one 32-bit number each."""
    n = len(sections)
    data = struct.pack("<HHI16sI", 0xFFFE, 0, 0, b"\0" * 16, n)
    body, at = b"", 28 + 20 * n
    for k, value in enumerate(sections):
        data += bytes([k % 256]) * 16 + struct.pack("<I", at + 24 * k)
        body += struct.pack("<IIIIII", 24, 1, 5, 16, 3, value)
    return data + body


def test_all_sections_are_read():
    rows = list(binary.property_rows(property_set(list(range(200)))))
    assert [(r[0], json.loads(r[5])) for r in rows] == [(k, k) for k in range(200)]
    cut = bytearray(property_set([1, 2]))
    cut[24:28] = struct.pack("<I", 4_000_000_000)
    rows = list(binary.property_rows(bytes(cut)))
    assert "4000000000 sections" in rows[0][7] and len(rows) < 10


def test_manifest_comes_back(spark, tmp_path):
    entries = spark.createDataFrame([("a", 3, "x.fpx", ["Trip"]), ("b", 4, None, None)], "sha256 string, size long, store_name string, albums array<string>")
    path = str(tmp_path / "manifest.json")
    catalogue.export_manifest(entries, spark.createDataFrame([(2,)], "files_distinct long"), True, path)
    header, back = catalogue.read_manifest(spark, path)
    assert [r[0] for r in header.select(catalogue.is_verified(header)).collect()] == [True]
    assert header.first()["counts"] == {"files_distinct": 2}
    assert [tuple(r) for r in back.select("sha256", "size", "store_name", "albums").orderBy("sha256").collect()] == [("a", 3, "x.fpx", ["Trip"]), ("b", 4, None, None)]


def test_records_have_defaults(spark):
    got = records.from_json(spark.createDataFrame([('{"sha256": "a", "crop_applied": [], "status": "failed"}',), ("{}",)], "json string")).orderBy("sha256").collect()
    assert [r["sha256"] for r in got] == ["", "a"]
    for r in got:
        assert r["status"] == "resumed" and r["is_undated"] and r["date_source"] == "none" and r["crop_applied"] is None and r["outputs"] == r["errors"] == [] and r["seconds"] == 0


def test_report_and_log(spark, tmp_path):
    one = spark.createDataFrame([(1,)], "n int")
    records.write_report(str(tmp_path / "report"), counts=one, groups=one.limit(0))
    assert spark.read.json(str(tmp_path / "report/counts")).first()["n"] == 1
    log = spark.createDataFrame([("r", 1, "a")], "run string, at long, line string")
    for _ in range(2):
        records.append_log(log, str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).count() == 2


def test_scan_is_assembled(spark, tmp_path):
    root = tmp_path / "archive"
    (root / "Trip").mkdir(parents=True)
    (root / "Trip" / "_hidden.FPX").write_bytes(b"abc")
    (root / "note.txt").write_text("x")
    before, files = assemble_scan(spark, str(root), str(tmp_path / "work"))
    os.remove(root / "note.txt")
    assert sorted(r["path"] for r in before.collect()) == ["Trip/_hidden.FPX", "note.txt"]
    row = files.collect()[0]
    assert row["relpath"] == "Trip/_hidden.FPX" and row["is_ole"] is False and row["streams"] == [] and row["size"] == 3
    assert tree_snapshot(spark, str(root)).count() == 1


def test_size_of_any_number_of_files(spark):
    assert tuple(size_estimate(spark.range(50_002).select(F.lit(2).cast("long").alias("size"))).first()) == (100_004, False)


def test_size_estimate_is_capped(spark):
    files = spark.range(10).select(F.lit(2).cast("long").alias("size"))
    assert tuple(size_estimate(files, 4).first()) == (8, True) and tuple(size_estimate(files, 10).first()) == (20, False)


def test_streams_of_a_file(spark):
    rows = binary.file_properties(spark.createDataFrame([(1, bytearray(b"no document")), (2, None)], "k int, data binary"), ["k"], "data").collect()
    assert {r["k"] for r in rows} == {1, 2} and all(r["error"] and r["stream"] is None for r in rows)
