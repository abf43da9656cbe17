import datetime
import json
import os
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarryline.functions import geometry
from quarryline.operators import choose
from quarryline.sources import binary, config, log_lines, tree
from quarryline.streaming import progress, resume


def test_tree_lists_hidden_names(spark, tmp_path):
    for p, text in (("a.fpx", "1"), ("_h/b.FPX", "22"), (".d/c.fpx", "3"), ("x/y/z.txt", "4"), ("x/e.fpx", "")):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text(text)
    rows = {r["relpath"]: r for r in tree.scan_tree(spark, str(tmp_path)).collect()}
    assert set(rows) == {"a.fpx", "_h/b.FPX", ".d/c.fpx", "x/e.fpx"} and rows["_h/b.FPX"]["size"] == 2
    assert rows["x/e.fpx"]["sha256"].startswith("e3b0c442")
    snap = tree.tree_snapshot(spark, str(tmp_path))
    assert snap.count() == 5 and tuple(tree.size_estimate(snap, 3).first())[1] and tuple(tree.size_estimate(snap).first()) == (5, False)


def test_settings_are_refused(tmp_path):
    (tmp_path / ".env").write_text("# c\nA=1\nB=' x '\nbad\n")
    assert config.read_env([str(tmp_path / "no"), str(tmp_path / ".env")], {"A": "2"}) == {"A": "2", "B": " x "}
    with pytest.raises(config.ConfigError):
        config.refuse_inside(str(tmp_path / "s/out"), str(tmp_path / "s"))
    config.refuse_inside(str(tmp_path / "s2"), str(tmp_path / "s"))
    for bad in ("1994-12", "1825-01-01", "9999-01-01", "2001-02-30", "20010203", 5):
        with pytest.raises(config.ConfigError):
            config.parse_owner_date(bad)
    f = tmp_path / "d.json"
    f.write_text(json.dumps({"album_dates": {" Lake ": "1999-05-01"}}))
    assert config.read_album_dates(str(f)) == {"lake": datetime.date(1999, 5, 1)}
    f.write_text("[]")
    with pytest.raises(config.ConfigError):
        config.read_album_dates(str(f))
    assert config.run_key(["b", "a"], "t", "album", None, []) == config.run_key(["a", "b"], "t", "album", None, []) != config.run_key(["a"], "t", "album", None, [])


def property_set(props, page=1252):
    body, index = b"", []
    for pid, code, raw in [(1, 2, struct.pack("<H", page) + b"\0\0"), *props]:
        index.append((pid, len(body)))
        body += struct.pack("<I", code) + raw + b"\0" * (-len(raw) % 4)
    head = 8 + 8 * len(index)
    section = struct.pack("<II", head + len(body), len(index)) + b"".join(struct.pack("<II", p, head + o) for p, o in index) + body
    return struct.pack("<HHI16sI", 0xFFFE, 0, 0, b"\1" * 16, 1) + b"\2" * 16 + struct.pack("<I", 48) + section


def text(raw):
    return struct.pack("<I", len(raw)) + raw


def test_properties(spark):
    props = [(2, 30, text(b"caf\xe9\0")), (3, 3, struct.pack("<i", -7)), (4, 21, struct.pack("<Q", 2**64 - 1)), (5, 6, struct.pack("<q", 12345)), (6, 11, b"\xff\xff"), (7, 64, struct.pack("<Q", 126227808000000000)), (8, 0x1003, struct.pack("<Iii", 2, 1, 2)), (9, 31, text("hé\0".encode("utf-16-le"))[4:] and struct.pack("<I", 3) + "hé\0".encode("utf-16-le")), (10, 30, struct.pack("<I", 9999)), (11, 65, text(b"\xff\xd8xy"))]
    df = spark.createDataFrame([("f", property_set(props)), ("g", b"\1\2"), ("h", None)], "sha string, data binary")
    rows = binary.parse_properties(df, ["sha"], "data").collect()
    got = {r["pid"]: r for r in rows if r["sha"] == "f"}
    value = lambda p: json.loads(got[p]["value"])
    assert [value(p) for p in (2, 3, 4, 5, 6, 7, 8, 9)] == ["café", -7, 2**64 - 1, 1.2345, True, "2001-01-01 00:00:00", [1, 2], "hé"]
    assert got[10]["error"] and value(11)["kind"] == "jpeg_tables" and got[8]["type_name"] == "VECTOR|I4"
    assert all(r["error"] for r in rows if r["sha"] != "f") and len([r for r in rows if r["sha"] != "f"]) == 2


def compound(streams):
    """A document of 512-byte sectors whose streams are all long enough for the main chains."""
    names = list(streams)
    sectors, starts = [], []
    fat = []
    for n in names:
        data = streams[n].ljust(-(-max(len(streams[n]), 4096) // 512) * 512, b"\0")
        starts.append(len(sectors))
        for k in range(0, len(data), 512):
            fat.append(len(sectors) + 1 if k + 512 < len(data) else 0xFFFFFFFE)
            sectors.append(data[k : k + 512])
    entries = [("Root Entry", 5, 1, 0xFFFFFFFE, 0)] + [(n, 2, 0xFFFFFFFF, s, max(len(streams[n]), 4096)) for n, s in zip(names, starts, strict=True)]
    out = b""
    for k, (n, kind, child, start, size) in enumerate(entries):
        raw = n.encode("utf-16-le")
        right = k + 1 if 0 < k < len(entries) - 1 else 0xFFFFFFFF
        out += raw.ljust(64, b"\0") + struct.pack("<HBBIII36xIQ", len(raw) + 2, kind, 1, 0xFFFFFFFF, right, child, start, size)
    out = out.ljust(-(-len(out) // 512) * 512, b"\0")
    first_dir = len(sectors)
    for k in range(0, len(out), 512):
        fat.append(len(sectors) + 1 if k + 512 < len(out) else 0xFFFFFFFE)
        sectors.append(out[k : k + 512])
    fat.append(0xFFFFFFFD)
    fat_at = len(sectors)
    sectors.append(struct.pack("<128I", *(fat + [0xFFFFFFFF] * (128 - len(fat)))))
    head = binary.MAGIC + b"\0" * 16 + struct.pack("<HHHHH6xIIIIIIIII", 62, 3, 0xFFFE, 9, 6, 0, 1, first_dir, 0, 4096, 0xFFFFFFFE, 0, 0xFFFFFFFE, 0)
    return head + struct.pack("<109I", fat_at, *[0xFFFFFFFF] * 108) + b"".join(sectors)


def test_compound_documents(spark):
    data = compound({"\x05Info": b"hello", "Data": b"x" * 5000})
    c = binary.read_compound(data)
    assert not c.error and set(c.streams) == {"\x05Info", "Data"} and c.streams["Data"][:5000] == b"x" * 5000
    df = spark.createDataFrame([(1, data), (2, b"plain"), (3, data[:700]), (4, None)], "i int, content binary").select("i", binary.inventory(F.col("content")).alias("x")).select("i", "x.*")
    got = {r["i"]: r for r in df.collect()}
    assert got[1]["is_ole"] and got[1]["streams"] == ["\x05Info", "Data"] and not got[2]["is_ole"] and got[3]["is_ole"] and got[4]["is_ole"] is None


def test_thumbnails_and_tiles(spark):
    pixels = np.arange(2 * 3 * 3, dtype=np.uint8).reshape(2, 3, 3)
    rows = b"".join(bytes(r[:, ::-1].tobytes()).ljust(12, b"\0") for r in pixels[::-1])
    head = struct.pack("<iIIiiHHI", -1, 8, 40, 3, 2, 1, 24, 0) + b"\0" * 20
    cases = [head + rows, head, b"", None, head[:4] + b"\3" + head[5:] + rows, head[:24] + rows]
    df = spark.createDataFrame(list(enumerate(cases)), "i int, data binary")
    got = {r["i"]: r for r in binary.parse_thumbnails(df, ["i"], "data").collect()}
    assert bytes(got[0]["rgb"]) == pixels.tobytes() and (got[0]["width"], got[0]["height"]) == (3, 2)
    assert [bool(got[k]["error"]) for k in range(6)] == [False, True, True, True, True, True]
    tiles = struct.pack("<HHI", 0xFFFE, 0, 0).ljust(24, b"\0") + struct.pack("<10I", 1, 0, 130, 70, 2, 64, 64, 3, 0, 16) + struct.pack("<8I", 0, 9, 2, 0xFE000000, 9, 5, 0, 0)
    t = binary.parse_tiles(spark.createDataFrame([(1, tiles), (2, tiles[:80])], "i int, data binary"), ["i"], "data").collect()
    assert [(r["i"], r["tile_ix"], r["table_id"], bool(r["error"])) for r in sorted(t, key=lambda r: (r["i"], r["tile_ix"] or 0))] == [(1, 0, 254, False), (1, 1, 0, False), (2, None, None, True)]


def test_colours_agree(spark):
    rng = np.random.default_rng(3)
    ycc = rng.integers(0, 256, (50, 1, 3), dtype=np.uint8)
    df = spark.createDataFrame([tuple(map(float, p[0])) for p in ycc], "y double, c1 double, c2 double").select(geometry.rgb(F.col("y"), F.col("c1"), F.col("c2")).alias("p")).select("p.*")
    assert [tuple(r) for r in df.collect()] == [tuple(map(int, p[0])) for p in binary.ycc_image(ycc)]


LINES = ["=== run start: 9 entries", "x OK [1/9]", "noise", "FAIL [2 / 9] bad", "OK [3/9]", "INTERRUPTED by user"]


def test_log_lines_batch_and_stream_agree(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    rows = [{"run": run, "seq": k, "value": v} for run in ("a", "b") for k, v in enumerate(LINES)]
    for part, cut in enumerate((rows[:5], rows[5:9], rows[9:])):
        (src / f"{part}.json").write_text("\n".join(map(json.dumps, cut)))
        os.utime(src / f"{part}.json", (part + 1000, part + 1000))
    schema = "run string, seq long, value string"
    batch = choose.running_progress(log_lines.progress_events(spark.read.schema(schema).json(str(src))), "run", ["seq"])
    want = sorted(map(tuple, batch.select("run", "seq", "done", "total", "failed", "interrupted").collect()))
    stream = log_lines.progress_events(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(src))).drop("value")
    q = progress.track_progress(stream).writeStream.format("memory").queryName("progress_out").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(map(tuple, spark.table("progress_out").collect())) == want
    assert want[-1] == ("b", 5, 3, 9, 1, True)


def test_resumed_stream(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "1.json").write_text('{"sha256":"h1"}\n{"sha256":"h2"}')
    made = []

    def convert(df):
        made.extend(r["sha256"] for r in df.collect())
        return df.selectExpr("sha256", "concat('out/', sha256) as path")

    existing = lambda: spark.createDataFrame([(f"out/{m}",) for m in set(made) - {"h2"}] or [("none",)], "path string")
    entries = lambda: spark.readStream.schema("sha256 string").json(str(src))
    resume.process_stream(entries(), convert, existing, str(tmp_path), "k1").awaitTermination()
    assert sorted(made) == ["h1", "h2"]
    (src / "2.json").write_text('{"sha256":"h1"}\n{"sha256":"h2"}\n{"sha256":"h3"}')
    resume.process_stream(entries(), convert, existing, str(tmp_path), "k1").awaitTermination()
    assert sorted(made) == ["h1", "h2", "h2", "h3"]
    assert resume.read_state(spark, str(tmp_path), "other").count() == 0
