"""Compound documents read by seeks, all property sets of a file, and what they tell."""

import hashlib
import json
import os
import random
import struct

import pytest
from pyspark.sql import functions as F

from quarryline.functions import properties
from quarryline.operators import images
from quarryline.sinks import catalogue
from quarryline.sources import binary, sectors

FREE, END, FAT_SECTOR, DIFAT_SECTOR = 0xFFFFFFFF, 0xFFFFFFFE, 0xFFFFFFFD, 0xFFFFFFFC


def document(streams):
    """A compound document with storages, small streams and a table of as many sectors as it needs."""
    fat, body = [], []

    def put(data):
        if not data:
            return END
        start = len(fat)
        for k in range(0, len(data), 512):
            fat.append(len(fat) + 1 if k + 512 < len(data) else END)
            body.append(data[k : k + 512].ljust(512, b"\0"))
        return start

    mini, mini_fat, nodes = b"", [], [("Root Entry", 5, None, 0)]
    children = {"": []}
    for path in sorted(streams):
        above = ""
        for part in path.split("/")[:-1]:
            full = f"{above}{part}/"
            if full not in children:
                children[full] = []
                children[above].append(len(nodes))
                nodes.append((part, 1, full, 0))
            above = full
        data = streams[path]
        if len(data) < 4096:
            start = len(mini_fat)
            n = -(-len(data) // 64)
            mini_fat += [start + k + 1 if k + 1 < n else END for k in range(n)]
            mini += data.ljust(n * 64, b"\0")
            start = start if n else END
        else:
            start = put(data)
        children[above].append(len(nodes))
        nodes.append((path.split("/")[-1], 2, start, len(data)))
    mini_start = put(mini)
    mini_fat_start = put(struct.pack(f"<{len(mini_fat)}I", *mini_fat) + b"\xff" * (-4 * len(mini_fat) % 512))
    right = {a: b for kids in children.values() for a, b in zip(kids, kids[1:])}
    out = b""
    for k, (name, kind, where, size) in enumerate(nodes):
        raw = name.encode("utf-16-le")
        kids = children[""] if k == 0 else children[where] if kind == 1 else []
        first = mini_start if k == 0 else where if kind == 2 else 0
        out += raw.ljust(64, b"\0") + struct.pack("<HBBIII36xIQ", len(raw) + 2, kind, 1, FREE, right.get(k, FREE), kids[0] if kids else FREE, first, len(mini) if k == 0 else size)
    first_dir = put(out)
    n = difat = 0
    while True:
        need = -(-(len(fat) + n + difat) // 128)
        more = max(0, -(-(need - 109) // 127))
        if (need, more) == (n, difat):
            break
        n, difat = need, more
    at = list(range(len(fat), len(fat) + n))
    difat_at = list(range(len(fat) + n, len(fat) + n + difat))
    table = fat + [FAT_SECTOR] * n + [DIFAT_SECTOR] * difat
    table += [FREE] * (128 * n - len(table))
    tail = struct.pack(f"<{len(table)}I", *table)
    for k in range(difat):
        part = at[109 + 127 * k : 109 + 127 * (k + 1)]
        tail += struct.pack("<128I", *part, *[FREE] * (127 - len(part)), difat_at[k + 1] if k + 1 < difat else END)
    head = binary.MAGIC + b"\0" * 16 + struct.pack("<HHHHH6xIIIIIIIII", 62, 3, 0xFFFE, 9, 6, 0, n, first_dir, 0, 4096, mini_fat_start, -(-len(mini_fat) // 128), difat_at[0] if difat else END, difat)
    return head + struct.pack("<109I", *(at[:109] + [FREE] * (109 - len(at[:109])))) + b"".join(body) + tail


def property_set(props, fmtid=b"\2" * 16):
    body, index = b"", []
    for pid, code, raw in [(1, 2, struct.pack("<HH", 1252, 0)), *props]:
        index.append((pid, len(body)))
        body += struct.pack("<I", code) + raw + b"\0" * (-len(raw) % 4)
    head = 8 + 8 * len(index)
    section = struct.pack("<II", head + len(body), len(index)) + b"".join(struct.pack("<II", p, head + o) for p, o in index) + body
    return struct.pack("<HHI16sI", 0xFFFE, 0, 0, b"\1" * 16, 1) + fmtid + struct.pack("<I", 48) + section


def text(s):
    return struct.pack("<I", len(s) + 1) + s.encode("cp1252") + b"\0"


def whole_file(picture=b""):
    number = lambda k: struct.pack("<I", k)
    colour = struct.pack("<I5I", 20, 1, 3, *binary.CHANNELS["PhotoYCC"])
    sets = {n: property_set([(7, 30, text(n))]) for n in binary.PROPERTY_STREAMS}
    sets["Data Object Store 000001/\x05Image Contents"] = property_set([(0x01000000, 19, number(2)), (0x01000002, 19, number(640)), (0x01000003, 19, number(480)), (0x02000000, 19, number(640)), (0x02000001, 19, number(480)), (0x02000002, 65, colour), (0x02010000, 19, number(320)), (0x02010001, 19, number(240)), (0x02020000, 19, number(9))])
    sets["Data Object Store 000001/\x05Image Info"] = property_set([(0x24000000, 30, text("Kam")), (0x28000000, 30, text("Scan")), (0x28000001, 30, text("S1")), (0x27000000, 30, text("Film"))])
    return document(sets | {"Data Object Store 000001/Resolution 0000/Subimage 0000 Data": picture, "Ext/\x05Own": property_set([(2, 30, text("extension"))]), "z": b""})


@pytest.mark.parametrize("picture", [b"", b"p" * 5000, bytes(500_000)])
def test_seeks_find_what_whole_reads_find(tmp_path, picture):
    data = whole_file(picture)
    (tmp_path / "f.fpx").write_bytes(data)
    want = binary.read_compound(data)
    with open(tmp_path / "f.fpx", "rb") as f:
        d = sectors.SectorFile(f)
        got = {n: d.content(*where) for n, where in d.streams().items()}
    assert want.error == "" and got == want.streams and len([n for n in got if n in binary.PROPERTY_STREAMS]) == 10


def test_bytes_read_grow_with_the_directory(spark, tmp_path):
    paths = []
    for k, size in enumerate((5000, 20_000_000)):
        (tmp_path / f"{k}.fpx").write_bytes(whole_file(bytes(size)))
        paths.append((k, str(tmp_path / f"{k}.fpx")))
    (tmp_path / "text.fpx").write_text("no document")
    df = spark.createDataFrame([*paths, (2, str(tmp_path / "text.fpx")), (3, str(tmp_path / "none")), (4, None)], "k int, path string")
    r = {x["k"]: x["i"] for x in df.select("k", sectors.inventory_of(F.col("path")).alias("i")).collect()}
    assert r[0]["streams"] == r[1]["streams"] and len(r[0]["streams"]) == 13 and r[0]["is_ole"] and r[0]["error"] == ""
    # 39,000 sectors: the table alone has 156,000 bytes.
    assert r[1]["bytes_read"] < 15_000 < os.path.getsize(paths[1][1])
    assert r[2]["is_ole"] is False and r[3]["is_ole"] is None and r[3]["error"] and r[4]["is_ole"] is None


def test_damaged_documents_end(tmp_path):
    rng = random.Random(3)
    data = whole_file(b"x" * 6000)
    for _ in range(300):
        broken = bytearray(data)
        for _ in range(rng.randint(1, 6)):
            broken[rng.randrange(len(broken))] = rng.randrange(256)
        broken = bytes(broken[: rng.randint(0, len(broken))] if rng.random() < 0.3 else broken)
        (tmp_path / "f").write_bytes(broken)
        with open(tmp_path / "f", "rb") as f:
            try:
                d = sectors.SectorFile(f)
                for where in d.streams().values():
                    try:
                        d.content(*where)
                    except sectors.DamagedDocument:
                        pass
            except sectors.DamagedDocument:
                pass


def test_all_ten_property_sets_and_what_they_tell(spark, tmp_path):
    (tmp_path / "f.fpx").write_bytes(whole_file(b"p" * 9000))
    df = spark.createDataFrame([(1, str(tmp_path / "f.fpx")), (2, str(tmp_path / "none.fpx")), (3, None)], "k int, path string")
    rows = sectors.file_properties_at(df, ["k"], "path")
    streams = [r["stream"] for r in sectors.property_streams_at(df.where("k = 1"), ["k"], "path").collect()]
    assert streams == [*binary.PROPERTY_STREAMS, "Ext/\x05Own"]
    named = {(r["stream"], json.loads(r["value"])) for r in rows.where("k = 1 and pid = 7").collect()}
    assert named == {(n, n.replace("\x05", "\x05")) for n in binary.PROPERTY_STREAMS if not n.endswith(("Image Contents", "Image Info"))}
    assert {(r["k"], r["stream"]) for r in rows.where("k > 1").collect()} == {(2, None), (3, None)}
    d = properties.derived(rows.where("k = 1"), ["k"]).first()
    assert [tuple(r) for r in d["resolutions"]] == [(0, 640, 480), (1, 320, 240)]
    assert d["colour"].asDict() == {"colour_space": "PhotoYCC", "uncalibrated": True, "channels": 3, "channel_ids": ["0x00020000", "0x00020001", "0x00020002"], "decoded_as": "PhotoYCC", "assumed": False}
    assert d["camera"]["make"] == "Kam" and (d["scanner"]["make"], d["scanner"]["model"], d["scanner"]["film_brand"], d["scanner"]["serial"]) == ("Scan", "S1", "Film", None)


def test_what_isnt_declared_is_assumed(spark):
    other = struct.pack("<I5I", 20, 0, 3, 1, 2, 3)
    sets = [(1, property_set([(0x02000002, 65, other)])), (2, property_set([(2, 30, text("t"))]))]
    rows = binary.parse_properties(spark.createDataFrame(sets, "k int, data binary"), ["k"], "data")
    d = {r["k"]: r for r in properties.derived(rows, ["k"]).collect()}
    assert (d[1]["colour"]["colour_space"], d[1]["colour"]["decoded_as"], d[1]["colour"]["assumed"]) == ("UNKNOWN", "NIF_RGB", True)
    assert (d[2]["colour"]["colour_space"], d[2]["colour"]["assumed"], d[2]["scanner"], d[2]["resolutions"]) == ("NIF_RGB", True, None, [])


def test_store_copies_by_address(spark, tmp_path):
    (tmp_path / "in").mkdir()
    rows = []
    for k in range(5):
        (tmp_path / "in" / str(k)).write_bytes(bytes([k]) * 3_000_000)
        rows.append((hashlib.sha256(bytes([k]) * 3_000_000).hexdigest() if k else "0" * 64, 3_000_000, f"file://{tmp_path}/in/{k}", f"deep/{k}.fpx"))
    df = spark.createDataFrame(rows, "sha256 string, size long, source_path string, store_name string")
    store = f"file://{tmp_path}/store"
    assert tuple(catalogue.copy_totals(catalogue.copy_to_store(df, store)).first()) == (4, 0, 1, 12_000_000)
    assert tuple(catalogue.copy_totals(catalogue.copy_to_store(df, store)).first()) == (0, 4, 1, 0)
    assert sorted(os.listdir(tmp_path / "store/deep")) == [f"{k}.fpx" for k in range(1, 5)]


def test_sidecars_and_refused_resolutions(spark):
    texts = [("a", '{"derived_metadata": {"timestamps": {"datetime_original_exif": "x", "sort_datetime": "y"}}}'), ("b", '{"derived_metadata": {"timesta'), ("c", "{}"), ("d", None)]
    s = images.sidecar_dates(spark.createDataFrame(texts, "store_name string, sidecar string"))
    report = spark.createDataFrame([(n, d, "") for n, d in (("a", ""), ("b", "own"), ("c", None), ("e", "z"))], "store_name string, date_original string, album string")
    got = {r["store_name"]: (r["date_original"], r["sort_date"], r["album"]) for r in images.report_with_sidecars(report, s).collect()}
    assert got == {"a": ("x", "y", "(no album)"), "b": ("own", None, "(no album)"), "c": (None, None, "(no album)"), "e": ("z", None, "(no album)")}
    df = spark.createDataFrame([(None, 3), (2, 3), (3, 3), (-1, 3), (0, None)], "w int, n int").select(images.resolution_index(F.col("w"), F.col("n")).alias("r"))
    assert [tuple(r[0]) for r in df.collect()] == [(0, None), (2, None), (None, "no resolution 3 of 3"), (None, "no resolution -1 of 3"), (None, "no resolution 0 of 0")]
