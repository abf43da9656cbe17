import random
import re

import pytest
from pyspark.sql import functions as F

from quarryline.functions import geometry, names
from quarryline.operators import audit, catalogue, choose, compare, groundtruth


def one_pass(entries):
    taken, out = set(), {}
    for key, sha, name in sorted(entries, key=lambda e: (e[1], e[2])):
        s = re.sub(r"(?i)\.fpx$", "", name)
        k, t = 0, s
        while t.lower() in taken:
            k += 1
            t = f"{s}_{sha[:8]}" + (f"-{k}" if k > 1 else "")
        taken.add(t.lower())
        out[key] = t
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_names_as_one_pass_gives_them(spark, seed):
    rng = random.Random(seed)
    shas = [f"{rng.randrange(3):08x}{i:04d}" for i in range(120)]
    stems = ["a", "A", "b", *(f"a_{s[:8]}" for s in shas[:3]), f"a_{shas[0][:8]}-2", "c_zz"]
    rows = [(i, s, rng.choice(stems) + rng.choice([".fpx", ".FPX", ""])) for i, s in enumerate(shas)]
    for data in (rows, rows[::-1]):
        got = {r["i"]: r["given"] for r in catalogue.assign_names(spark.createDataFrame(data, "i int, sha256 string, name string").repartition(3)).collect()}
        assert got == one_pass(rows) and len({v.lower() for v in got.values()}) == len(rows)


def test_preferences_and_counts(spark):
    rows = [("h1", "t/al/DCP_01.fpx", "DCP_01.fpx", 5), ("h1", "t/bl/Lake.fpx", "Lake.fpx", 5), ("h1", "t/al/Lakes.fpx", "Lakes.fpx", 5), ("h2", "x.fpx", "x.fpx", 7)]
    m = {r["sha256"]: r for r in catalogue.manifest(spark.createDataFrame(rows, "sha256 string, relpath string, name string, size long")).collect()}
    assert (m["h1"]["preferred_name"], m["h1"]["albums"], m["h1"]["trees"], m["h1"]["duplicate_count"]) == ("Lakes.fpx", ["al", "bl"], ["t"], 3)
    assert m["h2"]["albums"] == [] and m["h2"]["is_human_named"]


def test_names_of_files(spark):
    df = spark.createDataFrame([("DCP_0123.FPX",), ("p-7.fpx",), ("pic.fpx.fpx",), ("1995",), ("31",), ("Lake",), (" Misc ",), ("9" * 60,)], "n string")
    got = df.select(names.is_camera_name(F.col("n")), names.stem(F.col("n")), names.is_descriptive(F.col("n"))).collect()
    assert [r[0] for r in got[:3]] == [True, True, False] and got[2][1] == "pic.fpx" and [r[2] for r in got[3:]] == [True, False, True, False, False]


def test_templates():
    for bad in ("", "{x}", "a{b", "no field", "a:{name}", "{name}/x", "{name}. "):
        with pytest.raises(names.TemplateError):
            names.check_template(bad, ["name"])
    names.check_template("{name}/x", ["name"], folders=True)
    assert names.fields_of("{a}-{b}{a}") == ["a", "b", "a"]


def test_folders(spark):
    r = spark.range(1).select(
        names.render_folder("{y}/../{a} /{e}", {"y": F.lit("1999"), "a": F.lit("x:y"), "e": F.lit("")}).alias("f"), names.render_folder("{e}/.", {"e": F.lit(None).cast("string")}).alias("u"),
        names.human_bytes(F.lit(5_300_000)).alias("b"), names.html_escape(F.lit("<a&'b'>")).alias("h"),
    ).first()
    assert tuple(r) == ("1999/x-y", "undated", "5.1 MB", "&lt;a&amp;&#x27;b&#x27;&gt;")


def test_diff_and_resume(spark):
    t = lambda rows: spark.createDataFrame(rows, "path string, size long, mtime_ns long")
    got = {(r["path"], r["kind"]) for r in compare.snapshot_diff(t([("a", 1, 1), ("b", 1, 1), ("c", 1, 1)]), t([("a", 1, 1), ("b", 2, 1), ("d", 1, 1)])).collect()}
    assert got == {("b", "modified"), ("c", "vanished"), ("d", "added")}
    outs = spark.createDataFrame([("h1", "p1"), ("h1", "p2"), ("h2", "q1")], "sha256 string, path string")
    done = compare.done_entries(outs, outs, spark.createDataFrame([("p1",), ("q1",)], "path string"))
    assert [r[0] for r in done.collect()] == ["h2"]
    assert compare.exact_sample(outs, 2, 1).count() == 2 and compare.exact_sample(outs, 9).count() == 3
    with pytest.raises(ValueError):
        compare.exact_sample(outs, -1)


def test_tags_absent_and_null_differ(spark):
    e = spark.createDataFrame([("p", "date", "1", False), ("p", "gps", None, True), ("q", "gps", None, True), ("q", "x", "1", False)], "path string, tag string, value string, forbidden boolean")
    a = spark.createDataFrame([("p", "date", "1"), ("p", "gps", None), ("q", "x", "2")], "path string, tag string, value string")
    assert {tuple(r) for r in compare.check_tags(e, a).collect()} == {("p", "gps", "forbidden"), ("q", "x", "different")}


def test_verdicts_count_pairs(spark):
    import datetime as dt

    e = spark.createDataFrame([("1", ["Feb 2000", "Stuff"]), ("2", ["Feb 2000"]), ("3", ["Feb 2000"])], "sha256 string, albums array<string>")
    s = spark.createDataFrame([("1", dt.datetime(2000, 2, 3)), ("2", dt.datetime(2000, 5, 1))], "sha256 string, import_ts timestamp_ntz")
    got = {r["album"]: r for r in groundtruth.verdicts(e, s).collect()}
    assert (got["Feb 2000"]["verdict"], got["Feb 2000"]["file_count"], got["Stuff"]["verdict"]) == ("PASS", 2, "UNDATED")
    assert groundtruth.roll_up(groundtruth.verdicts(e, s)).first()["ok"]


def test_geometry(spark):
    ident = [1.0 if k % 5 == 0 else 0.0 for k in range(16)]
    quarter = ident.copy()
    quarter[0] = quarter[5] = 0.0
    quarter[1], quarter[4], quarter[3] = -1.0, 1.0, 1.0
    half = ident.copy()
    half[0] = half[5] = 0.5
    half[3], half[7] = 0.25, 0.25
    df = spark.createDataFrame([(0, ident, 1.5), (1, quarter, 1.0), (2, half, 1.0), (3, None, None), (4, half, 0.0), (5, [1.0] * 16, 1.0), (6, None, 0.5)], "i int, m array<double>, a double")
    got = {r["i"]: r for r in df.select("i", geometry.orientation(F.col("m")).alias("k"), geometry.crop_box(F.col("m"), F.col("a"), F.lit(150), F.lit(100)).alias("c"), geometry.output_geometry(F.col("m"), F.col("a"), F.lit(150), F.lit(100)).alias("g")).collect()}
    assert [got[i]["k"] for i in range(6)] == ["identity", "rotate", "crop", "unsupported", "crop", "unsupported"]
    assert got[0]["c"] == (None, "") and tuple(got[2]["c"]["box"]) == (25, 25, 75, 75) and got[4]["c"]["reason"] == "no aspect"
    assert [got[i]["g"]["status"] for i in (0, 1, 2, 3, 5, 6)] == ["identity", "rotate", "crop", "absent", "unsupported", "crop"]
    assert (got[1]["g"]["out_width"], got[1]["g"]["out_height"]) == (100, 150)


def test_audit_tolerates_a_missing_complete(spark):
    r = spark.createDataFrame([(3, 0, 0, False, None)], "attempted long, failed long, with_warnings long, interrupted boolean, complete boolean")
    assert audit.summary(r).first()["severity"] == "incomplete"


def test_cover_is_topped_up(spark):
    df = spark.createDataFrame([(i, "ab"[i > 8], "x") for i in range(12)], "i int, a string, b string")
    assert sorted(r["i"] for r in choose.stratified_cover(df, "i", {"a": 2, "b": 1}, 6).collect()) == [0, 1, 2, 3, 9, 10]
