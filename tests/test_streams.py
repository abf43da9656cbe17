"""Streams of files and of progress: what a stop, a failure and a restart leave."""

import hashlib
import json
import os
import threading
import time

import pytest
from pyspark.sql import functions as F

from quarryline.operators import choose
from quarryline.sources import log_lines, tree
from quarryline.streaming import progress, resume


def put(folder, names, text="x"):
    for n in names:
        p = folder / n
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(f"{text}{n}")


def converter(out, fail_at=None, slow=0.0, calls=None):
    """Writes a file for each and a line for each call, as tasks run in other processes."""
    out.mkdir(exist_ok=True)

    def convert(row):
        with open(out.parent / "calls.txt", "a", encoding="utf-8") as f:
            f.write(row["name"] + "\n")
        if row["name"] == fail_at:
            raise ValueError(f"can't convert {fail_at}")
        time.sleep(slow)
        target = out / f"{row['sha256']}.out"
        target.write_text(row["relpath"])
        return [str(target)]

    return convert


def called(tmp_path):
    path = tmp_path / "calls.txt"
    return path.read_text().split() if path.exists() else []


def existing(spark, out):
    return lambda: spark.createDataFrame([(str(p),) for p in out.glob("*.out")] or [("none",)], "path string")


def start(spark, tmp_path, **how):
    root, out = tmp_path / "archive", tmp_path / "out"
    how.setdefault("convert", converter(out))
    files = tree.arriving_files(spark, str(root), str(tmp_path / "log"))
    return resume.run_files(files, existing=existing(spark, out), root=str(tmp_path / "state"), run_key="k", **how)


def test_arriving_files_across_restarts(spark, tmp_path):
    root = tmp_path / "archive"
    put(root, ["a/1.fpx", "a/2.FPX", "b/c/3.fpx", "b/x.txt"])
    assert start(spark, tmp_path) == {"converted": 3, "resumed": 0, "interrupted": False, "error": None}
    assert start(spark, tmp_path)["converted"] == 0
    put(root, ["a/4.fpx"])
    put(root, ["a/1.fpx"], text="changed ")
    got = start(spark, tmp_path)
    assert got["converted"] == 2 and sorted(called(tmp_path)) == ["1.fpx", "1.fpx", "2.FPX", "3.fpx", "4.fpx"]
    # The same bytes under another name are done already.
    put(root, ["z/9.fpx"])
    (root / "z/9.fpx").write_bytes((root / "a/4.fpx").read_bytes())
    assert start(spark, tmp_path) == {"converted": 0, "resumed": 1, "interrupted": False, "error": None}


def test_a_batch_that_fails_midway_repeats_no_finished_file(spark, tmp_path):
    put(tmp_path / "archive", [f"{k:02}.fpx" for k in range(30)])
    reports = []
    with pytest.raises(Exception, match="17.fpx"):
        start(spark, tmp_path, convert=converter(tmp_path / "out", fail_at="17.fpx"), report=reports.append)
    before = called(tmp_path)
    done = {p.read_text() for p in (tmp_path / "out").glob("*.out")}
    assert reports[0]["error"] and 0 < len(done) < 30
    assert {r["sha256"] for r in resume.read_state(spark, str(tmp_path / "state"), "k").collect()} == {hashlib.sha256(f"x{n}".encode()).hexdigest() for n in done}
    got = start(spark, tmp_path)
    after = called(tmp_path)[len(before) :]
    assert got["converted"] == 30 - len(done) and got["resumed"] == len(done) and not set(after) & done and set(after) | done == {f"{k:02}.fpx" for k in range(30)}
    assert not list((tmp_path / "state/journal-k").glob("*.jsonl"))


def test_torn_journal_lines_count_for_nothing(spark, tmp_path):
    folder = resume.journals(str(tmp_path), "k")
    folder.mkdir(parents=True)
    (folder / "a.jsonl").write_text('{"sha256": "h1", "path": "p1"}\n{"sha256": "h2", "pa')
    assert [tuple(r) for r in resume.read_state(spark, str(tmp_path), "k").collect()] == [("h1", "p1")]
    resume.compact_state(spark, str(tmp_path), "k")
    assert [tuple(r) for r in resume.read_state(spark, str(tmp_path), "k").collect()] == [("h1", "p1")] and not list(folder.iterdir())


def test_a_stop_lets_tasks_finish_their_file(spark, tmp_path):
    put(tmp_path / "archive", [f"{k:02}.fpx" for k in range(40)])
    marker = tmp_path / "stop"

    def leave():
        while len(called(tmp_path)) < 3:
            time.sleep(0.02)
        marker.write_text("")
        os.utime(marker, (time.time() + 5, time.time() + 5))

    t = threading.Thread(target=leave)
    t.start()
    reports = []
    got = start(spark, tmp_path, convert=converter(tmp_path / "out", slow=0.3), marker=str(marker), report=reports.append)
    t.join()
    done = list((tmp_path / "out").glob("*.out"))
    assert got["interrupted"] and reports == [got] and got["error"] is None and 3 <= len(done) < 40 and len(called(tmp_path)) == len(done)
    os.unlink(marker)
    assert start(spark, tmp_path)["converted"] == 40 - len(done) and len(called(tmp_path)) == 40


def test_a_listener_stops_between_batches(spark, tmp_path):
    src = tmp_path / "in"
    put(src, ["1.json"], text='{"a": 1} ')
    asked = threading.Event()
    listener = resume.StopListener(spark, asked.is_set)
    spark.streams.addListener(listener)
    try:
        q = spark.readStream.text(str(src)).writeStream.format("noop").option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="200 milliseconds").start()
        q.processAllAvailable()
        assert q.isActive
        asked.set()
        put(src, ["2.json"])
        assert q.awaitTermination(30) and q.exception() is None
    finally:
        spark.streams.removeListener(listener)


def test_one_folder_of_many_files_is_many_tasks(spark, tmp_path):
    put(tmp_path / "t", [f"big/{k}.fpx" for k in range(3000)] + ["B/x.fpx", "a.FPX", "c/d/e/f.fpx"])
    os.symlink(tmp_path / "t", tmp_path / "t/c/loop")
    snap = tree.tree_snapshot(spark, str(tmp_path / "t"))
    tasks = snap.groupBy(F.spark_partition_id()).count().count()
    assert snap.count() == 3003 and tasks > 3
    got = tree.in_listing_order(tree.scan_tree(spark, str(tmp_path / "t"))).collect()
    assert [r["relpath"] for r in got] == sorted((r["relpath"] for r in got), key=lambda p: (p.lower(), p)) and len(got) == 3003
    assert got[0]["sha256"] == hashlib.sha256(b"xa.FPX").hexdigest() and got[1]["relpath"] == "B/x.fpx"
    (tmp_path / "none").mkdir()
    assert tree.scan_tree(spark, str(tmp_path / "none")).count() == 0


LINES = ["=== run start: 9 entries", "x OK [1/9]", "noise", "FAIL [2 / 9] bad", "OK [3/9]", "INTERRUPTED by user"]


def test_progress_equals_its_batch_twin_across_a_restart(spark, tmp_path):
    src, out = tmp_path / "in", tmp_path / "out"
    src.mkdir()
    rows = [{"run": run, "seq": k, "value": v} for k, v in enumerate(LINES) for run in "ab"]
    schema = "run string, seq long, value string"
    for part, k in enumerate(range(0, len(rows), 4)):
        (src / f"{part}.json").write_text("\n".join(map(json.dumps, rows[k : k + 4])))
        stream = progress.track_progress(log_lines.progress_events(spark.readStream.schema(schema).json(str(src))).drop("value"))
        stream.writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(tmp_path / "c")).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    batch = choose.running_progress(log_lines.progress_events(spark.read.schema(schema).json(str(src))), "run", ["seq"])
    cols = ["run", "seq", "done", "total", "failed", "interrupted"]
    assert sorted(map(tuple, spark.read.parquet(str(out)).select(*cols).collect())) == sorted(map(tuple, batch.select(*cols).collect()))


def test_state_of_an_idle_run_ends(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    schema = "run string, seq long, done int, total int, failed boolean, interrupted boolean"
    line = lambda seq: json.dumps({"run": "r", "seq": seq, "done": 10 - seq, "failed": True})
    (src / "1.json").write_text(line(1))
    q = progress.track_progress(spark.readStream.schema(schema).json(str(src)), idle_ms=1500).writeStream.format("memory").queryName("idle_out").outputMode("append").trigger(processingTime="200 milliseconds").start()

    def until(n):
        end = time.time() + 40
        while spark.table("idle_out").count() < n and time.time() < end:
            time.sleep(0.3)

    try:
        until(1)
        time.sleep(5)
        (src / "2.json").write_text(line(2))
        until(2)
    finally:
        q.stop()
    assert [(r["seq"], r["done"], r["failed"]) for r in spark.table("idle_out").orderBy("seq").collect()] == [(1, 9, 1), (2, 8, 1)]
