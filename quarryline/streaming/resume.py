"""Incremental work that survives a stop (STM-01, STM-03, FLT-10): state under the run's key, tested against what exists.

``run_files`` converts the files of a stream, and records each as it is done: every task keeps a journal of its own, a line a
file, on disk before the next file begins. A task that is lost, a batch that fails or a process that ends loses at most the
file it was at; when the batch is run again, what the journals have is left out. Between runs journals are compacted into one table.
The folders must be mounted by driver and executors.
"""

from __future__ import annotations

import json
import os
import threading
import time
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import pandas as pd
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from quarryline.operators.compare import done_entries, split_resume
from quarryline.sources.config import stop_requested

STATE = "sha256 string, path string"
#: What a stopped batch says, so that the engine does not count it as done.
STOPPED = "stopped on request"


def state_path(root: str, run_key: str) -> str:
    """Another key, another state: changed specs, templates or folders start anew."""
    return os.path.join(root, f"state-{run_key}")


def journals(root: str, run_key: str) -> Path:
    return Path(root) / f"journal-{run_key}"


def read_state(spark: SparkSession, root: str, run_key: str) -> DataFrame:
    """(sha256, path) of what is recorded: the table and the journals since. A line that was cut as its task died counts for nothing."""
    try:
        table = spark.read.schema(STATE).parquet(state_path(root, run_key))
    except AnalysisException:
        table = spark.createDataFrame([], STATE)
    folder = journals(root, run_key)
    if not any(folder.glob("*.jsonl")):
        return table
    lines = spark.read.schema(STATE + ", _bad string").option("columnNameOfCorruptRecord", "_bad").json(str(folder))
    return table.unionByName(lines.where("_bad is null and sha256 is not null").select("sha256", "path"))


def compact_state(spark: SparkSession, root: str, run_key: str) -> None:
    """Journals become rows of the table. If it ends between the two steps, rows stand twice, which changes nothing."""
    files = sorted(journals(root, run_key).glob("*.jsonl"))
    if files:
        lines = spark.read.schema(STATE + ", _bad string").option("columnNameOfCorruptRecord", "_bad").json([str(f) for f in files])
        lines.where("_bad is null and sha256 is not null").select("sha256", "path").write.mode("append").parquet(state_path(root, run_key))
        for f in files:
            f.unlink()


def todo(entries: DataFrame, state: DataFrame, existing: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(to do, resumed): recorded as done with all outputs still there, or not."""
    return split_resume(entries, done_entries(state, state, existing))


def process_stream(entries: DataFrame, convert: Callable[[DataFrame], DataFrame], existing: Callable[[], DataFrame], root: str, run_key: str) -> StreamingQuery:
    """Convert arriving entries batch by batch; ``convert`` returns (sha256, path) of what it wrote, which is recorded.

    Stop between batches with query.stop(); what a batch recorded stays done.
    """

    def batch(df: DataFrame, _: int) -> None:
        left, _resumed = todo(df, read_state(df.sparkSession, root, run_key), existing())
        convert(left).select("sha256", "path").write.mode("append").parquet(state_path(root, run_key))

    return entries.writeStream.foreachBatch(batch).option("checkpointLocation", os.path.join(root, f"checkpoint-{run_key}")).trigger(availableNow=True).start()


def journalled(files: DataFrame, convert: Callable[[dict], list[str]], root: str, run_key: str, stop: Callable[[], bool] = lambda: False) -> DataFrame:
    """Rows with sha256 -> (sha256, path) of what convert wrote for each, recorded as each is done. Tasks end early once stop says so.

    A task that is run again leaves out what any journal has by then.
    """
    folder = journals(root, run_key)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        folder.mkdir(parents=True, exist_ok=True)
        context = TaskContext.get()
        known = _recorded(folder) if context is not None and context.attemptNumber() else {}
        with open(folder / f"{uuid.uuid4().hex}.jsonl", "w", encoding="utf-8") as journal:
            for batch in batches:
                out = []
                for row in batch.to_dict("records"):
                    if stop():
                        break
                    sha = row["sha256"]
                    if sha not in known:
                        known[sha] = convert(row)
                        journal.write("".join(json.dumps({"sha256": sha, "path": p}) + "\n" for p in known[sha]))
                        journal.flush()
                        os.fsync(journal.fileno())
                    out += [(sha, p) for p in known[sha]]
                yield pd.DataFrame(out, columns=["sha256", "path"])

    return files.mapInPandas(run, STATE)


def _recorded(folder: Path) -> dict[str, list[str]]:
    out: dict[str, list[str]] = {}
    for f in folder.glob("*.jsonl"):
        for line in f.read_text(encoding="utf-8").splitlines():
            try:
                row = json.loads(line)
            except ValueError:
                continue
            out.setdefault(row["sha256"], []).append(row["path"])
    return out


class StopListener(StreamingQueryListener):
    """Ends a query between two batches once a stop is asked for."""

    def __init__(self, spark: SparkSession, asked: Callable[[], bool]):
        self.spark, self.asked = spark, asked
        self.stopped: set[str] = set()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        name = str(event.progress.id)
        if name not in self.stopped and self.asked():
            self.stopped.add(name)
            query = self.spark.streams.get(name)
            if query is not None:
                # A query can't end in the thread that tells of its progress.
                threading.Thread(target=query.stop, daemon=True).start()

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def run_files(
    entries: DataFrame, convert: Callable[[dict], list[str]], existing: Callable[[], DataFrame], root: str, run_key: str, marker: str | None = None, report: Callable[[dict], None] | None = None, **trigger
) -> dict:
    """Convert the files of a stream until it has no more, or until a stop marker is left after the start; returns the run's report.

    ``convert`` takes a row and returns the paths that it wrote; ``existing`` gives the paths (path) that exist. A stop lets each task finish
    the file it is at. The report (converted, resumed, interrupted, error) is handed to ``report`` however the run ends.
    """
    spark, since = entries.sparkSession, time.time()
    asked = (lambda: stop_requested(marker, since)) if marker else (lambda: False)
    counts = {"converted": 0, "resumed": 0, "interrupted": False, "error": None}

    def batch(df: DataFrame, _: int) -> None:
        session = df.sparkSession
        left, resumed = todo(df.dropDuplicates(["sha256"]), read_state(session, root, run_key), existing())
        counts["resumed"] += resumed.count()
        counts["converted"] += journalled(left, convert, root, run_key, asked).agg(F.count_distinct("sha256")).first()[0]
        if asked():
            raise InterruptedError(STOPPED)

    listener = StopListener(spark, asked)
    spark.streams.addListener(listener)
    try:
        writer = entries.writeStream.foreachBatch(batch).option("checkpointLocation", os.path.join(root, f"checkpoint-{run_key}"))
        writer.trigger(**(trigger or {"availableNow": True})).start().awaitTermination()
    except Exception as e:  # noqa: BLE001  whatever ends the query ends up in the report
        if STOPPED not in str(e):
            counts["error"] = str(e).splitlines()[0]
            raise
    finally:
        spark.streams.removeListener(listener)
        counts["interrupted"] = asked()
        compact_state(spark, root, run_key)
        if report is not None:
            report(dict(counts))
    return counts
