"""Running progress of runs over an arriving log (STM-02); operators.choose.running_progress is its batch twin.

State is typed: one row a run (done, total, failed, interrupted). With ``idle_ms`` a run's state ends once no line came for so
long, by a timer that each of its lines sets anew; such a query looks for timers for ever and needs a trigger by processing time. transformWithState keeps its state in RocksDB, which ``track_progress`` sets for the session.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OUT = "run string, seq long, done int, total int, failed long, interrupted boolean"
STATE = "done int, total int, failed long, interrupted boolean"
PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class RunProgress(StatefulProcessor):
    def __init__(self, idle_ms: int | None):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("progress", STATE)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        done, total, failed, interrupted = self.state.get() if self.state.exists() else (None, None, 0, False)
        out = []
        for x in pd.concat(rows).sort_values("seq").itertuples(index=False):
            if not pd.isna(x.done):
                done = int(x.done) if done is None else max(done, int(x.done))
            if not pd.isna(x.total):
                total = int(x.total)
            failed += not pd.isna(x.failed) and bool(x.failed)
            interrupted = interrupted or (not pd.isna(x.interrupted) and bool(x.interrupted))
            out.append((key[0], x.seq, done, total, failed, interrupted))
        self.state.update((done, total, failed, interrupted))
        if self.idle_ms is not None:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)
        d = pd.DataFrame(out, columns=["run", "seq", "done", "total", "failed", "interrupted"])
        yield d.astype({"done": "Int32", "total": "Int32"})

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.state.clear()
        return iter([])

    def close(self) -> None:
        pass


def track_progress(events: DataFrame, idle_ms: int | None = None) -> DataFrame:
    """A stream of (run, seq, done, total, failed, interrupted) -> the same as they stand after each event of the run."""
    events.sparkSession.conf.set(*PROVIDER)
    mode = "none" if idle_ms is None else "processingTime"
    return events.groupBy("run").transformWithStateInPandas(RunProgress(idle_ms), OUT, "Append", mode)
