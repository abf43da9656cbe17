"""Session defaults: UTC wall clock, ANSI arithmetic, adaptive execution, zone-free timestamps."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.timestampType": "TIMESTAMP_NTZ",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}

#: Bytes of an Arrow batch of large values, on the way to Python and back, and Spark's setting of the former.
BATCH_BYTES = 4 << 20
BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def local_session(cores: int | str = 8, app: str = "quarryline", memory: str = "12g", **extra: str) -> SparkSession:
    """A local session for tests and the bench; on a cluster pass your own session to the operators."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app).config("spark.driver.memory", memory)
    conf = {**DEFAULTS, "spark.sql.shuffle.partitions": os.environ.get("SHUFFLE_PARTITIONS", "8"), **extra}
    return builder.config(map=conf).getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where none is set, a local session (tests) gets a new one, a cluster must name one."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        path = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if not path and not re.match(r"local(\[|$)", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(path or tempfile.mkdtemp(prefix="spark-shared-", dir="/tmp"))
    return context.getCheckpointDir()


def mounted_folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder for files that tasks open themselves, which needs the folder to be mounted."""
    return f"{shared_folder(spark).removeprefix('file:').replace('///', '/')}/{name}-{uuid.uuid4().hex}"


def many_tasks(spark: SparkSession) -> int:
    """Tasks for work that bytes don't tell of: several a core, or as many as the session shuffles into."""
    return max(spark.sparkContext.defaultParallelism * 4, int(spark.conf.get("spark.sql.shuffle.partitions")))


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches of rows with large values stay small: Spark's own 64 MB stand in the JVM, in the worker and in what it makes of them, in every task of an executor."""
    number, unit = re.fullmatch(r"\s*(\d+)\s*([kmgtp]?)i?b?\s*", spark.conf.get(BATCH_SETTING).lower()).groups()
    if int(number) << 10 * " kmgtp".index(unit or " ") > BATCH_BYTES:
        spark.conf.set(BATCH_SETTING, str(BATCH_BYTES))


def cut(df: DataFrame) -> DataFrame:
    """df as a table of its own: a reliable checkpoint in the shared folder, which ends its lineage."""
    shared_folder(df.sparkSession)
    return df.checkpoint()
