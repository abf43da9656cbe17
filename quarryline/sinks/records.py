"""Records of a run, to JSON and back, and its report (JSN-01, SNK-07, SNK-08)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RECORD = "sha256 string, store_name string, album string, status string, date_source string, is_undated boolean, date_original string, transform_status string, crop_applied array<int>, outputs array<string>, pixel_sha256 string, errors array<string>, warnings array<string>, seconds double"
NAMES = [x.split()[0] for x in RECORD.split(", ")]


def _defaults() -> dict[str, Column]:
    """What a record is when it doesn't say."""
    none = F.array().cast("array<string>")
    text = {n: F.lit("") for n in ("sha256", "store_name", "album", "date_original", "transform_status")}
    return text | {"date_source": F.lit("none"), "is_undated": F.lit(True), "outputs": none, "errors": none, "warnings": none, "seconds": F.lit(0.0)}


def to_json(records: DataFrame, out: str = "json") -> DataFrame:
    """sha256 and the record as a JSON text; seconds to three places, nulls written."""
    own = records.withColumn("seconds", F.round("seconds", 3))
    return own.select("sha256", F.to_json(F.struct(*NAMES), {"ignoreNullFields": "false"}).alias(out))


def from_json(texts: DataFrame, column: str = "json") -> DataFrame:
    """Recalled records: what is missing has its default, and the status is resumed, as this run didn't do the work."""
    r = texts.select(F.from_json(column, RECORD).alias("r")).select("r.*")
    r = r.withColumns({n: F.coalesce(F.col(n), d) for n, d in _defaults().items()})
    box = F.when(F.size("crop_applied") > 0, F.col("crop_applied"))
    return r.withColumns({"status": F.lit("resumed"), "crop_applied": box}).select(*NAMES)


def write_report(path: str, **parts: DataFrame) -> None:
    """The report's tables (counts, frequencies, groups, failures, ...) as JSON, a folder each."""
    for name, part in parts.items():
        part.write.mode("overwrite").json(f"{path}/{name}")


def append_log(lines: DataFrame, path: str) -> None:
    """Lines (run, at, line) at the end of a log table; what is there stays."""
    lines.select("run", "at", "line").write.mode("append").partitionBy("run").parquet(path)
