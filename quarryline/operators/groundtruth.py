"""Albums whose names are dated, held against their files' import stamps (JON-02, AGG-03, AGG-04)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryline.functions.dates import folder_date


def verdicts(entries: DataFrame, stamps: DataFrame) -> DataFrame:
    """(sha256, albums) and (sha256, import_ts) -> a row per album: its date, the stamps' range and a verdict.

    A file counts once in each of its albums; entries without a stamp don't count. Pairs combine per album and day before
    the albums meet, so one album may hold most files.
    """
    pairs = entries.select("sha256", F.explode("albums").alias("album")).where(F.trim("album") != "").join(stamps, "sha256")
    days = pairs.groupBy("album", F.to_date("import_ts").alias("day")).agg(F.count("*").alias("n"))
    a = days.groupBy("album").agg(F.sum("n").alias("file_count"), F.count_if(F.col("day").isNotNull()).alias("distinct_days"), F.min("day").alias("min_day"), F.max("day").alias("max_day"))
    a = a.withColumn("d", folder_date(F.col("album")))
    start, end, kind, low, high = F.col("d.start_date"), F.col("d.end_date"), F.col("d.date_kind"), F.col("min_day"), F.col("max_day")
    a = a.withColumns({"delta_min": F.date_diff(low, start), "delta_max": F.date_diff(high, start)})
    lo, hi = F.col("delta_min"), F.col("delta_max")
    gate = kind.isin("exact_day", "month", "season") & (F.year(low) != F.year(start))
    day = F.when((lo >= 0) & (lo <= 3) & (hi >= 0) & (hi <= 3), "PASS").when((lo >= 0) & (lo <= 14) & (hi <= 7), "NEAR").otherwise("FAIL")
    after = F.date_diff(low, end)
    part = F.when((low >= start) & (low <= end), "PASS").when((after >= 0) & (after <= 30), "NEAR").otherwise("FAIL")
    years = F.when((low >= start) & (high <= end), "PASS").when((F.year(low) == F.col("d.year")) | (F.year(high) == F.year(end)), "NEAR").otherwise("FAIL")
    verdict = F.when(~F.col("d.parsed") | low.isNull(), "UNDATED").when(gate, "FAIL").when(kind == "exact_day", day).when(kind.isin("month", "season"), part).otherwise(years)
    return a.select("album", "file_count", "distinct_days", kind.alias("date_kind"), start.alias("start_date"), end.alias("end_date"), "min_day", "max_day", "delta_min", "delta_max", verdict.alias("verdict"))


def roll_up(albums: DataFrame) -> DataFrame:
    count = lambda v: F.count_if(F.col("verdict") == v)
    return albums.agg(F.count("*").alias("albums"), count("PASS").alias("passed"), count("NEAR").alias("near"), count("FAIL").alias("failed"), count("UNDATED").alias("undated"), F.coalesce(F.sum("file_count"), F.lit(0)).alias("files"), (count("FAIL") == 0).alias("ok"))
