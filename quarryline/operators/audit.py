"""What a run did (AGG-05..10, LIM-02, PRJ-13, RUN-02/04, SRT-01)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PRESENT = ("converted", "resumed")


def counts(records: DataFrame) -> DataFrame:
    one = lambda s: F.count_if(F.col("status") == s).alias(s)
    return records.agg(F.count("*").alias("attempted"), one("converted"), one("resumed"), one("failed"), F.count_if((F.col("n_warnings") > 0) & F.col("status").isin(*PRESENT)).alias("with_warnings"), F.count_if(F.col("is_undated") & F.col("status").isin(*PRESENT)).alias("undated"))


def frequencies(records: DataFrame) -> DataFrame:
    """Counts by date source, transform and album of what is present, in one pass: (axis, value, n)."""
    axes = ["date_source", "transform_status", "album"]
    long = records.where(F.col("status").isin(*PRESENT)).select(F.explode(F.array(*[F.struct(F.lit(a).alias("axis"), F.col(a).alias("value")) for a in axes])).alias("x"))
    return long.select("x.*").where("value is not null and (axis <> 'transform_status' or trim(value) <> '')").groupBy("axis", "value").agg(F.count("*").alias("n"))


def identical_groups(records: DataFrame) -> DataFrame:
    """Groups of present files with the same pixels: digest, size of the group, its first and last name."""
    g = records.where(F.col("pixel_sha256").isNotNull() & F.col("status").isin(*PRESENT)).groupBy("pixel_sha256")
    return g.agg(F.count("*").alias("n"), F.min("store_name").alias("first_name"), F.max("store_name").alias("last_name")).where("n > 1")


def identical_members(records: DataFrame) -> DataFrame:
    """The files of those groups: (pixel_sha256, store_name), a row each, so that no group has to fit a list."""
    own = records.where(F.col("pixel_sha256").isNotNull() & F.col("status").isin(*PRESENT)).select("pixel_sha256", "store_name")
    return own.join(identical_groups(records).select("pixel_sha256"), "pixel_sha256", "left_semi")


def by_album(records: DataFrame) -> DataFrame:
    """The records sorted by album, whatever its case, then by name."""
    return records.orderBy(F.lower("album"), "album", "store_name")


def failure_preview(records: DataFrame, most: int = 20) -> DataFrame:
    """The first failures by name, with their errors as one text."""
    shown = records.where("status = 'failed'").select("store_name", "errors").orderBy("store_name").limit(most)
    return shown.select("store_name", F.array_join("errors", "; ").alias("errors"))


def run_text(report: DataFrame) -> DataFrame:
    """converted, resumed, failed, with_warnings, attempted, in_manifest, interrupted, complete -> lines for a person."""
    lines = F.array_compact(F.array(
        F.format_string("converted %d, resumed %d, failed %d of %d", "converted", "resumed", "failed", "in_manifest"),
        F.format_string("%d with warnings", "with_warnings"),
        F.when(F.col("interrupted"), "INTERRUPTED: run again to resume"),
        F.when(~F.coalesce("complete", F.lit(True)), F.format_string("PARTIAL RUN: %d of %d entries were not handled", F.col("in_manifest") - F.col("attempted"), "in_manifest")),
    ))
    return report.select("*", F.array_join(lines, "\n").alias("text"))


def completeness(records: DataFrame, selected: int | None, in_manifest: int, interrupted: bool) -> DataFrame:
    """attempted, complete, not_attempted; a run is complete if it wasn't stopped and attempted all of the manifest."""
    n = F.count("*")
    wanted = in_manifest if selected is None else selected
    return records.agg(n.alias("attempted"), ((n == wanted) & F.lit(wanted == in_manifest) & F.lit(not interrupted)).alias("complete"), F.greatest(F.lit(0), F.lit(in_manifest) - n).alias("not_attempted"))


def albums_needing_date(records: DataFrame) -> DataFrame:
    """Albums of which any file is undated: (album, files, undated_files)."""
    return records.groupBy("album").agg(F.count("*").alias("files"), F.count_if("is_undated").alias("undated_files")).where("undated_files > 0")


def summary(report: DataFrame) -> DataFrame:
    """attempted, failed, with_warnings, interrupted, complete -> a severity and a sentence; a missing complete is false."""
    complete = F.coalesce(F.col("complete"), F.lit(False))
    level = F.when(F.col("interrupted"), "interrupted").when(~complete, "incomplete").when(F.col("failed") > 0, "failed").otherwise("ok")
    sentence = F.when(level == "interrupted", F.format_string("Stopped after %d files.", "attempted")).when(level == "incomplete", F.format_string("Only %d files were attempted.", "attempted")).when(level == "failed", F.format_string("%d of %d files failed.", "failed", "attempted")).otherwise(F.format_string("All %d files are done, %d with warnings.", "attempted", "with_warnings"))
    return report.select("*", level.alias("severity"), sentence.alias("sentence"))


def dry_run(entries: DataFrame, specs: int) -> DataFrame:
    """Entries with found_path -> what a run would write and what it would miss."""
    missing = F.count_if(F.col("found_path").isNull())
    return entries.agg(F.count("*").alias("entries"), (F.count("*") * specs).alias("images"), missing.alias("missing"), F.when(missing > 0, 2).otherwise(0).alias("exit_code"))
