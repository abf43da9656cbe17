"""One table held against another (JON-01, JON-04..07, SET-01/02, SMP-01, FLT-08/11, VAL-05/07)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarryline.session import cut


def snapshot_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """path, size, mtime_ns of a tree before and after -> (path, kind) of what vanished, was modified or was added."""
    b, a = before.select("path", F.struct("size", "mtime_ns").alias("b")), after.select("path", F.struct("size", "mtime_ns").alias("a"))
    kind = F.when(F.col("a").isNull(), "vanished").when(F.col("b").isNull(), "added").when(~F.col("a").eqNullSafe(F.col("b")), "modified")
    return b.join(a, "path", "full").select("path", kind.alias("kind")).where("kind is not null")


def added_paths(before: DataFrame, after: DataFrame) -> DataFrame:
    return after.join(before, "path", "left_anti").select("path").distinct()


def exact_sample(df: DataFrame, n: int, seed: int | None = None) -> DataFrame:
    """Just n rows (or all), drawn at random; a top-n by random key, so nothing but n rows a task moves."""
    if n < 0:
        raise ValueError("a sample can't be negative")
    return df.orderBy(F.rand(seed) if seed is not None else F.rand()).limit(n)


def verify_store(entries: DataFrame, store: DataFrame) -> DataFrame:
    """Expected (store_name, sha256) against stored (store_name, sha256): (store_name, problem)."""
    s = store.select("store_name", F.col("sha256").alias("stored"))
    problem = F.when(F.col("stored").isNull(), "missing").when(F.col("stored") != F.col("sha256"), "mismatch")
    return entries.join(s, "store_name", "left").select("store_name", problem.alias("problem")).where("problem is not null")


def done_entries(recorded: DataFrame, outputs: DataFrame, existing: DataFrame) -> DataFrame:
    """sha256 of entries recorded as done, all of whose recorded outputs (sha256, path) exist (path)."""
    missing = outputs.join(existing, "path", "left_anti").select("sha256")
    return recorded.select("sha256").distinct().join(missing, "sha256", "left_anti")


def split_resume(entries: DataFrame, done: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(to do, resumed)."""
    return entries.join(done, "sha256", "left_anti"), entries.join(done, "sha256", "left_semi")


def run_is_valid(stored: Column, wanted: Column) -> Column:
    """Whether state of one run key serves another: version, specs, template (default if missing), folder key, extras."""
    extras = F.coalesce(stored["extras"], F.array(F.lit("jpeg"), F.lit("tiff")))
    return (
        stored["version"].eqNullSafe(wanted["version"]) & F.array_sort(stored["specs"]).eqNullSafe(F.array_sort(wanted["specs"]))
        & (F.coalesce(stored["template"], F.lit("{date}_{name}")) == wanted["template"]) & (F.coalesce(stored["folder_key"], F.lit("album")) == wanted["folder_key"])
        & (F.size(F.array_except(wanted["extras"], extras)) == 0)
    )


def first_pattern(rows: DataFrame, text: Column, patterns: list[tuple[str, str]], default: str | None = None, out: str = "zone") -> DataFrame:
    """The value of the first pattern, in their order, that the lower-cased text contains. The list is configuration."""
    found = F.lit(default)
    for pattern, value in reversed(patterns):
        found = F.when(F.contains(F.lower(text), F.lit(pattern.lower())), value).otherwise(found)
    return rows.withColumn(out, found)


def collisions(paths: DataFrame, order: list[str], path: str = "path") -> DataFrame:
    """Rows whose path, whatever its case, a row before them in order claims. The first claimant has it."""
    turn = F.row_number().over(Window.partitionBy(F.lower(path)).orderBy(*order))
    return paths.withColumn("_n", turn).where("_n > 1").drop("_n")


def refused_entries(claims: DataFrame, taken: DataFrame | None = None) -> DataFrame:
    """(entry, path), several paths an entry, in the order of entry -> (entry, path): entries refused, with a claimed path of each.

    An entry one of whose paths is taken, by an earlier entry that was not refused itself or by what an earlier run
    left (taken: path), is refused as a whole and claims nothing. In rounds: who comes first for all its paths has them, who
    wants one of those is refused; the others are asked again. Paths count whatever their case.
    """
    open_ = cut(claims.select("entry", F.lower("path").alias("key"), "path").dropDuplicates(["entry", "key"]))
    out = open_.select("entry", "path").limit(0)
    won = open_.select("key").limit(0) if taken is None else taken.select(F.lower("path").alias("key")).distinct()
    while True:
        refused = cut(open_.join(won, "key", "left_semi").groupBy("entry").agg(F.min("path").alias("path")))
        out = out.unionByName(refused)
        open_ = open_.join(refused.select("entry"), "entry", "left_anti")
        first = open_.groupBy("key").agg(F.min("entry").alias("first"))
        ahead = open_.join(first, "key").groupBy("entry").agg(F.bool_and(F.col("entry") == F.col("first")).alias("has_all")).where("has_all").select("entry")
        ahead = cut(ahead)
        if ahead.isEmpty():
            return out
        won = open_.join(ahead, "entry", "left_semi").select("key")
        open_ = open_.join(ahead, "entry", "left_anti")
        won, open_ = cut(won), cut(open_)


def tag_problem(forbidden: Column, value: Column, values: Column) -> Column:
    """What is wrong with the values (none: an empty array) of a tag of which one should be value, or none be there; else null."""
    there = F.size(values) > 0
    same = F.exists(values, lambda v: v.eqNullSafe(value))
    return F.when(forbidden, F.when(there, "forbidden")).when(~there, "missing").when(~same, "different")


def check_tags(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """(path, tag, value, forbidden) against (path, tag, value): problems.

    A tag may stand in several rows, and one of them must have the value. A tag that is there with null is there.
    """
    a = actual.groupBy("path", "tag").agg(F.collect_set(F.struct(F.col("value").alias("v"))).alias("values"))
    values = F.coalesce(F.transform("values", lambda x: x["v"]), F.array().cast("array<string>"))
    problem = tag_problem(F.col("forbidden"), F.col("value"), values)
    return expected.join(a, ["path", "tag"], "left").select("path", "tag", problem.alias("problem")).where("problem is not null")


def expected_geometry(turned_w: Column, turned_h: Column, width: Column, height: Column, box: Column, cropped: Column) -> Column:
    """The size an output should have, from what the file declares and never from its pixels."""
    w, h = F.coalesce(turned_w, width), F.coalesce(turned_h, height)
    return F.struct(F.when(cropped & box.isNotNull(), box["right"] - box["left"]).otherwise(w).alias("width"), F.when(cropped & box.isNotNull(), box["bottom"] - box["top"]).otherwise(h).alias("height"))


def check_output_set(expected: DataFrame, existing: DataFrame) -> DataFrame:
    """(sha256, path, width, height) against (path, width, height): problems; a missing file silences the entry's others."""
    e = existing.select("path", F.col("width").alias("w"), F.col("height").alias("h"), F.lit(True).alias("there"))
    size = F.when(F.col("there").isNull(), "missing").when(F.col("width").isNull() | F.col("height").isNull(), "size unknown").when((F.col("w") != F.col("width")) | (F.col("h") != F.col("height")), "size differs")
    d = expected.join(e, "path", "left").withColumn("problem", size)
    d = d.withColumn("_gone", F.max(F.coalesce(F.col("problem") == "missing", F.lit(False))).over(Window.partitionBy("sha256")))
    return d.where("problem is not null and (problem = 'missing' or not _gone)").select("sha256", "path", "problem")


def source_fallback(entries: DataFrame, files: DataFrame) -> DataFrame:
    """The store's file if it is there, else the source's, else null."""
    f = files.select(F.col("path").alias("f")).distinct()
    d = entries.join(f, F.col("store_path") == F.col("f"), "left").withColumnRenamed("f", "_s").join(f, F.col("source_path") == F.col("f"), "left")
    return d.withColumn("found_path", F.coalesce("_s", "f")).drop("_s", "f")
