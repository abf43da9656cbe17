"""The catalogue of distinct files: copies collapsed, a preferred place chosen, names given (AGG-01/02, WIN-01..04, LIM-01)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarryline.functions import names
from quarryline.session import cut


def preferred(sources: DataFrame) -> DataFrame:
    """sha256, relpath, name -> the row of each sha256 to prefer: a person's name over a camera's, the longest stem, the first path."""
    order = Window.partitionBy("sha256").orderBy(names.is_camera_name(F.col("name")), F.length(names.stem(F.col("name"))).desc(), "relpath")
    return sources.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def manifest(sources: DataFrame) -> DataFrame:
    """sha256, relpath, name, size -> one row per sha256.

    The preferred row comes from a minimum of structs, so copies combine before the shuffle and one content may have any
    number of copies; albums, trees and sources are lists by contract.
    """
    path = F.col("relpath")
    place = F.struct(names.is_camera_name(F.col("name")).alias("camera"), (-F.length(names.stem(F.col("name")))).alias("short"), "relpath", "name")
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    return sources.groupBy("sha256").agg(
        F.max("size").alias("size"), F.min(place).alias("p"), F.array_sort(F.collect_set(blank(names.album(path)))).alias("albums"),
        F.array_sort(F.collect_set(blank(names.tree(path)))).alias("trees"), F.array_sort(F.collect_list("relpath")).alias("sources"), F.count("*").alias("duplicate_count"),
    ).select("sha256", "size", F.col("p.name").alias("preferred_name"), F.col("p.relpath").alias("preferred_relpath"), (~F.col("p.camera")).alias("is_human_named"), "albums", "trees", "sources", "duplicate_count")


def manifest_counts(entries: DataFrame) -> DataFrame:
    """Entries -> files and bytes seen and distinct, human names, and what isn't a container (unknown counts as not)."""
    n = F.col("duplicate_count")
    out = [F.sum(n).alias("files_seen"), F.count("*").alias("files_distinct"), F.sum(n * F.col("size")).alias("bytes_seen"), F.sum("size").alias("bytes_distinct"), F.count_if("is_human_named").alias("human_named")]
    if "is_ole" in entries.columns:
        out.append(F.count_if(~F.col("is_ole").eqNullSafe(F.lit(True))).alias("not_ole"))
    return entries.agg(*out)


def assign_names(entries: DataFrame, name: str = "name", scope: str | None = None, out: str = "given") -> DataFrame:
    """sha256 and name (and scope) -> the stem each entry gets.

    In the order of (sha256, name) the first to ask has its stem bare; others add 8 digits of their hash, then -2, -3 and on. Stems
    differ by more than case. That is found in rounds: every entry asks for a stem, of all that ask for one the first in order
    keeps it, also from one that had it, and the others ask for their next. When all keep theirs, all have what they had in one pass in
    order. Of entries that ask for the same stems in the same order the k-th can't have one before the k-th, and begins there.
    """
    stem = names.stem(F.col(name))
    scoped = F.lower(F.col(scope)) if scope else F.lit("")
    e = entries.withColumns({"_stem": stem, "_scope": F.coalesce(scoped, F.lit("")), "_digits": F.substring("sha256", 1, 8)})
    alike = Window.partitionBy("_scope", F.lower("_stem"), "_digits").orderBy("sha256", name)
    e = e.withColumn("_k", F.row_number().over(alike) - 1)
    e = cut(e.withColumn("_turn", F.struct("sha256", name, "_k")))
    k = F.col("_k")
    asked = F.concat("_stem", F.when(k == 0, "").when(k == 1, F.concat(F.lit("_"), "_digits")).otherwise(F.concat(F.lit("_"), "_digits", F.lit("-"), k.cast("string"))))
    while True:
        e = e.withColumn(out, asked).withColumn("_asked", F.lower(out))
        first = e.groupBy("_scope", "_asked").agg(F.min("_turn").alias("_first"))
        e = cut(e.join(first, ["_scope", "_asked"]).withColumn("_lost", F.col("_turn") != F.col("_first")).drop("_first"))
        if e.where("_lost").isEmpty():
            return e.select(*entries.columns, out)
        e = e.withColumn("_k", k + F.col("_lost").cast("int"))


def first_entries(named: DataFrame, limit: int | None) -> DataFrame:
    """The first entries by sha256, after all have their names; no limit for none, 0 or less."""
    return named.orderBy("sha256").limit(limit) if limit and limit > 0 else named


def choose_album(entries: DataFrame, dated) -> DataFrame:
    """sha256, albums -> album: the first of the highest rank, 2 for descriptive and dated, 1 for descriptive; 'Root' for none."""
    rank = lambda a: F.when(names.is_descriptive(a), F.when(dated(a), 2).otherwise(1)).otherwise(0)
    ranked = F.transform("albums", lambda a, i: F.struct((-rank(a)).alias("r"), i.alias("i"), a.alias("album")))
    return entries.withColumn("album", F.coalesce(F.array_min(ranked)["album"], F.lit("Root")))
