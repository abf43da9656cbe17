"""Rows chosen by order (WIN-06, WIN-07)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarryline.session import cut


def stratified_cover(rows: DataFrame, key: str, axes: dict[str, int], size: int) -> DataFrame:
    """The first k rows of every value on each axis, then the next rows in order up to a size.

    The cover is bounded by the axes' values: each axis keeps its first rows where they are read, before anything is
    shuffled, and only keys are ranked. The rest is a top-n, so no step sorts the table as a whole. Keys are unique.
    """
    kept = None
    for axis, k in axes.items():
        ranked = rows.select(axis, key).withColumn("_r", F.row_number().over(Window.partitionBy(axis).orderBy(key))).where(F.col("_r") <= k)
        kept = ranked.select(key) if kept is None else kept.unionByName(ranked.select(key))
    chosen = kept.distinct()
    cover = rows.join(chosen, key, "left_semi")
    more = rows.join(chosen, key, "left_anti").orderBy(key).limit(size)
    n = Window.orderBy("_late", key)
    both = cover.withColumn("_late", F.lit(0)).unionByName(more.withColumn("_late", F.lit(1)))
    return both.withColumn("_n", F.row_number().over(n)).where((F.col("_late") == 0) | (F.col("_n") <= size)).drop("_late", "_n")


def running_progress(lines: DataFrame, run: str, order: list[str]) -> DataFrame:
    """done, total, failed, interrupted of each line -> the same as they stand after it, within a run: the largest done, the last
    total, all that failed, whether it was ever interrupted.

    A prefix scan of two levels: lines are dealt by ranges of run and order, each range is summed up, what the ranges before say is
    carried into it, and rows add up inside their range. So a run of any length spreads over tasks. The order tells the lines of a run apart.
    """
    dealt = lines.select(run, *order, "done", "total", F.col("failed").cast("long").alias("failed"), "interrupted").repartitionByRange(run, *order)
    dealt = cut(dealt.withColumn("_part", F.spark_partition_id()))
    at = F.struct(*order)
    parts = dealt.groupBy(run, "_part").agg(F.max("done").alias("done"), F.max_by("total", F.when(F.col("total").isNotNull(), at)).alias("total"), F.sum("failed").alias("failed"), F.bool_or("interrupted").alias("interrupted"))

    def so_far(w) -> dict[str, Column]:
        return {"done": F.max("done").over(w), "total": F.last("total", ignorenulls=True).over(w), "failed": F.coalesce(F.sum("failed").over(w), F.lit(0)), "interrupted": F.coalesce(F.bool_or("interrupted").over(w), F.lit(False))}

    before = so_far(Window.partitionBy(run).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    carried = parts.select(F.col(run).alias("_run"), F.col("_part").alias("_p"), *(c.alias(f"_{n}") for n, c in before.items()))
    inside = so_far(Window.partitionBy(run, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    both = dealt.select(run, *order, "_part", *(c.alias(n) for n, c in inside.items())).join(carried, F.col(run).eqNullSafe(F.col("_run")) & (F.col("_part") == F.col("_p")))
    return both.select(run, *order, F.greatest("_done", "done").alias("done"), F.coalesce("total", "_total").alias("total"), (F.col("_failed") + F.col("failed")).alias("failed"), (F.col("_interrupted") | F.col("interrupted")).alias("interrupted"))
