"""Agreement of images and statistics of samples (AGG-11..17)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FLAT = 1e-6
#: Chroma agrees from this correlation on, within this scale, and up to this offset.
LEAST_CORR, SCALE, OFFSET = 0.5, (0.65, 1.45), 30.0


def pearson(x: Column, y: Column) -> Column:
    """Correlation of two columns in a group; 0 if either is flat; within -1 and 1."""
    spread = F.sqrt(F.var_pop(x) * F.count(x)), F.sqrt(F.var_pop(y) * F.count(y))
    r = F.try_divide(F.covar_pop(x, y) * F.count(x), spread[0] * spread[1])
    return F.when((spread[0] < FLAT) | (spread[1] < FLAT), F.lit(0.0)).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.coalesce(r, F.lit(0.0)))))


def chroma(x: Column, y: Column, name: str) -> list[Column]:
    """Correlation, scale and offset of an output's chroma x against the thumbnail's y, flat ones told apart."""
    sx, sy = F.stddev_pop(x), F.stddev_pop(y)
    r = F.coalesce(F.try_divide(F.covar_pop(x, y), sx * sy), F.lit(0.0))
    corr = F.when(sy < FLAT, F.lit(1.0)).when(sx < FLAT, F.lit(0.0)).otherwise(r)
    scale = F.when(sy < FLAT, F.when(sx < FLAT, F.lit(1.0)).otherwise(F.lit(float("inf")))).when(sx < FLAT, F.lit(0.0)).otherwise(F.try_divide(sx, sy))
    return [corr.alias(f"{name}_corr"), scale.alias(f"{name}_scale"), (F.avg(x) - F.avg(y)).alias(f"{name}_offset")]


def chroma_faults(df: DataFrame, names: tuple[str, ...] = ("cr", "cb")) -> DataFrame:
    """Add faults: what fails the gates, in a fixed order, joined by commas."""
    checks = []
    for n in names:
        checks += [F.when(F.col(f"{n}_corr") < LEAST_CORR, f"{n}_corr"), F.when(~F.col(f"{n}_scale").between(*SCALE), f"{n}_scale"), F.when(F.abs(f"{n}_offset") > OFFSET, f"{n}_offset")]
    return df.withColumn("faults", F.concat_ws(",", *checks))


def pixel_statistics(value: Column, low: float, high: float) -> list[Column]:
    return [F.avg(value).alias("mean"), F.stddev_pop(value).alias("stdev"), F.avg(((value <= low) | (value >= high)).cast("double")).alias("clipped")]


def sample_extremes(samples: DataFrame) -> DataFrame:
    """mean, stdev, corr, offset of samples -> their extremes and the exact median of the spreads."""
    return samples.agg(F.count("*").alias("n"), F.min("mean").alias("least_mean"), F.max("mean").alias("most_mean"), F.min("stdev").alias("least_stdev"), F.max("stdev").alias("most_stdev"), F.median("stdev").alias("median_stdev"), F.min("corr").alias("worst_corr"), F.max(F.abs("offset")).alias("worst_offset"))


def improvements(pairs: DataFrame) -> DataFrame:
    """before, after -> how many got better, and by how much on average and at least."""
    delta = F.col("after") - F.col("before")
    return pairs.agg(F.count_if(delta > 0).alias("better"), F.avg(delta).alias("mean_delta"), F.min(delta).alias("least_delta"))
