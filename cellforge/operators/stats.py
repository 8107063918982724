"""Band statistics, histograms and percentiles; all by partial and final aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .zones import inside, sized


def statistics(cells: DataFrame, value: str, *by: str) -> DataFrame:
    """``n, min, max, mean, std`` (of the population) of valid cells; all zero where there are none."""
    v = F.col(value).cast("double")
    found = (F.count(v).alias("n"), F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"))
    out = cells.groupBy(*by).agg(*found) if by else cells.agg(*found)
    return out.select(*by, "n", *(F.coalesce(c, F.lit(0.0)).alias(c) for c in ("min", "max", "mean", "std")))


def sigma_range(stats: DataFrame, sigmas: float, *by: str) -> DataFrame:
    """``low, high``: mean -+ sigmas * std within the data; the data's own range where that is empty."""
    low = F.greatest(F.col("min"), F.col("mean") - sigmas * F.col("std"))
    high = F.least(F.col("max"), F.col("mean") + sigmas * F.col("std"))
    return stats.select(*by, F.when(low < high, low).otherwise(F.col("min")).alias("low"), F.when(low < high, high).otherwise(F.col("max")).alias("high"))


def bin_of(v: Column, low: Column, high: Column, bins: int) -> Column:
    return F.least(F.lit(bins - 1), F.greatest(F.lit(0), ((v - low) * (bins / (high - low))).cast("int")))


def histogram(cells: DataFrame, value: str, bins: int = 1024, *by: str) -> DataFrame:
    """``bin, n`` and the range ``low, high`` they divide evenly; only bins with cells, and none if all are alike.

    The range is a row a group that joins the cells; counts are combined before the shuffle.
    """
    bins = max(2, bins)
    v = F.col(value).cast("double")
    spread = (F.min(v).alias("low"), F.max(v).alias("high"))
    valid = cells.where(F.col(value).isNotNull())
    if by:
        ranged = valid.join(valid.groupBy(*by).agg(*spread), list(by))
    else:
        ranged = valid.crossJoin(F.broadcast(valid.agg(*spread)))  # one row
    width = F.when(F.col("high") > F.col("low"), bin_of(v, F.col("low"), F.col("high"), bins))
    return ranged.where("high > low").groupBy(*by, "low", "high", width.alias("bin")).agg(F.count("*").alias("n"))


def display_histogram(cells: DataFrame, value: str, bins: int = 64) -> DataFrame:
    """``bin, n`` as drawn: the greatest value has a bin of its own, so bins are (high - low) / (bins - 1) wide."""
    v = F.col(value).cast("double")
    valid = cells.where(F.col(value).isNotNull())
    ranged = valid.crossJoin(F.broadcast(valid.agg(F.min(v).alias("low"), F.max(v).alias("high"))))  # one row
    place = F.when(F.col("high") > F.col("low"), ((v - F.col("low")) / (F.col("high") - F.col("low")) * (bins - 1)).cast("int")).otherwise(0)
    return ranged.groupBy(place.alias("bin")).agg(F.count("*").alias("n"))


def percentiles(counts: DataFrame, percents: list[float], bins: int = 1024, *by: str) -> DataFrame:
    """``percent, value``: the centre of the first bin where the running count reaches the rounded rank (half to even)."""
    running = F.sum("n").over(Window.partitionBy(*by, "low", "high").orderBy("bin"))
    total = F.sum("n").over(Window.partitionBy(*by, "low", "high"))
    wanted = F.explode(F.array(*(F.lit(float(min(100.0, max(0.0, p)))) for p in percents)))
    ranked = counts.select("*", running.alias("running"), total.alias("total")).select("*", wanted.alias("percent"))
    reached = ranked.where(F.col("running") >= F.rint(F.col("percent") / 100 * F.col("total")))
    first = reached.groupBy(*by, "low", "high", "percent").agg(F.min("bin").alias("bin"))
    first = first.withColumn("bin", F.when(F.col("percent") == 0, F.lit(0)).otherwise(F.col("bin")))
    return first.select(*by, "percent", (F.col("low") + (F.col("bin") + 0.5) / (bins / (F.col("high") - F.col("low")))).alias("value"))


def percentile_range(cells: DataFrame, value: str, low: float = 2.0, high: float = 98.0, bins: int = 1024, *by: str) -> DataFrame:
    """``low, high``: two percentiles; the range of all values where these don't differ, as of a constant raster, and zeros
    where there are no values."""
    found = percentiles(histogram(cells, value, bins, *by), [low, high], bins, *by)
    pick = lambda p: F.max(F.when(F.col("percent") == float(p), F.col("value")))
    two = found.groupBy(*by).agg(pick(low).alias("a"), pick(high).alias("b")) if by else found.agg(pick(low).alias("a"), pick(high).alias("b"))
    whole = statistics(cells, value, *by)
    both = whole.join(two, list(by), "left") if by else whole.crossJoin(F.broadcast(two))  # one row each
    apart = F.coalesce(F.col("b") > F.col("a"), F.lit(False))
    return both.select(*by, F.when(apart, F.col("a")).otherwise(F.col("min")).alias("low"), F.when(apart, F.col("b")).otherwise(F.col("max")).alias("high"))


def no_data(cells: DataFrame, value: str, *by: str) -> DataFrame:
    """``n_missing, n_cells`` of dense cells."""
    found = (F.count_if(F.col(value).isNull()).alias("n_missing"), F.count("*").alias("n_cells"))
    return cells.groupBy(*by).agg(*found) if by else cells.agg(*found)


def change(cells: DataFrame, first: str, second: str, area: float, threshold: float = 0.0) -> DataFrame:
    """Summary of second - first where both are valid: counts, range, mean, deviation, cells beyond the threshold, volumes."""
    delta = F.col(second).cast("double") - F.col(first).cast("double")
    d = F.col("delta")
    zero = F.lit(0.0)
    return (
        cells.select(delta.alias("delta"))
        .agg(
            F.count(d).alias("n"), F.count_if(d.isNull()).alias("n_missing"), F.min(d).alias("min"), F.max(d).alias("max"), F.avg(d).alias("mean"),
            F.stddev_pop(d).alias("std"), F.count_if(F.abs(d) > threshold).alias("n_beyond"),
            F.coalesce(F.sum(F.when(d < 0, -d * area)), zero).alias("cut"), F.coalesce(F.sum(F.when(d >= 0, d * area)), zero).alias("fill"),
        )
        .withColumn("net", F.col("fill") - F.col("cut"))
        .withColumn("area_beyond", F.col("n_beyond") * area)
    )


def change_within(cells: DataFrame, first: str, second: str, spans: DataFrame, area: float, threshold: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """The summary of ``change`` and the raster of ``change_raster`` within row spans; the raster is null outside."""
    held = inside(cells, sized(spans.drop("zone").distinct()), "left_semi").select("row", "col").withColumn("held", F.lit(True))
    within = cells.join(held, ["row", "col"], "left")
    values = [F.when(F.col("held"), F.col(c)).alias(c) for c in (first, second)]
    return change(within.where("held"), first, second, area, threshold), change_raster(within.select("row", "col", *values), first, second)


def change_raster(cells: DataFrame, first: str, second: str) -> DataFrame:
    """``row, col, v``: second - first, in single precision; null where either is."""
    delta = (F.col(second).cast("double") - F.col(first).cast("double")).cast("float")
    return cells.select("row", "col", F.when(~F.isnan(delta), delta).alias("v"))
