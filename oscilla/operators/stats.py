"""Exact order statistics of a series, and measures of resampling quality."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import in_band, positive_step
from ..validate import columns


def median(value: Column) -> Column:
    """Exact; 0 of no values."""
    return F.coalesce(F.median(value), F.lit(0.0))


def percentile(value: Column, p: float) -> Column:
    """Exact, between neighbours by share; 0 of no values."""
    if not 0 <= p <= 100:
        raise ValueError(f"a percentile lies between 0 and 100, not at {p}")
    return F.coalesce(F.percentile(value, F.lit(p / 100)), F.lit(0.0))


def extremes(df: DataFrame, value: str, series: str = "series_id") -> DataFrame:
    """Least and greatest value of a series; of no values +inf and -inf."""
    low, high = F.coalesce(F.min(value), F.lit(math.inf)), F.coalesce(F.max(value), F.lit(-math.inf))
    return df.groupBy(series).agg(low.alias("min"), high.alias("max"))


def without_floor(df: DataFrame, value: str, name: str, series: str = "series_id") -> DataFrame:
    """``df`` with ``value`` less the series' median, 0 where negative, and 0 under its tenth percentile after that."""
    whole = W.partitionBy(series)
    lifted = df.withColumn("__up", F.greatest(F.col(value) - F.coalesce(F.median(value).over(whole), F.lit(0.0)), F.lit(0.0)))
    low = F.coalesce(F.percentile("__up", F.lit(0.1)).over(whole), F.lit(0.0))
    return lifted.withColumn(name, F.when(F.col("__up") < low, F.lit(0.0)).otherwise(F.col("__up"))).drop("__up")


def steps(samples: DataFrame, series: str = "series_id", time: str = "ts_us") -> DataFrame:
    """(series_id, dt): seconds between neighbouring samples."""
    order = W.partitionBy(series).orderBy(time)
    return samples.select(series, ((F.col(time) - F.lag(time).over(order)) / F.lit(1e6)).alias("dt"))


def sampling_rate(samples: DataFrame, series: str = "series_id", time: str = "ts_us") -> DataFrame:
    """(series_id, dt, fs): the upper median of the positive steps, and its inverse; series without one are left out."""
    good = steps(samples, series, time).select(series, positive_step(F.col("dt")).alias("dt")).where("dt is not null")
    return upper_median(good, series, "dt").withColumn("fs", 1.0 / F.col("dt"))


def upper_median(df: DataFrame, series: str, value: str) -> DataFrame:
    """(series, value): the upper median of each series' values, from counts of equal ones in order; no array of a series."""
    counted = df.groupBy(series, value).agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(W.partitionBy(series).orderBy(value).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    place = F.floor(F.sum("__n").over(W.partitionBy(series)) / 2)
    marked = counted.withColumns({"__before": before, "__place": place})
    return marked.where("__before <= __place and __place < __before + __n").select(series, value)


def window_seconds(samples: DataFrame, n: int, series: str = "series_id", time: str = "ts_us") -> DataFrame:
    """(series_id, seconds) that ``n`` samples take at the median positive step."""
    return steps(samples, series, time).where("dt > 0").groupBy(series).agg((F.median("dt") * n).alias("seconds"))


def jitter(samples: DataFrame, series: str = "series_id", time: str = "ts_us") -> DataFrame:
    """Of each series' steps: median, spread, greatest, 99th percentile, and how many exceed three medians."""
    known = steps(samples, series, time).where("dt is not null").withColumn("m", F.median("dt").over(W.partitionBy(series)))
    return known.groupBy(series).agg(
        F.first("m").alias("median_dt"),
        F.stddev_pop("dt").alias("std_dt"),
        F.max("dt").alias("max_dt"),
        F.percentile("dt", F.lit(0.99)).alias("p99_dt"),
        F.count_if(F.col("dt") > 3 * F.col("m")).alias("gaps"),
    )


def first_seconds(samples: DataFrame, seconds: float, series: str = "series_id", time: str = "ts_us") -> DataFrame:
    """Samples less than ``seconds`` after their series' first."""
    start = samples.groupBy(series).agg(F.min(time).alias("__start"))
    return samples.join(start, series).where((F.col(time) - F.col("__start")) / F.lit(1e6) < seconds).drop("__start")


def band_mean(spec: DataFrame, low: float, high: float) -> DataFrame:
    """(series_id, power): mean magnitude over all times and the bins of a band."""
    return spec.where(in_band(F.col("freq_hz"), low, high)).groupBy("series_id").agg(F.avg("mag").alias("power"))


def flicker(spec: DataFrame) -> DataFrame:
    """(series_id, flicker): mean change of a bin from time to time, over the mean magnitude."""
    columns(spec, "series_id", "seg", "k", "mag")
    order = W.partitionBy("series_id", "k").orderBy("seg")
    moved = spec.withColumn("change", F.abs(F.col("mag") - F.lag("mag").over(order)))
    return moved.groupBy("series_id").agg(F.try_divide(F.avg("change"), F.avg("mag")).alias("flicker"))


def mean_spectrum_peak(spec: DataFrame, low: float, high: float) -> DataFrame:
    """(series_id, k, freq_hz, mag): the highest bin of a band in the mean over time, the lowest of equals."""
    mean = spec.where(in_band(F.col("freq_hz"), low, high)).groupBy("series_id", "k", "freq_hz").agg(F.avg("mag").alias("mag"))
    rank = F.row_number().over(W.partitionBy("series_id").orderBy(F.desc("mag"), "k"))
    return mean.withColumn("n", rank).where("n = 1").drop("n")


def rmse(pairs: DataFrame, a: str, b: str, series: str = "series_id") -> DataFrame:
    return pairs.groupBy(series).agg(F.sqrt(F.avg((F.col(a) - F.col(b)) ** 2)).alias("rmse"))
