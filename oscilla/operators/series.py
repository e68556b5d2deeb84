"""Operators along a series: order, neighbours, jerk, rolling spread, smoothing, rate limits.

Every operator partitions on the series once. One very long series can be split by ``chunk_us``: rows then meet by
(series, span of time), and only a row for each span passes between spans.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import magnitude
from ..validate import columns, not_negative, positive


def _spans(df: DataFrame, order: str, chunk_us: int) -> DataFrame:
    return df.withColumn("__span", F.floor(F.col(order) / F.lit(chunk_us)))


def indexed(df: DataFrame, series: str = "series_id", order: tuple[str, ...] = ("ts_us",), chunk_us: int | None = None) -> DataFrame:
    """``df`` with ``idx``, each row's place in its series from 0."""
    if chunk_us is None:
        return df.withColumn("idx", (F.row_number().over(W.partitionBy(series).orderBy(*order)) - 1).cast("long"))
    positive(chunk_us=chunk_us)
    spans = _spans(df, order[0], chunk_us)
    before = W.partitionBy(series).orderBy("__span").rowsBetween(W.unboundedPreceding, -1)
    offsets = spans.groupBy(series, "__span").agg(F.count("*").alias("__n")).withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    within = F.row_number().over(W.partitionBy(series, "__span").orderBy(*order)) - 1
    return (
        spans.withColumn("idx", within)
        .join(offsets.drop("__n"), [series, "__span"])
        .withColumn("idx", (F.col("idx") + F.col("__before")).cast("long"))
        .drop("__span", "__before")
    )


def with_neighbour(
    df: DataFrame, fields: list[str], name: str, series: str = "series_id", order: tuple[str, ...] = ("ts_us",), ahead: bool = False, chunk_us: int | None = None
) -> DataFrame:
    """``df`` with ``name``, a struct of the previous (``ahead``: next) row's ``fields``; null at the series' end."""
    value, step = F.struct(*fields), F.lead if ahead else F.lag
    if chunk_us is None:
        return df.withColumn(name, step(value).over(W.partitionBy(series).orderBy(*order)))
    positive(chunk_us=chunk_us)
    spans = _spans(df, order[0], chunk_us)
    edge = (F.min_by if ahead else F.max_by)(value, F.struct(*order))
    edges = spans.groupBy(series, "__span").agg(edge.alias("__edge"))
    edges = edges.withColumn("__edge", step("__edge").over(W.partitionBy(series).orderBy("__span")))
    inner = spans.withColumn(name, step(value).over(W.partitionBy(series, "__span").orderBy(*order)))
    return inner.join(edges, [series, "__span"]).withColumn(name, F.coalesce(name, "__edge")).drop("__span", "__edge")


def jerk(samples: DataFrame, use_diff: bool = True, order: tuple[str, ...] = ("ts_us",), chunk_us: int | None = None) -> DataFrame:
    """Length of the change between samples, not divided by time; the first of a series is 0.

    Without ``use_diff`` it is the samples' own magnitude, but the first is 0 all the same. Series of one sample are
    left out.
    """
    columns(samples, "series_id", "ts_us", "x", "y", "z")
    near = with_neighbour(samples, ["x", "y", "z"], "__before", order=order, chunk_us=chunk_us)
    near = with_neighbour(near, ["ts_us"], "__after", order=order, ahead=True, chunk_us=chunk_us)
    own = [F.col(c) - (F.col(f"__before.{c}") if use_diff else F.lit(0.0)) for c in "xyz"]
    first = F.col("__before").isNull()
    keys = [c for c in order if c != "ts_us"]
    return near.where(~(first & F.col("__after").isNull())).select(
        "series_id", "ts_us", *keys, F.when(first, F.lit(0.0)).otherwise(magnitude(*own)).alias("jerk")
    )


def rolling_std(signal: DataFrame, width: int | None = None, window_minutes: float = 5.0, seconds_per_window: float = 30.0, value: str = "value", name: str = "rolling_std", chunk: int | None = None) -> DataFrame:
    """``signal`` with the population spread of the ``width`` values before each, itself and ``width`` - 1 after it.

    Without ``width`` it is the whole windows in ``window_minutes``. Of width 0 the spread is NaN. With ``chunk`` a
    series too long for one task is split into so many sample numbers, which must follow one another.
    """
    columns(signal, "series_id", "idx", value)
    if width is None:
        positive(seconds_per_window=seconds_per_window)
        not_negative(window_minutes=window_minutes)
        width = int(window_minutes * 60 / seconds_per_window)
    if width == 0:
        return signal.withColumn(name, F.lit(float("nan")))
    signal, keys = _chunked(signal, "idx", chunk, width)
    frame = W.partitionBy(*keys).orderBy("idx").rowsBetween(-width, width - 1)
    return _unchunked(signal.withColumn(name, F.stddev_pop(value).over(frame)), "idx", chunk)


def gaussian_kernel(sigma: float, truncate: float = 4.0) -> list[float]:
    positive(sigma=sigma, truncate=truncate)
    radius = int(truncate * sigma + 0.5)
    raw = [math.exp(-(k * k) / (2 * sigma * sigma)) for k in range(-radius, radius + 1)]
    return [w / sum(raw) for w in raw]


def _chunked(df: DataFrame, at: str, chunk: int | None, margin: int) -> tuple[DataFrame, list[str]]:
    """``df`` with rows that are within ``margin`` of another chunk in that one too, and the columns to partition by."""
    if chunk is None:
        return df, ["series_id"]
    positive(chunk=chunk)
    ends = [F.floor((F.col(at) + d) / F.lit(float(chunk))).cast("long") for d in (-margin, margin)]
    return df.withColumn("__chunk", F.explode(F.sequence(*ends))), ["series_id", "__chunk"]


def _unchunked(df: DataFrame, at: str, chunk: int | None) -> DataFrame:
    """Each row of :func:`_chunked` in its own chunk alone."""
    return df if chunk is None else df.where(F.col("__chunk") == F.floor(F.col(at) / F.lit(float(chunk))).cast("long")).drop("__chunk")


def gaussian_filter(
    signal: DataFrame, sigma: float, truncate: float = 4.0, value: str = "value", name: str = "smoothed", chunk: int | None = None
) -> DataFrame:
    """series_id, idx and the smoothed value; beyond its ends a series goes on in mirror image, at most once.

    Mirrored rows are added as rows, so that one sort serves all taps and nothing is joined. With ``chunk`` a series
    too long for one task is split into so many sample numbers; only its length is joined.
    """
    columns(signal, "series_id", "idx", value)
    kernel = gaussian_kernel(sigma, truncate)
    r = len(kernel) // 2
    n, i = F.col("n"), F.col("idx")
    none = F.array().cast("array<bigint>")
    longer = F.when(F.lit(r) > n, F.sequence(n + 1, F.lit(r).cast("long"))).otherwise(none)  # past a whole mirror image: the far end
    left = F.concat(F.when(i < r, F.array(-i - 1)).otherwise(none), F.when(i == n - 1, F.transform(longer, lambda p: -p)).otherwise(none))
    right = F.concat(F.when(i >= n - r, F.array(2 * n - 1 - i)).otherwise(none), F.when(i == 0, F.transform(longer, lambda p: n - 1 + p)).otherwise(none))
    own = signal.select("series_id", "idx", F.col(value).alias("v"))
    if chunk is None:
        own = own.withColumn("n", F.count("*").over(W.partitionBy("series_id")))
    else:
        own = own.join(own.groupBy("series_id").agg(F.count("*").alias("n")), "series_id")
    rows = own.select("series_id", "v", "n", F.explode(F.concat(F.array("idx"), left, right)).alias("at"))
    rows, keys = _chunked(rows, "at", chunk, r)
    order = W.partitionBy(*keys).orderBy("at")
    total: Column = F.lit(0.0)
    for k, w in enumerate(kernel):
        near = F.col("v") if k == r else F.lag("v", r - k).over(order) if k < r else F.lead("v", k - r).over(order)
        total = total + near * F.lit(w)
    rows = _unchunked(rows.withColumn(name, total), "at", chunk)
    return rows.where("at >= 0 and at < n").select("series_id", F.col("at").alias("idx"), name)


def rate_clamp(signal: DataFrame, max_change: float, sampling_rate: float, values: tuple[str, ...] = ("value",)) -> DataFrame:
    """``signal`` with each of ``values`` kept within max_change / sampling_rate of the value before it, as clamped.

    Each value depends on the one clamped before it, so a series is one task's; NaN stays and starts anew.
    """
    positive(sampling_rate=sampling_rate)
    not_negative(max_change=max_change)
    return clamped(signal, {v: max_change / sampling_rate for v in values})


def clamped(signal: DataFrame, steps: dict[str, float]) -> DataFrame:
    columns(signal, "series_id", "idx", *steps)

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("idx")
        for name, most in steps.items():
            own = table.column(name).to_pylist()
            for k in range(1, len(own)):
                if own[k] is None or own[k - 1] is None:
                    continue
                delta = own[k] - own[k - 1]
                if abs(delta) > most:
                    own[k] = own[k - 1] + (most if delta > 0 else -most)
            table = table.set_column(table.column_names.index(name), name, pa.array(own, pa.float64()))
        return table

    return signal.groupBy("series_id").applyInArrow(run, signal.schema)


def smooth_peaks(signal: DataFrame, sampling_rate: float, max_change: float = 10.0, sigma: float = 2.0) -> DataFrame:
    """Gaussian smoothing, then the rate limit: series_id, idx, value."""
    smooth = gaussian_filter(signal, sigma, name="value")
    return rate_clamp(smooth, max_change, sampling_rate)
