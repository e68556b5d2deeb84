"""Resampling on a uniform grid, linear or by natural cubic splines.

Grid points come out of the interval they lie in, so nothing is joined: each sample, knowing the next one, emits the
points between the two.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..schema import SAMPLES
from ..sources import microseconds
from ..validate import columns, positive
from .series import with_neighbour

_AXES = ("x", "y", "z")
#: Grid points of one interval that are made at once.
BLOCK = 4096


def _grid(samples: DataFrame, target_fs: float) -> DataFrame:
    """(series_id, t0, t1, points): first and last sample and how many points the grid has, one at least."""
    positive(target_fs=target_fs)
    ends = samples.groupBy("series_id").agg(F.min("ts_us").alias("t0"), F.max("ts_us").alias("t1"), F.count("*").alias("n")).where("n >= 2")
    duration = (F.col("t1") - F.col("t0")) / F.lit(1_000_000.0)
    return ends.select("series_id", "t0", "t1", F.greatest(F.lit(1).cast("long"), (duration * F.lit(float(target_fs))).cast("long")).alias("points"))


def _at(t0: Column, i: Column, target_fs: float) -> Column:
    return t0 + (i * F.lit(1_000_000.0 / target_fs)).cast("long")


def resample_linear(samples: DataFrame, target_fs: float, order: tuple[str, ...] = ("ts_us",), ts_unit: str = "us", time: str = "ts_us", chunk_us: int | None = None) -> DataFrame:
    """SAMPLES at ``target_fs`` from each series' first sample on; series of one sample are left out.

    A point on a sample takes that sample (of equal timestamps the first), later points lie on the line from the last.
    """
    columns(samples, "series_id", time, *_AXES)
    keys = {c: f"__{c}" for c in order if c != "ts_us"}
    samples = samples.select(
        "series_id", microseconds(F.col(time), ts_unit).alias("ts_us"), *_AXES, *(F.col(c).alias(k) for c, k in keys.items())
    )
    order = tuple(keys.get(c, c) for c in order)
    # Whole-series facts by window where a series is one task's anyway, else by an aggregate that is joined.
    if chunk_us is None:
        whole = W.partitionBy("series_id")
        base = samples.withColumns({"t0": F.min("ts_us").over(whole), "t1": F.max("ts_us").over(whole), "n": F.count("*").over(whole)}).where("n >= 2")
        duration = (F.col("t1") - F.col("t0")) / F.lit(1_000_000.0)
        base = base.withColumn("points", F.greatest(F.lit(1).cast("long"), (duration * F.lit(float(target_fs))).cast("long"))).drop("n")
        positive(target_fs=target_fs)
    else:
        base = samples.join(_grid(samples, target_fs), "series_id")
    near = with_neighbour(base, ["ts_us", *_AXES], "next", order=order, ahead=True, chunk_us=chunk_us)
    near = with_neighbour(near, ["ts_us"], "before", order=order, chunk_us=chunk_us)
    step = F.lit(1_000_000.0 / target_fs)
    last = F.col("points") - 1
    low = F.greatest(F.lit(0).cast("long"), F.floor((F.col("ts_us") - F.col("t0")) / step) - 1)
    high = F.least(last, F.ceil((F.col("next.ts_us") - F.col("t0")) / step) + 1)
    # Points in blocks, then one by one: however long a gap is, no array is.
    none = F.array().cast("array<bigint>")
    part = near.where("next is not null").withColumns({"low": low, "high": high})
    blocks = F.sequence(F.floor(F.col("low") / F.lit(float(BLOCK))).cast("long"), F.floor(F.col("high") / F.lit(float(BLOCK))).cast("long"))
    part = part.withColumn("block", F.explode(F.when(F.col("low") <= F.col("high"), blocks).otherwise(none)))
    i = F.sequence(F.greatest("low", F.col("block") * BLOCK), F.least("high", F.col("block") * BLOCK + (BLOCK - 1)))
    points = part.withColumn("i", F.explode(i)).withColumn("t", _at(F.col("t0"), F.col("i"), target_fs))
    inside = ((F.col("t") > F.col("ts_us")) & (F.col("t") <= F.col("next.ts_us"))) | (F.col("before").isNull() & (F.col("t") <= F.col("t0")))
    share = (F.col("t") - F.col("ts_us")) / (F.col("next.ts_us") - F.col("ts_us"))
    alpha = F.when(F.col("t") <= F.col("ts_us"), F.lit(0.0)).otherwise(share)
    axes = [(F.col(a) + alpha * (F.col(f"next.{a}") - F.col(a))).alias(a) for a in _AXES]
    return points.where(inside).select("series_id", F.col("t").alias("ts_us"), *axes)


def spline(t: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """b, c, d of the natural cubic spline through rows (t, y[:, axis]): second derivatives vanish at both ends."""
    n = len(t)
    h = np.diff(t)[:, None]
    if (h <= 0).any():
        raise ValueError("timestamps of a series must rise")
    slope = np.diff(y, axis=0) / h
    c = np.zeros_like(y)
    if n > 2:
        right = 3 * np.diff(slope, axis=0)
        diagonal = 2 * (h[:-1] + h[1:])[:, 0]
        upper = np.zeros(n - 2)
        for k in range(n - 2):
            below = h[k, 0] if k else 0.0
            pivot = diagonal[k] - below * (upper[k - 1] if k else 0.0)
            upper[k] = h[k + 1, 0] / pivot
            right[k] = (right[k] - below * (right[k - 1] if k else 0.0)) / pivot
        for k in range(n - 3, -1, -1):
            c[k + 1] = right[k] - upper[k] * c[k + 2]
    return slope - h * (c[1:] + 2 * c[:-1]) / 3, c, np.diff(c, axis=0) / (3 * h)


def evaluate(t: np.ndarray, y: np.ndarray, coefficients: tuple, at: np.ndarray) -> np.ndarray:
    """The spline at ``at``; beyond the knots the end values."""
    b, c, d = coefficients
    k = np.clip(np.searchsorted(t, at, side="left") - 1, 0, len(t) - 2)
    x = (at - t[k])[:, None]
    value = y[k] + x * (b[k] + x * (c[k] + x * d[k]))
    value[at <= t[0]], value[at >= t[-1]] = y[0], y[-1]
    return value


def resample_cubic(samples: DataFrame, target_fs: float, ts_unit: str = "us", time: str = "ts_us") -> DataFrame:
    """As :func:`resample_linear` along natural cubic splines. Equal timestamps are an error.

    A spline's coefficients depend on the whole series, so a series is one task's.
    """
    columns(samples, "series_id", time, *_AXES)
    positive(target_fs=target_fs)

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("ts_us")
        stamp = table.column("ts_us").to_numpy()
        if len(stamp) < 2:
            return pa.table({f.name: pa.array([], pa.int64() if f.name in ("series_id", "ts_us") else pa.float64()) for f in SAMPLES})
        n = max(1, int((stamp[-1] - stamp[0]) / 1_000_000.0 * target_fs))
        grid = stamp[0] + (np.arange(n) * (1_000_000.0 / target_fs)).astype(np.int64)
        t, y = (stamp - stamp[0]).astype(float), np.stack([table.column(a).to_numpy() for a in _AXES], axis=1)
        values = evaluate(t, y, spline(t, y), (grid - stamp[0]).astype(float))
        key = table.column("series_id")[0].as_py()
        return pa.table({"series_id": pa.array([key] * n, pa.int64()), "ts_us": pa.array(grid)} | {a: pa.array(values[:, k]) for k, a in enumerate(_AXES)})

    inner = samples.select(F.col("series_id").cast("long").alias("series_id"), microseconds(F.col(time), ts_unit).alias("ts_us"), *(F.col(a).cast("double").alias(a) for a in _AXES))
    return inner.groupBy("series_id").applyInArrow(run, SAMPLES)
