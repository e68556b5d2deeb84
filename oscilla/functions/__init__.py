"""Pure Column functions, and their registration for SQL users."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..validate import band, positive



def magnitude(x: Column, y: Column, z: Column) -> Column:
    return F.sqrt(x * x + y * y + z * z)


def next_power_of_2(n: Column) -> Column:
    """The least power of two that is at least ``n``; 1 for n of 1 or less."""
    n = n.cast("long")
    return F.when(n <= 1, F.lit(1).cast("long")).otherwise(F.call_function("shiftleft", F.lit(1).cast("long"), F.length(F.bin(n - 1))))


def hann(position: Column, size: int) -> Column:
    """The periodic Hann window of ``size`` at ``position``."""
    positive(size=size)
    return 0.5 * (1 - F.cos(position * F.lit(2 * math.pi / size)))


def hann_window(spark: SparkSession, size: int) -> DataFrame:
    i = F.col("id").alias("i")
    return spark.range(size).select(i, hann(F.col("id"), size).alias("w"))


def hann_power(size: int) -> float:
    """Sum of the window's squares."""
    return sum((0.5 * (1 - math.cos(2 * math.pi * i / size))) ** 2 for i in range(size))


def phase(re: Column, im: Column) -> Column:
    return F.atan2(im, re)


def power(re: Column, im: Column) -> Column:
    return re * re + im * im


def in_band(freq: Column, low: float | None = None, high: float | None = None) -> Column:
    """Inclusive frequency mask; a bound left out doesn't bind."""
    band(-math.inf if low is None else low, math.inf if high is None else high)
    ok = F.lit(True)
    if low is not None:
        ok = ok & (freq >= low)
    if high is not None:
        ok = ok & (freq <= high)
    return ok


def positive_step(dt: Column) -> Column:
    """``dt`` where it is finite and positive, else null."""
    return F.when((dt > 0) & ~F.isnan(dt) & (dt < float("inf")), dt)


def rescaled(values: Column, eps: float = 1e-12) -> Column:
    """An array over its own maximum, which counts as ``eps`` at least."""
    most = F.array_max(F.filter(values, lambda v: ~F.isnan(v)))
    return F.transform(values, lambda v: v / F.greatest(F.lit(eps), most))


def prominences(values: Column) -> Column:
    """(at, value, prominence) of every strict interior maximum of an array of doubles, by position from 0.

    On either side the lowest value is taken up to the first that is higher than the peak, or the array's end; the
    smaller descent of the two counts.
    """

    def low(side: Column, top: Column) -> Column:
        start = F.struct(top.alias("least"), F.lit(False).alias("over"))
        step = lambda acc, v: F.when(acc["over"], acc).otherwise(F.struct(F.least(acc["least"], v).alias("least"), ((v > top) & ~F.isnan(v)).alias("over")))
        return F.aggregate(side, start, step, lambda acc: acc["least"])

    n = F.size(values)

    def at(i: Column) -> Column:
        top = F.get(values, i)
        left, right = F.reverse(F.slice(values, 1, i)), F.slice(values, i + 2, n)
        return F.struct(i.alias("at"), top.alias("value"), (top - F.greatest(low(left, top), low(right, top))).alias("prominence"))

    inner = F.when(n > 2, F.sequence(F.lit(1), n - 2)).otherwise(F.array().cast("array<int>"))
    # NaN is greater than any number here, but no peak and no wall.
    tops = F.filter(inner, lambda i: ~F.isnan(F.get(values, i)) & (F.get(values, i) > F.get(values, i - 1)) & (F.get(values, i) > F.get(values, i + 1)))
    return F.transform(tops, at)


def highest_peak(values: Column, threshold: Column) -> Column:
    """Position of the highest value among peaks of at least ``threshold`` prominence, the first of equals; else 0."""
    good = F.filter(prominences(values), lambda p: p["prominence"] >= threshold)
    best = F.array_max(F.transform(good, lambda p: F.struct(p["value"].alias("value"), (-p["at"]).alias("back"))))
    return F.coalesce(-best["back"], F.lit(0))


def register(spark: SparkSession) -> None:
    """The scalar functions under these names in SQL; bodies are SQL, so they stay in generated code."""
    for name, parameters, body in (
        ("magnitude3", "x DOUBLE, y DOUBLE, z DOUBLE", "sqrt(x * x + y * y + z * z)"),
        ("hann_at", "i BIGINT, n BIGINT", "0.5D * (1 - cos(2 * pi() * i / n))"),
        ("next_pow2", "n BIGINT", "CASE WHEN n <= 1 THEN 1L ELSE shiftleft(1L, length(bin(n - 1))) END"),
    ):
        returns = "BIGINT" if name == "next_pow2" else "DOUBLE"
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {returns} RETURN {body}")
