"""Scans of recorded series, time units, and array-shaped sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import SAMPLES
from ..validate import columns, unit

HEADER = "TIMESTAMP"


def microseconds(t: Column, ts_unit: str = "s") -> Column:
    """Time in ``ts_unit`` as whole microseconds, cut towards zero."""
    return (t * F.lit(unit(ts_unit))).cast("long")


def seconds(t: Column, ts_unit: str = "s") -> Column:
    return t.cast("double") * F.lit(unit(ts_unit) / 1e6)


def read_recordings(spark: SparkSession, path: str | list[str], ts_unit: str = "s") -> DataFrame:
    """SAMPLES, and ``file``, of text recordings: comma-separated under a header, or blank-separated without one.

    The layout is told line by line (a header has letters, a comma makes the comma layout), so that files of both
    kinds, split anywhere, are read in one pass without a look at any file on the driver. The series is the hash of
    the file's name. Only the first four columns count; lines without four numbers are left out.
    """
    return recordings(spark.read.text(path).select(F.input_file_name().alias("file"), "value"), ts_unit)


def recordings(lines: DataFrame, ts_unit: str = "s") -> DataFrame:
    """As :func:`read_recordings` of lines (file, value) from anywhere."""
    parts = F.split(F.trim("value"), r"\s*,\s*|\s+")
    number = [F.expr(f"try_cast(get(parts, {k}) as double)") for k in range(4)]
    return (
        # exploded, so that no filter is moved below the split and repeats it, and all that makes a line, for each condition
        lines.select("file", F.explode(F.array(parts)).alias("parts"))
        .where(~F.get("parts", F.lit(0)).startswith(HEADER))
        .select(
            F.xxhash64("file").alias("series_id"),
            microseconds(number[0], ts_unit).alias("ts_us"),
            *(n.alias(c) for n, c in zip(number[1:], "xyz", strict=True)),
            "file",
        )
        .where("ts_us is not null and x is not null and y is not null and z is not null")
    )


def from_arrays(spark: SparkSession, series: dict[int, tuple], ts_unit: str = "us") -> DataFrame:
    """SAMPLES of in-memory arrays: series_id to (t, x, y, z) of equal length."""
    import pyarrow as pa

    parts = []
    for key, arrays in series.items():
        if len({len(a) for a in arrays}) != 1:
            raise ValueError(f"arrays of series {key} differ in length")
        t, x, y, z = arrays
        parts.append(pa.table({"series_id": pa.array([key] * len(t), pa.int64()), "t": pa.array(t, pa.float64() if ts_unit != "us" else pa.int64()), "x": pa.array(x, pa.float64()), "y": pa.array(y, pa.float64()), "z": pa.array(z, pa.float64())}))
    if not parts:
        return spark.createDataFrame([], SAMPLES)
    return spark.createDataFrame(pa.concat_tables(parts)).select("series_id", microseconds(F.col("t"), ts_unit).alias("ts_us"), "x", "y", "z")


def events_as_samples(events: DataFrame) -> DataFrame:
    """SAMPLES, and ``event_id``, of an event table: a user is a series."""
    epoch = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', cast(ts as timestamp_ntz))")
    return events.select(
        F.col("user_id").cast("long").alias("series_id"),
        epoch.alias("ts_us"),
        F.col("value").alias("x"),
        F.get_json_object("props", "$.k").cast("double").alias("y"),
        ((F.col("event_id") % 100) / 10.0).alias("z"),
        "event_id",
    )


def xyz_rows(samples: DataFrame) -> DataFrame:
    """series_id, ts_us, xyz: each row's axes as one array."""
    columns(samples, "series_id", "ts_us", "x", "y", "z")
    return samples.select("series_id", "ts_us", F.array("x", "y", "z").alias("xyz"))


def txyz_rows(samples: DataFrame) -> DataFrame:
    columns(samples, "series_id", "ts_us", "x", "y", "z")
    return samples.select("series_id", F.array(F.col("ts_us").cast("double"), "x", "y", "z").alias("txyz"))


def lengths(samples: DataFrame) -> DataFrame:
    return samples.groupBy("series_id").agg(F.count("*").alias("n"))
