"""Jerk of a stream of samples, and windowed summaries, with Structured Streaming."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import magnitude
from ..validate import columns, positive


def stream_jerk(samples: DataFrame, idle_ms: int | None = None, keep_late: bool = False) -> DataFrame:
    """(series_id, ts_us, jerk) of a stream of SAMPLES: each series keeps its last sample as state.

    Samples of a micro-batch are taken in time order; one no newer than the state's is late and left out, or with
    ``keep_late`` given with a null jerk, so that late ones can be counted or stored. With
    ``idle_ms`` a series idle for so long in processing time is forgotten and starts anew with a jerk of 0; such a
    query has a batch to run at any time, so it doesn't end by itself.
    """
    columns(samples, "series_id", "ts_us", "x", "y", "z")
    if idle_ms is not None:
        positive(idle_ms=idle_ms)

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(batches)).sort_values("ts_us", kind="stable")
        last = state.get if state.exists else None
        if last is not None:
            late = rows["ts_us"] <= last[0]
            if keep_late and late.any():
                yield pd.DataFrame({"series_id": key[0], "ts_us": rows["ts_us"][late], "jerk": None}).astype({"jerk": "Float64"})
            rows = rows[~late]
        if len(rows):
            before = rows[["x", "y", "z"]].shift()
            if last is not None:
                before.iloc[0] = last[1:]
            change = ((rows[["x", "y", "z"]] - before) ** 2).sum(axis=1, skipna=False).pow(0.5).fillna(0.0)
            end = rows.iloc[-1]
            state.update((int(end["ts_us"]), float(end["x"]), float(end["y"]), float(end["z"])))
            yield pd.DataFrame({"series_id": key[0], "ts_us": rows["ts_us"], "jerk": change})
        if idle_ms is not None:
            state.setTimeoutDuration(idle_ms)

    timeout = GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout
    narrow = samples.select("series_id", "ts_us", "x", "y", "z")
    return narrow.groupBy("series_id").applyInPandasWithState(
        run, "series_id long, ts_us long, jerk double", "ts_us long, x double, y double, z double", "append", timeout
    )


def window_summary(samples: DataFrame, size: str = "30 seconds", hop: str | None = None, late: str = "1 minute") -> DataFrame:
    """(series_id, start, n, mean, std) of the magnitude in event-time windows, for streams and tables alike.

    Windows start at whole multiples of the hop since the epoch, not at a series' first sample.
    """
    columns(samples, "series_id", "ts_us", "x", "y", "z")
    timed = samples.select("series_id", F.timestamp_micros("ts_us").alias("ts"), magnitude(F.col("x"), F.col("y"), F.col("z")).alias("m"))
    if samples.isStreaming:
        timed = timed.withWatermark("ts", late)
    span = F.window("ts", size, hop or size)
    return (
        timed.groupBy("series_id", span.alias("w"))
        .agg(F.count("*").alias("n"), F.avg("m").alias("mean"), F.stddev_pop("m").alias("std"))
        .select("series_id", F.col("w.start").alias("start"), "n", "mean", "std")
    )
