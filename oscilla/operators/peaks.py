"""Peaks by prominence, in one signal and across the segments of a spectrogram."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import highest_peak, in_band, rescaled
from ..validate import columns, positive
from .spectral import wide

#: Samples of a series that one task looks at together.
CHUNK = 1 << 16
#: What is known of a sample that may tell other chunks of its series something: it is a peak as far as its chunk tells,
#: the chunk's first, its last. Peaks found in their chunk have none of these and keep their chunk's number.
_PEAK, _FIRST, _LAST = 1, 2, 4


def _descents(v: list[float], new: list[bool]) -> tuple[list[float], list[int]]:
    """For each value the lowest one back to the nearest higher one, or to its run's start where ``new`` is set.

    Also its rank: 0 with a higher one before it in its run, 1 with an equal one at most, 2 above all before it.
    """
    lows, ranks = [], []
    stack: list[tuple[float, float]] = []
    most = -math.inf
    for x, begins in zip(v, new, strict=True):
        if begins:
            stack, most = [], -math.inf
        low = x
        while stack and stack[-1][0] <= x:
            before = stack.pop()[1]
            if before < low:
                low = before
        lows.append(low)
        ranks.append(0 if stack else 2 if x > most else 1)
        stack.append((x, low))
        if x > most:
            most = x
    return lows, ranks


def _sides(v: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The higher of both sides' lows, and both sides' ranks (left, right), of runs that begin at ``first``; NaN is in none."""
    known = np.flatnonzero(~np.isnan(v))
    run = np.cumsum(first)[known]
    bound = run[1:] != run[:-1]
    own = v[known].tolist()
    left, left_rank = _descents(own, np.r_[True, bound][: len(own)].tolist())
    right, right_rank = _descents(own[::-1], np.r_[bound, True][::-1][: len(own)].tolist())
    low, ranks = np.full(len(v), math.nan), np.zeros((2, len(v)), dtype=np.int8)
    low[known] = np.maximum(np.array(left, dtype=float), np.array(right[::-1], dtype=float))
    ranks[0, known], ranks[1, known] = left_rank, right_rank[::-1]
    return low, ranks[0], ranks[1]


def _tables(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Batches anew, so that what begins at ``place`` 1 is never in two, and where it begins; many of them at once."""
    held: list[pa.RecordBatch] = []

    def whole() -> tuple[pa.Table, np.ndarray]:
        table = pa.Table.from_batches(held)
        return table, table.column("place").to_numpy() == 1

    for batch in batches:
        starts = np.flatnonzero(batch.column("place").to_numpy() == 1)
        if len(starts):
            held.append(batch.slice(0, starts[-1]))
            if any(len(b) for b in held):
                yield whole()
            held = [batch.slice(starts[-1])]
        else:
            held.append(batch)
    if any(len(b) for b in held):
        yield whole()


def _runs(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` with runs of equal ``keys`` together, in order, and each row's ``place`` in its run from 1."""
    return df.withColumn("place", F.row_number().over(W.partitionBy(*keys).orderBy("idx")))


def find_peaks(signal: DataFrame, prominence: float, value: str = "value", chunk: int = CHUNK) -> DataFrame:
    """(series_id, idx): strict interior maxima of at least ``prominence``, measured to the nearest higher value on either side.

    NaN and null are neither peaks nor higher than any value, and what is beside them is no peak. Chunks of ``chunk``
    sample numbers are looked through on their own, once; only peaks that are higher than all before or after them in
    their chunk, and what tells these of other chunks, meet by series: a chunk's first and last sample, those above all
    before or after them, and the lowest between two of these. Many chunks or series are one call of Python.
    """
    columns(signal, "series_id", "idx", value)
    positive(chunk=chunk)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, first in _tables(batches):
            idx, v = table.column("idx").to_numpy(), table.column("v").to_numpy()
            last = np.r_[first[1:], True]
            before, after = np.r_[-math.inf, v[:-1]], np.r_[v[1:], -math.inf]
            before[first], after[last] = -math.inf, -math.inf
            low, left, right = _sides(v, first)
            tops = (v > before) & (v > after)
            opened = tops & (first | last | (left > 0) | (right > 0))
            done = np.flatnonzero(tops & ~opened)
            done = done[v[done] - low[done] >= prominence]
            kept = opened | first | last | (left == 2) | (right == 2)
            # between two kept samples what matters is the lowest one, which takes the place of the first
            rest = np.flatnonzero(~kept & ~np.isnan(v))
            gap = np.cumsum(kept)[rest]
            lowest = np.flatnonzero(np.r_[True, gap[1:] != gap[:-1]][: len(rest)])
            own = np.flatnonzero(kept)
            told = np.r_[own, rest[lowest]]
            values = np.r_[v[own], np.minimum.reduceat(v[rest], lowest) if len(rest) else []]
            at = np.r_[done, told]
            inner, none = np.arange(len(at)) < len(done), np.full(len(done), math.nan)
            state = _PEAK * opened + _FIRST * first + _LAST * last
            yield pa.record_batch(
                [
                    table.column("series_id").take(pa.array(at)).combine_chunks(),
                    pa.array(table.column("chunk").to_numpy()[at], pa.int64(), mask=~inner),
                    pa.array(idx[at], pa.int64()),
                    pa.array(np.r_[none, values], pa.float64()),
                    pa.array(np.where(inner, 0, state[at]), pa.int32()),
                ],
                ["series_id", "part", "idx", "v", "state"],
            )

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, first in _tables(batches):
            v, state = table.column("v").to_numpy(), table.column("state").to_numpy()
            before, after = np.r_[math.nan, v[:-1]], np.r_[v[1:], math.nan]
            before[first], after[np.r_[first[1:], True]] = math.nan, math.nan  # the series ends here
            tops = (state & _PEAK > 0) & ((state & _FIRST == 0) | (v > before)) & ((state & _LAST == 0) | (v > after))
            at = np.flatnonzero(tops)
            at = at[v[at] - _sides(v, first)[0][at] >= prominence]
            at = np.r_[np.flatnonzero(table.column("part").is_valid().to_numpy()), at]
            yield from table.select(["series_id", "idx"]).take(pa.array(at)).to_batches()

    own = signal.select(
        F.col("series_id").cast("long").alias("series_id"), F.floor(F.col("idx") / F.lit(float(chunk))).cast("long").alias("chunk"), F.col("idx").cast("long").alias("idx"), F.col(value).cast("double").alias("v")
    )
    told = _runs(own, "series_id", "chunk").mapInArrow(look, "series_id long, part long, idx long, v double, state int")
    return _runs(told, "series_id", "part").mapInArrow(meet, "series_id long, idx long")


def spectrogram_peaks(spec: DataFrame, prominence: float, scale: float = 60.0) -> DataFrame:
    """(series_id, seg, t_s, k, peak): each segment's highest peak as scale * Hz; without one its lowest bin.

    Segments are rescaled to a maximum of 1 first; ``prominence`` is a share of the series' range up to 1 after that.
    """
    rows = wide(spec).withColumn("mags", rescaled(F.col("mags")))
    least = F.min(F.array_min("mags")).over(W.partitionBy("series_id"))
    best = highest_peak(F.col("mags"), F.lit(float(prominence)) * (1.0 - F.col("least")))
    return rows.withColumn("least", least).withColumn("at", best).select(
        "series_id", "seg", "t_s", (F.col("k0") + F.col("at")).alias("k"), (F.lit(float(scale)) * F.get("freqs", F.col("at"))).alias("peak")
    )


def result_peaks(spec: DataFrame, threshold: float, relative: bool = True, freq_min: float | None = None, freq_max: float | None = None, scale: float = 60.0) -> DataFrame:
    """As :func:`spectrogram_peaks` within a band; ``relative`` scales the threshold by the band's raw range beforehand."""
    part = spec.where(in_band(F.col("freq_hz"), freq_min, freq_max))
    if not relative:
        return spectrogram_peaks(part, threshold, scale)
    rows = wide(part)
    whole = W.partitionBy("series_id")
    span = F.max(F.array_max("mags")).over(whole) - F.min(F.array_min("mags")).over(whole)
    rows = rows.withColumn("span", span).withColumn("mags", rescaled(F.col("mags")))
    rows = rows.withColumn("least", F.min(F.array_min("mags")).over(whole))
    best = highest_peak(F.col("mags"), F.lit(float(threshold)) * F.col("span") * (1.0 - F.col("least")))
    return rows.withColumn("at", best).select(
        "series_id", "seg", "t_s", (F.col("k0") + F.col("at")).alias("k"), (F.lit(float(scale)) * F.get("freqs", F.col("at"))).alias("peak")
    )
