"""Short-time Fourier transforms: by sums in the JVM for short windows, by grouped numpy for long ones.

Both cut a series of known sample numbers into segments. The grouped path takes blocks of segments, so a long series
is many groups; the sums need the segments' samples only.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import hann, hann_power, next_power_of_2, positive_step
from ..validate import columns, not_negative, overlap, positive
from .series import with_neighbour
from .stats import upper_median

#: Products of window length and bins up to which sums are quicker than a trip to Python.
DIRECT = 1024
#: Segments in one group of the numpy path.
BLOCK = 64


def segments(signal: DataFrame, nperseg: int, noverlap: int, value: str = "value") -> DataFrame:
    """(series_id, seg, i, v, mean): each sample in each whole segment it is in; the tail that fills none is dropped."""
    overlap(nperseg, noverlap)
    columns(signal, "series_id", "idx", value)
    step = nperseg - noverlap
    idx = F.col("idx")
    first = F.greatest(F.lit(0).cast("long"), F.ceil((idx - (nperseg - 1)) / F.lit(float(step))).cast("long"))
    cut = signal.select("series_id", F.col(value).alias("v"), "idx", F.explode(F.sequence(first, F.floor(idx / F.lit(float(step))).cast("long"))).alias("seg"))
    whole = W.partitionBy("series_id", "seg")
    return (
        cut.select("series_id", F.col("seg").cast("int").alias("seg"), (F.col("idx") - F.col("seg") * step).cast("int").alias("i"), "v", F.count("*").over(whole).alias("n"), F.avg("v").over(whole).alias("mean"))
        .where(F.col("n") == nperseg)
        .drop("n")
    )


def stft(signal: DataFrame, fs: float, nperseg: int, noverlap: int, value: str = "value", k_range: tuple[int, int] | None = None, method: str = "auto") -> DataFrame:
    """(series_id, seg, t_s, k, freq_hz, re, im) of Hann-weighted segments less their mean.

    Bins 0 to nperseg / 2, or ``k_range`` of them; t_s is the segment's middle. A series shorter than a window has none.
    """
    positive(fs=fs)
    overlap(nperseg, noverlap)
    low, high = k_range or (0, nperseg // 2)
    low, high = max(0, low), min(high, nperseg // 2)
    if method == "auto":
        method = "direct" if nperseg * (high - low + 1) <= DIRECT else "grouped"
    if method == "direct":
        parts = segments(signal, nperseg, noverlap, value).withColumn("d", (F.col("v") - F.col("mean")) * hann(F.col("i"), nperseg))
        angle = F.pmod(F.col("k") * F.col("i"), F.lit(nperseg)) * F.lit(2 * math.pi / nperseg)
        found = (
            parts.withColumn("k", F.explode(F.sequence(F.lit(low), F.lit(high))))
            .groupBy("series_id", "seg", "k")
            .agg(F.sum(F.col("d") * F.cos(angle)).alias("re"), (-F.sum(F.col("d") * F.sin(angle))).alias("im"))
        )
    else:
        found = _grouped(signal, nperseg, noverlap, value, low, high)
    step = nperseg - noverlap
    return found.select(
        "series_id", "seg", ((F.col("seg") * step + nperseg // 2) / F.lit(float(fs))).alias("t_s"), "k", (F.col("k") * F.lit(fs / nperseg)).alias("freq_hz"), "re", "im"
    )


def _grouped(signal: DataFrame, nperseg: int, noverlap: int, value: str, low: int, high: int) -> DataFrame:
    step = nperseg - noverlap
    window = 0.5 * (1 - np.cos(2 * np.pi * np.arange(nperseg) / nperseg))

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        table = table.sort_by("idx")
        idx, v = table.column("idx").to_numpy(), table.column("v").to_numpy()
        start = key[1].as_py() * BLOCK * step
        n = min(BLOCK, (int(idx[-1]) + 1 - start - nperseg) // step + 1) if len(idx) else 0
        n = max(0, n)
        picks = np.arange(n)[:, None] * step + np.arange(nperseg)[None, :] + (start - int(idx[0]) if len(idx) else 0)
        cut = v[picks] if n else np.zeros((0, nperseg))
        spectrum = np.fft.rfft((cut - cut.mean(axis=1, keepdims=True)) * window, axis=1)[:, low : high + 1] if n else np.zeros((0, high - low + 1), dtype=complex)
        bins = high - low + 1
        return pa.table(
            {
                "series_id": pa.array(np.full(n * bins, key[0].as_py(), dtype=np.int64)),
                "seg": pa.array(np.repeat(np.arange(n, dtype=np.int32) + np.int32(key[1].as_py() * BLOCK), bins)),
                "k": pa.array(np.tile(np.arange(low, high + 1, dtype=np.int32), n)),
                "re": pa.array(spectrum.real.ravel()),
                "im": pa.array(spectrum.imag.ravel()),
            }
        )

    size = float(BLOCK * step)
    first = F.greatest(F.lit(0).cast("long"), F.ceil((F.col("idx") - ((BLOCK - 1) * step + nperseg - 1)) / F.lit(size)).cast("long"))
    blocks = signal.select(
        F.col("series_id").cast("long").alias("series_id"), "idx", F.col(value).cast("double").alias("v"), F.explode(F.sequence(first, F.floor(F.col("idx") / F.lit(size)).cast("long"))).alias("block")
    )
    return blocks.groupBy("series_id", "block").applyInArrow(run, "series_id long, seg int, k int, re double, im double")


def spectrogram(signal: DataFrame, fs: float, nperseg: int, noverlap: int, value: str = "value", k_range: tuple[int, int] | None = None, method: str = "auto") -> DataFrame:
    """SPEC: magnitudes over sqrt(fs * sum of the window's squares), of which nothing is squared or doubled."""
    scale = 1 / math.sqrt(fs * hann_power(nperseg))
    parts = stft(signal, fs, nperseg, noverlap, value, k_range, method)
    return parts.select("series_id", "seg", "t_s", "k", "freq_hz", (F.sqrt(F.col("re") ** 2 + F.col("im") ** 2) * scale).alias("mag"))


def wide(spec: DataFrame) -> DataFrame:
    """(series_id, seg, t_s, k0, freqs, mags): a segment's bins in one row; k0 is the first bin."""
    bins = F.sort_array(F.collect_list(F.struct("k", "freq_hz", "mag")))
    return spec.groupBy("series_id", "seg", "t_s").agg(bins.alias("b")).select(
        "series_id", "seg", "t_s", F.get("b", F.lit(0))["k"].alias("k0"), F.col("b.freq_hz").alias("freqs"), F.col("b.mag").alias("mags")
    )


def rescale(spec: DataFrame, eps: float = 1e-12) -> DataFrame:
    """``spec`` with magnitudes over their segment's greatest, which counts as ``eps`` at least."""
    return spec.withColumn("mag", F.col("mag") / F.greatest(F.lit(eps), F.max(F.when(~F.isnan("mag"), F.col("mag"))).over(W.partitionBy("series_id", "seg"))))


def frequency_sum(spec: DataFrame) -> DataFrame:
    """(series_id, seg, t_s, frequency_sum): all bins, the mean's among them."""
    return spec.groupBy("series_id", "seg", "t_s").agg(F.sum("mag").alias("frequency_sum"))


def band_bins(spec: DataFrame, low: float, high: float) -> DataFrame:
    """(series_id, start, end): the first bin from ``low`` on and the last up to ``high``, 0 where there is none.

    Bin 0 never starts a band: 0 stands for none, so a band from 0 or below starts at bin 1.
    """
    f, k = F.col("freq_hz"), F.col("k")
    return spec.groupBy("series_id").agg(
        F.coalesce(F.min(F.when((f >= low) & (k > 0), k)), F.lit(0)).alias("start"), F.coalesce(F.max(F.when(f <= high, k)), F.lit(0)).alias("end")
    )


def band_bins_of(fs: float, nperseg: int, low: float, high: float) -> tuple[int, int]:
    """As :func:`band_bins` for a grid that is known."""
    grid = [k * (fs / nperseg) for k in range(nperseg // 2 + 1)]
    start = next((k for k, f in enumerate(grid) if f >= low and k > 0), 0)
    end = max((k for k, f in enumerate(grid) if f <= high), default=0)
    if end < start:
        raise ValueError(f"no bin between {low} and {high} Hz")
    return start, end


def resolution(spec: DataFrame) -> DataFrame:
    """(series_id, frequency_resolution, time_resolution): first differences of the axes, 0 for axes of one value."""
    f = F.array_sort(F.collect_set("freq_hz"))
    t = F.array_sort(F.collect_set("t_s"))
    gap = lambda a: F.coalesce(F.get(a, F.lit(1)) - F.get(a, F.lit(0)), F.lit(0.0))
    return spec.groupBy("series_id").agg(f.alias("f"), t.alias("t")).select("series_id", gap(F.col("f")).alias("frequency_resolution"), gap(F.col("t")).alias("time_resolution"))


def band_power(signal: DataFrame, fs: float, low: float, high: float, value: str = "value") -> DataFrame:
    """(series_id, power): sum over a band's bins of the whole series' squared transform, over its length.

    Neither the mean is taken off nor a window laid on; bins are k fs / n of each series' own length n.
    """
    positive(fs=fs)
    n = F.count("*").over(W.partitionBy("series_id"))
    base = signal.select("series_id", "idx", F.col(value).alias("v"), n.alias("n"))
    unit = F.lit(float(fs)) / F.col("n")
    first = F.greatest(F.lit(0).cast("long"), F.floor(F.lit(float(low)) / unit).cast("long"))
    last = F.least(F.floor(F.col("n") / 2).cast("long"), F.ceil(F.lit(float(high)) / unit).cast("long"))
    none = F.array().cast("array<bigint>")
    angle = F.pmod(F.col("k") * F.col("idx"), F.col("n")) * F.lit(2 * math.pi) / F.col("n")
    bins = (
        base.withColumn("k", F.explode(F.when(first <= last, F.sequence(first, last)).otherwise(none)))
        .where((F.col("k") * F.lit(float(fs)) / F.col("n")).between(low, high))
        .groupBy("series_id", "n", "k")
        .agg(F.sum(F.col("v") * F.cos(angle)).alias("re"), F.sum(F.col("v") * F.sin(angle)).alias("im"))
    )
    return bins.groupBy("series_id").agg((F.sum(F.col("re") ** 2 + F.col("im") ** 2) / F.first("n")).alias("power"))


def nufft_spectrogram(samples: DataFrame, secperseg: float, secoverlap: float, value: str = "value", target_fs: float = 0.0, time: str = "ts_us", on_error: str = "drop", chunk_us: int | None = None) -> DataFrame:
    """SPEC of irregular samples: windows by time from each series' first sample, exact sums at the true times.

    The bin count is the next power of two from secperseg over the upper median step, halved; a window of under four
    samples is left out; a window whose weights vanish is zero. With ``target_fs`` bins go up to half of it: beyond
    the last one its value is repeated. A series without a rising step, or with steps too long for the window, gives
    no rows, or an error with ``on_error="raise"``. With ``chunk_us`` a series too long for one task is split by time.
    """
    overlap(secperseg, secoverlap)
    not_negative(target_fs=target_fs)
    columns(samples, "series_id", time, value)
    hop = secperseg - secoverlap
    if chunk_us is None:
        t0 = F.min(time).over(W.partitionBy("series_id"))
        base = samples.select("series_id", F.col(time).alias("us"), ((F.col(time) - t0) / F.lit(1e6)).alias("t"), F.col(value).alias("v"))
        before = F.lag("t").over(W.partitionBy("series_id").orderBy("t"))
    else:
        start = samples.groupBy("series_id").agg(F.min(time).alias("t0"))
        base = samples.select("series_id", F.col(time).alias("us"), F.col(value).alias("v")).join(start, "series_id")
        base = base.select("series_id", "us", ((F.col("us") - F.col("t0")) / F.lit(1e6)).alias("t"), "v")
        base = with_neighbour(base, ["t"], "last", order=("us",), chunk_us=chunk_us)
        before = F.col("last.t")
    base = base.withColumn("dt", positive_step(F.col("t") - before)).select("series_id", "t", "v", "dt")
    ends = base.groupBy("series_id").agg(F.max("t").alias("t_end"), F.count("dt").alias("steps"))
    middle = upper_median(base.where("dt is not null").select("series_id", F.col("dt").alias("dt_median")), "series_id", "dt_median")
    facts = ends.join(middle, "series_id", "left")
    fits = (F.col("steps") > 0) & ((F.lit(float(secperseg)) * (1.0 / F.col("dt_median"))).cast("long") >= 2)
    if on_error == "raise":
        facts = facts.where(F.when(fits, F.lit(True)).otherwise(F.raise_error(F.lit("a series is too sparse for the window")).cast("boolean")))
    facts = facts.where(F.when(F.col("steps") > 0, fits).otherwise(F.lit(False)))
    bins = next_power_of_2((F.lit(float(secperseg)) * (1.0 / F.col("dt_median"))).cast("long"))
    facts = facts.select("series_id", "t_end", "dt_median", F.floor(bins / 2).cast("int").alias("half"))
    near = base.drop("dt").join(facts, "series_id")
    # Windows a sample may be in; starts are summed hops, which a product equals up to rounding.
    last = F.floor((F.col("t_end") + F.col("dt_median") - secperseg) / hop).cast("int")
    low = F.greatest(F.lit(0), F.floor((F.col("t") - secperseg) / hop).cast("int"))
    high = F.least(last, F.floor(F.col("t") / hop).cast("int"))
    none = F.array().cast("array<int>")
    start = F.col("seg") * F.lit(float(hop))
    cut = near.withColumn("seg", F.explode(F.when(low <= high, F.sequence(low, high)).otherwise(none))).where((F.col("t") >= start) & (F.col("t") < start + secperseg))
    tau = (F.col("t") - start) / secperseg
    window = W.partitionBy("series_id", "seg")
    weighed = cut.withColumns({"tau": tau, "w": hann(tau, 1), "mean": F.avg("v").over(window), "n": F.count("*").over(window)}).where("n >= 4")
    top = F.least(F.col("half"), F.lit(int(target_fs / 2 * secperseg + 0.5))) if target_fs > 0 else F.col("half")
    angle = F.col("k") * F.col("tau") * F.lit(2 * math.pi)
    d = (F.col("v") - F.col("mean")) * F.col("w")
    found = (
        weighed.withColumn("k", F.explode(F.sequence(F.lit(0), top)))
        .groupBy("series_id", "seg", "k", "dt_median", "half")
        .agg(F.sum(d * F.cos(angle)).alias("re"), F.sum(d * F.sin(angle)).alias("im"), F.sum(F.col("w") ** 2).alias("ss"))
    )
    mag = F.when(F.col("ss") > 0, F.sqrt(F.col("re") ** 2 + F.col("im") ** 2) / F.sqrt(F.col("ss") / F.col("dt_median"))).otherwise(F.lit(0.0))
    found = found.select("series_id", "seg", "k", "half", mag.alias("mag"))
    if target_fs > 0:
        most = int(target_fs / 2 * secperseg + 0.5)
        beyond = F.when((F.col("k") == F.col("half")) & (F.col("half") < most), F.sequence(F.col("k"), F.lit(most))).otherwise(F.array("k"))
        found = found.withColumn("k", F.explode(beyond))
    return found.select("series_id", "seg", (F.col("seg") * F.lit(float(hop)) + secperseg / 2).alias("t_s"), "k", (F.col("k") / F.lit(float(secperseg))).alias("freq_hz"), "mag")
