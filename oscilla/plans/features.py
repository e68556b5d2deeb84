"""Breathing and heart rates of a motion signal."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import highest_peak, rescaled
from ..operators.series import clamped, rolling_std
from ..operators.spectral import band_bins_of, spectrogram, wide
from ..operators.stats import without_floor
from ..validate import not_negative, positive

#: Half a minute at 50 Hz, and half of that.
WINDOW, OVERLAP = 1500, 750


def motion_features(
    signal: DataFrame,
    fs: float,
    window: int = WINDOW,
    overlap: int = OVERLAP,
    breathing: tuple[float, float] = (0.15, 0.417),
    heart: tuple[float, float] = (0.5, 2.0),
    std_window_minutes: float = 5.0,
    heart_change: float = 15.0,
    breathing_change: float = 7.5,
    time_resolution: float = 30.0,
    prominence: float = 0.1,
    value: str = "value",
) -> DataFrame:
    """FEATURES of every whole window: rates a minute, their rolling spread, and the summed spectrum above its floor.

    ``time_resolution`` (seconds a window counts for in the limits and the rolling spread) is independent of the hop.
    The spectrogram is computed once; from its wide rows on, a series stays where the first shuffle put it.
    """
    positive(fs=fs, time_resolution=time_resolution)
    not_negative(heart_change=heart_change, breathing_change=breathing_change)
    rows = wide(spectrogram(signal, fs, window, overlap, value))
    whole = W.partitionBy("series_id")
    rates = {}
    for name, (low, high) in (("breathing_rate", breathing), ("heart_rate", heart)):
        start, end = band_bins_of(fs, window, low, high)
        part = f"__{name}"
        # Twice: rows whose maximum is under eps are changed by the second pass as well.
        rows = rows.withColumn(part, rescaled(rescaled(F.slice("mags", start + 1, end - start + 1))))
        rows = rows.withColumn(f"{part}_least", F.min(F.array_min(part)).over(whole))
        best = highest_peak(F.col(part), F.lit(prominence) * (1.0 - F.col(f"{part}_least")))
        rates[name] = 60.0 * (best + start) * F.lit(fs / window)
    total = F.aggregate("mags", F.lit(0.0), lambda a, v: a + v)
    base = rows.select(
        "series_id", "seg", F.col("seg").cast("long").alias("idx"), "t_s", *(c.cast("double").alias(n) for n, c in rates.items()), total.alias("__sum")
    )
    base = without_floor(base, "__sum", "frequency_sum").drop("__sum")
    base = clamped(base, {"breathing_rate": breathing_change * time_resolution, "heart_rate": heart_change * time_resolution})
    for name in rates:
        base = rolling_std(base, None, std_window_minutes, time_resolution, name, f"{name}_std")
    return base.select("series_id", "seg", "t_s", "breathing_rate", "heart_rate", "frequency_sum", "breathing_rate_std", "heart_rate_std")
