"""The public surface under the names that users of array libraries for motion sensing know.

Functions take and return DataFrames with a ``series_id``; containers hold one and give derived frames. What is a bare
array elsewhere is a SIGNAL frame (series_id, idx, value) here, so that every call covers all series at once.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import functions as fn
from . import sources, validate
from .operators import peaks, resample, series, spectral, stats
from .plans import features
from .schema import FrequencyRanges, SamplingRates

__all__ = [
    "AccelerometerData", "FrequencyRanges", "JerkData", "MotionFeatures", "SamplingRates", "ShortTimeFTResult", "SpectrogramResult",
    "compute_jerk", "compute_jerk_microseconds", "compute_magnitude", "compute_median", "compute_motion_features", "compute_percentile", "compute_short_time_ft", "compute_spectrogram",
    "compute_spectrogram_nufft", "find_peaks", "find_spectrogram_peaks", "gaussian_filter_1d", "hann_window", "next_power_of_2", "resample_accelerometer",
    "resample_accelerometer_cubic", "resample_accelerometer_cubic_microseconds", "resample_accelerometer_microseconds", "rolling_std", "smooth_spectrogram_peaks",
]


@dataclass(frozen=True)
class _Frame:
    df: DataFrame

    def lengths(self) -> DataFrame:
        """(series_id, n)."""
        return sources.lengths(self.df)

    def to_pandas(self):
        return self.df.toPandas()

    def to_arrow(self):
        return self.df.toArrow()


class AccelerometerData(_Frame):
    """SAMPLES."""

    def with_seconds(self) -> DataFrame:
        return self.df.withColumn("timestamp_s", F.col("ts_us") / F.lit(1e6))

    def to_xyz_array(self) -> DataFrame:
        return sources.xyz_rows(self.df)

    def to_txyz_array(self) -> DataFrame:
        return sources.txyz_rows(self.df)


class JerkData(_Frame):
    """JERK."""

    def signal(self) -> DataFrame:
        """As SIGNAL, in time order."""
        return series.indexed(self.df).select("series_id", "idx", F.col("jerk").alias("value"))


class SpectrogramResult(_Frame):
    """SPEC."""

    def resolution(self) -> DataFrame:
        return spectral.resolution(self.df)

    def find_peaks(self, threshold: float, relative: bool = True, band: tuple[float | None, float | None] = (None, None), scale: float = 60.0) -> DataFrame:
        return peaks.result_peaks(self.df, threshold, relative, *band, scale)


class ShortTimeFTResult(_Frame):
    """STFT, with re and im."""

    def resolution(self) -> DataFrame:
        return spectral.resolution(self.df)

    def parts(self) -> DataFrame:
        """The transform as ``complex`` (a struct), magnitude, phase and power."""
        re, im = F.col("re"), F.col("im")
        more = {"complex": F.struct("re", "im"), "magnitude": F.sqrt(fn.power(re, im)), "phase": fn.phase(re, im), "power": fn.power(re, im)}
        return self.df.withColumns(more)


@dataclass(frozen=True)
class MotionFeatures(_Frame):
    """FEATURES, and the spectrogram they come from."""

    spectrogram: SpectrogramResult


def resample_accelerometer(samples: DataFrame, target_fs: float, ts_unit: str = "s", time: str = "t") -> AccelerometerData:
    return AccelerometerData(resample.resample_linear(samples, target_fs, ts_unit=ts_unit, time=time))


def resample_accelerometer_microseconds(samples: DataFrame, target_fs: float) -> AccelerometerData:
    return AccelerometerData(resample.resample_linear(samples, target_fs))


def resample_accelerometer_cubic(samples: DataFrame, target_fs: float, ts_unit: str = "s", time: str = "t") -> AccelerometerData:
    return AccelerometerData(resample.resample_cubic(samples, target_fs, ts_unit, time))


def resample_accelerometer_cubic_microseconds(samples: DataFrame, target_fs: float) -> AccelerometerData:
    return AccelerometerData(resample.resample_cubic(samples, target_fs))


def compute_jerk(samples: DataFrame, use_diff: bool = True, ts_unit: str = "s", time: str = "t") -> JerkData:
    timed = samples.withColumn("ts_us", sources.microseconds(F.col(time), ts_unit))
    return JerkData(series.jerk(timed, use_diff))


def compute_jerk_microseconds(samples: DataFrame, use_diff: bool) -> JerkData:
    return JerkData(series.jerk(samples, use_diff))


def compute_magnitude(samples: DataFrame) -> DataFrame:
    return samples.withColumn("magnitude", fn.magnitude(F.col("x"), F.col("y"), F.col("z")))


def compute_spectrogram(signal: DataFrame, fs: float, nperseg: int, noverlap: int) -> SpectrogramResult:
    return SpectrogramResult(spectral.spectrogram(signal, fs, nperseg, noverlap))


def compute_short_time_ft(signal: DataFrame, fs: float, nperseg: int, noverlap: int) -> ShortTimeFTResult:
    return ShortTimeFTResult(spectral.stft(signal, fs, nperseg, noverlap))


def compute_spectrogram_nufft(samples: DataFrame, secperseg: float, secoverlap: float, ts_unit: str = "s", time: str = "t", value: str = "value", target_fs: float = 0.0) -> SpectrogramResult:
    """Of (series_id, ``time``, ``value``); a series too sparse for the window is an error, as it is for one array."""
    timed = samples.withColumn("ts_us", F.round(sources.seconds(F.col(time), ts_unit) * F.lit(1e6)).cast("long"))
    return SpectrogramResult(spectral.nufft_spectrogram(timed, secperseg, secoverlap, value, target_fs, on_error="raise"))


def compute_motion_features(jerk: DataFrame, fs: float, **options) -> MotionFeatures:
    """``options`` are those of :func:`oscilla.plans.features.motion_features`; of the spectrogram nothing is made until it is asked for."""
    cut = (options.get("window", features.WINDOW), options.get("overlap", features.OVERLAP), options.get("value", "value"))
    return MotionFeatures(features.motion_features(jerk, fs, **options), SpectrogramResult(spectral.spectrogram(jerk, fs, *cut)))


def hann_window(spark: SparkSession, n: int) -> DataFrame:
    return fn.hann_window(spark, n)


def gaussian_filter_1d(signal: DataFrame, sigma: float, truncate: float = 4.0) -> DataFrame:
    return series.gaussian_filter(signal, sigma, truncate, name="value")


def find_peaks(signal: DataFrame, prominence: float) -> DataFrame:
    return peaks.find_peaks(signal, prominence)


def find_spectrogram_peaks(spec: DataFrame, prominence: float, scale: float = 60.0) -> DataFrame:
    return peaks.spectrogram_peaks(spec, prominence, scale)


def rolling_std(signal: DataFrame, window_minutes: float, seconds_per_window: float = 30.0) -> DataFrame:
    return series.rolling_std(signal, None, window_minutes, seconds_per_window)


def next_power_of_2(n: Column) -> Column:
    return fn.next_power_of_2(n)


def compute_median(value: Column) -> Column:
    return stats.median(value)


def compute_percentile(value: Column, percentile: float) -> Column:
    return stats.percentile(value, percentile)


def smooth_spectrogram_peaks(signal: DataFrame, sampling_rate: float, max_change: float = 10.0, sigma: float = 2.0) -> DataFrame:
    validate.positive(sampling_rate=sampling_rate)
    return series.smooth_peaks(signal, sampling_rate, max_change, sigma)
