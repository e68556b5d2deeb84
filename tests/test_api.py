"""Every public name, end to end on two small series."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from oscilla import api


@pytest.fixture(scope="module")
def recording(spark):
    rng = np.random.default_rng(8)
    rows = [(k, i / 50 + 0.001 * float(rng.random()), float(np.sin(i / 5 + k)), float(rng.normal()), 1.0) for k in (1, 2) for i in range(400)]
    return spark.createDataFrame(rows, "series_id long, t double, x double, y double, z double")


def test_all_names_exist():
    assert all(hasattr(api, n) for n in api.__all__)


def test_chain(recording):
    even = api.resample_accelerometer(recording, 25.0)
    cubic = api.resample_accelerometer_cubic(recording, 25.0)
    assert {r["n"] for r in even.lengths().collect()} == {r["n"] for r in cubic.lengths().collect()} == {199}
    again = api.resample_accelerometer_microseconds(even.df, 25.0)
    a, b = (f.df.orderBy("series_id", "ts_us").limit(100).toPandas() for f in (even, again))
    assert np.allclose(a["x"], b["x"])
    assert api.resample_accelerometer_cubic_microseconds(even.df, 10.0).df.count() > 0
    assert even.with_seconds().first()["timestamp_s"] is not None
    assert len(even.to_xyz_array().first()["xyz"]) == 3 and len(even.to_txyz_array().first()["txyz"]) == 4
    jerk = api.compute_jerk_microseconds(even.df, True)
    assert api.compute_jerk(recording).df.count() == 800
    signal = jerk.signal()
    spec = api.compute_spectrogram(signal, 25.0, 64, 32)
    row = spec.resolution().first()
    assert row["frequency_resolution"] == pytest.approx(25 / 64) and row["time_resolution"] == pytest.approx(32 / 25)
    assert spec.find_peaks(0.1, band=(1.0, 8.0)).count() == 2 * 5
    parts = api.compute_short_time_ft(signal, 25.0, 64, 32).parts().limit(20).toPandas()
    assert np.allclose(parts["magnitude"] ** 2, parts["power"]) and np.allclose(parts["magnitude"] * np.cos(parts["phase"]), parts["re"])
    found = api.compute_motion_features(signal, 25.0, window=64, overlap=32, breathing=(0.3, 2.0), heart=(2.0, 8.0)).to_pandas()
    assert len(found) == 10 and np.isfinite(found.drop(columns="series_id")).all().all()
    assert api.compute_magnitude(recording).first()["magnitude"] >= 1.0
    peaks = api.find_spectrogram_peaks(spec.df, 0.1)
    track = peaks.select("series_id", F.col("seg").cast("long").alias("idx"), F.col("peak").alias("value"))
    assert api.smooth_spectrogram_peaks(track, 1.0).count() == 10
    assert api.rolling_std(track, 1.0).count() == 10
    assert api.gaussian_filter_1d(track, 1.0).columns == ["series_id", "idx", "value"]
    assert api.find_peaks(signal, 0.5).count() > 0


def test_long_window_defaults_take_the_grouped_path(spark):
    rng = np.random.default_rng(9)
    df = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate(rng.random(6000))], "series_id long, idx long, value double")
    found = api.compute_motion_features(df, 50.0).to_pandas()
    assert len(found) == 7 and found["breathing_rate"].between(9, 25.02).all() and found["heart_rate"].between(30, 120).all()


def test_non_uniform_errors_are_raised(spark, recording):
    assert api.compute_spectrogram_nufft(recording.withColumn("value", F.col("x")), 2.0, 1.0, target_fs=10.0).df.count() > 0
    with pytest.raises(Exception, match="too sparse"):
        api.compute_spectrogram_nufft(recording.withColumn("value", F.col("x")), 0.01, 0.0).df.collect()
    with pytest.raises(ValueError):
        api.compute_jerk(recording, ts_unit="minutes")


def test_columns(spark):
    row = spark.range(1, 4).agg(api.compute_median(F.col("id")).alias("m"), api.compute_percentile(F.col("id"), 25).alias("p")).first()
    assert (row["m"], row["p"]) == (2.0, 1.5)
    assert spark.range(1).select(api.next_power_of_2(F.lit(700))).first()[0] == 1024
    assert [r["w"] for r in api.hann_window(spark, 4).orderBy("i").collect()] == pytest.approx([0.0, 0.5, 1.0, 0.5])
