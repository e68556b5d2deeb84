"""Accuracy on seeded synthetic recordings: leakage, reconstruction and non-uniform spectra, with known figures."""

import numpy as np
import pytest

from oscilla import sources
from oscilla.operators import resample, series, spectral, stats

FS, RATE = 55.0, 32.0


def tones(parts, seconds=60.0, jitter=0.002, seed=42):
    rng = np.random.default_rng(seed)
    n = int(seconds * FS)
    t = np.arange(n) / FS
    if jitter:
        t = np.sort(t + rng.normal(0, jitter, n))
    return t, sum(a * np.sin(2 * np.pi * f * t) for f, a in parts)


def band(x, low, high):
    f = np.fft.rfftfreq(len(x), 1 / RATE)
    p = np.abs(np.fft.rfft(x)) ** 2 / len(x)
    return p[(f >= low) & (f <= high)].sum()


def resampled(spark, method, t, x):
    # Times as whole microseconds, as every recording has them.
    df = sources.from_arrays(spark, {1: (t, x, np.zeros_like(x), np.zeros_like(x))}, "s")
    f = resample.resample_linear if method == "linear" else resample.resample_cubic
    rows = f(df, RATE).orderBy("ts_us").collect()
    return np.array([r["ts_us"] for r in rows]) / 1e6, np.array([r["x"] for r in rows])


@pytest.mark.parametrize(("method", "figure"), [("linear", 2.80116e-2), ("cubic", 8.98411e-4)])
def test_tone_leakage(spark, method, figure):
    _, x = resampled(spark, method, *tones([(15, 1)]))
    assert len(x) == 1919
    ratio = band(x, 0.5, 10) / band(x, 14, 16)
    assert ratio < 1 and ratio == pytest.approx(figure, rel=0.02)


@pytest.mark.parametrize(("method", "figure"), [("linear", 2.48107e-2), ("cubic", 1.52489e-3)])
def test_empty_band_stays_empty(spark, method, figure):
    _, x = resampled(spark, method, *tones([(13, 1), (15, 0.8), (18, 0.6)], seed=77))
    assert band(x, 0.5, 10) / band(x, 10, 20) < 1


@pytest.mark.parametrize("hz", [1, 5, 10])
def test_reconstruction(spark, hz):
    errors = {}
    for method in ("linear", "cubic"):
        t, x = resampled(spark, method, *tones([(hz, 1)], 10.0, 0))
        errors[method] = np.sqrt(np.mean((x - np.sin(2 * np.pi * hz * t)) ** 2))
    assert errors["cubic"] <= errors["linear"] < 0.1


@pytest.mark.parametrize("jitter", [0.0005, 0.002, 0.005])
def test_non_uniform_peaks(spark, jitter):
    t, x = tones([(3, 1), (7, 0.5)], 60.0, jitter)
    df = sources.from_arrays(spark, {1: (t, x, x, x)}, "s")
    step = float(np.median(np.diff(t)[np.diff(t) > 0]))
    spec = spectral.nufft_spectrogram(df, 256 * step, 128 * step, "x")
    for low, high, hz in ((2, 4, 3), (6, 8, 7)):
        assert stats.mean_spectrum_peak(spec, low, high).first()["freq_hz"] == pytest.approx(hz, abs=0.5)
    assert spec.select("seg").distinct().count() == 24
    assert spec.agg({"k": "max"}).first()[0] == 128


@pytest.mark.parametrize("n", [15, 16, 1001])
def test_transforms_match_numpy(spark, n):
    rng = np.random.default_rng(n)
    x = rng.normal(size=3 * n + 5)
    df = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate(x)], "series_id long, idx long, value double")
    step = n - n // 2
    window = 0.5 * (1 - np.cos(2 * np.pi * np.arange(n) / n))
    cut = np.stack([x[s : s + n] for s in range(0, len(x) - n + 1, step)])
    want = np.fft.rfft((cut - cut.mean(axis=1, keepdims=True)) * window, axis=1)
    for method in ("direct", "grouped") if n < 100 else ("grouped",):
        rows = spectral.stft(df, 2.0, n, n // 2, method=method).orderBy("seg", "k").collect()
        got = np.array([complex(r["re"], r["im"]) for r in rows]).reshape(want.shape)
        assert np.allclose(got, want, atol=1e-9)
    assert rows[0]["t_s"] == (n // 2) / 2.0


def test_spectra_scale_with_the_signal_and_not_with_its_level(spark):
    x = np.random.default_rng(3).normal(size=64)
    df = lambda v: spark.createDataFrame([(1, i, float(a)) for i, a in enumerate(v)], "series_id long, idx long, value double")
    mags = lambda v: np.array([r["mag"] for r in spectral.spectrogram(df(v), 1.0, 16, 8).orderBy("seg", "k").collect()])
    assert np.allclose(3 * mags(x), mags(3 * x + 7), atol=1e-9)


def test_blocks_of_segments_join_without_a_seam(spark):
    x = np.random.default_rng(4).normal(size=64 * 8 * 3)
    df = spark.createDataFrame([(1, i, float(a)) for i, a in enumerate(x)], "series_id long, idx long, value double")
    a, b = (spectral.stft(df, 1.0, 16, 8, method=m).orderBy("seg", "k").select("seg", "k", "re").toPandas() for m in ("direct", "grouped"))
    assert len(a) == len(b) == 191 * 9
    assert (a["seg"] == b["seg"]).all() and np.allclose(a["re"], b["re"])


def test_jerk_of_a_steady_turn(spark):
    t = np.arange(100) / 50
    df = sources.from_arrays(spark, {1: (t, np.cos(t), np.sin(t), 0 * t)}, "s")
    rows = [r["jerk"] for r in series.jerk(df).orderBy("ts_us").collect()]
    assert rows[0] == 0 and np.allclose(rows[1:], 2 * np.sin(0.01), atol=1e-9)
