"""Empty, short, repeated, constant and broken series, and parameters that make no sense."""

import math

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from oscilla import functions as fn
from oscilla import sources, validate
from oscilla.operators import peaks, resample, series, spectral, stats
from oscilla.plans import registry
from oscilla.plans.features import motion_features


def samples(spark, rows):
    return spark.createDataFrame(rows, "series_id long, ts_us long, x double, y double, z double")


def signal(spark, *values):
    rows = [(k, i, None if v is None else float(v)) for k, vs in enumerate(values) for i, v in enumerate(vs)]
    return spark.createDataFrame(rows, "series_id long, idx long, value double")


def values(df, column, *order):
    return [r[column] for r in df.orderBy(*order).collect()]


def test_empty_tables_give_empty_results(spark):
    none, flat = samples(spark, []), signal(spark)
    for df in (
        series.jerk(none), resample.resample_linear(none, 1.0), resample.resample_cubic(none, 1.0), series.rolling_std(flat, 3), series.gaussian_filter(flat, 1.0),
        series.rate_clamp(flat, 1.0, 1.0), spectral.spectrogram(flat, 1.0, 8, 4), spectral.spectrogram(flat, 1.0, 8, 4, method="grouped"), peaks.find_peaks(flat, 0.1),
        spectral.nufft_spectrogram(none, 10.0, 5.0, "x"), motion_features(flat, 1.0, 16, 8, (0.07, 0.2), (0.25, 0.45)), stats.jitter(none),
    ):
        assert df.count() == 0


def test_one_sample_has_no_jerk_and_no_grid(spark):
    one = samples(spark, [(1, 0, 1.0, 2.0, 3.0)])
    assert series.jerk(one).count() == 0
    assert resample.resample_linear(one, 5.0).count() == 0
    assert resample.resample_cubic(one, 5.0).count() == 0


def test_two_samples(spark):
    two = samples(spark, [(1, 0, 0.0, 0.0, 0.0), (1, 1_000_000, 3.0, 4.0, 0.0)])
    assert values(series.jerk(two), "jerk", "ts_us") == [0.0, 5.0]
    assert values(series.jerk(two, use_diff=False), "jerk", "ts_us") == [0.0, 5.0]
    assert values(resample.resample_linear(two, 4.0), "x", "ts_us") == [0.0, 0.75, 1.5, 2.25]
    assert values(resample.resample_cubic(two, 4.0), "x", "ts_us") == pytest.approx([0.0, 0.75, 1.5, 2.25])
    assert resample.resample_linear(two, 0.1).count() == 1


def test_repeated_timestamps(spark):
    rows = [(1, 0, 0.0, 0.0, 0.0), (1, 10, 1.0, 0.0, 0.0), (1, 10, 5.0, 0.0, 0.0), (1, 20, 6.0, 0.0, 0.0)]
    df = samples(spark, rows).withColumn("n", F.col("x"))
    got = values(resample.resample_linear(df, 200_000.0, order=("ts_us", "n")), "x", "ts_us")
    assert got == [0.0, 0.5, 1.0, 5.5]
    with pytest.raises(Exception, match="must rise"):
        resample.resample_cubic(df, 200_000.0).collect()


def test_rolling_width_zero_is_nan(spark):
    assert all(math.isnan(v) for v in values(series.rolling_std(signal(spark, [1, 2, 3]), 0), "rolling_std", "idx"))


def test_order_statistics_of_nothing(spark):
    row = signal(spark).agg(stats.median(F.col("value")).alias("m"), stats.percentile(F.col("value"), 10).alias("p")).first()
    assert (row["m"], row["p"]) == (0.0, 0.0)
    nulls = signal(spark, [None])
    row = stats.extremes(nulls, "value").first()
    assert (row["min"], row["max"]) == (math.inf, -math.inf)


def test_constant_signal_has_no_spectrum_and_the_lowest_peak(spark):
    spec = spectral.spectrogram(signal(spark, [2.0] * 40), 1.0, 16, 8)
    assert max(values(spec, "mag", "seg", "k")) < 1e-12
    assert set(values(peaks.spectrogram_peaks(spec.where("k >= 3"), 0.1), "k", "seg")) == {3}


def test_short_signal_has_no_segments(spark):
    assert spectral.stft(signal(spark, [1.0] * 7), 1.0, 8, 4).count() == 0
    assert spectral.stft(signal(spark, [1.0] * 7), 1.0, 8, 4, method="grouped").count() == 0


def test_plateaus_are_no_peaks_and_nan_is_no_wall(spark):
    assert values(peaks.find_peaks(signal(spark, [0, 1, 1, 0, 2, 0]), 0.5), "idx", "idx") == [4]
    assert values(peaks.find_peaks(signal(spark, [0, 3, 1, 2, 0]), 1.5), "idx", "idx") == [1]


def test_gaussian_radius_beyond_the_series(spark):
    own = [1.0, 4.0, 2.0]
    kernel = series.gaussian_kernel(3.0)
    r = len(kernel) // 2

    def reflect(i):
        i = -i - 1 if i < 0 else 2 * 3 - 1 - i if i >= 3 else i
        return own[max(0, min(2, i))]

    want = [sum(w * reflect(i + k - r) for k, w in enumerate(kernel)) for i in range(3)]
    assert values(series.gaussian_filter(signal(spark, own), 3.0), "smoothed", "idx") == pytest.approx(want)


def test_nan_passes_the_rate_limit(spark):
    got = values(series.rate_clamp(signal(spark, [0.0, 10.0, float("nan"), 10.0, 0.0]), 2.0, 1.0), "value", "idx")
    assert got[:2] == [0.0, 2.0] and math.isnan(got[2]) and got[3:] == [10.0, 8.0]


def test_nufft_needs_four_samples_and_a_rising_step(spark):
    few = samples(spark, [(1, i * 1_000_000, float(i % 2), 0.0, 0.0) for i in (0, 1, 2, 10, 11, 12, 13, 14)])
    got = spectral.nufft_spectrogram(few, 4.0, 0.0, "x")
    assert set(values(got, "seg", "seg")) <= {0, 1, 2, 3} and 0 not in set(values(got, "seg", "seg"))
    same = samples(spark, [(1, 5, 1.0, 0.0, 0.0)] * 5)
    assert spectral.nufft_spectrogram(same, 4.0, 0.0, "x").count() == 0
    with pytest.raises(Exception, match="too sparse"):
        spectral.nufft_spectrogram(same, 4.0, 0.0, "x", on_error="raise").collect()


def test_band_from_zero_starts_at_bin_one(spark):
    spec = spectral.spectrogram(signal(spark, list(np.sin(np.arange(40)))), 1.0, 16, 8)
    row = spectral.band_bins(spec, 0.0, 0.2).first()
    assert (row["start"], row["end"]) == (1, 3)
    assert spectral.band_bins_of(1.0, 16, 0.0, 0.2) == (1, 3)


@pytest.mark.parametrize(
    "call",
    [
        lambda: validate.unit("minutes"), lambda: validate.overlap(8, 8), lambda: validate.overlap(0, 0), lambda: validate.band(2, 1), lambda: validate.positive(fs=0),
        lambda: validate.positive(fs=float("nan")), lambda: validate.not_negative(x=-1), lambda: series.gaussian_kernel(0), lambda: spectral.band_bins_of(1.0, 16, 0.49, 0.48),
        lambda: stats.percentile(F.lit(1.0), 101),
    ],
)
def test_senseless_parameters_fail_at_once(spark, call):
    with pytest.raises(ValueError):
        call()


def test_clashing_and_extra_columns(spark):
    df = samples(spark, [(1, i * 1_000_000, float(i), 0.0, 0.0) for i in range(5)]).withColumns({"n": F.lit(1), "t0": F.lit(2), "k": F.lit(3), "before": F.lit("b")})
    assert values(series.jerk(df), "jerk", "ts_us") == [0.0, 1.0, 1.0, 1.0, 1.0]
    assert resample.resample_linear(df, 1.0).columns == ["series_id", "ts_us", "x", "y", "z"]


def test_chunks_give_what_whole_series_give(spark):
    rng = np.random.default_rng(5)
    stamps = np.sort(rng.choice(10_000_000, 300, replace=False))
    rows = [(int(k % 2), int(t), *map(float, rng.normal(size=3))) for k, t in enumerate(stamps)]
    df = samples(spark, rows)
    for f in (lambda d, c: series.jerk(d, chunk_us=c), lambda d, c: series.indexed(d, chunk_us=c), lambda d, c: resample.resample_linear(d, 30.0, chunk_us=c)):
        whole, parts = (sorted(map(str, f(df, c).select(sorted(f(df, c).columns)).collect())) for c in (None, 700_000))
        assert whole == parts


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(v=st.lists(st.floats(-100, 100), min_size=3, max_size=40))
def test_prominence_by_arrays_is_prominence_by_definition(spark, v):
    found = spark.createDataFrame([(v,)], "v array<double>").select(fn.prominences(F.col("v")).alias("p")).first()["p"]
    want = []
    for i in range(1, len(v) - 1):
        if v[i] > v[i - 1] and v[i] > v[i + 1]:
            left = next((j for j in range(i - 1, -1, -1) if v[j] > v[i]), -1)
            right = next((j for j in range(i + 1, len(v)) if v[j] > v[i]), len(v))
            want.append((i, v[i] - max(min(v[left + 1 : i + 1]), min(v[i:right]))))
    assert [(p["at"], p["prominence"]) for p in found] == want


def test_sources(spark, tmp_path):
    (tmp_path / "a.csv").write_text("TIMESTAMP,ACC_X,ACC_Y,ACC_Z\n0.5,1,2,3\n1.5,4,5,6\n")
    (tmp_path / "b.csv").write_text("0.25 1 2 3\n0.75  4 5 6\nbroken line\n")
    df = sources.read_recordings(spark, str(tmp_path))
    assert sorted(values(df, "ts_us", "ts_us")) == [250_000, 500_000, 750_000, 1_500_000]
    assert df.select("series_id").distinct().count() == 2
    made = sources.from_arrays(spark, {7: ([0.001, 0.002], [1, 2], [3, 4], [5, 6])}, "s")
    assert [tuple(r) for r in made.orderBy("ts_us").collect()] == [(7, 1000, 1.0, 3.0, 5.0), (7, 2000, 2.0, 4.0, 6.0)]
    with pytest.raises(ValueError):
        sources.from_arrays(spark, {1: ([1], [1, 2], [1], [1])})


def test_sql_functions(spark):
    fn.register(spark)
    row = spark.sql("SELECT magnitude3(2, 3, 6) AS m, next_pow2(1025) AS p, next_pow2(0) AS q, hann_at(4, 8) AS w").first()
    assert (row["m"], row["p"], row["q"], row["w"]) == (7.0, 2048, 1, 1.0)


def slow_peaks(v, prominence):
    """By the definition, value by value; comparisons with NaN are false."""
    found = []
    for i in range(1, len(v) - 1):
        if v[i] > v[i - 1] and v[i] > v[i + 1]:
            lows = []
            for side in (range(i - 1, -1, -1), range(i + 1, len(v))):
                low = v[i]
                for j in side:
                    low = v[j] if v[j] < low else low
                    if v[j] > v[i]:
                        break
                lows.append(low)
            if v[i] - max(lows) >= prominence:
                found.append(i)
    return found


@pytest.mark.parametrize("chunk", [1, 3, 10, 1 << 16])
def test_peaks_against_brute_force_in_chunks(spark, chunk):
    rng = np.random.default_rng(4)
    rows = [rng.normal(size=n).round(k) for n in (1, 2, 3, 50, 120) for k in (0, 1, 6)]
    rows += [np.arange(40.0), np.arange(40.0)[::-1], np.sin(np.arange(90) / 5) + np.arange(90) / 30, np.zeros(9)]
    for share in (0.1, 0.4):
        rows.append(np.where(rng.random(100) < share, np.nan, rng.normal(size=100).round(1)))
    df = signal(spark, *rows)
    for prominence in (0.0, 0.5, 1.7):
        got = sorted((r["series_id"], r["idx"]) for r in peaks.find_peaks(df, prominence, chunk=chunk).collect())
        assert got == [(k, i) for k, v in enumerate(rows) for i in slow_peaks(v, prominence)]


def test_nan_is_neither_a_peak_nor_a_wall(spark):
    nan = float("nan")
    assert values(peaks.find_peaks(signal(spark, [0, 1, 0, nan, 0, 2, 0]), 0.5), "idx", "idx") == [1, 5]
    arrays = spark.createDataFrame([([0.0, 1.0, 0.0, nan, 0.0, 2.0, 0.0],), ([nan, nan],)], "a array<double>")
    rows = arrays.select(fn.prominences(F.col("a")).alias("p"), fn.rescaled(F.col("a")).alias("r")).collect()
    assert [(p["at"], p["prominence"]) for p in rows[0]["p"]] == [(1, 1.0), (5, 2.0)] and rows[0]["r"][5] == 1.0 and rows[1]["p"] == []


def test_find_peaks_joins_no_series_with_itself(spark):
    plan = peaks.find_peaks(signal(spark, [0, 1, 0]), 0.5)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan


def test_find_peaks_calls_python_for_many_chunks_at_once(spark):
    rng = np.random.default_rng(7)
    df = signal(spark, *(rng.normal(size=n).round(1) for n in (1, 40, 2, 75)), np.arange(30.0), np.where(rng.random(40) < 0.3, np.nan, rng.normal(size=40)))
    found = peaks.find_peaks(df, 0.5, chunk=7)
    assert "FlatMapGroups" not in found._jdf.queryExecution().executedPlan().toString()
    whole = sorted(peaks.find_peaks(df, 0.5).collect())
    assert len(whole) > 20 and sorted(found.collect()) == whole
    kept = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")  # chunks and series in several batches
    try:
        assert sorted(peaks.find_peaks(df, 0.5, chunk=7).collect()) == whole
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", kept)


def test_lines_are_made_and_split_once(spark, small):
    plan = registry.QUERIES["scan_recordings"](spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1 and plan.count("format_string(") == 2  # one for each layout
    lines = [("a", "TIMESTAMP,X"), ("a", " 1.5 , 1,2 ,3,4"), ("b", " 2  1\t2 3 "), ("b", "1 2 3"), ("b", "1 2 x 3"), ("b", ""), ("b", None)]
    got = sources.recordings(spark.createDataFrame(lines, "file string, value string")).drop("series_id").collect()
    assert sorted(tuple(r) for r in got) == [(1_500_000, 1.0, 2.0, 3.0, "a"), (2_000_000, 1.0, 2.0, 3.0, "b")]


def test_a_year_long_gap_needs_no_long_array(spark, monkeypatch):
    two = samples(spark, [(1, 0, 0.0, 0.0, 0.0), (1, 31_536_000 * 1_000_000, 1.0, 0.0, 0.0)])
    got = resample.resample_linear(two, 0.1)
    assert got.count() == 3_153_600 and got.agg(F.max("x")).first()[0] < 1
    monkeypatch.setattr(resample, "BLOCK", 3)
    few = samples(spark, [(1, 0, 0.0, 0.0, 0.0), (1, 9_000_000, 9.0, 0.0, 0.0), (1, 10_000_000, 0.0, 0.0, 0.0)])
    assert values(resample.resample_linear(few, 1.0), "x", "ts_us") == [float(k) for k in range(10)]


@pytest.mark.parametrize("chunk", [1, 4, 1000])
def test_chunks_change_nothing(spark, chunk):
    rng = np.random.default_rng(5)
    df = signal(spark, *(rng.normal(size=n) for n in (1, 2, 7, 30)))
    for f in (lambda **k: series.rolling_std(df, 3, **k), lambda **k: series.gaussian_filter(df, 1.5, **k)):
        whole, cut = (sorted(tuple(round(x, 9) for x in r) for r in f(**k).collect()) for k in ({}, {"chunk": chunk}))
        assert str(whole) == str(cut)


def test_upper_median(spark):
    rng = np.random.default_rng(6)
    own = [rng.integers(1, 5, n).astype(float) for n in (1, 2, 3, 10, 11)]
    df = signal(spark, *own)
    got = {r["series_id"]: r["value"] for r in stats.upper_median(df, "series_id", "value").collect()}
    assert got == {k: sorted(v)[len(v) // 2] for k, v in enumerate(own)}
