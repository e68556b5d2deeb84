"""The engine's queries over the driver's tables, each with its DuckDB twin.

Events are the samples: a user is a series, ``value`` its signal, sample numbers follow (ts, event_id). Results are
rounded to six decimals on both sides; adding 0.0 turns a negative zero into zero.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .. import functions as fn
from ..operators import peaks, resample, series, spectral, stats
from ..sources import events_as_samples, from_arrays, lengths, microseconds, recordings, seconds, txyz_rows, xyz_rows
from .features import motion_features

ORDER = ("ts_us", "event_id")
N, SHARED, STEP, HALF = 16, 8, 8, 8
HOUR = 1 / 3600
WEEK, HOP = 604_800.0, 302_400.0
BREATH, HEART = (0.07, 0.2), (0.25, 0.45)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def _query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _r(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) + F.lit(0.0) for n in names})


def _samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events_as_samples(spark.read.parquet(f"{sf_dir}/events.parquet"))


def _signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.indexed(_samples(spark, sf_dir), order=ORDER).select("series_id", "idx", F.col("x").alias("value"))


def _spec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spectral.spectrogram(_signal(spark, sf_dir), 1.0, N, SHARED)


# Building blocks of the twins; each is a list of common table expressions.
S = """s AS (SELECT user_id AS series_id, epoch_us(ts) AS ts_us, value AS x, CAST(json_extract(props, '$.k') AS DOUBLE) AS y,
  (event_id % 100) / 10.0 AS z, event_id FROM events)"""
SIG = S + """, sig AS (SELECT series_id, row_number() OVER (PARTITION BY series_id ORDER BY ts_us, event_id) - 1 AS idx, x AS value FROM s)"""
DFT = SIG + f""", cut AS (SELECT series_id, value AS v, idx, unnest(range(greatest(0, CAST(ceil((idx - {N - 1}) / {STEP}.0) AS BIGINT)), idx // {STEP} + 1)) AS seg FROM sig),
seg0 AS (SELECT series_id, CAST(seg AS INTEGER) AS seg, idx - seg * {STEP} AS i, v, count(*) OVER w AS n, avg(v) OVER w AS m FROM cut WINDOW w AS (PARTITION BY series_id, seg)),
tap AS (SELECT series_id, seg, i, (v - m) * 0.5 * (1 - cos(2 * pi() * i / {N})) AS d FROM seg0 WHERE n = {N}),
ft AS (SELECT series_id, seg, CAST(k AS INTEGER) AS k, sum(d * cos(2 * pi() * ((k * i) % {N}) / {N})) AS re, -sum(d * sin(2 * pi() * ((k * i) % {N}) / {N})) AS im
  FROM tap, range(0, {HALF + 1}) r(k) GROUP BY ALL)"""
SPEC = DFT + f""", spec AS (SELECT series_id, seg, (seg * {STEP} + {HALF}) / 1.0 AS t_s, k, k / {N}.0 AS freq_hz,
  sqrt(re * re + im * im) / sqrt((SELECT sum(pow(0.5 * (1 - cos(2 * pi() * i / {N})), 2)) FROM range(0, {N}) q(i))) AS mag FROM ft)"""


def _peaks_sql(source: str, out: str) -> str:
    """``out`` (g, h, i, v, p): peaks of ``source`` (g, h, i, v) and their prominence."""
    return f"""{out}_c AS (SELECT * FROM (SELECT *, lag(v) OVER w AS lv, lead(v) OVER w AS rv FROM {source} WINDOW w AS (PARTITION BY g, h ORDER BY i)) WHERE v > lv AND v > rv),
{out}_w AS (SELECT c.g, c.h, c.i, c.v, coalesce(max(CASE WHEN s.i < c.i AND s.v > c.v THEN s.i END), -1) AS lw, coalesce(min(CASE WHEN s.i > c.i AND s.v > c.v THEN s.i END), 1000000000) AS rw
  FROM {out}_c c JOIN {source} s ON s.g = c.g AND s.h = c.h GROUP BY ALL),
{out} AS (SELECT w.g, w.h, w.i, w.v, w.v - greatest(min(CASE WHEN s.i <= w.i THEN s.v END), min(CASE WHEN s.i >= w.i THEN s.v END)) AS p
  FROM {out}_w w JOIN {source} s ON s.g = w.g AND s.h = w.h AND s.i BETWEEN w.lw AND w.rw GROUP BY w.g, w.h, w.i, w.v)"""


def _band_sql(low: float, high: float, name: str, passes: int, prominence: str) -> str:
    """``name`` (g, h, k): the highest peak's bin of every segment within bins of ``spec`` chosen by Hz."""
    ctes = [
        f"{name}_b AS (SELECT series_id AS g, seg AS h, k AS i, mag AS v FROM spec WHERE k BETWEEN (SELECT min(k) FROM range(1, {HALF + 1}) t(k) WHERE k / {N}.0 >= {low}) AND (SELECT max(k) FROM range(0, {HALF + 1}) t(k) WHERE k / {N}.0 <= {high}))"
    ]
    last = f"{name}_b"
    for p in range(passes):
        ctes.append(f"{name}_r{p} AS (SELECT g, h, i, v / greatest(1e-12, max(v) OVER (PARTITION BY g, h)) AS v FROM {last})")
        last = f"{name}_r{p}"
    ctes.append(_peaks_sql(last, f"{name}_p"))
    ctes.append(f"{name}_m AS (SELECT g, min(v) AS mn FROM {last} GROUP BY g)")
    ctes.append(
        f"{name}_t AS (SELECT p.g, p.h, p.i, row_number() OVER (PARTITION BY p.g, p.h ORDER BY p.v DESC, p.i) AS n FROM {name}_p p JOIN {name}_m m ON m.g = p.g WHERE p.p >= {prominence} * (1.0 - m.mn))"
    )
    ctes.append(f"{name} AS (SELECT b.g, b.h, coalesce(t.i, b.lo) AS k FROM (SELECT g, h, min(i) AS lo FROM {name}_b GROUP BY ALL) b LEFT JOIN {name}_t t ON t.g = b.g AND t.h = b.h AND t.n = 1)")
    return ",\n".join(ctes)


def _clamp_sql(source: str, columns: dict[str, float], out: str) -> str:
    """``out``: ``source`` (g, i from 0, ...) with each column kept near the one before it. Needs WITH RECURSIVE."""
    first = ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in columns)
    step = ", ".join(f"CASE WHEN abs(s.{c} - p.{c}) > {m} THEN p.{c} + (CASE WHEN s.{c} > p.{c} THEN {m} ELSE -{m} END) ELSE s.{c} END" for c, m in columns.items())
    return f"{out} AS (SELECT g, i, {first} FROM {source} WHERE i = 0 UNION ALL SELECT s.g, s.i, {step} FROM {out} p JOIN {source} s ON s.g = p.g AND s.i = p.i + 1)"


@_query(f"WITH {S} SELECT series_id, ts_us, event_id, round(sqrt(x * x + y * y + z * z), 6) + 0.0 AS magnitude FROM s")
def magnitude(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = fn.magnitude(F.col("x"), F.col("y"), F.col("z")).alias("magnitude")
    return _r(_samples(spark, sf_dir).select("series_id", "ts_us", "event_id", m), "magnitude")


_JERK = """WITH {S}, d AS (SELECT *, x - {lag} AS dx, y - {lagy} AS dy, z - {lagz} AS dz, row_number() OVER w AS rn, count(*) OVER (PARTITION BY series_id) AS n FROM s WINDOW w AS (PARTITION BY series_id ORDER BY ts_us, event_id))
SELECT series_id, ts_us, event_id, round(CASE WHEN rn = 1 THEN 0.0 ELSE sqrt(dx * dx + dy * dy + dz * dz) END, 6) + 0.0 AS jerk FROM d WHERE n >= 2"""


@_query(_JERK.format(S=S, lag="lag(x) OVER w", lagy="lag(y) OVER w", lagz="lag(z) OVER w"))
def jerk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(series.jerk(_samples(spark, sf_dir), order=ORDER), "jerk")


@_query(_JERK.format(S=S, lag="0", lagy="0", lagz="0"))
def jerk_nodiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(series.jerk(_samples(spark, sf_dir), use_diff=False, order=ORDER), "jerk")


@_query(ORACLE_SQL["jerk"])
def jerk_chunked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same split by days, as for series too long for one task."""
    return _r(series.jerk(_samples(spark, sf_dir), order=ORDER, chunk_us=86_400_000_000), "jerk")


@_query(f"WITH {SIG} SELECT series_id, idx, round(stddev_pop(value) OVER (PARTITION BY series_id ORDER BY idx ROWS BETWEEN 5 PRECEDING AND 4 FOLLOWING), 6) + 0.0 AS rolling_std FROM sig")
def rolling_std(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(series.rolling_std(_signal(spark, sf_dir), 5), "rolling_std").drop("value")


@_query(f"WITH {S} SELECT series_id, round(median(x), 6) + 0.0 AS median FROM s GROUP BY series_id")
def series_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(_samples(spark, sf_dir).groupBy("series_id").agg(stats.median(F.col("x")).alias("median")), "median")


@_query(f"WITH {S} SELECT series_id, round(quantile_cont(x, 0.1), 6) + 0.0 AS p10, round(quantile_cont(x, 0.9), 6) + 0.0 AS p90 FROM s GROUP BY series_id")
def series_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _samples(spark, sf_dir).groupBy("series_id").agg(*(stats.percentile(F.col("x"), p).alias(f"p{p}") for p in (10, 90)))
    return _r(found, "p10", "p90")


@_query("SELECT l_partkey AS series_id, round(median(l_extendedprice), 6) + 0.0 AS median, round(quantile_cont(l_extendedprice, 0.9), 6) + 0.0 AS p90 FROM lineitem GROUP BY l_partkey")
def part_price_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.col("l_extendedprice")
    found = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy(F.col("l_partkey").alias("series_id")).agg(stats.median(price).alias("median"), stats.percentile(price, 90).alias("p90"))
    return _r(found, "median", "p90")


@_query("SELECT i, round(0.5 * (1 - cos(2 * pi() * i / 1500)), 6) + 0.0 AS w FROM range(0, 1500) t(i)")
def hann_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(fn.hann_window(spark, 1500), "w")


@_query("SELECT n, CASE WHEN n <= 1 THEN 1 ELSE CAST(pow(2, length(bin(n - 1))) AS BIGINT) END AS p FROM range(0, 2001) t(n)")
def next_power_of_2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.range(2001).select(F.col("id").alias("n"), fn.next_power_of_2(F.col("id")).alias("p"))


_GRID = S + f""", e AS (SELECT series_id, min(ts_us) AS t0, max(ts_us) AS t1, count(*) AS n FROM s GROUP BY series_id),
g AS (SELECT series_id, t0, t1, unnest(range(0, greatest(1, CAST(trunc((t1 - t0) / 1000000.0::DOUBLE * {HOUR!r}::DOUBLE) AS BIGINT)))) AS i FROM e WHERE n >= 2),
q AS (SELECT series_id, t0 + CAST(trunc(i * {1_000_000.0 / HOUR!r}::DOUBLE) AS BIGINT) AS t FROM g),
nx AS (SELECT *, lead(ts_us) OVER w AS t2, lead(x) OVER w AS x2, lead(y) OVER w AS y2, lead(z) OVER w AS z2, row_number() OVER w - 1 AS k FROM s WINDOW w AS (PARTITION BY series_id ORDER BY ts_us, event_id))"""


@_query(
    f"""WITH {_GRID}
SELECT q.series_id, q.t AS ts_us, round(x + a * (x2 - x), 6) + 0.0 AS x, round(y + a * (y2 - y), 6) + 0.0 AS y, round(z + a * (z2 - z), 6) + 0.0 AS z
FROM q ASOF JOIN nx ON q.series_id = nx.series_id AND q.t >= nx.ts_us, LATERAL (SELECT CASE WHEN t2 > ts_us THEN (q.t - ts_us) / (t2 - ts_us)::DOUBLE ELSE 0.0 END AS a) l"""
)
def resample_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(resample.resample_linear(_samples(spark, sf_dir), HOUR, order=ORDER), "x", "y", "z")


@_query(ORACLE_SQL["resample_linear"])
def resample_linear_chunked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(resample.resample_linear(_samples(spark, sf_dir), HOUR, order=ORDER, chunk_us=86_400_000_000), "x", "y", "z")


@_query(
    f"""WITH RECURSIVE {_GRID},
h AS (SELECT series_id, k, ts_us, x, y, z, (t2 - ts_us)::DOUBLE AS h, x2, y2, z2, lag((t2 - ts_us)::DOUBLE) OVER w AS hp, lag(x) OVER w AS xp, lag(y) OVER w AS yp, lag(z) OVER w AS zp, count(*) OVER (PARTITION BY series_id) AS n FROM nx WINDOW w AS (PARTITION BY series_id ORDER BY k)),
f AS (SELECT series_id, k, h, h AS own, 0.0::DOUBLE AS mu, 0.0::DOUBLE AS ax, 0.0::DOUBLE AS ay, 0.0::DOUBLE AS az FROM h WHERE k = 0
  UNION ALL SELECT h.series_id, h.k, h.h, l, h.h / l, (3 * ((h.x2 - h.x) / h.h - (h.x - h.xp) / h.hp) - h.hp * f.ax) / l, (3 * ((h.y2 - h.y) / h.h - (h.y - h.yp) / h.hp) - h.hp * f.ay) / l, (3 * ((h.z2 - h.z) / h.h - (h.z - h.zp) / h.hp) - h.hp * f.az) / l
  FROM f JOIN h ON h.series_id = f.series_id AND h.k = f.k + 1 AND h.k < h.n - 1, LATERAL (SELECT 2 * (h.h + h.hp) - h.hp * f.mu AS l) y),
c AS (SELECT series_id, k, 0.0::DOUBLE AS cx, 0.0::DOUBLE AS cy, 0.0::DOUBLE AS cz FROM h WHERE k = n - 1
  UNION ALL SELECT f.series_id, f.k, f.ax - f.mu * c.cx, f.ay - f.mu * c.cy, f.az - f.mu * c.cz FROM c JOIN f ON f.series_id = c.series_id AND f.k = c.k - 1),
co AS (SELECT h.*, a.cx, a.cy, a.cz, b.cx AS cx2, b.cy AS cy2, b.cz AS cz2 FROM h LEFT JOIN c a ON a.series_id = h.series_id AND a.k = h.k LEFT JOIN c b ON b.series_id = h.series_id AND b.k = h.k + 1)
SELECT q.series_id, q.t AS ts_us,
  round(x + d * ((x2 - x) / h - h * (cx2 + 2 * cx) / 3 + d * (cx + d * (cx2 - cx) / (3 * h))), 6) + 0.0 AS x,
  round(y + d * ((y2 - y) / h - h * (cy2 + 2 * cy) / 3 + d * (cy + d * (cy2 - cy) / (3 * h))), 6) + 0.0 AS y,
  round(z + d * ((z2 - z) / h - h * (cz2 + 2 * cz) / 3 + d * (cz + d * (cz2 - cz) / (3 * h))), 6) + 0.0 AS z
FROM q ASOF JOIN co ON q.series_id = co.series_id AND q.t >= co.ts_us, LATERAL (SELECT (q.t - ts_us)::DOUBLE AS d) l"""
)
def resample_cubic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(resample.resample_cubic(_samples(spark, sf_dir), HOUR), "x", "y", "z")


@_query(f"WITH {SPEC} SELECT series_id, seg, t_s, k, freq_hz, round(mag, 6) + 0.0 AS mag FROM spec")
def spectrogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(_spec(spark, sf_dir), "mag")


@_query(ORACLE_SQL["spectrogram"])
def spectrogram_grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by grouped numpy, as for long windows."""
    return _r(spectral.spectrogram(_signal(spark, sf_dir), 1.0, N, SHARED, method="grouped"), "mag")


@_query(f"WITH {DFT} SELECT series_id, seg, (seg * {STEP} + {HALF}) / 1.0 AS t_s, k, k / {N}.0 AS freq_hz, round(re, 6) + 0.0 AS re, round(im, 6) + 0.0 AS im FROM ft")
def stft(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(spectral.stft(_signal(spark, sf_dir), 1.0, N, SHARED), "re", "im")


@_query(
    f"""WITH {DFT} SELECT series_id, seg, k, round(sqrt(re * re + im * im), 6) + 0.0 AS magnitude, round(atan2(im, re), 5) + 0.0 AS phase, round(re * re + im * im, 6) + 0.0 AS power
FROM ft WHERE sqrt(re * re + im * im) > 1e-6 AND k BETWEEN 1 AND {HALF - 1}"""
)
def stft_phase(spark: SparkSession, sf_dir: str) -> DataFrame:
    re, im = F.col("re"), F.col("im")
    parts = spectral.stft(_signal(spark, sf_dir), 1.0, N, SHARED, k_range=(1, HALF - 1)).where(F.sqrt(fn.power(re, im)) > 1e-6)
    found = parts.select("series_id", "seg", "k", F.sqrt(fn.power(re, im)).alias("magnitude"), (F.round(fn.phase(re, im), 5) + F.lit(0.0)).alias("phase"), fn.power(re, im).alias("power"))
    return _r(found, "magnitude", "power")


@_query(f"WITH {SPEC} SELECT series_id, seg, k, freq_hz, round(mag, 6) + 0.0 AS mag FROM spec WHERE freq_hz >= 0.125 AND freq_hz <= 0.375")
def freq_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(_spec(spark, sf_dir).where(fn.in_band(F.col("freq_hz"), 0.125, 0.375)).drop("t_s"), "mag")


@_query(f"WITH {SPEC} SELECT series_id, seg, t_s, round(sum(mag), 6) + 0.0 AS frequency_sum FROM spec GROUP BY ALL")
def freq_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(spectral.frequency_sum(_spec(spark, sf_dir)), "frequency_sum")


_FLOOR = """fs AS (SELECT series_id, seg, sum(mag) AS v FROM spec GROUP BY ALL),
up AS (SELECT series_id, seg, greatest(v - median(v) OVER (PARTITION BY series_id), 0.0) AS u FROM fs),
fl AS (SELECT series_id, seg, CASE WHEN u < quantile_cont(u, 0.1) OVER (PARTITION BY series_id) THEN 0.0 ELSE u END AS v FROM up)"""


@_query(f"WITH {SPEC}, {_FLOOR} SELECT series_id, seg, round(v, 6) + 0.0 AS frequency_sum FROM fl")
def freq_sum_processed(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = stats.without_floor(spectral.frequency_sum(_spec(spark, sf_dir)), "frequency_sum", "processed")
    return _r(found.select("series_id", "seg", F.col("processed").alias("frequency_sum")), "frequency_sum")


@_query(f"WITH {SPEC} SELECT series_id, seg, k, round(mag / greatest(1e-12, max(mag) OVER (PARTITION BY series_id, seg)), 6) + 0.0 AS mag FROM spec")
def rescale_spectrogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(spectral.rescale(_spec(spark, sf_dir)).select("series_id", "seg", "k", "mag"), "mag")


@_query(f"WITH {SPEC} SELECT series_id, seg, k - 2 AS k, round(mag / greatest(1e-12, max(mag) OVER (PARTITION BY series_id, seg)), 6) + 0.0 AS mag FROM spec WHERE k BETWEEN 2 AND 6")
def rescale_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = spectral.spectrogram(_signal(spark, sf_dir), 1.0, N, SHARED, k_range=(2, 6))
    return _r(spectral.rescale(part).select("series_id", "seg", (F.col("k") - 2).alias("k"), "mag"), "mag")


@_query(f"WITH {SPEC} SELECT series_id, round(min(mag), 6) + 0.0 AS min, round(max(mag), 6) + 0.0 AS max FROM spec GROUP BY series_id")
def minmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(stats.extremes(_spec(spark, sf_dir), "mag"), "min", "max")


@_query(
    f"""WITH {SPEC} SELECT series_id, coalesce(min(k) FILTER (WHERE freq_hz >= {BREATH[0]} AND k > 0), 0) AS b_start, coalesce(max(k) FILTER (WHERE freq_hz <= {BREATH[1]}), 0) AS b_end,
  coalesce(min(k) FILTER (WHERE freq_hz >= 0 AND k > 0), 0) AS z_start, coalesce(max(k) FILTER (WHERE freq_hz <= -1), 0) AS z_end FROM spec GROUP BY series_id"""
)
def band_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = _spec(spark, sf_dir)
    a = spectral.band_bins(spec, *BREATH).toDF("series_id", "b_start", "b_end")
    return a.join(spectral.band_bins(spec, 0.0, -1.0).toDF("series_id", "z_start", "z_end"), "series_id")


@_query(f"WITH {SIG}, b AS (SELECT series_id AS g, 0 AS h, idx AS i, value AS v FROM sig), {_peaks_sql('b', 'p')} SELECT g AS series_id, i AS idx FROM p WHERE p >= 0.5")
def find_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return peaks.find_peaks(_signal(spark, sf_dir), 0.5)


@_query(f"WITH {SPEC}, {_band_sql(-1, 9, 'pk', 1, '0.1').replace('range(1, 9) t(k) WHERE k', 'range(0, 9) t(k) WHERE k')} SELECT g AS series_id, h AS seg, CAST(k AS INTEGER) AS k, round(60.0 * k / {N}.0, 6) + 0.0 AS peak FROM pk")
def spectrogram_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(peaks.spectrogram_peaks(_spec(spark, sf_dir), 0.1).drop("t_s"), "peak")


@_query(
    f"""WITH {SPEC}, span AS (SELECT series_id, max(mag) - min(mag) AS sp FROM spec WHERE freq_hz BETWEEN 0.1 AND 0.45 GROUP BY series_id),
{_band_sql(0.1, 0.45, "pk", 1, "0.05 * (SELECT sp FROM span WHERE span.series_id = p.g)")} SELECT g AS series_id, h AS seg, CAST(k AS INTEGER) AS k, round(60.0 * k / {N}.0, 6) + 0.0 AS peak FROM pk"""
)
def result_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(peaks.result_peaks(_spec(spark, sf_dir), 0.05, True, 0.1, 0.45).drop("t_s"), "peak")


_GAUSS = SIG + """, ln AS (SELECT series_id, count(*) AS n FROM sig GROUP BY series_id),
ker AS (SELECT o, exp(-(o * o) / 8.0) / (SELECT sum(exp(-(p * p) / 8.0)) FROM range(-8, 9) b(p)) AS w FROM range(-8, 9) a(o)),
tapped AS (SELECT sig.series_id, idx, w, greatest(0, least(n - 1, CASE WHEN idx + o < 0 THEN -(idx + o) - 1 WHEN idx + o >= n THEN 2 * n - 1 - (idx + o) ELSE idx + o END)) AS j FROM sig JOIN ln USING (series_id), ker),
sm AS (SELECT t.series_id, t.idx, sum(t.w * s.value) AS v FROM tapped t JOIN sig s ON s.series_id = t.series_id AND s.idx = t.j GROUP BY ALL)"""


@_query(f"WITH {_GAUSS} SELECT series_id, idx, round(v, 6) + 0.0 AS smoothed FROM sm")
def gaussian_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(series.gaussian_filter(_signal(spark, sf_dir), 2.0), "smoothed")


@_query(f"WITH RECURSIVE {SIG}, b AS (SELECT series_id AS g, idx AS i, value AS v FROM sig), {_clamp_sql('b', {'v': 5.0}, 'o')} SELECT g AS series_id, i AS idx, round(v, 6) + 0.0 AS value FROM o")
def rate_clamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(series.rate_clamp(_signal(spark, sf_dir), 5.0, 1.0), "value")


@_query(f"WITH RECURSIVE {_GAUSS}, b AS (SELECT series_id AS g, idx AS i, v FROM sm), {_clamp_sql('b', {'v': 5.0}, 'o')} SELECT g AS series_id, i AS idx, round(v, 6) + 0.0 AS value FROM o")
def smooth_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(series.smooth_peaks(_signal(spark, sf_dir), 1.0, 5.0), "value")


@_query(
    f"""WITH RECURSIVE {SPEC}, {_FLOOR}, {_band_sql(*BREATH, "br", 2, "0.1")}, {_band_sql(*HEART, "hr", 2, "0.1")},
b AS (SELECT br.g, br.h AS i, 60.0 * br.k / {N}.0 AS b, 60.0 * hr.k / {N}.0 AS hh FROM br JOIN hr ON hr.g = br.g AND hr.h = br.h),
{_clamp_sql("b", {"b": 4.0, "hh": 3.0}, "o")}
SELECT o.g AS series_id, CAST(o.i AS INTEGER) AS seg, (o.i * {STEP} + {HALF}) / 1.0 AS t_s, round(b, 6) + 0.0 AS breathing_rate, round(hh, 6) + 0.0 AS heart_rate, round(fl.v, 6) + 0.0 AS frequency_sum,
  round(stddev_pop(b) OVER w, 6) + 0.0 AS breathing_rate_std, round(stddev_pop(hh) OVER w, 6) + 0.0 AS heart_rate_std
FROM o JOIN fl ON fl.series_id = o.g AND fl.seg = o.i WINDOW w AS (PARTITION BY o.g ORDER BY o.i ROWS BETWEEN 3 PRECEDING AND 2 FOLLOWING)"""
)
def motion_features_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = motion_features(
        _signal(spark, sf_dir), 1.0, N, SHARED, BREATH, HEART, std_window_minutes=0.4, heart_change=0.375, breathing_change=0.5, time_resolution=8.0
    )
    return _r(found, "breathing_rate", "heart_rate", "frequency_sum", "breathing_rate_std", "heart_rate_std")


QUERIES["motion_features"] = QUERIES.pop("motion_features_query")
ORACLE_SQL["motion_features"] = ORACLE_SQL.pop("motion_features_query")

_NUFFT = S + f""", b AS (SELECT series_id, (ts_us - min(ts_us) OVER (PARTITION BY series_id)) / 1e6 AS t, x AS v FROM s),
d AS (SELECT *, t - lag(t) OVER (PARTITION BY series_id ORDER BY t) AS dt FROM b),
m AS (SELECT series_id, max(t) AS te, list_sort(list(dt) FILTER (WHERE dt > 0)) AS l FROM d GROUP BY series_id),
n AS (SELECT series_id, te, l[len(l) // 2 + 1] AS dm FROM m WHERE len(l) > 0),
n2 AS (SELECT *, CAST(trunc({WEEK} * (1.0 / dm)) AS BIGINT) AS nf FROM n),
n3 AS (SELECT series_id, te, dm, CAST(pow(2, length(bin(nf - 1))) AS BIGINT) // 2 AS half FROM n2 WHERE nf >= 2),
wi AS (SELECT *, unnest(range(0, CAST(floor((te + dm - {WEEK}) / {HOP}) AS BIGINT) + 1)) AS seg FROM n3),
j AS (SELECT wi.series_id, seg, half, dm, (b.t - seg * {HOP}) / {WEEK} AS tau, b.v FROM wi JOIN b ON b.series_id = wi.series_id AND b.t >= seg * {HOP} AND b.t < seg * {HOP} + {WEEK}),
h AS (SELECT *, 0.5 * (1 - cos(2 * pi() * tau)) AS w, avg(v) OVER q AS mv, count(*) OVER q AS c FROM j WINDOW q AS (PARTITION BY series_id, seg)),
kk AS (SELECT *, unnest(range(0, half + 1)) AS k FROM h WHERE c >= 4),
nu AS (SELECT series_id, seg, k, half, CASE WHEN sum(w * w) > 0 THEN sqrt(pow(sum((v - mv) * w * cos(2 * pi() * k * tau)), 2) + pow(sum((v - mv) * w * sin(2 * pi() * k * tau)), 2)) / sqrt(sum(w * w) / dm) ELSE 0.0 END AS mag FROM kk GROUP BY series_id, seg, k, half, dm)"""


@_query(f"WITH {_NUFFT} SELECT series_id, CAST(seg AS INTEGER) AS seg, round(seg * {HOP} + {WEEK / 2}, 6) + 0.0 AS t_s, CAST(k AS INTEGER) AS k, round(mag, 4) + 0.0 AS mag FROM nu")
def nufft_spectrogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spectral.nufft_spectrogram(_samples(spark, sf_dir), WEEK, HOP, "x")
    return _r(found.select("series_id", "seg", "t_s", "k", (F.round("mag", 4) + F.lit(0.0)).alias("mag")), "t_s")


_TARGET = 16 / WEEK


@_query(
    f"""WITH {_NUFFT}, g AS (SELECT f.series_id, f.seg, k, least(k, f.half) AS from_k FROM (SELECT DISTINCT series_id, seg, half FROM nu) f, range(0, 9) t(k))
SELECT g.series_id, CAST(g.seg AS INTEGER) AS seg, CAST(g.k AS INTEGER) AS k, round(mag, 4) + 0.0 AS mag FROM g JOIN nu ON nu.series_id = g.series_id AND nu.seg = g.seg AND nu.k = g.from_k"""
)
def nufft_target_fs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spectral.nufft_spectrogram(_samples(spark, sf_dir), WEEK, HOP, "x", target_fs=_TARGET)
    return found.select("series_id", "seg", "k", (F.round("mag", 4) + F.lit(0.0)).alias("mag"))


@_query(
    f"""WITH {SIG}, ln AS (SELECT series_id, count(*) AS n FROM sig GROUP BY series_id),
ft AS (SELECT sig.series_id, n, k, sum(value * cos(2 * pi() * ((k * idx) % n) / n)) AS re, sum(value * sin(2 * pi() * ((k * idx) % n) / n)) AS im FROM sig JOIN ln USING (series_id), range(0, 1000) r(k) WHERE k <= n // 2 AND k / n::DOUBLE BETWEEN 0.1 AND 0.3 GROUP BY ALL)
SELECT series_id, round(sum(re * re + im * im) / any_value(n), 4) + 0.0 AS power FROM ft GROUP BY series_id"""
)
def band_power(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spectral.band_power(_signal(spark, sf_dir), 1.0, 0.1, 0.3)
    return found.select("series_id", (F.round("power", 4) + F.lit(0.0)).alias("power"))


@_query(f"WITH {SPEC} SELECT series_id, round(avg(mag), 6) + 0.0 AS power FROM spec WHERE freq_hz BETWEEN 0.1 AND 0.3 GROUP BY series_id")
def band_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(stats.band_mean(_spec(spark, sf_dir), 0.1, 0.3), "power")


_STEPS = S + ", st AS (SELECT series_id, (ts_us - lag(ts_us) OVER (PARTITION BY series_id ORDER BY ts_us)) / 1e6 AS dt FROM s)"


@_query(
    f"""WITH {_STEPS}, m AS (SELECT series_id, dt, median(dt) OVER (PARTITION BY series_id) AS md FROM st WHERE dt IS NOT NULL)
SELECT series_id, round(any_value(md), 4) + 0.0 AS median_dt, round(stddev_pop(dt), 3) + 0.0 AS std_dt, max(dt) AS max_dt, round(quantile_cont(dt, 0.99), 3) + 0.0 AS p99_dt, count(*) FILTER (WHERE dt > 3 * md) AS gaps FROM m GROUP BY series_id"""
)
def jitter_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = stats.jitter(_samples(spark, sf_dir)).withColumn("median_dt", F.round("median_dt", 4) + F.lit(0.0))
    return found.withColumns({"std_dt": F.round("std_dt", 3) + F.lit(0.0), "p99_dt": F.round("p99_dt", 3) + F.lit(0.0)})


@_query(f"WITH {_STEPS}, l AS (SELECT series_id, list_sort(list(dt) FILTER (WHERE dt > 0)) AS l FROM st GROUP BY series_id) SELECT series_id, l[len(l) // 2 + 1] AS dt, round(1.0 / l[len(l) // 2 + 1], 9) + 0.0 AS fs FROM l WHERE len(l) > 0")
def sampling_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.sampling_rate(_samples(spark, sf_dir)).withColumn("fs", F.round("fs", 9) + F.lit(0.0))


@_query(f"WITH {_STEPS} SELECT series_id, round(64 * median(dt), 6) + 0.0 AS seconds FROM st WHERE dt > 0 GROUP BY series_id")
def window_seconds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(stats.window_seconds(_samples(spark, sf_dir), 64), "seconds")


@_query(f"WITH {S} SELECT series_id, ts_us, event_id FROM (SELECT *, (ts_us - min(ts_us) OVER (PARTITION BY series_id)) / 1e6 AS t FROM s) WHERE t < 86400")
def first_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.first_seconds(_samples(spark, sf_dir), 86_400.0).select("series_id", "ts_us", "event_id")


@_query(
    f"""WITH {SPEC}, c AS (SELECT series_id, mag, abs(mag - lag(mag) OVER (PARTITION BY series_id, k ORDER BY seg)) AS ch FROM spec)
SELECT series_id, round(avg(ch) / nullif(avg(mag), 0), 6) + 0.0 AS flicker FROM c GROUP BY series_id"""
)
def flicker(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(stats.flicker(_spec(spark, sf_dir)), "flicker")


@_query(
    f"""WITH {SPEC}, a AS (SELECT series_id, k, freq_hz, avg(mag) AS m FROM spec WHERE freq_hz BETWEEN 0.1 AND 0.45 GROUP BY ALL)
SELECT series_id, k, freq_hz, round(m, 6) + 0.0 AS mag FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY m DESC, k) AS n FROM a) WHERE n = 1"""
)
def mean_spectrum_peak(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(stats.mean_spectrum_peak(_spec(spark, sf_dir), 0.1, 0.45), "mag")


@_query(f"WITH {S} SELECT series_id, round(sqrt(avg(pow(x - y, 2))), 6) + 0.0 AS rmse FROM s GROUP BY series_id")
def rmse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(stats.rmse(_samples(spark, sf_dir), "x", "y"), "rmse")


@_query(f"WITH {SPEC} SELECT DISTINCT series_id, {1 / N} AS frequency_resolution, CASE WHEN max(seg) OVER (PARTITION BY series_id) > 0 THEN {STEP}.0 ELSE 0.0 END AS time_resolution FROM spec")
def resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spectral.resolution(_spec(spark, sf_dir))


@_query(f"WITH {S} SELECT series_id, count(*) AS n FROM s GROUP BY series_id")
def sample_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lengths(_samples(spark, sf_dir))


@_query(f"WITH {S} SELECT series_id, ts_us, x + y + z AS total, ts_us::DOUBLE AS t FROM s")
def array_sinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = _samples(spark, sf_dir)
    total = F.aggregate("xyz", F.lit(0.0), lambda a, v: a + v)
    return xyz_rows(samples).select("series_id", "ts_us", total.alias("total"), F.get(F.array(F.col("ts_us").cast("double")), F.lit(0)).alias("t"))


@_query("SELECT vec_id AS series_id, round(median(v), 6) + 0.0 AS median, round(min(v), 6) + 0.0 AS min, round(max(v), 6) + 0.0 AS max FROM (SELECT vec_id, unnest(embedding)::DOUBLE AS v FROM embeddings) GROUP BY vec_id")
def embedding_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("series_id"), F.explode("embedding").alias("v")).withColumn("v", F.col("v").cast("double"))
    return _r(v.groupBy("series_id").agg(stats.median(F.col("v")).alias("median"), F.min("v").alias("min"), F.max("v").alias("max")), "median", "min", "max")


@_query(ORACLE_SQL["rolling_std"])
def rolling_std_chunked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same split by 100 sample numbers, as for series too long for one task."""
    return _r(series.rolling_std(_signal(spark, sf_dir), 5, chunk=100), "rolling_std").drop("value")


@_query(ORACLE_SQL["gaussian_filter"])
def gaussian_filter_chunked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(series.gaussian_filter(_signal(spark, sf_dir), 2.0, chunk=100), "smoothed")


@_query(ORACLE_SQL["find_peaks"])
def find_peaks_chunked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return peaks.find_peaks(_signal(spark, sf_dir), 0.5, chunk=7)


@_query(ORACLE_SQL["nufft_spectrogram"])
def nufft_spectrogram_chunked(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spectral.nufft_spectrogram(_samples(spark, sf_dir), WEEK, HOP, "x", chunk_us=86_400_000_000)
    return _r(found.select("series_id", "seg", "t_s", "k", (F.round("mag", 4) + F.lit(0.0)).alias("mag")), "t_s")


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as the lines of text recordings: series of even number under a header with commas, others with blanks."""
    s = _samples(spark, sf_dir)
    even = F.col("series_id") % 2 == 0
    comma = F.concat_ws(",", F.format_string("%.6f", F.col("ts_us") / F.lit(1e6)), *(F.col(c).cast("string") for c in "xyz"), F.lit("extra"))
    blank = F.concat_ws("  ", F.format_string(" %.6f", F.col("ts_us") / F.lit(1e6)), F.col("x").cast("string"), F.concat_ws("\t", F.col("y").cast("string"), F.col("z").cast("string")))
    rows = s.select(F.col("series_id").cast("string").alias("file"), F.when(even, comma).otherwise(blank).alias("value"))
    more = F.when(even, F.lit("TIMESTAMP,ACC_X,ACC_Y,ACC_Z")).otherwise(F.lit("1.0 not numbers at"))
    return rows.unionByName(s.select("series_id").distinct().select(F.col("series_id").cast("string").alias("file"), more.alias("value")))


@_query(f"WITH {S} SELECT CAST(series_id AS VARCHAR) AS file, CAST(trunc(CAST(printf('%.6f', ts_us / 1e6) AS DOUBLE) * 1000000) AS BIGINT) AS ts_us, round(x, 6) + 0.0 AS x, round(y, 6) + 0.0 AS y, round(z, 6) + 0.0 AS z FROM s")
def scan_recordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both text layouts, told line by line."""
    return _r(recordings(_lines(spark, sf_dir)).drop("series_id"), "x", "y", "z")


@_query("SELECT 7 AS series_id, i * 20000 AS ts_us, round(sin(i / 10.0), 6) + 0.0 AS x, round(cos(i / 10.0), 6) + 0.0 AS y, i * 0.5 AS z FROM range(0, 1000) t(i)")
def in_memory_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrays in, frame out; by way of Arrow and back, as :meth:`to_arrow` gives it."""
    i = np.arange(1000)
    found = from_arrays(spark, {7: (i * 20_000, np.sin(i / 10), np.cos(i / 10), i * 0.5)})
    return _r(spark.createDataFrame(found.toArrow()), "x", "y")


@_query(f"WITH {S} SELECT series_id, event_id, ts_us, ts_us // 1000 * 1000 AS of_ms, ts_us // 1000000 * 1000000 AS of_s, round(ts_us / 1e6, 6) AS seconds, round((ts_us // 1000) / 1e3, 6) AS seconds_of_ms FROM s")
def time_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Time in each unit as microseconds and as seconds."""
    ms, s = F.floor(F.col("ts_us") / 1000).cast("long"), F.floor(F.col("ts_us") / 1_000_000).cast("long")
    return _samples(spark, sf_dir).select(
        "series_id", "event_id", microseconds(F.col("ts_us"), "us").alias("ts_us"), microseconds(ms, "ms").alias("of_ms"), microseconds(s, "s").alias("of_s"),
        F.round(seconds(F.col("ts_us"), "us"), 6).alias("seconds"), F.round(seconds(ms, "ms"), 6).alias("seconds_of_ms"),
    )


_JERK_OF_TIME = f"""WITH {S}, u AS (SELECT series_id, ts_us, any_value(x) AS x, any_value(y) AS y, any_value(z) AS z FROM s GROUP BY ALL HAVING count(*) = 1),
d AS (SELECT *, x - lag(x) OVER w AS dx, y - lag(y) OVER w AS dy, z - lag(z) OVER w AS dz, row_number() OVER w AS rn, count(*) OVER (PARTITION BY series_id) AS n FROM u WINDOW w AS (PARTITION BY series_id ORDER BY ts_us))
SELECT series_id, ts_us, round(CASE WHEN rn = 1 THEN 0.0 ELSE sqrt(dx * dx + dy * dy + dz * dz) END, 6) + 0.0 AS jerk FROM d WHERE n >= 2"""


def _apart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples whose timestamp is their series' only one: what has no order besides time."""
    n = F.count("*").over(W.partitionBy("series_id", "ts_us"))
    return _samples(spark, sf_dir).withColumn("n", n).where("n = 1").drop("n", "event_id")


@_query(_JERK_OF_TIME)
def jerk_microseconds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Timestamps that are microseconds already, through the public call for them."""
    return _r(series.jerk(_apart(spark, sf_dir), True), "jerk")


@_query(_JERK_OF_TIME)
def jerk_of_unit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from time in another unit."""
    timed = _apart(spark, sf_dir).withColumn("t", F.col("ts_us")).withColumn("ts_us", microseconds(F.col("t"), "us"))
    return _r(series.jerk(timed), "jerk")


@_query(ORACLE_SQL["resample_linear"])
def resample_linear_of_unit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Linear resampling of a column of time in a named unit."""
    timed = _samples(spark, sf_dir).withColumnRenamed("ts_us", "t")
    return _r(resample.resample_linear(timed, HOUR, order=ORDER, ts_unit="us", time="t"), "x", "y", "z")


@_query(ORACLE_SQL["resample_cubic"])
def resample_cubic_of_unit(spark: SparkSession, sf_dir: str) -> DataFrame:
    timed = _samples(spark, sf_dir).withColumnRenamed("ts_us", "t")
    return _r(resample.resample_cubic(timed, HOUR, ts_unit="us", time="t"), "x", "y", "z")


@_query(f"WITH {S} SELECT series_id, ts_us::DOUBLE AS t, round(x, 6) + 0.0 AS x, round(y, 6) + 0.0 AS y, round(z, 6) + 0.0 AS z FROM s")
def txyz_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = lambda k: F.get("txyz", F.lit(k))
    return _r(txyz_rows(_samples(spark, sf_dir)).select("series_id", at(0).alias("t"), at(1).alias("x"), at(2).alias("y"), at(3).alias("z")), "x", "y", "z")


@_query(f"WITH {DFT} SELECT series_id, seg, k, round(re, 6) + 0.0 AS re, round(im, 6) + 0.0 AS im, round(re * re + im * im, 5) + 0.0 AS power FROM ft")
def stft_complex(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The transform as complex numbers: a struct whose parts are power's."""
    both = spectral.stft(_signal(spark, sf_dir), 1.0, N, SHARED).select("series_id", "seg", "k", F.struct("re", "im").alias("complex"))
    re, im = F.col("complex.re"), F.col("complex.im")
    found = both.select("series_id", "seg", "k", re.alias("re"), im.alias("im"), (F.round(fn.power(re, im), 5) + F.lit(0.0)).alias("power"))
    return _r(found, "re", "im")


def _rejected(call: Callable[[], object]) -> bool:
    try:
        call()
    except ValueError:
        return True
    return False


@_query(
    """SELECT * FROM (VALUES ('band', true), ('empty_rate', true), ('good', false), ('missing_column', true), ('negative_limit', true), ('overlap', true), ('percentile', true), ('unequal_arrays', true), ('unit', true)) t("check", rejected)"""
)
def validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which parameters are refused before anything runs."""
    s, v = _samples(spark, sf_dir), _signal(spark, sf_dir)
    checks = {
        "band": lambda: fn.in_band(F.lit(1.0), 2.0, 1.0),
        "empty_rate": lambda: resample.resample_linear(s, 0.0),
        "good": lambda: spectral.spectrogram(v, 1.0, N, SHARED),
        "missing_column": lambda: series.jerk(s.drop("z")),
        "negative_limit": lambda: series.rate_clamp(v, -1.0, 1.0),
        "overlap": lambda: spectral.stft(v, 1.0, 8, 8),
        "percentile": lambda: stats.percentile(F.lit(1.0), 101),
        "unequal_arrays": lambda: from_arrays(spark, {1: ([1, 2], [0.0], [0.0], [0.0])}),
        "unit": lambda: microseconds(F.lit(1), "fortnight"),
    }
    return spark.createDataFrame([(name, _rejected(call)) for name, call in checks.items()], "check string, rejected boolean")


@_query(ORACLE_SQL["spectrogram"])
def motion_spectrogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The spectrogram that motion features come from, as their result gives it."""
    from ..api import compute_motion_features

    found = compute_motion_features(_signal(spark, sf_dir), 1.0, window=N, overlap=SHARED, breathing=BREATH, heart=HEART)
    return _r(found.spectrogram.df, "mag")
