from oscilla import streaming
from oscilla.operators import series
from oscilla.schema import SAMPLES


def test_stream_jerk_is_batch_jerk(spark, tmp_path):
    rows = [(k, i * 1000 + k, float(i * i % 7), float(i % 3), 0.0) for k in (1, 2) for i in range(40)]
    batches = [[r for r in rows if r[1] < 20_000], [r for r in rows if r[1] >= 20_000]]
    whole = spark.createDataFrame(rows, SAMPLES)
    folder = str(tmp_path / "in")
    out = []
    for k, batch in enumerate(batches):
        spark.createDataFrame(batch, SAMPLES).coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(SAMPLES).parquet(folder)
        query = (
            streaming.stream_jerk(stream)
            .writeStream.foreachBatch(lambda df, _: out.extend(df.collect()))
            .option("checkpointLocation", str(tmp_path / "state"))
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination(120)
        assert k is not None and not query.isActive
    got = sorted((r["series_id"], r["ts_us"], round(r["jerk"], 9)) for r in out)
    want = sorted((r["series_id"], r["ts_us"], round(r["jerk"], 9)) for r in series.jerk(whole).collect())
    assert got == want


def test_window_summary(spark):
    rows = [(1, i * 1_000_000, 3.0, 4.0, 0.0) for i in range(60)]
    got = streaming.window_summary(spark.createDataFrame(rows, SAMPLES), "30 seconds").orderBy("start").collect()
    assert [(r["n"], r["mean"], r["std"]) for r in got] == [(30, 5.0, 0.0)] * 2


def test_late_samples_may_be_kept(spark, tmp_path):
    folder, out = str(tmp_path / "in"), []
    for batch in ([(1, 10, 0.0, 0.0, 0.0), (1, 20, 3.0, 4.0, 0.0)], [(1, 15, 9.0, 9.0, 9.0), (1, 20, 9.0, 9.0, 9.0), (1, 30, 3.0, 4.0, 1.0)]):
        spark.createDataFrame(batch, SAMPLES).coalesce(1).write.mode("append").parquet(folder)
        query = (
            streaming.stream_jerk(spark.readStream.schema(SAMPLES).parquet(folder), keep_late=True)
            .writeStream.foreachBatch(lambda df, _: out.extend(df.collect()))
            .option("checkpointLocation", str(tmp_path / "state"))
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination(120)
    assert sorted((r["ts_us"], r["jerk"]) for r in out if r["jerk"] is not None) == [(10, 0.0), (20, 5.0), (30, 1.0)]
    assert sorted(r["ts_us"] for r in out if r["jerk"] is None) == [15, 20]
