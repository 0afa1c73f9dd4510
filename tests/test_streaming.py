from sparkburst.streaming.scoring import alarms_per_window, score_stream


def test_scores_of_a_stream(spark, tmp_path):
    rows = [(i, [float(i), 0.0]) for i in range(6)]
    spark.createDataFrame(rows, "sample_idx long, x array<double>").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("sample_idx long, x array<double>").parquet(str(tmp_path / "in"))
    query = score_stream(stream, [0.0, 0.0], [1.0, 0.0], 9.0).writeStream.format("memory").queryName("scored").start()
    query.processAllAvailable()
    query.stop()
    got = {r["sample_idx"]: (r["score"], r["detected"]) for r in spark.table("scored").collect()}
    assert got[2] == (4.0, False) and got[3] == (9.0, True) and len(got) == 6


def test_alarms_per_window(spark):
    rows = spark.sql("SELECT timestamp'2024-01-01 00:00:10' AS ts, true AS detected UNION ALL SELECT timestamp'2024-01-01 00:07:00', false")
    assert [(r["n_detected"], r["n_rows"]) for r in alarms_per_window(rows).orderBy("window").collect()] == [(1, 1), (0, 1)]
