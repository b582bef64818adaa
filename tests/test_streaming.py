from carteframe.streaming import windows


def run(spark, df, name, mode="append"):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).start()
    q.processAllAvailable()
    q.stop()
    return spark.table(name)


def stream(spark, tmp_path, rows, schema):
    spark.createDataFrame(rows, schema).selectExpr("k", "id", "timestamp_seconds(t + 1200) AS ts", "value").coalesce(1).write.parquet(str(tmp_path / "in"))
    return spark.readStream.schema(spark.read.parquet(str(tmp_path / "in")).schema).parquet(str(tmp_path / "in"))


ROWS = [("a", 1, 0, 1.0), ("a", 2, 10, 2.0), ("a", 3, 20, 3.0), ("a", 4, 61, 4.0), ("b", 5, 5, 1.0), ("b", 5, 6, 1.0)]
SCHEMA = "k string, id long, t long, value double"


def test_windowed_counts(spark, tmp_path):
    got = run(spark, windows.windowed_counts(stream(spark, tmp_path, ROWS, SCHEMA), ["k"], "ts", "30 seconds"), "counts", "complete").collect()
    assert sorted((r.k, r.n, r.total) for r in got) == [("a", 1, 4.0), ("a", 3, 6.0), ("b", 2, 2.0)]


def test_rate_limit(spark, tmp_path):
    got = run(spark, windows.admitted(stream(spark, tmp_path, ROWS[:4], SCHEMA), "k", "ts", "id", 2), "admitted").orderBy("id").collect()
    assert [r.admitted for r in got] == [True, True, False, True]


def test_once(spark, tmp_path):
    assert run(spark, windows.once(stream(spark, tmp_path, ROWS, SCHEMA), "id", "ts"), "once").count() == 5
