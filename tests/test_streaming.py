"""The stream forms on the events table."""

from finlattice.streaming import events as E


def test_windows_as_stream_and_batch(spark, sf):
    schema = spark.read.parquet(f"{sf}/events.parquet").withColumnRenamed("ts", "ts").schema
    batch = {tuple(r)[:3] for r in E.flow_windows(spark.read.parquet(f"{sf}/events.parquet")).collect()}
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    stream = stream.withColumn("ts", stream["ts"].cast("timestamp"))
    q = E.flow_windows(stream).writeStream.outputMode("complete").format("memory").queryName("windows").start()
    q.processAllAvailable()
    q.stop()
    assert {tuple(r)[:3] for r in spark.table("windows").collect()} == batch


def test_append_new_is_idempotent(spark, tmp_path):
    write = E.append_new(str(tmp_path / "t"), ["k"])
    batch = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    write(batch, 0)
    write(batch, 0)
    write(spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string"), 1)
    assert sorted(r.k for r in spark.read.parquet(str(tmp_path / "t")).collect()) == [1, 2, 3]


def test_append_new_by_days(spark, tmp_path):
    path = str(tmp_path / "days")
    write = E.append_new(path, ["k", "day"], "day")
    batch = spark.createDataFrame([(1, "2024-01-01"), (2, "2024-01-02")], "k int, day string")
    write(batch, 0)
    write(batch, 0)
    write(spark.createDataFrame([(1, "2024-01-02"), (2, "2024-01-02")], "k int, day string"), 1)
    assert sorted((r.k, str(r.day)) for r in spark.read.parquet(path).collect()) == [(1, "2024-01-01"), (1, "2024-01-02"), (2, "2024-01-02")]
