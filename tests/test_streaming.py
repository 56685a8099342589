from datetime import datetime, timedelta

from scenelake.streaming import votes


def test_running_votes_equal_batch(spark, tmp_path):
    schema = "frame_index int, instance_id int, gaussian_index long, weight double"
    rows = [(i % 3, i % 2, i % 7, 0.5) for i in range(200)]
    src = spark.createDataFrame(rows, schema)
    src.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = votes.running_votes(stream).writeStream.format("memory").queryName("running").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination()
    assert sorted(map(tuple, spark.table("running").collect())) == sorted(map(tuple, votes.running_votes(src).collect()))


def test_windows_close_behind_the_watermark(spark, tmp_path):
    t0 = datetime(2024, 1, 1)
    spark.createDataFrame([(t0 + timedelta(minutes=m), "a") for m in (1, 2, 61, 600)], "ts timestamp, kind string").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, kind string").parquet(str(tmp_path / "in"))
    q = votes.windowed_counts(stream, "ts", "kind").writeStream.format("memory").queryName("closed").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination()
    assert sorted(r["n"] for r in spark.table("closed").collect()) == [1, 2]
