from kgweave.streaming import episodes

STEPS = [("a", "2024-01-01 00:00:00", 1.0), ("a", "2024-01-01 00:30:00", 2.0), ("a", "2024-01-01 05:00:00", 4.0), ("b", "2024-01-01 00:10:00", 8.0), ("z", "2024-01-03 00:00:00", 0.0)]


def test_stream_gives_what_the_batch_gives(spark, tmp_path):
    rows = spark.createDataFrame(STEPS, "env string, ts string, reward double").selectExpr("env", "cast(ts as timestamp) ts", "reward")
    rows.where("env <> 'z'").coalesce(1).write.parquet(f"file://{tmp_path}/in")
    want = {(r.env, r.reward, r.length) for r in episodes.ended(rows).collect() if r.env != "z"}
    assert want == {("a", 3.0, 2), ("a", 4.0, 1), ("b", 8.0, 1)}
    stream = spark.readStream.schema(rows.schema).parquet(f"file://{tmp_path}/in")
    q = episodes.ended(stream).writeStream.format("memory").queryName("ended").outputMode("append").option("checkpointLocation", f"file://{tmp_path}/c").start()
    try:
        q.processAllAvailable()
        # A later step moves the watermark past the episodes.
        rows.where("env = 'z'").coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
        q.processAllAvailable()
        q.processAllAvailable()
        got = {(r.env, r.reward, r.length) for r in spark.sql("select * from ended").collect()}
    finally:
        q.stop()
    assert got == want
