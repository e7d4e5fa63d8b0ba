from pyspark.sql import functions as F

from cadenza.streaming.popularity import windowed_popularity


def test_stream_agrees_with_batch(spark, small, tmp_path):
    events = spark.read.parquet(f"{small}/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "events"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "events"))
    query = windowed_popularity(stream).writeStream.outputMode("complete").format("memory").queryName("popularity").start()
    query.processAllAvailable()
    query.stop()

    def rows(df):
        return sorted(map(tuple, df.select(F.col("start").cast("string"), "event_type", "events").collect()))

    got = rows(spark.table("popularity"))
    assert got == rows(windowed_popularity(events))
    assert sum(r[2] for r in got) == events.where(F.col("ts").isNotNull()).count()
