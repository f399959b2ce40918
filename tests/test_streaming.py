from conftest import DATA

from lattis.streaming import read_events, windowed_counts


def test_a_stream_gives_what_a_batch_gives(spark, tmp_path):
    events = spark.read.parquet(f"{DATA}/sf0.001/events.parquet").orderBy("ts")
    rows = events.collect()
    for k in range(3):
        spark.createDataFrame(rows[k::3], events.schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    query = windowed_counts(read_events(spark, str(tmp_path / "in")), late="3650 days").writeStream.outputMode("complete").format("memory").queryName("win").option("checkpointLocation", str(tmp_path / "ck")).start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    got = {tuple(r) for r in spark.table("win").collect()}
    assert got == {tuple(r) for r in windowed_counts(events).collect()} and got
