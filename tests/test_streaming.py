from veilgraph.streaming.degrees import interaction_degrees

PATH = "/root/testdata/sf0.001/events.parquet"


def test_stream_gives_what_the_table_gives(spark, tmp_path):
    table = spark.read.parquet(PATH)
    want = {tuple(r) for r in interaction_degrees(table).select("window.start", "user_id", "event_type", "events").collect()}
    (tmp_path / "in").mkdir()
    (tmp_path / "in/e.parquet").symlink_to(PATH)
    stream = interaction_degrees(spark.readStream.schema(table.schema).parquet(f"{tmp_path}/in"))
    run = stream.writeStream.format("memory").queryName("degrees").outputMode("complete").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    run.awaitTermination(120)
    assert {tuple(r) for r in spark.sql("SELECT window.start, user_id, event_type, events FROM degrees").collect()} == want != set()
