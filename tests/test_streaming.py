from tallyspark.streaming import events


def test_windowed_stream(spark, tmp_path):
    src = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    src.coalesce(2).write.parquet(str(tmp_path / "in"))
    stream = events.windowed_values(events.event_stream(spark, str(tmp_path / "in")))
    events.run_once(stream, str(tmp_path / "out"), str(tmp_path / "check"))
    out = spark.read.parquet(str(tmp_path / "out"))
    batch = {(r.start, r.event_type): r.n for r in events.windowed_values(src).collect()}
    got = {(r.start, r.event_type): r.n for r in out.collect()}
    assert got and all(batch[k] == n for k, n in got.items())  # windows that the watermark has closed
    assert max(k[0] for k in got) < max(k[0] for k in batch)
    assert sum(r.n for r in events.user_sessions(src).collect()) == src.count()
