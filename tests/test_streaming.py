from pyspark.sql import functions as F

from tidewatch.streaming import feeds

SF = "/root/testdata/sf0.001"


def test_items_are_seen_once_across_restarts(spark, tmp_path):
    rows = [(1, "http://www.h/a?utm_source=x"), (2, "http://h/a"), (3, "http://h/b")]
    frame = spark.createDataFrame(rows, "id long, url string")
    seen = []
    take = lambda df, n: seen.extend(r["canonical_url"] for r in df.collect())
    for part in (frame.filter("id < 3"), frame.filter("id > 1")):
        part.write.mode("append").parquet(str(tmp_path / "in"))
        feeds.run_available(feeds.new_items(feeds.file_stream(spark, str(tmp_path / "in"), frame.schema)), str(tmp_path / "ck"), take)
    assert sorted(seen) == ["http://h/a", "http://h/b"]


def test_window_counts_equal_batch(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    out = {}
    keep = lambda df, n: out.update({(r["window_start"], r["event_type"]): r["n"] for r in df.collect()})
    stream = feeds.window_counts(feeds.file_stream(spark, str(tmp_path / "in"), events.schema, 1), "ts", "event_type", late="60 days")
    feeds.run_available(stream, str(tmp_path / "ck"), keep, mode="update")
    assert out == {(r["window_start"], r["event_type"]): r["n"] for r in feeds.window_counts(events, "ts", "event_type").collect()}
