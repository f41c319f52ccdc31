"""Streams give what the same batch query gives."""

from pyspark.sql import functions as F

from loomwell.streaming import events

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
SF = "/root/testdata/sf0.001"


def source(spark, tmp_path):
    d = tmp_path / "in"
    d.mkdir()
    df = spark.read.parquet(f"{SF}/events.parquet")
    df.orderBy("ts").coalesce(1).write.mode("overwrite").parquet(str(d / "a"))
    return df, spark.readStream.schema(df.schema).parquet(str(d / "a"))


def test_tumbling_stream_equals_batch(spark, tmp_path):
    batch, stream = source(spark, tmp_path)
    out = str(tmp_path / "out")
    events.drained(events.tumbling(stream, "ts", "1 hour", ["event_type"], "value"), out, str(tmp_path / "cp"))
    got = {(r[0], r[1]): (r[2], round(r[3], 6)) for r in spark.read.parquet(out).collect()}
    want = {(r[0], r[1]): (r[2], round(r[3], 6)) for r in events.tumbling(batch, "ts", "1 hour", ["event_type"], "value").collect()}
    assert got and all(want[k] == v for k, v in got.items())
    closed = batch.agg(F.max("ts")).first()[0]
    assert len(got) >= sum(k[0].timestamp() + 3600 + 600 < closed.timestamp() for k in want)


def test_rerun_adds_nothing(spark, tmp_path):
    _, stream = source(spark, tmp_path)
    out, cp = str(tmp_path / "out"), str(tmp_path / "cp")
    events.drained(events.unique_events(stream, "event_id", "ts"), out, cp)
    n = spark.read.parquet(out).count()
    events.drained(events.unique_events(stream, "event_id", "ts"), out, cp)
    assert spark.read.parquet(out).count() == n == spark.read.parquet(out).select("event_id").distinct().count()


def test_ledger(spark, tmp_path):
    batch, stream = source(spark, tmp_path)
    events.ledger(stream, str(tmp_path / "l"), str(tmp_path / "cp"), "user_id")
    assert spark.read.parquet(str(tmp_path / "l")).agg(F.sum("n_rows")).first()[0] == batch.count()


def test_state(spark, tmp_path):
    batch, stream = source(spark, tmp_path)
    q = events.running_totals(stream, "event_type", "value").writeStream.outputMode("update").format("memory").queryName("totals").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {r[0]: r[1] for r in spark.table("totals").collect()}
    assert got == {r[0]: r[1] for r in batch.groupBy("event_type").count().collect()}


def test_sessions(spark):
    df = spark.createDataFrame([("u", "2024-01-01 00:00:00"), ("u", "2024-01-01 00:10:00"), ("u", "2024-01-01 01:00:00")], "k string, t string").withColumn("t", F.to_timestamp("t"))
    assert sorted(r["n"] for r in events.sessions(df, "t", "30 minutes", "k").collect()) == [1, 2]
