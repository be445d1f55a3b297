import datetime as dt

from lexiloom.streaming import events as E
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def run(spark, df, name, mode):
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination(120)
    return spark.table(name)


def stream(spark):
    raw = spark.read.parquet(f"{SF}/events.parquet")
    rows = spark.readStream.schema(raw.schema).parquet(f"{SF}/events*.parquet")
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def test_minute_counts_equal_the_batch_twin(spark):
    got = run(spark, E.minute_counts_stream(stream(spark)), "minutes", "complete")
    want = E.q_minutes(spark, SF).withColumn("minute", F.col("minute").cast("timestamp"))
    key = lambda df: sorted(tuple(r) for r in df.select("user_id", "minute", "requests").collect())
    assert key(got) == key(want)


def test_acceptance_keeps_one_of_each_key(spark):
    keyed = stream(spark).withColumn("idempotency_key", F.col("user_id").cast("string"))
    got = run(spark, E.accept_once_stream(keyed, "60 days"), "accepted", "append")
    assert got.count() == got.select("idempotency_key").distinct().count() == spark.read.parquet(f"{SF}/events.parquet").select("user_id").distinct().count()


def test_throttling_equals_the_batch_twin(spark):
    got = run(spark, E.throttled_stream(stream(spark), 3600), "throttled", "append")
    want = {(r.user_id, str(r.since)) for r in E.throttled(spark.read.parquet(f"{SF}/events.parquet"), 3600).collect()}
    assert {(r.user_id, str(r.since)) for r in got.collect()} >= want


def test_snapshot_sink_keeps_the_newest(spark, tmp_path):
    make = lambda rows: spark.createDataFrame(rows, "item long, content_hash string, version long")
    for path in (None, f"file://{tmp_path}/snapshot"):
        sink = E.SnapshotSink(path)
        assert sink.state(spark) is None
        sink(make([(1, "a", 1), (2, "b", 1)]), 0)
        sink(make([(1, "c", 2), (3, "d", 2)]), 1)
        want = [(1, "c", 2), (2, "b", 1), (3, "d", 2)]
        assert sorted(tuple(r) for r in sink.state(spark).collect()) == want
        # A restart knows the snapshot; a batch delivered again changes nothing; the next one goes on.
        again = E.SnapshotSink(sink.path)
        again(make([(1, "z", 9)]), 1)
        assert sorted(tuple(r) for r in again.state(spark).collect()) == want
        again(make([(2, "e", 3)]), 2)
        assert (2, "e", 3) in {tuple(r) for r in again.state(spark).collect()} and again._epochs(spark) == [1, 2]


def test_sessions_close_on_gaps(spark):
    t = dt.datetime(2026, 1, 1)
    rows = [(1, t, 1.0), (1, t + dt.timedelta(minutes=90), 1.0), (1, t + dt.timedelta(hours=5), 2.0)]
    df = spark.createDataFrame(rows, "user_id long, ts timestamp, value double")
    assert sorted(r.events for r in E.sessions(df).collect()) == [1, 2]
