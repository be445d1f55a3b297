"""Structured Streaming forms of admission, acceptance, leases and throttling, with batch twins.

Each stream function takes a streaming DataFrame with ``ts`` as timestamp; its batch twin gives the
same rows once all data is processed and windows are closed.
"""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.session import scratch_dir, table


def minute_counts_stream(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Requests per user and tumbling minute."""
    window = F.window("ts", "1 minute")
    return events.withWatermark("ts", late).groupBy(window.alias("w"), "user_id").agg(F.count(F.lit(1)).alias("requests")).select("user_id", F.col("w.start").alias("minute"), "requests")


def accept_once_stream(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """The first event of each idempotency key within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["idempotency_key"])


def sessions(events: DataFrame, gap: str = "2 hours", late: str | None = None) -> DataFrame:
    """Sessions of each user: a gap ends one, as a missing heartbeat ends a lease. Batch, or stream with ``late``."""
    rows = events.withWatermark("ts", late) if late else events
    grouped = rows.groupBy(F.session_window("ts", gap).alias("s"), "user_id").agg(F.count(F.lit(1)).alias("events"), F.round(F.sum("value"), 4).alias("value"))
    return grouped.select("user_id", F.col("s.start").alias("start"), F.col("s.end").alias("end"), "events", "value")


def throttled_stream(events: DataFrame, limit_seconds: int = 900) -> DataFrame:
    """Users whose throttling (event_type ``error``) has lasted ``limit_seconds`` without a success between.

    State is the first throttled moment of a user, cleared by any other event.
    """

    def step(key, batches, state):
        since = state.get[0] if state.exists else None
        rows = []
        for event in pd.concat(list(batches)).sort_values("ts").itertuples():
            if event.event_type != "error":
                since = None
            elif since is None:
                since = event.ts
            elif (event.ts - since).total_seconds() >= limit_seconds:
                rows.append((key[0], since, event.ts))
                since = None
        if since is None:
            if state.exists:
                state.remove()
        else:
            state.update((since,))
        yield pd.DataFrame(rows, columns=["user_id", "since", "failed_at"])

    return events.groupBy("user_id").applyInPandasWithState(step, "user_id long, since timestamp, failed_at timestamp", "since timestamp", "append", "NoTimeout")


def throttled(events: DataFrame, limit_seconds: int = 900) -> DataFrame:
    """Batch twin: runs of errors, and their first failure after the limit."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    error = F.col("event_type") == "error"
    run = F.sum((~error).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    rows = events.withColumn("run", run).where(error)
    first = F.min("ts").over(Window.partitionBy("user_id", "run"))
    late = rows.withColumn("since", first).where(F.timestamp_diff("SECOND", F.col("since"), F.col("ts")) >= limit_seconds)
    return late.groupBy("user_id", "since").agg(F.min("ts").alias("failed_at"))


def merge_batch(state: DataFrame | None, batch: DataFrame) -> DataFrame:
    """Newest value of each item of the previous snapshot and a micro-batch; for ``foreachBatch``."""
    rows = batch if state is None else state.unionByName(batch)
    return rows.groupBy("item").agg(F.max_by(F.struct("content_hash", "version"), "version").alias("m")).select("item", "m.content_hash", "m.version")


class SnapshotSink:
    """``foreachBatch`` target that keeps the merged snapshot as tables ``epoch=N`` below a shared path.

    The newest finished table is the snapshot, so a restarted query goes on from it, and a batch that
    is delivered again changes nothing. The table before it stays for readers, older ones go. Without
    a path the snapshot lives in the scratch folder, for one run.
    """

    def __init__(self, path: str | None = None):
        self.path = path

    def _epochs(self, spark) -> list[int]:
        """The epochs of finished tables, in order."""
        folder = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
        names = [x.getPath().getName() for x in files.listStatus(folder)] if files.exists(folder) else []
        done = [n for n in names if n.startswith("epoch=") and files.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{n}/_SUCCESS"))]
        return sorted(int(n.partition("=")[2]) for n in done)

    def state(self, spark) -> DataFrame | None:
        """The snapshot as of the newest finished epoch."""
        epochs = self._epochs(spark) if self.path else []
        return spark.read.parquet(f"{self.path}/epoch={epochs[-1]}") if epochs else None

    def __call__(self, batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        self.path = self.path or f"{scratch_dir(spark)}/lexiloom-snapshot-{uuid.uuid4().hex}"
        epochs = self._epochs(spark)
        if epochs and epochs[-1] >= epoch:
            return
        merge_batch(self.state(spark), batch).write.mode("overwrite").parquet(f"{self.path}/epoch={epoch}")
        for old in epochs[:-1]:
            gone = spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/epoch={old}")
            gone.getFileSystem(spark._jsc.hadoopConfiguration()).delete(gone, True)


def q_sessions(spark, sf):
    return sessions(table(spark, sf, "events"))


def q_throttled(spark, sf):
    return throttled(table(spark, sf, "events"), limit_seconds=3600)


def q_minutes(spark, sf):
    return table(spark, sf, "events").groupBy("user_id", F.window("ts", "1 minute")["start"].alias("minute")).agg(F.count(F.lit(1)).alias("requests"))


def q_accept(spark, sf):
    """The first event of each user and day."""
    key = F.concat_ws("-", F.col("user_id").cast("string"), F.date_format("ts", "yyyyMMdd"))
    return table(spark, sf, "events").groupBy(key.alias("idempotency_key")).agg(F.min(F.struct("ts", "event_id"))["event_id"].alias("event_id"))


def q_merge(spark, sf):
    """Two orders of each customer in turn: the newest state of each."""
    orders = table(spark, sf, "orders").select(F.col("o_custkey").alias("item"), F.col("o_orderstatus").alias("content_hash"), F.col("o_orderkey").alias("version"))
    return merge_batch(orders.where("version % 2 = 0"), orders.where("version % 2 = 1"))


QUERIES = {
    "sessionize_events": (
        q_sessions,
        """WITH f AS (SELECT *, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 2 HOUR OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS c FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
        s AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM f)
        SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 2 HOUR AS end, count(*) AS events, round(sum(value), 4) AS value FROM s GROUP BY user_id, n""",
    ),
    "throttled_users": (
        q_throttled,
        """WITH r AS (SELECT *, sum(CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM events),
        f AS (SELECT *, min(ts) OVER (PARTITION BY user_id, run) AS since FROM r WHERE event_type = 'error') SELECT user_id, since, min(ts) AS failed_at FROM f WHERE ts >= since + INTERVAL 1 HOUR GROUP BY 1, 2""",
    ),
    "tumbling_minute_counts": (q_minutes, "SELECT user_id, date_trunc('minute', ts) AS minute, count(*) AS requests FROM events GROUP BY 1, 2"),
    "accept_once": (q_accept, "SELECT user_id || '-' || strftime(ts, '%Y%m%d') AS idempotency_key, arg_min(event_id, (ts, event_id)) AS event_id FROM events GROUP BY 1"),
    "merged_snapshot": (q_merge, "SELECT o_custkey AS item, arg_max(o_orderstatus, o_orderkey) AS content_hash, max(o_orderkey) AS version FROM orders GROUP BY 1"),
}
