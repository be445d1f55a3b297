"""Leases that end when heartbeats stay away, by event-time timers of a stateful processor."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: The state store that timers need.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def joined(runs: list[tuple[int, int, int]], gap: int) -> list[tuple[int, int, int]]:
    """Runs of heartbeats (first, last, number), joined where less than ``gap`` lies between two."""
    out: list[tuple[int, int, int]] = []
    for first, last, n in sorted(runs):
        if out and first < out[-1][1] + gap:
            out[-1] = (out[-1][0], max(out[-1][1], last), out[-1][2] + n)
        else:
            out.append((first, last, n))
    return out


class Leases(StatefulProcessor):
    """State of an owner: the runs of heartbeats that may still grow, and a timer at the end of the first.

    A heartbeat that comes late, but within the watermark, may join two runs; so a run leaves the state,
    and the lease is reported as expired, only when the watermark has passed its end. An owner without
    runs has no state and no timer.
    """

    def __init__(self, gap_ms: int):
        self.gap = gap_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.runs = handle.getListState("runs", "first long, last long, n long")

    def _kept(self) -> list[tuple[int, int, int]]:
        return [tuple(r) for r in self.runs.get()] if self.runs.exists() else []

    def _keep(self, runs: list[tuple[int, int, int]]) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if runs:
            self.runs.put(runs)
            self.handle.registerTimer(min(last for _, last, _ in runs) + self.gap)
        else:
            self.runs.clear()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        runs = self._kept()
        for batch in rows:
            at = (batch["ts"] - pd.Timestamp(0, tz=batch["ts"].dt.tz)) // pd.Timedelta(milliseconds=1)
            runs = joined([*runs, *((t, t, 1) for t in at.tolist())], self.gap)
        self._keep(runs)
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        runs = self._kept()
        over = [r for r in runs if r[1] + self.gap <= now]
        self._keep([r for r in runs if r not in over])
        stamp = lambda k, more=0: pd.to_datetime([r[k] + more for r in over], unit="ms")
        yield pd.DataFrame({"user_id": [key[0]] * len(over), "start": stamp(0), "end": stamp(1, self.gap), "heartbeats": [r[2] for r in over]})

    def close(self) -> None:
        pass


def expired_leases_stream(heartbeats: DataFrame, gap_seconds: int = 130, late: str = "1 minute") -> DataFrame:
    """user_id, start, end, heartbeats of every lease that ended ``gap_seconds`` after its last heartbeat.

    Its batch twin is ``sessions`` with the same gap. Heartbeats are (user_id, ts), exact to a millisecond; those
    without an owner or a time are left out, and those behind the watermark come too late. The session
    must use the RocksDB state store (``STATE_STORE``).
    """
    rows = heartbeats.select("user_id", "ts").where("user_id IS NOT NULL AND ts IS NOT NULL").withWatermark("ts", late)
    return rows.groupBy("user_id").transformWithStateInPandas(
        Leases(gap_seconds * 1000), "user_id long, start timestamp, end timestamp, heartbeats long", "append", "EventTime"
    )


def expired_leases(heartbeats: DataFrame, gap_seconds: int = 130) -> DataFrame:
    """Batch twin of :func:`expired_leases_stream`: all leases, as if time had gone on for ever."""
    rows = heartbeats.where("user_id IS NOT NULL AND ts IS NOT NULL")
    grouped = rows.groupBy("user_id", F.session_window("ts", f"{gap_seconds} seconds").alias("s")).agg(F.count(F.lit(1)).alias("heartbeats"))
    return grouped.select("user_id", F.col("s.start").alias("start"), F.col("s.end").alias("end"), "heartbeats")


def q_leases(spark, sf):
    from lexiloom.session import table

    return expired_leases(table(spark, sf, "events"), 5400)


QUERIES = {
    "expired_leases": (
        q_leases,
        """WITH f AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 5400 SECOND OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS c FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
        s AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM f)
        SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 5400 SECOND AS end, count(*) AS heartbeats FROM s GROUP BY user_id, n""",
    ),
}
