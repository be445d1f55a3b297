"""Usage, budget and operations reporting over ``events`` (user is client, event_type is status, value is cost)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.session import table

STATES = ("click", "view", "purchase", "signup", "error", "logout")


def per_minute(events: DataFrame, *keys: str, limit: int = 3) -> DataFrame:
    """Requests of each key in fixed minutes, and whether they exceed the limit."""
    counted = events.groupBy(*keys, F.date_trunc("minute", "ts").alias("minute")).agg(F.count(F.lit(1)).alias("requests"))
    return counted.withColumn("limited", F.col("requests") > limit)


def buckets(events: DataFrame, unit: str) -> DataFrame:
    """Reserved, settled and accepted spend of each day or month."""
    return events.groupBy(F.date_trunc(unit, "ts").alias("bucket")).agg(
        F.round(F.sum("value"), 4).alias("reserved"), F.round(F.coalesce(F.sum(F.when(F.col("event_type") == "purchase", F.col("value"))), F.lit(0.0)), 4).alias("settled"), F.count(F.lit(1)).alias("accepted")
    )


def reserved_sum(entries: DataFrame, released: DataFrame) -> DataFrame:
    """Reserved value of each owner without released entries; owners with none have zero."""
    open_entries = entries.join(released, "entry_id", "left_anti").groupBy(F.col("owner").alias("o")).agg(F.sum("value").alias("v"))
    owners = entries.select("owner").distinct()
    return owners.join(open_entries, F.col("owner") == F.col("o"), "left").select("owner", F.round(F.coalesce("v", F.lit(0.0)), 4).alias("reserved"))


def idempotent_first(events: DataFrame) -> DataFrame:
    """The first event of each key, how many repeat it, and whether one carries another payload."""
    first = F.min(F.struct("ts", "event_id", "payload_hash")).alias("f")
    return events.groupBy("key").agg(first, F.count(F.lit(1)).alias("attempts"), F.countDistinct("payload_hash").alias("payloads")).select(
        "key", F.col("f.event_id").alias("event_id"), "attempts", (F.col("payloads") > 1).alias("conflict")
    )


def worst_case(tokens_in, tokens_out, price_in, price_out):
    """Decimal price per million tokens, rounded up to six places."""
    d = lambda c: c.cast("decimal(18,6)")
    return F.ceil((tokens_in.cast("decimal(12,0)") * d(price_in) + tokens_out.cast("decimal(12,0)") * d(price_out)) / F.lit(1_000_000).cast("decimal(10,0)"), 6)


def status_counts(events: DataFrame, states=STATES) -> DataFrame:
    """One row for each fixed state, zero where none occurs."""
    session = events.sparkSession
    known = session.createDataFrame([(s,) for s in states], "state string")
    counted = events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    return known.join(counted, F.col("state") == F.col("event_type"), "left").select("state", F.coalesce("n", F.lit(0)).alias("n"))


def prometheus(counts: DataFrame, name: str = "lexiloom_events") -> DataFrame:
    """Metrics in text format, one line a state."""
    return counts.select(F.concat(F.lit(name + '{state="'), "state", F.lit('"} '), F.col("n").cast("string")).alias("line"))


def q_per_minute(spark, sf):
    return per_minute(table(spark, sf, "events"), "user_id", limit=1).where("limited").drop("limited")


def q_hourly_limit(spark, sf):
    """Users over a share of the whole window's requests: a limiter shared by two processes."""
    hour = table(spark, sf, "events").groupBy("event_type", F.date_trunc("hour", "ts").alias("hour")).agg(F.count(F.lit(1)).alias("n"))
    return hour.withColumn("over", F.col("n") * 2 > 10)


def q_queue(spark, sf):
    """Queue depth caps for a user, an event type and all, by conditional counts of open events."""
    open_events = table(spark, sf, "events").where("event_type <> 'purchase'").groupBy("event_type", "user_id").agg(F.count(F.lit(1)).alias("n"))
    per_type = open_events.groupBy(F.col("event_type").alias("t")).agg(F.sum("n").alias("type_n"))
    rows = open_events.join(per_type, F.col("event_type") == F.col("t")).join(F.broadcast(open_events.agg(F.sum("n").alias("all_n"))))  # one row
    reason = F.when(F.col("n") > 15, "user").when(F.col("type_n") > 1000, "type").when(F.col("all_n") > 6000, "all")
    return rows.select("event_type", "user_id", "n", (F.col("n") > 15).alias("user_over"), (F.col("type_n") > 1000).alias("type_over"), (F.col("all_n") > 6000).alias("all_over"), reason.alias("refused_by"))


def q_day(spark, sf):
    return buckets(table(spark, sf, "events"), "day")


def q_month(spark, sf):
    return buckets(table(spark, sf, "events"), "month")


def q_reserved(spark, sf):
    events = table(spark, sf, "events")
    entries = events.select(F.col("event_id").alias("entry_id"), F.col("user_id").alias("owner"), "value")
    return reserved_sum(entries, events.where("event_type IN ('purchase', 'error')").select(F.col("event_id").alias("entry_id")))


def q_idempotent(spark, sf):
    events = table(spark, sf, "events").select(F.concat_ws("-", F.col("user_id").cast("string"), F.date_format("ts", "yyyyMMddHH")).alias("key"), "ts", "event_id", F.col("event_type").alias("payload_hash"))
    return idempotent_first(events)


def q_worst_case(spark, sf):
    docs = table(spark, sf, "documents")
    return docs.select("doc_id", worst_case(F.col("n_chars"), F.col("n_chars") * 2, F.lit("0.15"), F.lit("0.60")).cast("decimal(18,6)").cast("string").alias("price"))


def q_status(spark, sf):
    return status_counts(table(spark, sf, "events"))


def q_prometheus(spark, sf):
    return prometheus(status_counts(table(spark, sf, "events")))


def q_operations(spark, sf):
    """Oldest age, stale and unknown counts and spend of the last day, against the newest event."""
    events = table(spark, sf, "events")
    now = events.agg(F.max("ts").alias("now"))
    rows = events.join(F.broadcast(now), F.col("ts") <= F.col("now"))
    age = F.timestamp_diff("SECOND", F.col("ts"), F.col("now"))
    return rows.groupBy("event_type").agg(
        F.max(age).alias("oldest_seconds"), F.count_if(age > 130).alias("stale"), F.count_if(F.get_json_object("props", "$.k").isNull()).alias("unknown"),
        F.round(F.coalesce(F.sum(F.when(age < 86_400, F.col("value"))), F.lit(0.0)), 4).alias("spend_last_day"),
    )


def q_backlog(spark, sf):
    """Work waiting in two tables under one list, with its oldest date."""
    orders = table(spark, sf, "orders").where("o_orderstatus = 'O'").agg(F.lit("orders").alias("queue"), F.count(F.lit(1)).alias("waiting"), F.date_format(F.min("o_orderdate"), "yyyy-MM-dd").alias("oldest"))
    lines = table(spark, sf, "lineitem").where("l_linestatus = 'O'").agg(F.lit("lineitem").alias("queue"), F.count(F.lit(1)).alias("waiting"), F.date_format(F.min("l_shipdate"), "yyyy-MM-dd").alias("oldest"))
    return orders.unionByName(lines)


def q_retention(spark, sf):
    """Inventory by two keys."""
    return table(spark, sf, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("rows"), F.date_format(F.min("l_shipdate"), "yyyy-MM-dd").alias("oldest"), F.date_format(F.max("l_shipdate"), "yyyy-MM-dd").alias("newest"))


def q_orphans(spark, sf):
    """Rows whose parent is missing, for three relations."""
    check = lambda child, key, parent, pkey, name: child.join(parent, F.col(key) == F.col(pkey), "left_anti").agg(F.lit(name).alias("relation"), F.count(F.lit(1)).alias("orphans"))
    t = lambda n: table(spark, sf, n)
    return (
        check(t("lineitem").select("l_orderkey"), "l_orderkey", t("orders").select("o_orderkey"), "o_orderkey", "lineitem_orders")
        .unionByName(check(t("orders").select("o_custkey"), "o_custkey", t("customer").select("c_custkey"), "c_custkey", "orders_customer"))
        .unionByName(check(t("labels").select("doc_id"), "doc_id", t("documents").select(F.col("doc_id").alias("d")), "d", "labels_documents"))
    )


def q_access(spark, sf):
    """Two aggregates joined to every customer segment: orders and lines of its customers."""
    t = lambda n: table(spark, sf, n)
    owners = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_mktsegment")
    orders = owners.groupBy(F.col("c_mktsegment").alias("o_seg")).agg(F.count(F.lit(1)).alias("orders"))
    lines = t("lineitem").join(owners, F.col("l_orderkey") == F.col("o_orderkey")).groupBy(F.col("c_mktsegment").alias("l_seg")).agg(F.count(F.lit(1)).alias("lines"))
    segments = t("customer").select("c_mktsegment").distinct()
    return segments.join(orders, F.col("c_mktsegment") == F.col("o_seg"), "left").join(lines, F.col("c_mktsegment") == F.col("l_seg"), "left").select("c_mktsegment", F.coalesce("orders", F.lit(0)).alias("orders"), F.coalesce("lines", F.lit(0)).alias("lines"))


_BUCKET = "SELECT date_trunc('{0}', ts) AS bucket, round(sum(value), 4) AS reserved, round(coalesce(sum(value) FILTER (event_type = 'purchase'), 0), 4) AS settled, count(*) AS accepted FROM events GROUP BY 1"
_STATES = f"(SELECT unnest({list(STATES)}) AS state)"
_STATUS = f"(SELECT state, count(event_id) AS n FROM {_STATES} LEFT JOIN events ON event_type = state GROUP BY 1)"

QUERIES = {
    "requests_per_minute_over_limit": (q_per_minute, "SELECT user_id, date_trunc('minute', ts) AS minute, count(*) AS requests FROM events GROUP BY 1, 2 HAVING count(*) > 1"),
    "hourly_shared_limit": (q_hourly_limit, "SELECT event_type, date_trunc('hour', ts) AS hour, count(*) AS n, count(*) * 2 > 10 AS over FROM events GROUP BY 1, 2"),
    "queue_depth_caps": (q_queue, "SELECT *, CASE WHEN user_over THEN 'user' WHEN type_over THEN 'type' WHEN all_over THEN 'all' END AS refused_by FROM (SELECT event_type, user_id, n, n > 15 AS user_over, sum(n) OVER (PARTITION BY event_type) > 1000 AS type_over, sum(n) OVER () > 6000 AS all_over FROM (SELECT event_type, user_id, count(*) AS n FROM events WHERE event_type <> 'purchase' GROUP BY 1, 2))"),
    "daily_budget": (q_day, _BUCKET.format("day")),
    "monthly_budget": (q_month, _BUCKET.format("month")),
    "reserved_without_released": (q_reserved, "SELECT user_id AS owner, round(coalesce(sum(value) FILTER (event_type NOT IN ('purchase', 'error')), 0), 4) AS reserved FROM events GROUP BY 1"),
    "idempotent_first": (q_idempotent, "SELECT user_id || '-' || strftime(ts, '%Y%m%d%H') AS key, arg_min(event_id, (ts, event_id)) AS event_id, count(*) AS attempts, count(DISTINCT event_type) > 1 AS conflict FROM events GROUP BY 1"),
    "worst_case_price": (q_worst_case, "SELECT doc_id, CAST(CAST(ceil(n_chars * 0.15 + n_chars * 2 * 0.60) / 1000000 AS DECIMAL(18,6)) AS VARCHAR) AS price FROM documents"),
    "status_counts": (q_status, f"SELECT * FROM {_STATUS}"),
    "prometheus_metrics": (q_prometheus, f"SELECT 'lexiloom_events{{state=\"' || state || '\"}} ' || n AS line FROM {_STATUS}"),
    "operations_metrics": (
        q_operations,
        """SELECT event_type, max(a) AS oldest_seconds, count(*) FILTER (a > 130) AS stale, count(*) FILTER (props ->> '$.k' IS NULL) AS unknown, round(coalesce(sum(value) FILTER (a < 86400), 0), 4) AS spend_last_day
        FROM (SELECT *, CAST(floor(epoch((SELECT max(ts) FROM events) - ts)) AS BIGINT) AS a FROM events) GROUP BY 1""",
    ),
    "job_backlog_union": (
        q_backlog,
        """SELECT 'orders' AS queue, count(*) AS waiting, strftime(min(o_orderdate), '%Y-%m-%d') AS oldest FROM orders WHERE o_orderstatus = 'O' UNION ALL
        SELECT 'lineitem', count(*), strftime(min(l_shipdate), '%Y-%m-%d') FROM lineitem WHERE l_linestatus = 'O'""",
    ),
    "retention_inventory": (q_retention, "SELECT l_returnflag, l_linestatus, count(*) AS rows, strftime(min(l_shipdate), '%Y-%m-%d') AS oldest, strftime(max(l_shipdate), '%Y-%m-%d') AS newest FROM lineitem GROUP BY 1, 2"),
    "orphan_checks": (
        q_orphans,
        """SELECT 'lineitem_orders' AS relation, count(*) AS orphans FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders) UNION ALL
        SELECT 'orders_customer', count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer) UNION ALL SELECT 'labels_documents', count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)""",
    ),
    "access_counts": (
        q_access,
        """WITH o AS (SELECT c_mktsegment, count(*) AS orders FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1), l AS (SELECT c_mktsegment, count(*) AS lines FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY 1)
        SELECT c_mktsegment, coalesce(orders, 0) AS orders, coalesce(lines, 0) AS lines FROM (SELECT DISTINCT c_mktsegment FROM customer) LEFT JOIN o USING (c_mktsegment) LEFT JOIN l USING (c_mktsegment)""",
    ),
}
