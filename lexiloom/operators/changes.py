"""Incremental changes, versioned snapshots, latest-version selection and fair scheduling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.operators.components import components
from lexiloom.session import table


def classify_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """new, changed, unchanged or removed by (item, content_hash, config_hash)."""
    b = before.select(F.col("item").alias("b_item"), F.col("content_hash").alias("b_content"), F.col("config_hash").alias("b_config"))
    same = F.col("b_content").eqNullSafe(F.col("content_hash")) & F.col("b_config").eqNullSafe(F.col("config_hash"))
    outcome = F.when(F.col("b_item").isNull(), "new").when(F.col("item").isNull(), "removed").when(same, "unchanged").otherwise("changed")
    return after.join(b, F.col("item") == F.col("b_item"), "full_outer").select(F.coalesce("item", "b_item").alias("item"), outcome.alias("outcome"))


def unchanged_sources(before: DataFrame, after: DataFrame) -> DataFrame:
    """Whether the sources of both sides have the same set of (item, content_hash, config_hash).

    Each distinct member is one row that knows its sides; no set is collected.
    """
    key = ["source", "item", "content_hash", "config_hash"]
    sides = before.select(*key, F.lit(True).alias("b"), F.lit(False).alias("a")).unionByName(after.select(*key, F.lit(False).alias("b"), F.lit(True).alias("a")))
    members = sides.groupBy(*key).agg(F.bool_or("b").alias("b"), F.bool_or("a").alias("a"))
    found = members.groupBy("source").agg(F.bool_or("b").alias("b"), F.bool_or("a").alias("a"), F.bool_and(F.col("a") & F.col("b")).alias("unchanged"))
    return found.where("a AND b AND source IS NOT NULL").select("source", "unchanged")


def set_digest(hashes: str, counted: str):
    """An order-free digest of a set of sha256 values: two sums of 60-bit parts of those counted; nothing is collected."""
    part = lambda at: F.conv(F.substring(hashes, at, 15), 16, 10).cast("decimal(38,0)")
    return [F.sum(F.when(F.col(counted), part(at))).cast("string") for at in (1, 16)]


def removed(prior: DataFrame, included: DataFrame, failed: DataFrame, carried: DataFrame, skipped_sources: DataFrame) -> DataFrame:
    """Prior items that are neither included, failed nor carried, of sources that were not skipped."""
    out = prior
    for gone in (included, failed, carried):
        out = out.join(gone.select("item"), "item", "left_anti")
    return out.join(skipped_sources.select("source"), "source", "left_anti")


def latest(rows: DataFrame, keys: list[str], *order) -> DataFrame:
    """The first row of each key in the given order."""
    return rows.withColumn("nth", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("nth = 1").drop("nth")


def fair_claims(queue: DataFrame, in_flight: DataFrame, cap: int, limit: int) -> DataFrame:
    """Turn by turn among owners with spare capacity: (turn, created, id), ``limit`` rows."""
    turn = F.row_number().over(Window.partitionBy("owner").orderBy("created", "id"))
    busy = in_flight.groupBy(F.col("owner").alias("b_owner")).agg(F.count(F.lit(1)).alias("busy"))
    rows = queue.withColumn("turn", turn).join(busy, F.col("owner") == F.col("b_owner"), "left").withColumn("busy", F.coalesce("busy", F.lit(0)))
    return rows.where(F.col("turn") + F.col("busy") <= cap).orderBy("turn", "created", "id").limit(limit)


def page(rows: DataFrame, order: list, offset: int, size: int) -> DataFrame:
    return rows.orderBy(*order).offset(offset).limit(size)


def next_due(last, zone, at_hour: int):
    """The next daily ``at_hour`` o'clock of a zone after ``last`` (UTC)."""
    local = F.from_utc_timestamp(last, zone)
    today = F.date_trunc("day", local) + F.make_dt_interval(F.lit(0), F.lit(at_hour))
    return F.to_utc_timestamp(F.when(local < today, today).otherwise(today + F.make_dt_interval(F.lit(1))), zone)


def _snapshots(spark, sf):
    """Two snapshots of documents: the first lacks one source, the second another; German texts were
    edited between them and Spanish ones are processed with another configuration."""
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("item"), "source", "lang", "text", "n_chars")
    before = docs.where("source <> 'src5'").select("item", "source", "lang", "n_chars", F.sha2("text", 256).alias("content_hash"), F.lit("v1").alias("config_hash"))
    text = F.when(F.col("lang") == "de", F.concat("text", F.lit("."))).otherwise(F.col("text"))
    config = F.when(F.col("lang") == "es", "v2").otherwise("v1")
    after = docs.where("source <> 'src7'").select("item", "source", "lang", "n_chars", F.sha2(text, 256).alias("content_hash"), config.alias("config_hash"))
    return before, after


def q_classify(spark, sf):
    return classify_changes(*_snapshots(spark, sf))


def q_removed(spark, sf):
    before, after = _snapshots(spark, sf)
    sources = before.select("source").distinct().where("source IN ('src3', 'src4')")
    return removed(before, after, before.where("n_chars > 8000"), before.where("n_chars < 300"), sources).select("item", "source")


def q_snapshot(spark, sf):
    """Outcome counters, bytes and provenance of a frozen snapshot, by source."""
    before, after = _snapshots(spark, sf)
    outcome = classify_changes(before, after).withColumnRenamed("item", "o_item")
    rows = after.join(outcome, F.col("item") == F.col("o_item"))
    # Repeated hashes of a source count once in its provenance.
    once = Window.partitionBy("source", "content_hash").orderBy("item")
    rows = rows.withColumn("first_of_hash", F.row_number().over(once) == 1)
    return rows.groupBy("source").agg(
        *[F.count_if(F.col("outcome") == o).alias(o) for o in ("new", "changed", "unchanged")], F.sum("n_chars").alias("total_chars"),
        *[part.alias(f"provenance_{n}") for n, part in enumerate(set_digest("content_hash", "first_of_hash"))],
    )


def q_compatible(spark, sf):
    """Snapshot members of each source that share the snapshot's configuration."""
    after = _snapshots(spark, sf)[1]
    return after.groupBy("source").agg(F.countDistinct("config_hash").alias("configs"), F.count_if(F.col("config_hash") == "v1").alias("compatible"))


def q_identities(spark, sf):
    """Reuse identities: digests of sorted-key JSON of content and configuration."""
    after = _snapshots(spark, sf)[1]
    identity = F.sha2(F.to_json(F.struct(F.col("config_hash").alias("config"), F.col("content_hash").alias("content"))), 256)
    return after.select(identity.alias("identity"), "item")


def q_compatible_run(spark, sf):
    """The newest finished order of each customer and priority: the run that can be reused."""
    return latest(table(spark, sf, "orders").where("o_orderstatus = 'F'"), ["o_custkey", "o_orderpriority"], F.desc("o_orderdate"), F.desc("o_orderkey")).select("o_custkey", "o_orderpriority", "o_orderkey")


def q_latest_order(spark, sf):
    return latest(table(spark, sf, "orders"), ["o_custkey"], F.desc("o_orderdate"), F.desc("o_orderkey")).select("o_custkey", "o_orderkey", "o_orderstatus")


def q_latest_by_max(spark, sf):
    """The same by a maximum and an inner join."""
    orders = table(spark, sf, "orders")
    newest = orders.groupBy(F.col("o_custkey").alias("c")).agg(F.max(F.struct("o_orderdate", "o_orderkey")).alias("m"))
    return orders.join(newest, F.col("o_orderkey") == F.col("m.o_orderkey")).select("o_custkey", "o_orderkey")


def q_never(spark, sf):
    """Customers of a name pattern (escaped) who never ordered, or whose last order is open."""
    last = q_latest_order(spark, sf).withColumnRenamed("o_custkey", "k")
    rows = table(spark, sf, "customer").join(last, F.col("c_custkey") == F.col("k"), "left")
    return rows.where(F.expr(r"c_name ILIKE 'customer#%' ESCAPE '!'") & (F.col("k").isNull() | (F.col("o_orderstatus") == "O"))).select("c_custkey", F.coalesce("o_orderstatus", F.lit("never")).alias("last_status"))


def q_page(spark, sf):
    return page(table(spark, sf, "orders"), [F.desc("o_orderdate"), "o_orderkey"], 40, 20).select("o_orderkey", "o_custkey")


def q_total_pages(spark, sf):
    return table(spark, sf, "orders").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("total"), F.ceil(F.count(F.lit(1)) / 20).alias("pages"))


def q_fair(spark, sf):
    orders, nations = table(spark, sf, "orders"), table(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").alias("owner"))
    rows = orders.join(nations, F.col("o_custkey") == F.col("c_custkey")).select("owner", F.col("o_orderdate").alias("created"), F.col("o_orderkey").alias("id"), "o_orderstatus")
    # The cap is what an owner has in flight on average, so that some have spare capacity at any scale.
    busy = rows.where("o_orderstatus = 'P'")
    cap = busy.groupBy("owner").count().agg(F.ceil(F.avg("count"))).first()[0] or 1
    return fair_claims(rows.where("o_orderstatus = 'O'"), busy, cap, 100).select("owner", "id", "turn")


def q_due(spark, sf):
    """The next nine o'clock in Berlin after each event."""
    ts = F.col("ts").cast("timestamp")
    return table(spark, sf, "events").select("event_id", F.date_format(next_due(ts, F.lit("Europe/Berlin"), 9), "yyyy-MM-dd HH:mm:ss").alias("due"))


def q_claim(spark, sf):
    """Due hourly schedules of users: missed hours coalesce into one run, claims under a minute old hold."""
    events = table(spark, sf, "events")
    last = events.groupBy("user_id").agg(F.max("ts").alias("last"))
    now = events.agg(F.max("ts").alias("now"))
    seconds = F.timestamp_diff("SECOND", F.col("last"), F.col("now"))
    return last.join(F.broadcast(now), F.col("last") <= F.col("now")).where(seconds >= 60).select("user_id", F.floor(seconds / 3600).alias("missed"), (seconds >= 3600).alias("due"))


def q_run_summary(spark, sf):
    return classify_changes(*_snapshots(spark, sf)).join(table(spark, sf, "documents").select("doc_id", F.col("lang").alias("of_lang")), F.col("item") == F.col("doc_id")).groupBy(F.col("of_lang").alias("lang")).pivot("outcome", ["new", "changed", "unchanged", "removed"]).count().na.fill(0)


def q_frontier(spark, sf):
    return table(spark, sf, "orders").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


def q_retain(spark, sf, keep: int = 3):
    """Finished orders of each customer beyond the newest few: what retention deletes."""
    nth = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")))
    return table(spark, sf, "orders").where("o_orderstatus = 'F'").withColumn("nth", nth).where(F.col("nth") > keep).select("o_custkey", "o_orderkey")


def q_redact_expired(spark, sf):
    """Old orders keep their row but lose their customer and price."""
    old = F.col("o_orderdate") < F.lit("1997-01-01").cast("timestamp")
    return table(spark, sf, "orders").select("o_orderkey", F.when(~old, F.col("o_custkey")).alias("o_custkey"), F.when(~old, F.round("o_totalprice", 2)).alias("o_totalprice"), old.alias("redacted"))


def retention_batch(rows: DataFrame, expires: str, key: str, done: Column, size: int = 50) -> DataFrame:
    """The next rows that retention takes: expired and not ``done``, the oldest ``size`` first, ties by key.

    The bound is the feature: a run of retention touches no more rows. Null expiries never come.
    """
    return rows.where(F.col(expires).isNotNull() & ~done).orderBy(expires, key).limit(size)


def q_retention(spark, sf):
    """Two runs of retention over finished old orders: the second takes up where the first ended."""
    old = table(spark, sf, "orders").where((F.col("o_orderdate") < F.lit("1997-01-01").cast("timestamp")) & (F.col("o_orderstatus") == "F")).select("o_orderkey", "o_orderdate")
    first = retention_batch(old, "o_orderdate", "o_orderkey", F.lit(False)).withColumn("run", F.lit(1))
    taken = old.join(F.broadcast(first.select(F.col("o_orderkey").alias("t"))), F.col("o_orderkey") == F.col("t"), "left_anti")  # at most a batch
    return first.unionByName(retention_batch(taken, "o_orderdate", "o_orderkey", F.lit(False)).withColumn("run", F.lit(2))).select("o_orderkey", "run")


def q_carry(spark, sf):
    """Last good items of failed sources, split by whether their configuration is current."""
    before, after = _snapshots(spark, sf)
    failed = before.where("source IN ('src1', 'src2')")
    return failed.join(after.where("lang = 'en'").select("item"), "item", "left_anti").select("item", F.when(F.col("lang") == "es", "stale").otherwise("current").alias("carried"))


def q_source_outcomes(spark, sf):
    before, after = _snapshots(spark, sf)
    a = after.groupBy(F.col("source").alias("a_s")).agg(F.count(F.lit(1)).alias("kept"))
    f = before.where("n_chars > 8000").groupBy(F.col("source").alias("f_s")).agg(F.count(F.lit(1)).alias("failed"))
    rows = table(spark, sf, "documents").select("source").distinct().join(a, F.col("source") == F.col("a_s"), "left").join(f, F.col("source") == F.col("f_s"), "left").na.fill(0, ["kept", "failed"])
    outcome = F.when((F.col("kept") == 0) & (F.col("failed") == 0), "skipped").when(F.col("kept") == 0, "failed").when(F.col("failed") > 0, "partial").otherwise("succeeded")
    return rows.select("source", "kept", "failed", outcome.alias("outcome"))


def q_lanes(spark, sf):
    """Sources that share a text are one lane, transitively."""
    docs = table(spark, sf, "documents").select(F.expr("cast(substr(source, 4) AS bigint)").alias("s"), F.sha2("text", 256).alias("h")).distinct()
    first = F.min("s").over(Window.partitionBy("h"))
    links = docs.select(F.col("s").alias("a"), first.alias("b")).where("a <> b")
    lanes = components(links)
    return docs.select("s").distinct().join(lanes, F.col("s") == F.col("node"), "left").select(F.col("s").alias("source_number"), F.coalesce("component", "s").alias("lane"))


def q_provenance(spark, sf):
    """Where a document's language equals the most common one of its source, the source is the basis, else the user."""
    counts = table(spark, sf, "documents").groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n"))
    basis = counts.groupBy(F.col("source").alias("b_s")).agg(F.max(F.struct("n", "lang"))["lang"].alias("usual"))
    return table(spark, sf, "documents").join(basis, F.col("source") == F.col("b_s")).select("doc_id", F.when(F.col("lang").eqNullSafe(F.col("usual")), "source").otherwise("user").alias("provenance"))


def q_unchanged_index(spark, sf):
    """Which indexes (one a source and language) of both snapshots have the same members in both."""
    index = F.concat_ws("/", "source", "lang")
    before, after = (side.withColumn("source", index) for side in _snapshots(spark, sf))
    return unchanged_sources(before, after)


def q_membership(spark, sf):
    """Index members: chunks of ready runs, numbered; the version follows the largest."""
    runs = table(spark, sf, "orders").where("o_orderstatus = 'F'").select("o_orderkey")
    members = table(spark, sf, "lineitem").join(runs, F.col("l_orderkey") == F.col("o_orderkey"), "left_semi")
    return members.groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("members"), F.coalesce(F.max("l_linenumber"), F.lit(0)).alias("latest_version")).withColumn("next_version", F.col("latest_version") + 1)


def q_vector_reuse(spark, sf):
    """Texts of the second snapshot whose vector exists under an equal text of the first."""
    before, after = _snapshots(spark, sf)
    known = before.groupBy(F.col("content_hash").alias("k")).agg(F.min("item").alias("reused_from"))
    fresh = after.groupBy("content_hash").agg(F.count(F.lit(1)).alias("uses"))
    return fresh.join(known, F.col("content_hash") == F.col("k"), "left").select("content_hash", "uses", "reused_from")


def q_index_listing(spark, sf):
    """Every supplier with its distinct orders and parts."""
    lines = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("k")).agg(F.countDistinct("l_orderkey").alias("orders"), F.countDistinct("l_partkey").alias("parts"))
    nation = table(spark, sf, "nation").select("n_nationkey", "n_name")
    return table(spark, sf, "supplier").join(lines, F.col("s_suppkey") == F.col("k"), "left").join(nation, F.col("s_nationkey") == F.col("n_nationkey"), "left").select("s_suppkey", "n_name", F.coalesce("orders", F.lit(0)).alias("orders"), F.coalesce("parts", F.lit(0)).alias("parts"))


def q_knowledge_sets(spark, sf):
    """Per region: its nations in order, and the customer with the largest balance."""
    t = lambda n: table(spark, sf, n)
    rows = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.groupBy("r_name").agg(F.array_join(F.array_sort(F.collect_set("n_name")), ",").alias("nations"), F.max(F.struct("c_acctbal", "c_custkey"))["c_custkey"].alias("richest"))


def q_named(spark, sf):
    """Case-insensitive lookup of part types: the exact spelling first, then the oldest."""
    names = table(spark, sf, "part").select("p_partkey", "p_type", F.when(F.col("p_partkey") % 2 == 0, F.upper("p_type")).otherwise(F.lower("p_type")).alias("name"))
    order = Window.partitionBy(F.lower("name")).orderBy(F.desc((F.col("name") == F.col("p_type")).cast("int")), "p_partkey")
    return names.withColumn("nth", F.row_number().over(order)).where("nth = 1").select(F.lower("name").alias("name"), "p_partkey")


def q_recommendation(spark, sf):
    """Crawl settings per host: pages rounded up to tens with a tenth to spare, sitemap coverage, depth."""
    host = F.regexp_extract("url", r"://([^/?#]+)", 1)
    path = F.regexp_extract("url", r"://[^/?#]+([^?#]*)", 1)
    pages = table(spark, sf, "pages").select(host.alias("host"), path.alias("path"), F.col("url").contains("?").alias("has_query"))
    out = pages.groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("path").alias("paths"), F.count_if("has_query").alias("queries"), F.max(F.size(F.split("path", "/"))).alias("deepest"))
    # In tenths, so that rounding is exact.
    return out.select("host", F.expr("cast(ceil(11 * n / 100) * 10 AS bigint)").alias("maximum_pages"), F.when(F.col("paths") * 5 >= F.col("n") * 4, "sitemap").otherwise("links").alias("discovery"), (F.col("queries") * 2 > F.col("n")).alias("exclude_queries"), F.greatest(F.lit(1), F.col("deepest") - 1).cast("long").alias("depth"))


def q_include_scope(spark, sf):
    """The folder of a host's first page, if half of the host's pages lie below it, else its parent."""
    host, path = F.regexp_extract("url", r"://([^/?#]+)", 1), F.regexp_extract("url", r"://[^/?#]+([^?#]*)", 1)
    pages = table(spark, sf, "pages").select("page_id", host.alias("host"), path.alias("path"))
    first = pages.groupBy(F.col("host").alias("f_h")).agg(F.min_by("path", "page_id").alias("entered")).withColumn("folder", F.regexp_extract("entered", r"^(.*/)", 1))
    rows = pages.join(first, F.col("host") == F.col("f_h"))
    counts = rows.groupBy("host", "folder").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("path").startswith(F.col("folder"))).alias("below"))
    return counts.select("host", F.when(F.col("below") * 2 >= F.col("n"), F.col("folder")).otherwise(F.regexp_replace("folder", r"[^/]*/$", "")).alias("scope"))


_BEFORE = "(SELECT doc_id AS item, source, lang, n_chars, sha256(text) AS content_hash, 'v1' AS config_hash FROM documents WHERE source <> 'src5')"
_AFTER = "(SELECT doc_id AS item, source, lang, n_chars, sha256(CASE WHEN lang = 'de' THEN text || '.' ELSE text END) AS content_hash, CASE WHEN lang = 'es' THEN 'v2' ELSE 'v1' END AS config_hash FROM documents WHERE source <> 'src7')"
_CHANGES = f"""(SELECT coalesce(a.item, b.item) AS item, CASE WHEN b.item IS NULL THEN 'new' WHEN a.item IS NULL THEN 'removed' WHEN a.content_hash = b.content_hash AND a.config_hash = b.config_hash THEN 'unchanged' ELSE 'changed' END AS outcome
  FROM {_AFTER} a FULL JOIN {_BEFORE} b ON a.item = b.item)"""
_LATEST = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS nth FROM orders) WHERE nth = 1)"
_HOSTS = "(SELECT page_id, url, regexp_extract(url, '://([^/?#]+)', 1) AS host, regexp_extract(url, '://[^/?#]+([^?#]*)', 1) AS path FROM pages)"

QUERIES = {
    "classify_changes": (q_classify, f"SELECT * FROM {_CHANGES}"),
    "removed_items": (q_removed, f"SELECT item, source FROM {_BEFORE} WHERE item NOT IN (SELECT item FROM {_AFTER}) AND n_chars <= 8000 AND n_chars >= 300 AND source NOT IN ('src3', 'src4')"),
    "snapshot_counts": (
        q_snapshot,
        f"SELECT source, count(*) FILTER (outcome = 'new') AS new, count(*) FILTER (outcome = 'changed') AS changed, count(*) FILTER (outcome = 'unchanged') AS unchanged, CAST(sum(n_chars) AS BIGINT) AS total_chars, p0 AS provenance_0, p1 AS provenance_1 FROM {_AFTER} JOIN {_CHANGES} USING (item) JOIN (SELECT source, CAST(sum(('0x' || content_hash[1:15])::HUGEINT) AS VARCHAR) AS p0, CAST(sum(('0x' || content_hash[16:30])::HUGEINT) AS VARCHAR) AS p1 FROM (SELECT DISTINCT source, content_hash FROM {_AFTER}) GROUP BY 1) USING (source) GROUP BY source, p0, p1",
    ),
    "snapshot_compatibility": (q_compatible, f"SELECT source, count(DISTINCT config_hash) AS configs, count(*) FILTER (config_hash = 'v1') AS compatible FROM {_AFTER} GROUP BY 1"),
    "reuse_identities": (q_identities, f"""SELECT sha256('{{"config":"' || config_hash || '","content":"' || content_hash || '"}}') AS identity, item FROM {_AFTER}"""),
    "compatible_run_lookup": (q_compatible_run, "SELECT o_custkey, o_orderpriority, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders WHERE o_orderstatus = 'F') WHERE n = 1"),
    "latest_order_per_customer": (q_latest_order, f"SELECT o_custkey, o_orderkey, o_orderstatus FROM {_LATEST}"),
    "latest_order_by_maximum": (q_latest_by_max, f"SELECT o_custkey, o_orderkey FROM {_LATEST}"),
    "never_ordered_customers": (q_never, f"SELECT c_custkey, coalesce(o_orderstatus, 'never') AS last_status FROM customer LEFT JOIN {_LATEST} ON o_custkey = c_custkey WHERE c_name ILIKE 'customer#%' AND (o_custkey IS NULL OR o_orderstatus = 'O')"),
    "page_of_orders": (q_page, "SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 20 OFFSET 40"),
    "page_totals": (q_total_pages, "SELECT o_orderpriority, count(*) AS total, CAST(ceil(count(*) / 20) AS BIGINT) AS pages FROM orders GROUP BY 1"),
    "fair_dispatch": (
        q_fair,
        """WITH r AS (SELECT c_nationkey AS owner, o_orderdate AS created, o_orderkey AS id, o_orderstatus FROM orders JOIN customer ON o_custkey = c_custkey),
        q AS (SELECT *, row_number() OVER (PARTITION BY owner ORDER BY created, id) AS turn FROM r WHERE o_orderstatus = 'O'), b AS (SELECT owner, count(*) AS busy FROM r WHERE o_orderstatus = 'P' GROUP BY 1)
        SELECT owner, id, turn FROM q LEFT JOIN b USING (owner) WHERE turn + coalesce(busy, 0) <= (SELECT ceil(avg(busy)) FROM b) ORDER BY turn, created, id LIMIT 100""",
    ),
    "next_due": (
        q_due,
        """WITH l AS (SELECT event_id, timezone('Europe/Berlin', timezone('UTC', ts::TIMESTAMP)) AS local FROM events)
        SELECT event_id, strftime(timezone('UTC', timezone('Europe/Berlin', date_trunc('day', local) + CASE WHEN hour(local) < 9 THEN INTERVAL 9 HOUR ELSE INTERVAL 33 HOUR END)), '%Y-%m-%d %H:%M:%S') AS due FROM l""",
    ),
    "due_schedule_claims": (
        q_claim,
        """WITH l AS (SELECT user_id, CAST(floor(epoch((SELECT max(ts) FROM events) - max(ts))) AS BIGINT) AS s FROM events GROUP BY 1) SELECT user_id, s // 3600 AS missed, s >= 3600 AS due FROM l WHERE s >= 60""",
    ),
    "run_summary_pivot": (
        q_run_summary,
        f"SELECT lang, count(*) FILTER (outcome = 'new') AS new, count(*) FILTER (outcome = 'changed') AS changed, count(*) FILTER (outcome = 'unchanged') AS unchanged, count(*) FILTER (outcome = 'removed') AS removed FROM {_CHANGES} JOIN documents ON doc_id = item GROUP BY 1",
    ),
    "frontier_status_counts": (q_frontier, "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1"),
    "retention_beyond_newest": (q_retain, "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders WHERE o_orderstatus = 'F') WHERE n > 3"),
    "redact_expired": (q_redact_expired, "SELECT o_orderkey, CASE WHEN o_orderdate >= '1997-01-01' THEN o_custkey END AS o_custkey, CASE WHEN o_orderdate >= '1997-01-01' THEN round(o_totalprice, 2) END AS o_totalprice, o_orderdate < '1997-01-01' AS redacted FROM orders"),
    "retention_batches": (
        q_retention,
        "SELECT o_orderkey, CAST((n - 1) // 50 + 1 AS INT) AS run FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS n FROM orders WHERE o_orderdate < '1997-01-01' AND o_orderstatus = 'F') WHERE n <= 100",
    ),
    "carry_forward": (q_carry, f"SELECT item, CASE WHEN lang = 'es' THEN 'stale' ELSE 'current' END AS carried FROM {_BEFORE} WHERE source IN ('src1', 'src2') AND item NOT IN (SELECT item FROM {_AFTER} WHERE lang = 'en')"),
    "source_outcomes": (
        q_source_outcomes,
        f"""WITH r AS (SELECT source, coalesce(kept, 0) AS kept, coalesce(failed, 0) AS failed FROM (SELECT DISTINCT source FROM documents) LEFT JOIN (SELECT source, count(*) AS kept FROM {_AFTER} GROUP BY 1) USING (source) LEFT JOIN (SELECT source, count(*) AS failed FROM {_BEFORE} WHERE n_chars > 8000 GROUP BY 1) USING (source))
        SELECT *, CASE WHEN kept = 0 AND failed = 0 THEN 'skipped' WHEN kept = 0 THEN 'failed' WHEN failed > 0 THEN 'partial' ELSE 'succeeded' END AS outcome FROM r""",
    ),
    "origin_lanes": (
        q_lanes,
        """WITH RECURSIVE d AS (SELECT DISTINCT CAST(substr(source, 4) AS BIGINT) AS s, sha256(text) AS h FROM documents), e AS (SELECT DISTINCT a.s AS a, b.s AS b FROM d a JOIN d b USING (h)),
        r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a) SELECT a AS source_number, min(b) AS lane FROM r GROUP BY 1""",
    ),
    "setting_provenance": (
        q_provenance,
        """WITH c AS (SELECT source, lang, row_number() OVER (PARTITION BY source ORDER BY count(*) DESC, lang DESC) AS r FROM documents GROUP BY 1, 2)
        SELECT doc_id, CASE WHEN d.lang = c.lang THEN 'source' ELSE 'user' END AS provenance FROM documents d JOIN c ON c.source = d.source AND r = 1""",
    ),
    "unchanged_index": (
        q_unchanged_index,
        f"""WITH m AS (SELECT source || '/' || lang AS source, item, content_hash, config_hash, max(b) AS b, max(a) AS a FROM
          (SELECT source, lang, item, content_hash, config_hash, true AS b, false AS a FROM {_BEFORE} UNION ALL SELECT source, lang, item, content_hash, config_hash, false, true FROM {_AFTER}) GROUP BY 1, 2, 3, 4)
        SELECT source, min(a AND b) AS unchanged FROM m GROUP BY 1 HAVING max(a) AND max(b)""",
    ),
    "index_membership": (q_membership, "SELECT l_suppkey, count(*) AS members, max(l_linenumber) AS latest_version, max(l_linenumber) + 1 AS next_version FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') GROUP BY 1"),
    "vector_reuse": (q_vector_reuse, f"SELECT content_hash, uses, reused_from FROM (SELECT content_hash, count(*) AS uses FROM {_AFTER} GROUP BY 1) LEFT JOIN (SELECT content_hash, min(item) AS reused_from FROM {_BEFORE} GROUP BY 1) USING (content_hash)"),
    "index_listing": (q_index_listing, "SELECT s_suppkey, n_name, coalesce(orders, 0) AS orders, coalesce(parts, 0) AS parts FROM supplier LEFT JOIN (SELECT l_suppkey, count(DISTINCT l_orderkey) AS orders, count(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY 1) ON l_suppkey = s_suppkey LEFT JOIN nation ON n_nationkey = s_nationkey"),
    "knowledge_set_listing": (q_knowledge_sets, "SELECT r_name, string_agg(DISTINCT n_name, ',' ORDER BY n_name) AS nations, arg_max(c_custkey, (c_acctbal, c_custkey)) AS richest FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1"),
    "case_insensitive_lookup": (
        q_named,
        """WITH n AS (SELECT p_partkey, p_type, CASE WHEN p_partkey % 2 = 0 THEN upper(p_type) ELSE lower(p_type) END AS name FROM part)
        SELECT name, p_partkey FROM (SELECT lower(name) AS name, p_partkey, row_number() OVER (PARTITION BY lower(name) ORDER BY CAST(name = p_type AS INT) DESC, p_partkey) AS r FROM n) WHERE r = 1""",
    ),
    "setting_recommendations": (
        q_recommendation,
        f"""SELECT host, CAST(ceil(11 * count(*) / 100) * 10 AS BIGINT) AS maximum_pages, CASE WHEN count(DISTINCT path) * 5 >= count(*) * 4 THEN 'sitemap' ELSE 'links' END AS discovery,
        count(*) FILTER (contains(url, '?')) * 2 > count(*) AS exclude_queries, greatest(1, max(len(string_split(path, '/'))) - 1) AS depth FROM {_HOSTS} GROUP BY 1""",
    ),
    "include_scope": (
        q_include_scope,
        f"""WITH f AS (SELECT host, regexp_extract(arg_min(path, page_id), '^(.*/)', 1) AS folder FROM {_HOSTS} GROUP BY 1)
        SELECT host, CASE WHEN count(*) FILTER (starts_with(path, folder)) * 2 >= count(*) THEN folder ELSE regexp_replace(folder, '[^/]*/$', '') END AS scope FROM {_HOSTS} JOIN f USING (host) GROUP BY host, folder""",
    ),
}
