"""Registered queries of catalog, monitoring, indexes, validation, names, telemetry and streaming windows."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from spanlake.functions.attributes import json_flatten
from spanlake.functions.names import normalize_client, severity, topic_part
from spanlake.operators import catalog, index_store, indexes, maintenance, monitor, otlp, validation
from spanlake.operators.filters import And, Between, Equals, GreaterThan, In, Or, overlaps
from spanlake.plans.registry import query
from spanlake.sources import storage
from spanlake.sources.storage import spread
from spanlake.streaming import pipelines

NOW = datetime(2024, 2, 1)


def batches(t):
    """events as pipeline batches: a client a user, stages passed by value."""
    flags = {s: F.col("value") > 10.0 * i for i, s in enumerate(monitor.STAGES)}
    status = F.when(F.col("value") > 90, "failed").when(F.col("value") > 50, "completed").otherwise("pending")
    return t.events.select(F.col("event_id").alias("batch_id"), F.col("user_id").alias("client_id"), (F.col("event_id") % 4).alias("node_id"), F.col("event_type").alias("index_name"), F.col("event_id").alias("message_count"), (F.col("event_id") * 100).alias("size_bytes"), F.col("ts").alias("created_at"), status.alias("status"), *(c.alias(s) for s, c in flags.items()))


def partitions(t):
    """orders as catalog partitions: a week from the order's date."""
    return t.orders.select(F.col("o_orderkey").alias("partition_id"), F.col("o_orderdate").alias("start_time"), (F.col("o_orderdate") + F.expr("INTERVAL 7 DAYS")).alias("end_time"))


def segments(t):
    """lineitem as segments of orders."""
    state = lambda c, a, b, d: F.when(F.col(c) == a, "pending").when(F.col(c) == b, d).otherwise("failed")
    return t.lineitem.select(F.col("l_orderkey").alias("partition_id"), F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("segment_id"), F.col("l_quantity").cast("bigint").alias("row_count"), F.col("l_extendedprice").cast("bigint").alias("size_bytes"), state("l_returnflag", "N", "R", "stored").alias("storage_status"), state("l_linestatus", "O", "F", "indexed").alias("index_status"))


@query("SELECT o_orderkey AS partition_id FROM orders WHERE o_orderdate <= TIMESTAMP '1996-03-01 00:00:00' AND o_orderdate + INTERVAL 7 DAYS >= TIMESTAMP '1996-01-15 00:00:00'")
def partition_overlap(t):
    return partitions(t).where(overlaps("start_time", "end_time", datetime(1996, 1, 15), datetime(1996, 3, 1))).select("partition_id")


def order_spans(t):
    """orders as root spans, their lineitems as child spans; those of orders with an odd key have lost their root."""
    span = lambda trace, span_id, parent, name: [F.col(trace).alias("trace_id"), span_id.cast("string").alias("span_id"), F.lit(parent).cast("string").alias("parent_span_id"), F.col(name).alias("span_name")]
    roots = t.orders.where("o_orderkey % 2 = 0").select(*span("o_orderkey", F.lit("root"), None, "o_orderpriority"))
    return roots.unionByName(t.lineitem.select(*span("l_orderkey", F.col("l_linenumber"), "root", "l_returnflag")))


@query(
    """WITH i AS (SELECT l_orderkey AS trace_id, count(*) AS items FROM lineitem GROUP BY 1),
    r AS (SELECT o_orderkey AS trace_id, o_orderpriority FROM orders WHERE o_orderkey % 2 = 0)
    SELECT trace_id, coalesce(items, 0) + CASE WHEN r.trace_id IS NULL THEN 0 ELSE 1 END AS spans, CASE WHEN items IS NOT NULL THEN o_orderpriority END AS parent_name,
    greatest(coalesce(items, 1) - 1, 0) AS siblings, CASE WHEN r.trace_id IS NULL THEN items ELSE 0 END AS orphans FROM i FULL JOIN r USING (trace_id)"""
)
def trace_assembly(t):
    """Each trace's spans, with the name of their parent and how many siblings they have."""
    tree = catalog.trace_tree(order_spans(t))
    child = F.col("parent_span_id").isNotNull()
    found = tree.groupBy("trace_id").agg(F.count("*").alias("spans"), F.max(F.when(child, F.col("parent_name"))).alias("parent_name"), F.coalesce(F.max(F.when(child, F.col("siblings"))), F.lit(0)).alias("siblings"), F.count_if(child & F.col("parent_name").isNull()).alias("orphans"))
    return found


@query(
    """SELECT user_id AS file_ulid, min(CASE WHEN event_type = 'click' THEN event_id END) AS click_url, min(CASE WHEN event_type = 'view' THEN event_id END) AS view_url
    FROM events GROUP BY user_id"""
)
def artifact_pivot(t):
    files = t.events.select(F.col("user_id").alias("file_ulid")).distinct()
    artifacts = t.events.select(F.col("user_id").alias("file_ulid"), F.col("event_type").alias("artifact_type"), F.col("event_id").alias("artifact_url"))
    return catalog.artifacts_by_type(files, artifacts, ["click", "view"])


@query("SELECT DISTINCT o.o_orderstatus AS snapshot_id, o.o_custkey AS file_ulid, c.c_name FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey")
def snapshot_explode_join(t):
    snapshots = t.orders.groupBy(F.col("o_orderstatus").alias("snapshot_id"), F.col("o_orderkey") % 50).agg(F.collect_list("o_custkey").alias("file_ulids"))
    return catalog.snapshot_files(snapshots, t.customer.select(F.col("c_custkey").alias("file_ulid"), "c_name"))


@query("SELECT c_custkey AS file_ulid FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 350000) ORDER BY c_custkey LIMIT 100")
def unindexed_files(t):
    files = t.customer.select(F.col("c_custkey").alias("file_ulid"), F.col("c_custkey").alias("created_at"))
    return catalog.unindexed(files, t.orders.where("o_totalprice > 350000").select(F.col("o_custkey").alias("file_ulid"))).select("file_ulid")


@query("SELECT user_id AS client_id, count(*) AS batches, CAST(sum(event_id) AS BIGINT) AS messages, round(sum(event_id) / 2678400.0, 6) AS per_second FROM events WHERE ts >= TIMESTAMP '2024-01-01' AND ts < TIMESTAMP '2024-02-01' GROUP BY user_id")
def client_throughput(t):
    return monitor.client_throughput(batches(t), datetime(2024, 1, 1), NOW).withColumn("per_second", F.round("per_second", 6))


@query("SELECT count(*) AS total, " + ", ".join(f"count(*) FILTER (WHERE value > {10 * i}) AS {s}" for i, s in enumerate(monitor.STAGES)) + " FROM events")
def pipeline_funnel(t):
    return monitor.funnel(batches(t))


@query("SELECT event_id AS batch_id, user_id AS client_id FROM events WHERE NOT value > 50 AND ts < TIMESTAMP '2024-01-31 23:30:00'")
def stuck_batches(t):
    return monitor.stuck(batches(t), NOW, 30).select("batch_id", "client_id")


@query("SELECT event_id AS batch_id FROM events WHERE value <= 50 AND contains(event_type, 'ic') ORDER BY ts, event_id LIMIT 40")
def batch_search(t):
    return monitor.search(batches(t), status="pending", index_name="ic", limit=40).select("batch_id")


@query(
    """WITH f AS (SELECT max(CASE WHEN value <= 50 THEN epoch_us(TIMESTAMP '2024-02-01') - epoch_us(ts) END) / 60e6 AS oldest, count(*) FILTER (WHERE value <= 50) AS pending, count(*) FILTER (WHERE value > 90) AS failed FROM events)
    SELECT 'warning' AS severity, 'oldest_pending_minutes' AS kind, round(oldest, 4) AS value FROM f WHERE oldest > 60
    UNION ALL SELECT 'warning', 'pending_batches', CAST(pending AS DOUBLE) FROM f WHERE pending > 100
    UNION ALL SELECT 'error', 'failed_batches', CAST(failed AS DOUBLE) FROM f WHERE failed > 0"""
)
def batch_alerts(t):
    return monitor.alerts(batches(t), NOW).withColumn("value", F.round("value", 4))


@query("SELECT event_id % 4 AS node_id, count(*) AS batches, count(*) FILTER (WHERE value <= 50) AS pending, count(*) FILTER (WHERE value > 90) AS failed, max(ts) AS newest FROM events GROUP BY 1")
def batch_nodes(t):
    return monitor.nodes(batches(t))


@query(
    """SELECT count(*) AS total, count(*) FILTER (WHERE l_returnflag = 'N') AS storage_pending, count(*) FILTER (WHERE l_returnflag = 'R') AS stored,
    count(*) FILTER (WHERE l_returnflag NOT IN ('N', 'R')) AS storage_failed, count(*) FILTER (WHERE l_linestatus = 'O') AS index_pending,
    count(*) FILTER (WHERE l_linestatus = 'F') AS indexed, count(*) FILTER (WHERE l_linestatus NOT IN ('O', 'F')) AS index_failed,
    count(*) FILTER (WHERE l_linestatus = 'F' AND l_returnflag <> 'R') AS orphaned, count(*) FILTER (WHERE l_returnflag = 'R' AND l_linestatus NOT IN ('O', 'F')) AS missing FROM lineitem"""
)
def segment_lifecycle(t):
    return catalog.segment_lifecycle(segments(t))


@query(
    """SELECT count(DISTINCT o_orderkey) AS partitions, count(DISTINCT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey) AS segments,
    CAST(coalesce(sum(trunc(l_quantity)), 0) AS BIGINT) AS rows, CAST(coalesce(sum(trunc(l_extendedprice)), 0) AS BIGINT) AS bytes FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey"""
)
def storage_stats(t):
    return catalog.storage_stats(partitions(t), segments(t))


@query("SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY user_id")
def upsert_latest(t):
    return catalog.latest(t.events.select("user_id", "ts", "event_id"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id")


@query("SELECT event_type AS topic, user_id % 8 AS partition, max(event_id) + 1 AS next_offset FROM events GROUP BY 1, 2")
def kafka_offsets(t):
    return catalog.next_offsets(t.events.select(F.col("event_type").alias("topic"), (F.col("user_id") % 8).alias("partition"), F.col("event_id").alias("offset")))


@query("SELECT count(*) AS partitions, CAST(coalesce(sum(o_custkey), 0) AS BIGINT) AS files, round(coalesce(sum(o_custkey), 0) * 1.2, 2) AS bytes FROM orders WHERE o_orderdate + INTERVAL 7 DAYS < TIMESTAMP '1995-01-01'")
def retention_estimate(t):
    sized = partitions(t).join(t.orders.select(F.col("o_orderkey").alias("partition_id"), F.col("o_custkey").alias("file_count"), F.col("o_custkey").alias("size_bytes")), "partition_id")
    return maintenance.retention_estimate(sized, datetime(1995, 1, 1)).withColumn("bytes", F.round(F.col("bytes").cast("double"), 2))


ZONES_SQL = "SELECT event_type AS file, 'value' AS column, min(value) AS min_number, max(value) AS max_number, count(*) FILTER (WHERE value IS NULL) AS null_count, count(*) AS row_count FROM events GROUP BY event_type"


def _zones(t):
    return indexes.zone_map(t.events, F.col("event_type"), ["value"])


@query(ZONES_SQL)
def zone_map(t):
    return _zones(t).select("file", "column", "min_number", "max_number", "null_count", "row_count")


@query("SELECT 'value' AS column, min(value) AS min_number, max(value) AS max_number, count(*) FILTER (WHERE value IS NULL) AS null_count, count(*) AS row_count FROM events")
def zone_map_merge(t):
    return indexes.merge_zone_maps(_zones(t), ["column"]).select("column", "min_number", "max_number", F.col("null_count").cast("bigint").alias("null_count"), F.col("row_count").cast("bigint").alias("row_count"))


@query(
    "\nUNION ALL ".join(
        f"SELECT '{c}' AS field, count(DISTINCT {c}) AS cardinality, count(*) FILTER (WHERE {c} IS NULL) AS null_count, min(CAST({c} AS VARCHAR)) AS min, max(CAST({c} AS VARCHAR)) AS max, round(avg(length(CAST({c} AS VARCHAR))), 6) AS avg_size FROM events"
        for c in ("event_type", "user_id", "event_id")
    )
)
def field_stats(t):
    return catalog.field_stats(t.events, ["event_type", "user_id", "event_id"], exact=True).withColumn("avg_size", F.round("avg_size", 6))


PROBES = (3, 7, 11, 1_000_001, 1_000_002)


@query(f"SELECT p AS value, (SELECT count(DISTINCT date_trunc('hour', ts)) FROM events WHERE user_id = p) AS files, 0 AS missed, true AS few_false FROM (SELECT unnest({list(PROBES)}) AS p)")
def bloom_probe(t):
    """Which hours' filters may hold each of some users, against those that do: none is missed, and no more than one in fifty is named in vain."""
    events = t.events.withColumn("file", F.date_format("ts", "yyyy-MM-dd-HH")).where("file IS NOT NULL")
    filters = indexes.bloom_by_size(events, F.col("file"), "user_id", 1_000)
    named = indexes.bloom_hits(filters, list(PROBES), "bigint").select(F.col("value").cast("bigint").alias("value"), "file", F.lit(1).alias("named"))
    held = events.where(F.col("user_id").isin(*PROBES)).select(F.col("user_id").alias("value"), "file", F.lit(1).alias("held")).distinct()
    both = named.join(held, ["value", "file"], "full").groupBy("value").agg(F.sum("held").alias("files"), F.count_if(F.expr("held IS NOT NULL AND named IS NULL")).alias("missed"), F.count_if(F.col("held").isNull()).alias("vain"))
    probes = events.sparkSession.createDataFrame([(p,) for p in PROBES], "value bigint")
    n = events.agg(F.count_distinct("file").alias("n"))
    found = probes.join(both, "value", "left").join(F.broadcast(n))
    return found.select("value", F.coalesce("files", F.lit(0)).alias("files"), F.coalesce("missed", F.lit(0)).cast("int").alias("missed"), (F.coalesce("vain", F.lit(0)) * 50 <= F.col("n")).alias("few_false"))


@query("SELECT user_id % 3 AS file, event_id AS row_index FROM events WHERE event_type = 'purchase'")
def bitmap_rows(t):
    """The rows of a value."""
    rows = indexes.bitmap(t.events, F.col("user_id") % 3, F.col("event_id"), "event_type")
    return indexes.bitmap_rows(rows, "purchase")


@query("SELECT event_type AS value, count(*) AS n FROM events GROUP BY event_type")
def bitmap_lookup(t):
    rows = indexes.bitmap(t.events, F.col("user_id") % 3, F.col("event_id"), "event_type")
    return indexes.bitmap_counts(indexes.merge_bitmaps(rows))


_lakes: dict[tuple[str, str], str] = {}


def lake(t) -> str:
    """events as the logs of four tenants, a file a tenant and day, with zone maps, Bloom filters and bitmaps; three days are combined. Written once a session and folder of tables."""
    spark = t.events.sparkSession
    key = (spark.sparkContext.applicationId, t.folder)
    if key not in _lakes:
        root = storage.scratch(spark)
        rows = t.events.select(F.concat(F.lit("t"), F.col("user_id") % 4).alias("client_name"), F.col("ts").alias("timestamp"), "event_id", "user_id", "event_type", "value")
        storage.write(rows, root, "logs", "timestamp")
        index_store.build(spark, root, "logs", index_store.Plan(zones=("event_id", "user_id", "value"), blooms=("user_id",), bitmaps=("event_type",), rows=2_000))
        for day in COMBINED:
            index_store.combine_day(spark, root, "logs", day)
        _lakes[key] = root
    return _lakes[key]


COMBINED = ("2024-01-03", "2024-01-04", "2024-01-10")
TENANT = "'t' || (user_id % 4)"


@query("SELECT event_id, user_id, value FROM events WHERE user_id = 7 AND value > 20")
def prune_equals_filter(t):
    """Only files whose indexes let them hold a match are read."""
    condition = And([Equals("user_id", 7), GreaterThan("value", 20.0)])
    return index_store.read(t.events.sparkSession, lake(t), "logs", condition, "t3").select("event_id", "user_id", "value")


@query("SELECT event_id, event_type FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-02' AND TIMESTAMP '2024-01-11' AND (event_id BETWEEN 100 AND 180 OR event_type IN ('purchase', 'error') AND user_id = 6)")
def index_prune_paths(t):
    """Or, In and Between, over hours and combined days."""
    low, high = datetime(2024, 1, 2), datetime(2024, 1, 11)
    condition = And([Between("timestamp", low, high), Or([Between("event_id", 100, 180), And([In("event_type", ["purchase", "error"]), Equals("user_id", 6)])])])
    return index_store.read(t.events.sparkSession, lake(t), "logs", condition, since=low, until=high).select("event_id", "event_type")


@query(f"SELECT {TENANT} AS tenant, count(DISTINCT date_trunc('day', ts)) AS files, count(*) AS rows, min(ts) AS min_ts, max(ts) AS max_ts FROM events GROUP BY 1")
def index_build(t):
    """The catalog of indexed files, by tenant."""
    known = index_store.files(t.events.sparkSession, lake(t))
    return known.groupBy("tenant").agg(F.count("*").alias("files"), F.sum("row_count").alias("rows"), F.min("min_ts").alias("min_ts"), F.max("max_ts").alias("max_ts"))


@query(
    f"""SELECT {TENANT} AS tenant, strftime(ts, '%Y-%m-%d') AS day, CAST(min(event_id) AS DOUBLE) AS least, CAST(max(event_id) AS DOUBLE) AS largest, count(*) AS rows
    FROM events WHERE strftime(ts, '%Y-%m-%d') IN {COMBINED} GROUP BY 1, 2"""
)
def combine_day(t):
    """The zone maps that combined days hold."""
    rows = index_store.index_rows(t.events.sparkSession, lake(t), "zone", "logs").where("level = 'day' AND column = 'event_id'")
    return rows.groupBy("tenant", F.col("partition").alias("day")).agg(F.min("min_number").alias("least"), F.max("max_number").alias("largest"), F.sum("row_count").cast("bigint").alias("rows"))


@query(
    f"""WITH d AS (SELECT strftime(ts, '%Y-%m-%d') AS day, min(ts) AS first FROM events WHERE user_id % 4 = 1 GROUP BY 1)
    SELECT CASE WHEN day IN {COMBINED} THEN 'day' ELSE 'hour' END AS level, CASE WHEN day IN {COMBINED} THEN day ELSE strftime(first, '%Y-%m-%d-%H') END AS partition, count(*) AS files FROM d GROUP BY 1, 2"""
)
def coverage(t):
    return index_store.coverage(t.events.sparkSession, lake(t), "logs", "t1")


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, json_extract_string(props, '$.none') AS missing FROM events")
def json_attributes(t):
    return t.events.select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"), F.get_json_object("props", "$.none").alias("missing"))


@query("SELECT event_id, 'k' AS path, json_extract_string(props, '$.k') AS value FROM events WHERE props IS NOT NULL")
def json_flattened(t):
    return spread(t.events).select("event_id", F.explode(json_flatten("props")).alias("path", "value"))


@query("SELECT event_id, CAST(user_id AS VARCHAR) AS client FROM events")
def tenant_from_topic(t):
    topic = F.concat_ws(".", F.lit("v1"), F.col("user_id"), F.col("event_type"))
    return t.events.select("event_id", topic_part(topic, 1).alias("client"))


@query("SELECT c_custkey, regexp_replace(lower(c_name || '@' || c_mktsegment), '[^a-z0-9_-]', '_', 'g') AS client FROM customer")
def normalize_clients(t):
    return t.customer.select("c_custkey", normalize_client(F.concat_ws("@", "c_name", "c_mktsegment")).alias("client"))


@query("SELECT event_id, CASE WHEN event_type = 'error' THEN 'ERROR' WHEN value > 50 THEN 'FATAL' ELSE 'WARN' END AS severity FROM events")
def severity_normalize(t):
    raw = F.when(F.col("event_type") == "error", "error").when(F.col("value") > 50, "Critical").otherwise("warning")
    return t.events.select("event_id", severity(raw).alias("severity"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_tax > l_discount THEN 1 ELSE 0 END AS slow, coalesce(l_returnflag = 'R', false) OR coalesce(l_quantity >= 40, false) AS is_error FROM lineitem")
def span_computed_fields(t):
    from spanlake.functions.attributes import duration, is_error

    nanos = lambda c: (F.col(c) * 100).cast("bigint")
    slow = F.when(duration(nanos("l_discount"), nanos("l_tax")) > 0, 1).otherwise(0)
    failed = is_error(F.when(F.col("l_returnflag") == "R", 2).otherwise(0), F.when(F.col("l_quantity") >= 40, 500).otherwise(200), F.lit(None))
    return t.lineitem.select("l_orderkey", "l_linenumber", slow.alias("slow"), failed.alias("is_error"))


@query(
    """SELECT event_id, array_to_string(list_filter([CASE WHEN event_type NOT IN ('click', 'view') THEN 'event_type: not one of the values' END,
    CASE WHEN value < 5 THEN 'value: below 5' END, CASE WHEN value > 80 THEN 'value: above 80' END], lambda x: x IS NOT NULL), '; ') AS errors
    FROM events WHERE event_type NOT IN ('click', 'view') OR value < 5 OR value > 80"""
)
def validate_quarantine(t):
    fields = [validation.FieldRules("event_type", "enum", values=["click", "view"]), validation.FieldRules("value", least=5, most=80)]
    checked = validation.validate(t.events, [r for f in fields for r in f.rules()])
    return validation.split(checked)[1].select("event_id", F.array_join("errors", "; ").alias("errors"))


@query("SELECT time_bucket(INTERVAL '1 hour', ts, TIMESTAMP '1970-01-01') AS window_start, time_bucket(INTERVAL '1 hour', ts, TIMESTAMP '1970-01-01') + INTERVAL '1 hour' AS window_end, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2, 3")
def tumbling_window(t):
    return pipelines.windows(t.events, "ts", "1 hour", ["event_type"], "value").withColumn("total", F.round("total", 2))


@query(
    """WITH e AS (SELECT event_type, value, time_bucket(INTERVAL '30 minutes', ts, TIMESTAMP '1970-01-01') - INTERVAL '30 minutes' * k AS window_start FROM events, (SELECT unnest([0, 1]) AS k))
    SELECT window_start, window_start + INTERVAL '1 hour' AS window_end, event_type, count(*) AS n, round(sum(value), 2) AS total FROM e GROUP BY 1, 2, 3"""
)
def sliding_window(t):
    return pipelines.windows(t.events, "ts", "1 hour", ["event_type"], "value", slide="30 minutes").withColumn("total", F.round("total", 2))


@query(
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL '30 minutes' THEN 0 ELSE 1 END AS fresh FROM events),
    s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
    SELECT min(ts) AS session_start, max(ts) + INTERVAL '30 minutes' AS session_end, user_id, count(*) AS n FROM s GROUP BY user_id, k"""
)
def session_window(t):
    return pipelines.sessions(t.events, "ts", "30 minutes", ["user_id"])


@query("SELECT DISTINCT user_id, event_type FROM events")
def dedup_events(t):
    return pipelines.deduplicated(t.events.select("user_id", "event_type"), ["user_id", "event_type"], "ts")


def messages(t):
    """events as OTLP trace messages, a span each."""
    attribute = lambda key, kind, value: F.struct(F.lit(key).alias("key"), F.struct(value.cast("string").alias(kind)).alias("value"))
    nanos = F.unix_micros(F.col("ts").cast("timestamp")) * 1000
    span = F.struct(F.lpad(F.hex("event_id"), 32, "0").alias("traceId"), F.lpad(F.hex("event_id"), 16, "0").alias("spanId"), F.col("event_type").alias("name"), nanos.cast("string").alias("startTimeUnixNano"), (nanos + F.floor(F.col("value") * 1000)).cast("string").alias("endTimeUnixNano"), F.array(attribute("http.status_code", "intValue", F.lit(200) + F.col("user_id") % 300)).alias("attributes"))
    resource = F.struct(F.array(attribute("service.name", "stringValue", F.concat(F.lit("svc-"), F.col("user_id")))).alias("attributes"))
    payload = F.struct(F.array(F.struct(resource.alias("resource"), F.array(F.struct(F.array(span).alias("spans"))).alias("scopeSpans"))).alias("resourceSpans"))
    return spread(t.events).select(F.to_json(payload).alias("payload"), F.col("event_id").cast("string").alias("message_id"))


@query("SELECT CAST(event_id AS VARCHAR) AS message_id, 'svc-' || user_id AS service_name, event_type AS span_name, CAST(200 + user_id % 300 AS INTEGER) AS http_status_code, 200 + user_id % 300 >= 400 AS is_error, CAST(greatest(floor(value * 1000), 0) AS BIGINT) AS duration_nanos FROM events")
def otlp_flatten(t):
    return otlp.spans(messages(t)).select("message_id", "service_name", "span_name", "http_status_code", "is_error", "duration_nanos")
