"""Registered queries of OTLP signals, attribute values, names, validation rules, batches and JSON results."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from spanlake.functions import attributes, evolution, names
from spanlake.functions.attributes import value_json, value_text
from spanlake.operators import catalog, maintenance, monitor, otlp, validation
from spanlake.operators.filters import overlaps
from spanlake.plans.platform_queries import batches, messages, partitions
from spanlake.plans.registry import query
from spanlake.sources import storage
from spanlake.sources.schemas import METRIC, VALUE
from spanlake.sources.storage import spread
from spanlake.streaming import pipelines

NOW = datetime(2024, 2, 1)
NANOS = "epoch_us(ts) * 1000"


def nanos():
    return (F.unix_micros(F.col("ts").cast("timestamp")) * 1000).cast("string")


def attribute(key, kind, value):
    return F.struct(F.lit(key).alias("key"), F.struct(value.cast("string").alias(kind)).alias("value"))


def service():
    return F.struct(F.array(attribute("service.name", "stringValue", F.concat(F.lit("svc-"), F.col("user_id")))).alias("attributes"))


def log_messages(t):
    """events as OTLP log messages, a record each."""
    record = F.struct(nanos().alias("timeUnixNano"), F.col("event_type").alias("severityText"), (F.col("user_id") % 24).cast("string").alias("severityNumber"), F.struct(F.col("props").alias("stringValue")).alias("body"), F.array(attribute("event.id", "intValue", F.col("event_id"))).alias("attributes"), F.lpad(F.hex("event_id"), 32, "0").alias("traceId"))
    payload = F.struct(F.array(F.struct(service().alias("resource"), F.array(F.struct(F.struct(F.lit("app").alias("name")).alias("scope"), F.array(record).alias("logRecords"))).alias("scopeLogs"))).alias("resourceLogs"))
    return spread(t.events).select(F.to_json(payload).alias("payload"))


def metric_messages(t):
    """events as OTLP metric messages: a gauge, a monotonic sum or a histogram by user."""
    point = F.struct(nanos().alias("timeUnixNano"), F.col("value").alias("asDouble"))
    gauge = F.when(F.col("user_id") % 3 == 0, F.struct(F.array(point).alias("dataPoints")))
    total = F.when(F.col("user_id") % 3 == 1, F.struct(F.array(point).alias("dataPoints"), F.lit(2).alias("aggregationTemporality"), (F.col("event_id") % 2 == 0).alias("isMonotonic")))
    spread_out = F.struct(nanos().alias("timeUnixNano"), F.lit("3").alias("count"), F.col("value").alias("sum"), F.array(F.lit("1"), F.lit("2")).alias("bucketCounts"), F.array(F.lit(10.0)).alias("explicitBounds"))
    histogram = F.when(F.col("user_id") % 3 == 2, F.struct(F.array(spread_out).alias("dataPoints")))
    metric = F.struct(F.concat(F.lit("m."), F.col("event_type")).alias("name"), F.lit("ms").alias("unit"), gauge.alias("gauge"), total.alias("sum"), histogram.alias("histogram"))
    payload = F.struct(F.array(F.struct(service().alias("resource"), F.array(F.struct(F.array(metric).alias("metrics"))).alias("scopeMetrics"))).alias("resourceMetrics"))
    return spread(t.events).select(F.to_json(payload).alias("payload"))


LOG_SQL = "ts AS timestamp, event_type AS severity_text, user_id % 24 AS severity_number, props AS body, 'svc-' || user_id AS service_name"


@query(f"SELECT {LOG_SQL}, event_id, lpad(lower(to_hex(event_id)), 32, '0') AS trace_id, 'app' AS scope FROM events")
def otlp_logs(t):
    found = otlp.logs(log_messages(t))
    return found.select(F.col("timestamp").cast("timestamp_ntz").alias("timestamp"), "severity_text", "severity_number", "body", "service_name", F.element_at("attributes", "event.id").cast("bigint").alias("event_id"), "trace_id", "scope")


KIND = "CASE user_id % 3 WHEN 0 THEN 'gauge' WHEN 1 THEN CASE WHEN event_id % 2 = 0 THEN 'counter' ELSE 'sum' END ELSE 'histogram' END"


@query(f"SELECT 'm.' || event_type AS metric_name, 'ms' AS unit, {KIND} AS metric_type, ts AS timestamp, CASE WHEN user_id % 3 < 2 THEN value END AS value, CASE WHEN user_id % 3 = 2 THEN value END AS sum, CASE WHEN user_id % 3 = 2 THEN 3 END AS buckets, 'svc-' || user_id AS service_name FROM events")
def otlp_metrics(t):
    found = otlp.metric_points(metric_messages(t))
    return found.select("metric_name", "unit", "metric_type", F.col("timestamp").cast("timestamp_ntz").alias("timestamp"), "value", "sum", F.aggregate("bucket_counts", F.lit(0).cast("bigint"), lambda a, b: a + b).cast("int").alias("buckets"), "service_name")


@query(
    f"""SELECT 'traces' AS telemetry_type, service_name, count(*) AS n, CAST(sum(greatest(floor(value * 1000), 0)) AS BIGINT) AS duration_ns, CAST(NULL AS DOUBLE) AS metric_value, CAST(NULL AS BIGINT) AS severity_number
    FROM (SELECT 'svc-' || user_id AS service_name, value FROM events) GROUP BY 2
    UNION ALL SELECT 'logs', 'svc-' || user_id, count(*), NULL, NULL, CAST(sum(user_id % 24) AS BIGINT) FROM events GROUP BY 2
    UNION ALL SELECT 'metrics', 'svc-' || user_id, count(*), NULL, round(sum(value), 2), NULL FROM events GROUP BY 2"""
)
def otlp_unified(t):
    """All three signals in one table, summed by service."""
    every = messages(t).select("payload").unionByName(log_messages(t)).unionByName(metric_messages(t))
    found = otlp.unified(every).groupBy("telemetry_type", "service_name")
    return found.agg(F.count("*").alias("n"), F.sum("duration_ns").alias("duration_ns"), F.round(F.sum("metric_value"), 2).alias("metric_value"), F.sum("severity_number").alias("severity_number"))


def values(t):
    """An attribute value of each kind, nested lists among them, by event."""
    text = F.concat_ws(
        "",
        F.lit('{"v":{"arrayValue":{"values":[{"stringValue":"'), F.col("event_type"), F.lit('"},{"intValue":'), F.col("event_id"),
        F.lit('},{"arrayValue":{"values":[{"boolValue":true},{"doubleValue":2.5}]}},{"kvlistValue":{"values":[{"key":"k","value":{"intValue":"'), F.col("user_id"), F.lit('"}}]}}]}}}'),
    )
    return t.events.select("event_id", F.from_json(text, f"v {VALUE}")["v"].alias("v"))


@query("SELECT event_id, '[' || event_type || ',' || event_id || ',[true,2.5],kvlist]' AS text FROM events")
def attribute_text_nested(t):
    return values(t).select("event_id", value_text(F.col("v")).alias("text"))


@query("""SELECT event_id, '["' || event_type || '",' || event_id || ',[true,2.5],{"k":' || user_id || '}]' AS json FROM events""")
def attribute_json(t):
    return values(t).select("event_id", value_json(F.col("v")).alias("json"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') AS at, coalesce(try_cast(json_extract_string(props, '$.k') AS BIGINT), 0) AS nanos FROM events")
def attribute_times(t):
    unix = F.unix_micros(F.col("ts").cast("timestamp")) * 1000
    return t.events.select("event_id", attributes.rfc3339(unix).alias("at"), attributes.nanos(F.get_json_object("props", "$.k")).alias("nanos"))


@query("SELECT c_custkey, regexp_replace(c_name || '.' || c_mktsegment, '[^A-Za-z0-9_-]', '_', 'g') AS key, c_name AS service_name, c_mktsegment AS environment, 'a' AS header FROM customer")
def flat_records(t):
    """Keys made safe, headers and telemetry under their prefixes, and what names the service."""
    record = F.create_map(F.lit("service.name"), F.col("c_name"), F.lit("x.deployment.environment"), F.col("c_mktsegment"))
    both = attributes.prefixed(F.create_map(F.lit("h"), F.lit("a")), record)
    found = attributes.service_metadata(record)
    return t.customer.select("c_custkey", attributes.sanitize_key(F.concat_ws(".", "c_name", "c_mktsegment")).alias("key"), found["service_name"].alias("service_name"), F.element_at(both, "telemetry.x.deployment.environment").alias("environment"), F.element_at(both, "header.h").alias("header"))


@query(
    """SELECT event_id, event_type = 'click' AS by_segment, event_type LIKE '%i%' AS by_text, CASE WHEN event_type = 'error' THEN 'logs' ELSE 'unknown' END AS kind, 'p-' || event_type AS named, 'v1' AS first
    FROM events"""
)
def topic_names(t):
    topic = F.concat_ws(".", F.lit("v1"), F.col("event_type"), F.when(F.col("event_type") == "error", "log").otherwise("x"))
    return t.events.select("event_id", names.topic_matches(topic, "v1.click").alias("by_segment"), names.topic_like(topic, "v1.*i*").alias("by_text"), names.payload_type(topic).alias("kind"), names.index_name(topic, 1, "p-").alias("named"), names.index_name(topic).alias("first"))


@query(
    """SELECT event_id, CASE user_id % 8 WHEN 0 THEN 'hdr' WHEN 1 THEN 'ten' WHEN 2 THEN 'acct' WHEN 3 THEN 'acme' WHEN 4 THEN 'shop' WHEN 5 THEN 'idx' WHEN 6 THEN 'node' ELSE 'default' END AS tenant,
    CASE user_id % 3 WHEN 0 THEN 'own' WHEN 1 THEN event_type ELSE 'default' END AS index FROM events"""
)
def tenant_cascade(t):
    """Where a tenant and an index are looked for, one place after the other."""
    k = F.col("user_id") % 8
    found = lambda n, key, value: F.when(k == n, F.array(F.struct(F.lit(key).alias("key"), F.lit(value).alias("value")), F.struct(F.lit("index_name").alias("key"), F.lit("late").alias("value"))))
    entries = F.coalesce(found(0, "header.client_name", "hdr"), found(1, "tenant", "ten"), found(2, "account_key", "acct"), found(3, "topic", "traces-acme"), found(4, "kafka_topic", "shop.orders.x"), F.when(k == 5, F.array(F.struct(F.lit("index_name").alias("key"), F.lit("idx").alias("value")))), F.when(k == 6, F.array(F.struct(F.lit("source_node").alias("key"), F.lit("ingest-node-7").alias("value")))), F.array(F.struct(F.lit("tenant").alias("key"), F.lit("default").alias("value"))))
    resource = F.create_map(F.lit("customer.name"), F.when(F.col("user_id") % 3 == 1, F.col("event_type")))
    return t.events.select("event_id", names.tenant_cascade(F.map_from_entries(entries)).alias("tenant"), names.index_cascade(F.when(F.col("user_id") % 3 == 0, "own"), resource).alias("index"))


@query("SELECT event_id, strftime(ts, 'year=%Y/month=%m/day=%d/hour=%H') AS path, strftime(ts, '%Y-%m-%d-%H') AS hour, strftime(ts, '%Y-%m-%d') AS day, 'hour' AS level FROM events")
def partition_paths(t):
    hour = names.partition_key(F.col("ts"))
    return t.events.select("event_id", names.hour_path(F.col("ts")).alias("path"), hour.alias("hour"), names.day_of(hour).alias("day"), names.level_of(hour).alias("level"))


@query(
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, array_to_string(list_filter([CASE WHEN l_linenumber % 5 = 0 THEN 'trace_id: length is not 32' END, CASE WHEN l_returnflag = 'A' THEN 'span_name: missing' END,
    CASE WHEN l_tax < l_discount THEN 'span: ends before it starts' END, CASE WHEN l_tax - l_discount > 0.05 THEN 'span: too long' END], lambda x: x IS NOT NULL), '; ') AS errors FROM lineitem"""
)
def validate_spans(t):
    cents = lambda c: F.round(F.col(c) * 100).cast("bigint")
    spans = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.repeat(F.lit("a"), F.when(F.col("l_linenumber") % 5 == 0, 30).otherwise(32)).alias("trace_id"), F.repeat(F.lit("b"), F.lit(16)).alias("span_id"), F.when(F.col("l_returnflag") != "A", F.col("l_linestatus")).alias("span_name"), cents("l_discount").alias("start_time_unix_nano"), cents("l_tax").alias("end_time_unix_nano"))
    return validation.validate(spans, validation.span_rules(5)).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.array_join("errors", "; ").alias("errors"))


@query(
    """SELECT event_id, CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'click' THEN 'WARN' WHEN 'view' THEN 'FATAL' ELSE upper(event_type) END AS severity_text,
    array_to_string(list_filter([CASE WHEN event_type NOT IN ('error', 'click', 'view') THEN 'log: unknown severity' END, CASE WHEN ts > TIMESTAMP '2024-01-21' THEN 'log: more than a day ahead' END], lambda x: x IS NOT NULL), '; ') AS errors FROM events"""
)
def validate_logs(t):
    """Severities are normalised first, then judged."""
    raw = F.when(F.col("event_type") == "click", "warning").when(F.col("event_type") == "view", "critical").otherwise(F.col("event_type"))
    logs = validation.prepare_logs(t.events.select("event_id", raw.alias("severity_text"), F.col("ts").alias("timestamp")))
    checked = validation.validate(logs, validation.log_rules(F.lit(datetime(2024, 1, 20)).cast("timestamp_ntz")))
    return checked.select("event_id", "severity_text", F.array_join("errors", "; ").alias("errors"))


@query(
    """SELECT event_id, array_to_string(list_filter([CASE WHEN user_id % 7 = 0 THEN 'metric: name missing' END, CASE WHEN user_id % 3 = 2 THEN 'metric: not exactly one kind' END, CASE WHEN user_id % 3 = 0 AND value < 50 THEN 'metric: point without value or time' END,
    CASE WHEN user_id % 3 = 1 AND user_id % 2 = 0 THEN 'sum: temporality must be 0, 1 or 2' END, CASE WHEN user_id % 3 = 1 AND user_id % 5 = 0 THEN 'sum: isMonotonic missing' END], lambda x: x IS NOT NULL), '; ') AS errors FROM events"""
)
def validate_metrics(t):
    name = F.when(F.col("user_id") % 7 != 0, F.lit("m"))
    gauge = F.when(F.col("user_id") % 3 == 0, F.struct(F.array(F.struct(nanos().alias("timeUnixNano"), F.when(F.col("value") >= 50, F.col("value")).alias("asDouble"))).alias("dataPoints")))
    total = F.when(F.col("user_id") % 3 == 1, F.struct(F.array(F.struct(nanos().alias("timeUnixNano"), F.lit("1").alias("asInt"))).alias("dataPoints"), F.when(F.col("user_id") % 2 == 0, 3).otherwise(1).alias("aggregationTemporality"), F.when(F.col("user_id") % 5 != 0, True).alias("isMonotonic")))
    text = F.to_json(F.struct(F.struct(name.alias("name"), gauge.alias("gauge"), total.alias("sum")).alias("x")))
    rows = t.events.select("event_id", F.from_json(text, f"x {METRIC}")["x"].alias("x"))
    return validation.validate(rows, validation.metric_rules()).select("event_id", F.array_join("errors", "; ").alias("errors"))


@query(
    """SELECT event_id, array_to_string(list_filter([CASE WHEN event_id % 4 = 0 THEN 'attributes: key repeated' END, CASE WHEN event_type <> 'click' THEN 'attributes: required key missing' END,
    CASE WHEN event_type NOT IN ('click', 'view') THEN 'attributes: unknown key' END], lambda x: x IS NOT NULL), '; ') AS errors FROM events"""
)
def validate_attributes(t):
    rows = t.events.select("event_id", F.array_compact(F.array(F.col("event_type"), F.when(F.col("event_id") % 4 == 0, F.col("event_type")))).alias("keys"))
    return validation.validate(rows, validation.attribute_rules(F.col("keys"), required=("click",), allowed=("click", "view"))).select("event_id", F.array_join("errors", "; ").alias("errors"))


@query("SELECT user_id AS batch, count(*) AS n FROM events GROUP BY user_id HAVING count(*) > 9")
def validate_batch_sizes(t):
    return validation.oversized_batches(t.events.withColumnRenamed("user_id", "batch"), "batch", 9)


@query("SELECT CAST(user_id AS VARCHAR) AS client_id, CAST((k - 1) // 3 AS BIGINT) AS batch_no, count(*) AS message_count, min(event_id) AS first_offset, max(event_id) AS last_offset FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events) GROUP BY 1, 2")
def tenant_batches(t):
    """Batches of three messages a tenant."""
    rows = t.events.select(F.col("user_id").cast("string").alias("client"), F.col("event_id").alias("offset"), F.col("event_type").alias("topic"), F.col("props").alias("payload"))
    found = pipelines.batch_records(pipelines.tenant_batches(rows, "client", 3, 1 << 30), "client")
    return found.select("client_id", "batch_no", "message_count", "first_offset", "last_offset")


@query(
    """WITH RECURSIVE m AS (SELECT user_id, event_id, length(props) AS size, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events),
    r AS (
        SELECT user_id, event_id, k, 0 AS batch_no, size AS held FROM m WHERE k = 1
        UNION ALL SELECT m.user_id, m.event_id, m.k, CASE WHEN r.held >= 20 THEN r.batch_no + 1 ELSE r.batch_no END, CASE WHEN r.held >= 20 THEN m.size ELSE r.held + m.size END FROM r JOIN m ON m.user_id = r.user_id AND m.k = r.k + 1)
    SELECT event_id, CAST(batch_no AS BIGINT) AS batch_no FROM r"""
)
def tenant_batches_by_size(t):
    """A batch ends when it holds twenty bytes or more, and the next counts from nothing."""
    rows = t.events.select(F.col("user_id").alias("client"), F.col("event_id").alias("offset"), F.col("props").alias("payload"), "event_id")
    return pipelines.tenant_batches(rows, "client", 1_000_000, 20).select("event_id", "batch_no")


@query("SELECT event_id, user_id, CAST(event_type AS VARCHAR) AS event_type, value, CAST(NULL AS VARCHAR) AS extra, CAST(event_id AS VARCHAR) AS _source_message_id FROM events WHERE event_id % 2 = 0 UNION ALL SELECT event_id, user_id, CAST(NULL AS VARCHAR), value, 'late', CAST(event_id AS VARCHAR) FROM events WHERE event_id % 2 = 1")
def merged_messages(t):
    """Messages of two sources, one of which lacks a column and has another, with the message each row came from."""
    rows = t.events.withColumn("message_id", F.col("event_id"))
    even, odd = rows.where("event_id % 2 = 0").drop("ts", "props"), rows.where("event_id % 2 = 1").drop("ts", "props", "event_type").withColumn("extra", F.lit("late"))
    return pipelines.merged_messages(even, odd).drop("message_id")


@query("SELECT CAST(NULL AS VARCHAR) AS event_type, event_id, CAST(NULL AS VARCHAR) AS value FROM events WHERE event_id % 2 = 0 UNION ALL SELECT event_type, event_id, CAST(event_id AS VARCHAR) FROM events WHERE event_id % 2 = 1")
def union_evolving(t):
    """A column that comes later, and one whose type changes: the later type counts, and older values are null."""
    first = t.events.where("event_id % 2 = 0").select("event_id", "value")
    return evolution.union_evolving(first, t.events.where("event_id % 2 = 1").select("event_id", "event_type", F.col("event_id").cast("string").alias("value")))


@query("""SELECT '{"event_id":' || event_id || ',"event_type":"' || event_type || '","user_id":' || user_id || ',"none":null,"nan":null}' AS json FROM events""")
def json_rows(t):
    return storage.json_rows(t.events.select("event_id", "event_type", "user_id", F.lit(None).cast("string").alias("none"), F.lit(float("nan")).alias("nan")))


@query("SELECT event_id, length(props) AS size FROM events WHERE event_id % 10 > 0")
def bronze_replay(t):
    """Kept messages whose payload still has its checksum; every tenth was damaged."""
    kept = storage.bronze(t.events.select("event_id", F.col("props").alias("payload"))).withColumn("payload", F.when(F.col("event_id") % 10 == 0, F.concat("payload", F.lit("x"))).otherwise(F.col("payload")))
    folder = storage.scratch(t.events.sparkSession)
    kept.write.parquet(folder)
    return storage.replay(t.events.sparkSession, folder)[0].select("event_id", F.length("payload").cast("bigint").alias("size"))


@query("SELECT count(*) AS batches, count(*) FILTER (WHERE value <= 50) AS pending, count(*) FILTER (WHERE value > 90) AS failed, count(*) FILTER (WHERE value > 50 AND value <= 90) AS completed, CAST(sum(event_id) AS BIGINT) AS messages, round(sum(event_id) * 100 / 1048576.0, 6) AS megabytes FROM events")
def batch_status(t):
    return monitor.status(batches(t)).withColumn("megabytes", F.round("megabytes", 6))


@query("SELECT event_id AS batch_id, round((epoch_us(TIMESTAMP '2024-02-01') - epoch_us(ts)) / 60e6, 4) AS age_minutes FROM events WHERE value <= 50")
def pending_batches(t):
    return monitor.pending(batches(t), NOW).select("batch_id", F.round("age_minutes", 4).alias("age_minutes"))


@query("SELECT event_type AS artifact_type, count(*) AS artifacts, count(DISTINCT user_id) AS files, CAST(sum(event_id) AS BIGINT) AS documents, CAST(sum(event_id * 2) AS BIGINT) AS bytes, round(sum(value) / count(*), 6) AS mean_build_seconds FROM events GROUP BY event_type")
def index_stats(t):
    rows = t.events.select(F.col("event_type").alias("artifact_type"), F.col("user_id").alias("file_ulid"), F.col("event_id").alias("document_count"), (F.col("event_id") * 2).alias("size_bytes"), F.col("value").alias("build_seconds"))
    return catalog.index_stats(rows).withColumn("mean_build_seconds", F.round("mean_build_seconds", 6))


def data_files(t):
    """orders as data files of tenants and signals; those of status O have no index yet."""
    return t.orders.select(F.col("o_orderkey").cast("string").alias("file_ulid"), F.concat(F.lit("t"), F.col("o_custkey") % 3).alias("tenant"), F.when(F.col("o_orderpriority") < "3", "logs").otherwise("traces").alias("signal"), F.col("o_orderdate").alias("min_ts"), (F.col("o_orderdate") + F.expr("INTERVAL 7 DAYS")).alias("max_ts"), F.when(F.col("o_orderstatus") != "O", F.col("o_orderdate")).alias("indexed_at"), F.col("o_orderdate").alias("created_at"), F.col("o_orderkey").alias("k"))


FILES = "FROM orders WHERE o_custkey % 3 = 1 AND o_orderpriority < '3'"


@query(f"SELECT CAST(o_orderkey AS VARCHAR) AS file_ulid {FILES} AND o_orderstatus <> 'O' AND o_orderdate <= TIMESTAMP '1996-06-01' AND o_orderdate + INTERVAL 7 DAYS >= TIMESTAMP '1996-01-01'")
def file_overlap(t):
    return catalog.files_between(data_files(t), "t1", "logs", datetime(1996, 1, 1), datetime(1996, 6, 1)).select("file_ulid")


@query(f"SELECT CAST(o_orderkey AS VARCHAR) AS file_ulid {FILES} AND o_orderstatus = 'O' ORDER BY o_orderdate, file_ulid LIMIT 50")
def not_indexed_files(t):
    return catalog.not_indexed(data_files(t), "t1", "logs", 50).select("file_ulid")


@query("SELECT o_orderkey AS partition_id, CAST(row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS BIGINT) AS place FROM orders WHERE o_orderdate <= TIMESTAMP '1996-03-01' AND o_orderdate + INTERVAL 7 DAYS >= TIMESTAMP '1996-01-15'")
def partitions_in_order(t):
    """Partitions that meet a time, by their start."""
    from pyspark.sql import Window

    found = partitions(t).where(overlaps("start_time", "end_time", datetime(1996, 1, 15), datetime(1996, 3, 1)))
    return found.select("partition_id", F.row_number().over(Window.orderBy("start_time", "partition_id")).cast("bigint").alias("place"))


@query("SELECT o_orderkey AS partition_id, CAST(least(5, o_custkey // 2) AS BIGINT) AS segments, o_totalprice * 0.75 AS bytes FROM orders")
def compaction_estimate(t):
    rows = t.orders.select(F.col("o_orderkey").alias("partition_id"), F.col("o_custkey").alias("segment_count"), F.col("o_totalprice").alias("size_bytes"))
    return maintenance.compaction_estimate(rows, 5)


@query(
    """SELECT 't' || (user_id % 4) AS tenant, event_type AS signal, strftime(ts, '%Y-%m-%d-%H') AS partition_key, count(*) AS files, CAST(sum(event_id) AS BIGINT) AS bytes, 'age' AS reason FROM events
    WHERE ts < TIMESTAMP '2024-01-30' GROUP BY 1, 2, 3"""
)
def to_combine(t):
    files = t.events.where("ts < TIMESTAMP_NTZ '2024-01-30'").select(F.concat(F.lit("t"), F.col("user_id") % 4).alias("tenant"), F.col("event_type").alias("signal"), names.partition_key(F.col("ts")).alias("partition_key"), F.col("event_id").alias("size_bytes"), F.col("ts").alias("created_at"))
    return maintenance.to_combine(files, NOW)


@query("SELECT o_orderkey FROM orders WHERE o_orderkey <= 700 AND o_orderdate < TIMESTAMP '1996-01-01'")
def wal_cleanup(t):
    rows = t.orders.select(F.col("o_orderkey").alias("sequence"), F.col("o_orderdate").alias("created_at"))
    return maintenance.wal_removable(rows, 700, datetime(1996, 1, 1)).select(F.col("sequence").alias("o_orderkey"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 50")
def sql_page(t):
    """A page of an SQL result."""
    from spanlake.plans import sqlapi

    session = t.orders.sparkSession
    t.orders.createOrReplaceTempView("orders")
    return sqlapi.sql(session, "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey", limit=25, offset=50)
