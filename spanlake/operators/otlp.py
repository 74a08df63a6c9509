"""OTLP JSON payloads flattened to typed tables: spans, logs, metric points, and all three as one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanlake.functions.attributes import attribute_map, bound, duration, event_time, is_error, nanos, value_text
from spanlake.sources.schemas import LOG, LOGS, METRICS, POINT, SPAN, SPAN_SCHEMA, TRACES, UNIFIED_SCHEMA

#: Span columns from span attributes, and from resource attributes.
SPAN_ATTRIBUTES = {
    "http_method": "http.method",
    "http_url": "http.url",
    "http_route": "http.route",
    "db_system": "db.system",
    "db_operation": "db.operation",
    "db_name": "db.name",
    "messaging_system": "messaging.system",
    "messaging_destination": "messaging.destination",
    "rpc_system": "rpc.system",
    "rpc_service": "rpc.service",
    "rpc_method": "rpc.method",
    "exception_type": "exception.type",
    "exception_message": "exception.message",
    "session_id": "session.id",
}
RESOURCE_ATTRIBUTES = {
    "service_namespace": "service.namespace",
    "service_instance_id": "service.instance.id",
    "service_version": "service.version",
    "cloud_provider": "cloud.provider",
    "cloud_region": "cloud.region",
    "k8s_namespace": "k8s.namespace.name",
    "k8s_pod_name": "k8s.pod.name",
    "container_name": "container.name",
    "host_name": "host.name",
}


def _json(payload: Column) -> Column:
    """A message's JSON text: its own or, where that can't be an object, what its base64 holds."""
    decoded = lambda p: F.try_to_binary(p, F.lit("base64")).cast("string")
    # base64 has no braces; a failed decoding costs many times a parse
    return bound(payload, lambda p: F.when(F.contains(p, F.lit("{")), p).otherwise(decoded(p)))


def parsed(payload: Column, schema: str, outer: str) -> Column:
    """The list `outer` of a message: of its JSON text or of the JSON that its base64 holds; null if neither has it."""
    return F.from_json(_json(payload), schema)[outer]


def _service(resource: Column) -> Column:
    return F.coalesce(F.try_element_at(resource, F.lit("service.name")), F.try_element_at(resource, F.lit("service_name")), F.lit("unknown"))


def _time(unix_nano: Column) -> Column:
    """Nanoseconds as text as a time; 0 is now."""
    return F.when(nanos(unix_nano) == 0, F.current_timestamp()).otherwise(event_time(nanos(unix_nano)))


def _parsed(messages: DataFrame, payload_col: str, schema: str, outer: str, inner: str, items: str) -> DataFrame:
    """A row for each innermost item, with its resource's and scope's; `m` holds the message's other columns."""
    # explode_outer: for explode the planner would filter by size first, and parse a second time for it
    rows = messages.select(F.struct("*").alias("m"), F.explode_outer(parsed(F.col(payload_col), schema, outer)).alias("r"))
    rows = rows.select("m", attribute_map(F.col("r.resource.attributes")).alias("resource"), F.explode_outer(f"r.{inner}").alias("s"))
    return rows.select("m", "resource", F.col("s.scope").alias("scope"), F.explode_outer(f"s.{items}").alias("x")).where("x IS NOT NULL")


def _span_columns(x: Column, start: Column, end: Column) -> dict[str, Column]:
    return {
        "trace_id": F.coalesce(x["traceId"], F.lit("")),
        "span_id": F.coalesce(x["spanId"], F.lit("")),
        "parent_span_id": x["parentSpanId"],
        "span_name": F.coalesce(x["name"], F.lit("")),
        "span_kind": F.coalesce(x["kind"].try_cast("int"), F.lit(1)),
        "duration_nanos": duration(start, end),
        "status_code": x["status"]["code"].try_cast("int"),
    }


def _log_columns(x: Column) -> dict[str, Column]:
    id_ = lambda name: F.when(F.length(x[name]) > 0, F.lower(x[name]))
    return {
        "timestamp": _time(x["timeUnixNano"]),
        "severity_text": x["severityText"],
        "severity_number": x["severityNumber"].try_cast("bigint"),
        "body": value_text(x["body"]),
        "trace_id": id_("traceId"),
        "span_id": id_("spanId"),
    }


def _points(metric: Column) -> Column:
    return F.coalesce(metric["gauge"]["dataPoints"], metric["sum"]["dataPoints"], metric["histogram"]["dataPoints"])


def _metric_type(metric: Column) -> Column:
    return F.when(metric["gauge"].isNotNull(), "gauge").when(metric["sum"].isNotNull(), F.when(metric["sum"]["isMonotonic"] == "true", "counter").otherwise("sum")).when(metric["histogram"].isNotNull(), "histogram")


def _point_columns(p: Column) -> dict[str, Column]:
    return {
        "timestamp": _time(p["timeUnixNano"]),
        "value": F.coalesce(p["asDouble"], p["asInt"]).try_cast("double"),
        "sum": p["sum"].try_cast("double"),
    }


def spans(messages: DataFrame, payload_col: str = "payload", ingestion_node: str = "spark") -> DataFrame:
    """The span table from messages (payload, and message_id, client_name, account_key where they have them).

    Payloads without resourceSpans give no rows. timestamp is the time of ingestion; event time is start_time_unix_nano.
    """
    x = _parsed(messages, payload_col, TRACES, "resourceSpans", "scopeSpans", "spans")
    x = x.withColumns({"attributes": attribute_map(F.col("x.attributes")), "start": nanos(F.col("x.startTimeUnixNano")), "end": nanos(F.col("x.endTimeUnixNano"))})
    attribute = lambda key: F.try_element_at(F.col("attributes"), F.lit(key))
    listed = lambda items: F.when(F.size(items) > 0, F.concat(F.lit("["), F.array_join(items, ","), F.lit("]")))
    size = lambda items: F.when(items.isNull(), 0).otherwise(F.size(items))
    message = lambda name, otherwise: F.coalesce(F.col(f"m.{name}").cast("string"), F.lit(otherwise)) if name in messages.columns else F.lit(otherwise).cast("string")
    found = {
        "timestamp": F.current_timestamp(),
        "message_id": message("message_id", ""),
        "ingestion_node": F.lit(ingestion_node),
        "client_name": message("client_name", "default"),
        "account_key": message("account_key", None),
        "trace_state": F.col("x.traceState"),
        "start_time_unix_nano": F.col("start"),
        "end_time_unix_nano": F.col("end"),
        "service_name": _service(F.col("resource")),
        "status_message": F.col("x.status.message"),
        "scope_name": F.col("scope.name"),
        "scope_version": F.col("scope.version"),
        "resource_attributes": F.col("resource"),
        "span_attributes": F.col("attributes"),
        "scope_attributes": attribute_map(F.col("scope.attributes")),
        "events": listed(F.col("x.events")),
        "links": listed(F.col("x.links")),
        "has_events": size(F.col("x.events")) > 0,
        "event_count": size(F.col("x.events")),
        "link_count": size(F.col("x.links")),
        "http_status_code": attribute("http.status_code").try_cast("int"),
        "user_id": F.coalesce(attribute("user.id"), attribute("enduser.id")),
    }
    found |= _span_columns(F.col("x"), F.col("start"), F.col("end"))
    found |= {name: attribute(key) for name, key in SPAN_ATTRIBUTES.items()}
    found |= {name: F.try_element_at(F.col("resource"), F.lit(key)) for name, key in RESOURCE_ATTRIBUTES.items()}
    found["latency_ms"] = found["duration_nanos"] / F.lit(1e6)
    found["is_error"] = is_error(found["status_code"], found["http_status_code"], found["exception_type"])
    return x.select(*(found[f.name].cast(f.dataType).alias(f.name) for f in SPAN_SCHEMA))


def logs(messages: DataFrame, payload_col: str = "payload") -> DataFrame:
    """A row a log record: times, severity, body, scope, flags, ids in hex, resource and attributes as maps."""
    x = _parsed(messages, payload_col, LOGS, "resourceLogs", "scopeLogs", "logRecords")
    found = _log_columns(F.col("x"))
    return x.select(
        found["timestamp"].alias("timestamp"),
        _time(F.col("x.observedTimeUnixNano")).alias("observed_timestamp"),
        *(found[name].alias(name) for name in ("severity_text", "severity_number", "body")),
        F.col("scope.name").alias("scope"),
        F.col("x.flags").try_cast("bigint").alias("flags"),
        *(found[name].alias(name) for name in ("trace_id", "span_id")),
        F.col("resource"),
        attribute_map(F.col("x.attributes")).alias("attributes"),
        _service(F.col("resource")).alias("service_name"),
    )


def metric_points(messages: DataFrame, payload_col: str = "payload") -> DataFrame:
    """A row a data point: gauge, counter (a monotonic sum), sum or histogram. Metrics of other kinds give no rows."""
    x = _parsed(messages, payload_col, METRICS, "resourceMetrics", "scopeMetrics", "metrics")
    x = x.select("m", "resource", "scope", "x", F.explode_outer(_points(F.col("x"))).alias("p")).where("p IS NOT NULL")
    found = _point_columns(F.col("p"))
    number = lambda name: F.col(f"p.{name}").try_cast("double").alias(name)
    return x.select(
        F.col("x.name").alias("metric_name"),
        F.col("x.unit").alias("unit"),
        F.col("x.description").alias("description"),
        _metric_type(F.col("x")).alias("metric_type"),
        *(found[name].alias(name) for name in ("timestamp", "value")),
        F.col("p.count").try_cast("bigint").alias("count"),
        found["sum"].alias("sum"),
        number("min"),
        number("max"),
        F.transform("p.bucketCounts", lambda c: c.try_cast("bigint")).alias("bucket_counts"),
        F.col("p.explicitBounds").alias("explicit_bounds"),
        attribute_map(F.col("p.attributes")).alias("attributes"),
        F.col("scope.name").alias("scope"),
        F.col("resource"),
        _service(F.col("resource")).alias("service_name"),
    )


def _items(messages: DataFrame, payload_col: str) -> DataFrame:
    """(signal, resource, span, log, metric, point): a row for each span, log record and metric point in its own columns; a message is parsed once."""
    kinds = {"span": SPAN, "log": LOG, "metric": "struct<name: string, unit: string, type: string>", "point": POINT}
    listed = lambda items: F.coalesce(items, F.array())
    each = lambda items, f: listed(F.flatten(F.transform(items, lambda e: listed(f(e)))))

    def row(signal: str, resource: Column, **own: Column) -> Column:
        return F.struct(F.lit(signal).alias("signal"), resource.alias("resource"), *(own.get(c, F.lit(None).cast(kind)).alias(c) for c, kind in kinds.items()))

    def rows(resources: Column, scopes: str, of_scope) -> Column:
        return each(resources, lambda r: bound(attribute_map(r["resource"]["attributes"]), lambda resource: each(r[scopes], lambda s: of_scope(resource, s))))

    def points(resource: Column, x: Column) -> Column:
        head = F.struct(x["name"].alias("name"), x["unit"].alias("unit"), _metric_type(x).alias("type"))
        return F.transform(_points(x), lambda p: row("metrics", resource, metric=head, point=p))

    def every(message: Column) -> Column:
        spans = rows(message["resourceSpans"], "scopeSpans", lambda resource, s: F.transform(s["spans"], lambda x: row("traces", resource, span=x)))
        logs = rows(message["resourceLogs"], "scopeLogs", lambda resource, s: F.transform(s["logRecords"], lambda x: row("logs", resource, log=x)))
        return F.concat(spans, logs, rows(message["resourceMetrics"], "scopeMetrics", lambda resource, s: each(s["metrics"], lambda x: points(resource, x))))

    # all lists are unfolded in one expression: a generator for each would copy what lies below it once more
    message = F.from_json(_json(F.col(payload_col)), f"{TRACES}, {LOGS}, {METRICS}")
    return messages.select(F.explode_outer(bound(message, every)).alias("x")).select("x.*").where("span IS NOT NULL OR log IS NOT NULL OR point IS NOT NULL")


def unified(messages: DataFrame, payload_col: str = "payload") -> DataFrame:
    """Spans, logs and metric points in one table; columns of the other signals are null."""
    x = _items(messages, payload_col)
    start, end = nanos(F.col("span.startTimeUnixNano")), nanos(F.col("span.endTimeUnixNano"))
    span, log, point = _span_columns(F.col("span"), start, end), _log_columns(F.col("log")), _point_columns(F.col("point"))
    attributes = F.coalesce(attribute_map(F.coalesce("span.attributes", "log.attributes", "point.attributes")), F.create_map().cast("map<string,string>"))
    of = lambda signal, value: F.when(F.col("signal") == signal, value)
    either = lambda name: of("traces", span[name]).when(F.col("signal") == "logs", log[name])
    found = {
        "timestamp": of("traces", event_time(start)).when(F.col("signal") == "logs", log["timestamp"]).otherwise(point["timestamp"]),
        "service_name": _service(F.col("resource")),
        "telemetry_type": F.col("signal"),
        "trace_id": either("trace_id"),
        "span_id": either("span_id"),
        "parent_span_id": span["parent_span_id"],
        "operation_name": of("traces", span["span_name"]),
        "span_kind": of("traces", span["span_kind"]),
        "duration_ns": of("traces", span["duration_nanos"]),
        "status_code": span["status_code"],
        "metric_name": F.col("metric.name"),
        "metric_value": F.coalesce(point["value"], point["sum"]),
        "metric_unit": F.col("metric.unit"),
        "metric_type": F.col("metric.type"),
        "severity_number": log["severity_number"],
        "severity_text": log["severity_text"],
        "body": of("logs", log["body"]),
        "attributes": F.to_json(attributes),
    }
    return x.select(*(found[f.name].cast(f.dataType).alias(f.name) for f in UNIFIED_SCHEMA))
