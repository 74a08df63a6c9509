"""Schemas of telemetry: the OTLP JSON that is read and the tables that are written."""

from __future__ import annotations

from pyspark.sql.types import BooleanType, DoubleType, IntegerType, LongType, MapType, StringType, StructType, TimestampType

#: How deep lists in attribute values are read as such; what lies deeper stays JSON text.
DEPTH = 3


def _value(depth: int) -> str:
    """An attribute value. Numbers are read as text, since OTLP writes them as numbers or strings."""
    inner = _value(depth - 1) if depth else None
    array = f"struct<values: array<{inner}>>" if depth else "string"
    pairs = f"struct<values: array<struct<key: string, value: {inner}>>>" if depth else "string"
    return f"struct<stringValue: string, boolValue: string, intValue: string, doubleValue: string, bytesValue: string, arrayValue: {array}, kvlistValue: {pairs}>"


VALUE = _value(DEPTH)
ATTRIBUTES = f"array<struct<key: string, value: {VALUE}>>"
SCOPE = f"struct<name: string, version: string, attributes: {ATTRIBUTES}>"
RESOURCE = f"struct<attributes: {ATTRIBUTES}>"

SPAN = (
    "struct<traceId: string, spanId: string, parentSpanId: string, traceState: string, name: string, kind: string, "
    f"startTimeUnixNano: string, endTimeUnixNano: string, attributes: {ATTRIBUTES}, "
    "status: struct<code: string, message: string>, events: array<string>, links: array<string>>"
)
TRACES = f"resourceSpans array<struct<resource: {RESOURCE}, scopeSpans: array<struct<scope: {SCOPE}, spans: array<{SPAN}>>>>>"

LOG = (
    "struct<timeUnixNano: string, observedTimeUnixNano: string, severityNumber: string, severityText: string, "
    f"body: {VALUE}, attributes: {ATTRIBUTES}, flags: string, traceId: string, spanId: string>"
)
LOGS = f"resourceLogs array<struct<resource: {RESOURCE}, scopeLogs: array<struct<scope: {SCOPE}, logRecords: array<{LOG}>>>>>"

POINT = (
    f"struct<timeUnixNano: string, asDouble: string, asInt: string, attributes: {ATTRIBUTES}, count: string, sum: string, "
    "min: string, max: string, bucketCounts: array<string>, explicitBounds: array<double>>"
)
METRIC = (
    f"struct<name: string, unit: string, description: string, gauge: struct<dataPoints: array<{POINT}>>, "
    f"sum: struct<dataPoints: array<{POINT}>, aggregationTemporality: string, isMonotonic: string>, "
    f"histogram: struct<dataPoints: array<{POINT}>, aggregationTemporality: string>, "
    f"exponentialHistogram: struct<dataPoints: array<string>>, summary: struct<dataPoints: array<string>>>"
)
METRICS = f"resourceMetrics array<struct<resource: {RESOURCE}, scopeMetrics: array<struct<scope: {SCOPE}, metrics: array<{METRIC}>>>>>"

#: The span table: column, type; in the order in which it is written.
SPAN_COLUMNS = """
timestamp timestamp, message_id string, ingestion_node string, client_name string, account_key string,
trace_id string, span_id string, parent_span_id string, trace_state string,
span_name string, span_kind int, start_time_unix_nano bigint, end_time_unix_nano bigint, duration_nanos bigint,
service_name string, service_namespace string, service_instance_id string, service_version string,
status_code int, status_message string, scope_name string, scope_version string,
resource_attributes map<string, string>, span_attributes map<string, string>, scope_attributes map<string, string>,
events string, links string,
is_error boolean, latency_ms double, has_events boolean, event_count int, link_count int,
http_method string, http_url string, http_status_code int, http_route string,
db_system string, db_operation string, db_name string, messaging_system string, messaging_destination string,
rpc_system string, rpc_service string, rpc_method string, exception_type string, exception_message string,
cloud_provider string, cloud_region string, k8s_namespace string, k8s_pod_name string, container_name string, host_name string,
user_id string, session_id string
"""

#: All three signals in one table; the columns of the other signals are null.
UNIFIED_COLUMNS = """
timestamp timestamp, service_name string, telemetry_type string,
trace_id string, span_id string, parent_span_id string, operation_name string, span_kind bigint, duration_ns bigint, status_code bigint,
metric_name string, metric_value double, metric_unit string, metric_type string,
severity_number bigint, severity_text string, body string, attributes string
"""

_TYPES = {"timestamp": TimestampType(), "string": StringType(), "int": IntegerType(), "bigint": LongType(), "double": DoubleType(), "boolean": BooleanType(), "map<string, string>": MapType(StringType(), StringType())}


def _schema(columns: str) -> StructType:
    """A schema from `name type` pairs; it needs no session."""
    out = StructType()
    for pair in columns.replace("string, string", "string; string").split(","):
        name, _, kind = pair.strip().partition(" ")
        out.add(name, _TYPES[kind.replace(";", ",")])
    return out


SPAN_SCHEMA = _schema(SPAN_COLUMNS)
UNIFIED_SCHEMA = _schema(UNIFIED_COLUMNS)
