"""Operators on small tables."""

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from spanlake.functions import attributes, evolution, names
from spanlake.functions.attributes import flatten
from spanlake.operators import catalog, index_store, indexes, maintenance, monitor, otlp, validation
from spanlake.operators import query as q
from spanlake.operators.filters import And, Between, Contains, Equals, GreaterThan, In, LessThan, Not, NotEquals, NotIn, Or, Regex, TimeRange
from spanlake.operators.search import postings, search, search_postings
from spanlake.plans import sqlapi
from spanlake.sources import storage
from spanlake.sources.schemas import SPAN_SCHEMA, UNIFIED_SCHEMA
from spanlake.streaming import pipelines


def text(value):
    return {"stringValue": value}


def number(value):
    return {"intValue": value}


def trace(**span):
    """A payload with one span, a checkout that calls a shop's payment service; what is given replaces the span's own."""
    one = {
        "traceId": "0af7651916cd43dd8448eb211c80319c",
        "spanId": "b7ad6b7169203331",
        "name": "POST /pay",
        "kind": 3,
        "startTimeUnixNano": "1717400000250000000",
        "endTimeUnixNano": 1717400002250000000,
        "attributes": [{"key": "http.route", "value": text("/pay/{id}")}, {"key": "http.status_code", "value": number("402")}],
        "status": {"code": 1, "message": "declined"},
    } | span
    shop = {"attributes": [{"key": "service.namespace", "value": text("shop")}, {"key": "service.name", "value": text("checkout")}]}
    return {"resourceSpans": [{"resource": shop, "scopeSpans": [{"scope": {"name": "payments", "version": "9"}, "spans": [one]}]}]}


def messages(spark, *documents):
    return spark.createDataFrame([(json.dumps(d) if isinstance(d, dict) else d,) for d in documents], "payload string")


def test_one_span(spark):
    (row,) = otlp.spans(messages(spark, trace())).collect()
    assert len(SPAN_SCHEMA) == 54 and len(row) == 54
    want = {"trace_id": "0af7651916cd43dd8448eb211c80319c", "span_kind": 3, "duration_nanos": 2_000_000_000, "latency_ms": 2000.0, "http_status_code": 402, "http_route": "/pay/{id}", "is_error": True, "service_name": "checkout", "service_namespace": "shop", "scope_version": "9", "status_message": "declined", "has_events": False, "event_count": 0, "events": None, "links": None, "scope_attributes": None, "parent_span_id": None}
    assert {k: row[k] for k in want} == want
    assert row["span_attributes"] == {"http.route": "/pay/{id}", "http.status_code": "402"}


def test_several_resources_scopes_and_spans(spark):
    """Every span has its own resource and scope; missing parts of a payload cost no span."""
    spans = lambda *ids: [{"spanId": i} for i in ids]
    document = {
        "resourceSpans": [
            {"resource": {"attributes": [{"key": "service_name", "value": text("a")}]}, "scopeSpans": [{"scope": {"name": "s1"}, "spans": spans("1", "2")}, {"spans": spans("3")}]},
            {"scopeSpans": [{"scope": {"name": "s2"}, "spans": spans("4")}, {"scope": {"name": "s3"}}, {"scope": {"name": "s4"}, "spans": []}]},
            {"resource": {}, "scopeSpans": None},
        ]
    }
    got = sorted(tuple(r) for r in otlp.spans(messages(spark, document)).select("span_id", "service_name", "scope_name").collect())
    assert got == [("1", "a", "s1"), ("2", "a", "s1"), ("3", "a", None), ("4", "unknown", "s2")]


def test_span_defaults_and_errors(spark):
    nothing = trace(kind=None, startTimeUnixNano="x", endTimeUnixNano=None, status=None, attributes=[{"key": "http.status_code", "value": number(503)}], events=[{"name": "e"}])
    rows = otlp.spans(messages(spark, nothing, trace(status={"code": 2}, attributes=[]), trace(attributes=[{"key": "exception.type", "value": text("E")}]), trace(attributes=[{"key": "http.status_code", "value": number(399)}]))).collect()
    assert (rows[0]["span_kind"], rows[0]["start_time_unix_nano"], rows[0]["duration_nanos"], rows[0]["is_error"], rows[0]["event_count"]) == (1, 0, 0, True, 1)
    assert rows[0]["events"] == '[{"name":"e"}]'
    assert rows[1]["is_error"] and rows[1]["span_attributes"] is None
    assert rows[2]["is_error"] and not rows[3]["is_error"]


def test_payload_forms(spark):
    import base64

    coded = base64.b64encode(json.dumps(trace()).encode()).decode()
    assert otlp.spans(messages(spark, coded, "no json", {"resourceSpans": []}, {"other": 1}, None)).count() == 1


def test_attribute_values(spark):
    values = [text("a"), {"boolValue": True}, {"intValue": 7}, {"intValue": "8"}, {"doubleValue": 1.0}, {"doubleValue": 2.5}, {"bytesValue": "eA=="}, {"arrayValue": {"values": [text("x"), {"intValue": 1}]}}, {"kvlistValue": {"values": []}}, text(""), {}]
    pairs = [{"key": f"k{i}", "value": v} for i, v in enumerate(values)] + [{"key": "k0", "value": text("last")}]
    (row,) = otlp.spans(messages(spark, trace(attributes=pairs))).select("span_attributes").collect()
    assert row[0] == {"k0": "last", "k1": "true", "k2": "7", "k3": "8", "k4": "1", "k5": "2.5", "k6": "eA==", "k7": "[x,1]", "k8": "kvlist"}


def test_logs_metrics_and_unified(spark):
    log = {"resourceLogs": [{"resource": {}, "scopeLogs": [{"scope": {"name": "s"}, "logRecords": [{"timeUnixNano": "1700000000000000000", "severityText": "INFO", "severityNumber": 9, "body": text("hello"), "traceId": "AB"}]}]}]}
    metric = {
        "resourceMetrics": [
            {
                "scopeMetrics": [
                    {
                        "metrics": [
                            {"name": "g", "unit": "1", "gauge": {"dataPoints": [{"timeUnixNano": 1, "asDouble": 1.5}]}},
                            {"name": "c", "sum": {"isMonotonic": True, "dataPoints": [{"timeUnixNano": 1, "asInt": "3"}]}},
                            {"name": "s", "sum": {"isMonotonic": False, "dataPoints": [{"timeUnixNano": 1, "asInt": "4"}]}},
                            {"name": "h", "histogram": {"dataPoints": [{"timeUnixNano": 1, "count": "2", "sum": 5.0, "bucketCounts": ["1", "1"], "explicitBounds": [2.0]}]}},
                            {"name": "x", "summary": {"dataPoints": []}},
                        ]
                    }
                ]
            }
        ]
    }
    (row,) = otlp.logs(messages(spark, log)).collect()
    assert (row["body"], row["severity_number"], row["trace_id"], row["service_name"], row["timestamp"].year) == ("hello", 9, "ab", "unknown", 2023)
    points = {r["metric_name"]: r for r in otlp.metric_points(messages(spark, metric)).collect()}
    assert {k: (r["metric_type"], r["value"]) for k, r in points.items()} == {"g": ("gauge", 1.5), "c": ("counter", 3.0), "s": ("sum", 4.0), "h": ("histogram", None)}
    assert points["h"]["bucket_counts"] == [1, 1]
    every = otlp.unified(messages(spark, trace(), log, metric))
    assert [f.name for f in every.schema] == [f.name for f in UNIFIED_SCHEMA] and len(every.columns) == 18
    assert {r[0]: r[1] for r in every.groupBy("telemetry_type").count().collect()} == {"traces": 1, "logs": 1, "metrics": 4}


def test_unified_parses_a_message_once(spark):
    """One message with all signals, as text and in base64, and lists that are null, empty or hold nulls: the rows of the three tables, by one parse."""
    import base64

    own = [{"attributes": [{"key": "service.name", "value": text("a")}]}, None, {"attributes": []}]
    scopes = lambda scope, items, some: [{"resource": r, scope: [None, {items: None}, {}, {"scope": {"name": "s"}, items: [None, *some]}]} for r in own] + [None, {"resource": own[0]}]
    points = [{"asInt": "3", "timeUnixNano": "1717400000250000000", "attributes": [{"key": "p", "value": text("q")}]}, None, {"sum": 2.5}]
    whole = {
        "resourceSpans": scopes("scopeSpans", "spans", [{"name": "n", "startTimeUnixNano": "1717400000250000000", "endTimeUnixNano": 1717400002250000000}, {}]),
        "resourceLogs": scopes("scopeLogs", "logRecords", [{"severityNumber": 9, "timeUnixNano": "1717400000250000000", "body": text("b"), "traceId": "AB"}]),
        "resourceMetrics": scopes("scopeMetrics", "metrics", [{"name": "g", "gauge": {"dataPoints": points}}, {"name": "c", "sum": {"isMonotonic": True, "dataPoints": points[:1]}}, {"name": "none", "summary": {"dataPoints": []}}, {"name": "empty", "gauge": {}}]),
    }
    raw = json.dumps(whole)
    given = spark.createDataFrame([(raw,), (base64.b64encode(raw.encode()).decode(),), ("{}",), ("no json {",), ("AAAA",), ("[]",), (None,), ('{"resourceLogs":null,"resourceSpans":[]}',)], "payload string")
    every = otlp.unified(given)
    found = sorted(map(str, every.drop("timestamp").collect()))
    kinds = {r["telemetry_type"]: r["count"] for r in every.groupBy("telemetry_type").count().collect()}
    assert kinds == {"traces": 12, "logs": 6, "metrics": 18} == {"traces": otlp.spans(given).count(), "logs": otlp.logs(given).count(), "metrics": otlp.metric_points(given).count()}
    span = otlp.spans(given).selectExpr("service_name", "'traces' AS telemetry_type", "trace_id", "span_id", "parent_span_id", "span_name AS operation_name", "CAST(span_kind AS bigint) AS span_kind", "duration_nanos AS duration_ns", "CAST(status_code AS bigint) AS status_code", "'{}' AS attributes")
    log = otlp.logs(given).selectExpr("service_name", "'logs' AS telemetry_type", "trace_id", "span_id", "severity_number", "severity_text", "body", "'{}' AS attributes")
    point = otlp.metric_points(given).selectExpr("service_name", "'metrics' AS telemetry_type", "metric_name", "coalesce(value, sum) AS metric_value", "unit AS metric_unit", "metric_type", "to_json(coalesce(attributes, CAST(map() AS map<string,string>))) AS attributes")
    want = span.unionByName(log, allowMissingColumns=True).unionByName(point, allowMissingColumns=True).select(every.drop("timestamp").columns)
    assert found == sorted(map(str, want.collect()))
    assert every.where("timestamp = TIMESTAMP '2024-06-03 07:33:20.25'").count() == 6 + 6 + 12
    assert every._jdf.queryExecution().optimizedPlan().toString().count("from_json(") == 1


def test_flatten():
    assert flatten('{"a": {"b": [1, {"c": null}], "e": {}, "f": []}, "t": true}') == {"a.b_length": "2", "a.b[0]": "1", "a.b[1].c": "null", "a.e": "{}", "a.f": "[]", "t": "true"}
    assert flatten("x") is None and flatten(None) is None and flatten("5") == {"": "5"}
    long = flatten(json.dumps({"s": "y" * 20_000, "a": [0] * 1_001}))
    assert long["s_full_length"] == "20000" and len(long["s"]) == 1_000 + len("..._TRUNCATED") and long["a[1000]"] == "[TRUNCATED]"
    deep = "x"
    for _ in range(60):
        deep = {"k": deep}
    assert any("TRUNCATED_MAX_DEPTH" in k for k in flatten(json.dumps(deep)))
    assert "_TRUNCATED_MAX_FIELDS" in flatten(json.dumps({str(i): i for i in range(20_000)}))


def test_records(spark):
    df = spark.createDataFrame([({"service.name": "a", "host.name": "h", "x": "1"}, {"h": "1"})], "r map<string,string>, h map<string,string>")
    row = df.select(attributes.service_metadata(F.col("r")).alias("m"), attributes.prefixed(F.col("h"), F.col("r")).alias("p"), attributes.sanitize_key(F.lit("service.näme-1_x")).alias("k"), attributes.rfc3339(F.lit(1700000000123456789)).alias("t")).first()
    assert (row["m"]["service_name"], row["m"]["host_name"], row["m"]["environment"]) == ("a", "h", None)
    assert row["p"] == {"header.h": "1", "telemetry.service.name": "a", "telemetry.host.name": "h", "telemetry.x": "1"}
    assert (row["k"], row["t"]) == ("service_näme-1_x", "2023-11-14T22:13:20.123456Z")


def test_names(spark):
    topic = F.lit("v1.acme.prod.traces.x")
    row = spark.range(1).select(names.topic_part(topic, 1), names.topic_part(topic, 9), names.topic_matches(topic, "v1.*.prod"), names.topic_matches(topic, "v1.prod"), names.topic_like(topic, "v1.*.x"), names.payload_type(topic), names.normalize_client(F.lit("A b.C")), names.index_name(topic, 1, "p-"), names.index_name(topic, 9, default_position=2), names.index_name(topic, 9, generate=True), names.tenant(F.lit(None), F.lit(" "), F.lit("t")), names.tenant(F.lit("")), names.severity(F.lit("Warning"))).first()
    assert tuple(row)[:9] == ("acme", "v1", True, False, True, "traces", "a_b_c", "p-acme", "prod")
    assert row[9].startswith("auto_") and tuple(row)[10:] == ("t", "default", "WARN")
    assert [names.tenant_from_sql(s) for s in ("select * from acme.traces", "SELECT 1 FROM lake.logs_acme WHERE x", "select * from logs_acme_acme", "select * from traces", "select 1")] == ["acme", "acme", "acme", None, None]


@pytest.fixture(scope="module")
def rows(spark):
    data = [(1, "a", 1.0, "hello world", datetime(2024, 1, 1, 10)), (2, "b", 5.0, "Hello there", datetime(2024, 1, 1, 11)), (3, None, None, None, datetime(2024, 1, 2)), (4, "a", 9.0, "world world", datetime(2024, 1, 3))]
    return spark.createDataFrame(data, "id long, k string, v double, message string, timestamp timestamp")


@pytest.mark.parametrize(
    ("condition", "ids"),
    [
        (Equals("k", "a"), [1, 4]),
        (NotEquals("k", "a"), [2]),
        (In("k", ["a", "b"]), [1, 2, 4]),
        (NotIn("k", ["a"]), [2]),
        (GreaterThan("v", 5), [4]),
        (LessThan("v", 5), [1]),
        (Contains("message", "HELLO"), [1, 2]),
        (Contains("message", "hell"), []),
        (Contains("message", "hell", mode="substring"), [1, 2]),
        (Contains("message", "world hello"), [1]),
        (Regex("message", "^h"), [1]),
        (And([]), [1, 2, 3, 4]),
        (Or([Equals("k", "b"), GreaterThan("v", 8)]), [2, 4]),
        (Not(Equals("k", "a")), [2]),
        (TimeRange(datetime(2024, 1, 1, 10), datetime(2024, 1, 3)), [2, 3]),
        (Equals("k", "a") & ~LessThan("v", 5) | Equals("id", 3), [3, 4]),
    ],
)
def test_filters(rows, condition, ids):
    assert sorted(r["id"] for r in q.run(rows, q.Query([condition])).hits.collect()) == ids


def test_query_pages_and_aggregations(rows):
    result = q.run(rows, q.Query(sort=[q.Sort("v", False), q.Sort("id")], limit=2, offset=1, aggregations={"k": q.GroupBy("k", aggregations=[q.Sum("v", "s"), q.DateHistogram("timestamp", "day", name="d", aggregations=[q.Count("c")])])}))
    assert [r["id"] for r in result.hits.collect()] == [2, 1] and result.total_hits == 4
    assert result.aggregations["k"].count() == 4
    outer, inner = q.levels(rows, q.GroupBy("k", aggregations=[q.Sum("v", "s"), q.Histogram("v", 5, name="h")]))
    assert {r["k"]: (r["doc_count"], r["s"]) for r in outer.collect()} == {"a": (2, 10.0), "b": (1, 5.0), None: (1, None)}
    assert {(r["k"], r["h"]) for r in inner.collect()} == {("a", 0.0), ("a", 5.0), ("b", 5.0), (None, None)}


def test_plan_kind():
    kinds = [q.plan_kind(x) for x in (q.Query(time_range=TimeRange(1, 2)), q.Query([Regex("a", "b")]), q.Query([Equals("a", 1)]), q.Query([Equals("a", 1)], aggregations={"c": q.Count()}), q.Query())]
    assert kinds == ["time_series", "full_text", "inverted", "columnar", "several"]


def test_search(rows):
    assert [r["id"] for r in search(rows, "hello", "id", "message").collect()] == [1, 2]
    assert [r["id"] for r in search(rows, "world", "id", "message").collect()] == [4, 1]
    assert search(rows, "absent", "id", "message").count() == 0
    posts = postings(rows, "id", "message")
    assert posts.where("token = 'world' AND id = 4").first()["tf"] == 2
    for text in ("hello", "world", "hello world", "absent"):
        assert [(r["id"], round(r["score"], 9)) for r in search_postings(posts, text).collect()] == [(r["id"], round(r["score"], 9)) for r in search(rows, text, "id", "message").collect()]


def test_indexes(spark):
    df = spark.createDataFrame([("f1", 0, "trace1", "INFO", 1.0), ("f1", 1, "trace2", "ERROR", 2.0), ("f1", 2, None, "INFO", None), ("f2", 0, "trace9", "WARN", 50.0)], "file string, row long, trace_id string, severity string, v double")
    file = F.col("file")
    zones = indexes.zone_map(df, file, ["trace_id", "v"])
    assert {(r["file"], r["column"]): (r["min_number"], r["max_text"], r["null_count"]) for r in zones.collect()} == {("f1", "trace_id"): (None, "trace2", 1), ("f1", "v"): (1.0, None, 1), ("f2", "trace_id"): (None, "trace9", 0), ("f2", "v"): (50.0, None, 0)}
    bits, hashes = indexes.bloom_size(100)
    filters = indexes.bloom(df, file, "trace_id", bits, hashes)
    assert [[r[0] for r in indexes.bloom_files(filters, v, bits, hashes).collect()] for v in ("trace1", "trace9", "nonexistent")] == [["f1"], ["f2"], []]
    maps = indexes.bitmap(df, file, F.col("row"), "severity")
    assert {r["value"]: r["n"] for r in indexes.bitmap_counts(maps).collect()} == {"INFO": 2, "ERROR": 1, "WARN": 1}
    files = spark.createDataFrame([("f1",), ("f2",), ("unindexed",)], "file string")
    pruned = lambda c: sorted(r[0] for r in indexes.prune(files, c, zones, {"trace_id": (filters, bits, hashes)}, {"severity": maps}).collect())
    assert pruned(Equals("trace_id", "trace1")) == ["f1", "unindexed"]
    assert pruned(GreaterThan("v", 10)) == ["f2", "unindexed"]
    assert pruned(LessThan("v", 10)) == ["f1", "unindexed"]
    assert pruned(In("severity", ["WARN"])) == ["f2", "unindexed"]
    assert pruned(And([Equals("severity", "INFO"), GreaterThan("v", 10)])) == ["unindexed"]
    assert pruned(Contains("severity", "x")) == ["f1", "f2", "unindexed"]


def test_bloom_has_no_false_negatives(spark):
    df = spark.range(3_000).select(F.lit("f").alias("file"), F.col("id").alias("x"))
    bits, hashes = indexes.bloom_size(3_000)
    filters = indexes.bloom(df, F.col("file"), "x", bits, hashes).cache()
    assert all(indexes.bloom_files(filters, v, bits, hashes).count() for v in (0, 1, 1_500, 2_999))
    assert sum(indexes.bloom_files(filters, v, bits, hashes).count() for v in range(5_000, 5_020)) <= 2


def test_bloom_filters_follow_their_files(spark, tmp_path):
    """A file with more values than a filter is made for gets a larger one, alone and in the index store; rows without a file are in none."""
    from spanlake.plans import registry

    from tests.conftest import SMALL, same_rows

    at = F.timestamp_seconds(F.lit(1704067200) + F.col("id") % 60 * 3600).cast("timestamp_ntz")
    rows = spark.range(150_000).select(at.alias("ts"), (F.floor(F.col("id") / 60) + 100).alias("user_id"))
    rows = rows.unionByName(spark.range(2).select(F.when(F.col("id") == 0, at).alias("ts"), F.lit(7).cast("bigint").alias("user_id")))
    rows.coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    same_rows(registry.QUERIES["bloom_probe"](spark, str(tmp_path)), registry.SQL["bloom_probe"].replace("FROM events", f"FROM '{tmp_path}/events.parquet/*.parquet'"), SMALL)

    filters = indexes.bloom_by_size(spark.range(5_010).select(F.when(F.col("id") < 5_000, "large").otherwise("small").alias("f"), "id"), F.col("f"), "id", 10).cache()
    assert filters.groupBy("file").agg(F.max("bits")).count() == filters.select("bits").distinct().count() == 2
    found = {(r["file"], int(r["value"])) for r in indexes.bloom_hits(filters, [*range(4_900, 5_100)], "bigint").collect()}
    assert found >= {("large", v) for v in range(4_900, 5_000)} | {("small", v) for v in range(5_000, 5_010)} and len(found) <= 120
    root = str(tmp_path / "lake")
    storage.write(spark.range(3_000).select(F.lit("acme").alias("client_name"), F.lit(datetime(2024, 1, 1)).alias("timestamp"), (F.col("id") * 2).alias("n")), root, "logs", "timestamp")
    index_store.build(spark, root, "logs", index_store.Plan(blooms=("n",), rows=10))
    assert index_store.paths_for(spark, root, "logs", In("n", [1_001, 1_003, 1_005])) == [] != index_store.paths_for(spark, root, "logs", In("n", [1_001, 1_004]))


def test_validation(spark):
    spans = otlp.spans(messages(spark, trace(), trace(traceId="xyz", endTimeUnixNano="5")))
    good, bad = validation.split(validation.validate(spans, validation.span_rules(3 * 10**9)))
    assert good.count() == 1 and "errors" not in good.columns
    assert bad.first()["errors"] == ["trace_id: not hexadecimal", "trace_id: length is not 32", "span: ends before it starts"]
    logs = spark.createDataFrame([("WARNING", None), ("odd", datetime(2020, 1, 1)), ("info", datetime.now() + timedelta(days=3))], "severity_text string, timestamp timestamp")
    checked = validation.validate(validation.prepare_logs(logs), validation.log_rules()).collect()
    assert [r["errors"] for r in checked] == [[], ["log: unknown severity"], ["log: more than a day ahead"]]
    keys = spark.createDataFrame([(["a", "a"],), (["b", None],), (["r"],)], "keys array<string>")
    errors = [r["errors"] for r in validation.validate(keys, validation.attribute_rules(F.col("keys"), 1, ("r",), ("r", "a"))).collect()]
    assert errors[0] == ["attributes: too many", "attributes: key repeated", "attributes: required key missing"] and errors[2] == []
    field = validation.FieldRules("x", "uint64", True, least=2, most=5, max_length=1)
    rows = spark.createDataFrame([("3",), ("-1",), (None,), ("12",), ("z",)], "x string")
    assert [len(r["errors"]) for r in validation.validate(rows, field.rules()).collect()] == [0, 3, 1, 2, 1]


def test_metric_rules(spark):
    from pyspark.sql.functions import from_json

    from spanlake.sources.schemas import METRIC

    good = {"name": "m", "gauge": {"dataPoints": [{"timeUnixNano": "1", "asDouble": 1}]}}
    bad = [{"name": "", "gauge": good["gauge"]}, {"name": "m"}, {"name": "m", "sum": {"dataPoints": [{"asInt": "1"}]}}, {"name": "m", "histogram": {"dataPoints": [{"timeUnixNano": "1", "count": "1", "bucketCounts": ["1"], "explicitBounds": [1.0]}]}}]
    df = messages(spark, *({"x": m} for m in [good, *bad])).select(from_json("payload", f"x {METRIC}").alias("j")).select("j.x")
    errors = [r["errors"] for r in validation.validate(df, validation.metric_rules()).collect()]
    assert errors == [[], ["metric: name missing"], ["metric: not exactly one kind"], ["metric: point without value or time", "sum: temporality must be 0, 1 or 2", "sum: isMonotonic missing"], ["histogram: buckets and bounds don't agree"]]


def test_evolution(spark):
    a = StructType([StructField("x", IntegerType(), False), StructField("b", StringType(), False)])
    b = StructType([StructField("x", StringType(), False), StructField("c", LongType())])
    merged = evolution.merge_schemas(a, b)
    assert [(f.name, f.dataType.simpleString(), f.nullable) for f in merged] == [("b", "string", True), ("c", "bigint", True), ("x", "string", True)]
    rows = evolution.union_evolving(spark.createDataFrame([(1, "p")], a), spark.createDataFrame([("q", 2)], b)).collect()
    assert [tuple(r) for r in rows] == [("p", None, None), (None, 2, "q")]
    assert evolution.normalize_field_name("a[3].b[10]") == "a[*].b[*]"
    assert evolution.schemas_compatible(StructType([StructField("a[1]", LongType())]), StructType([StructField("a[2]", LongType())]))
    assert not evolution.schemas_compatible(a, b)


def test_storage_and_sql(spark, tmp_path):
    root = str(tmp_path / "lake")
    df = spark.createDataFrame([("acme", datetime(2024, 1, d, 12), d, float("nan") if d == 3 else d / 2) for d in range(1, 6)] + [("other", datetime(2024, 1, 1), 99, 1.0)], "client_name string, timestamp timestamp, n int, v double")
    storage.write(df, root, "traces", "timestamp")
    read = storage.read(spark, root, "traces", "acme", datetime(2024, 1, 2), datetime(2024, 1, 4))
    assert sorted(r["n"] for r in read.collect()) == [2, 3]
    assert "PartitionFilters" in read._jdf.queryExecution().toString() and storage.file_stats(spark.read.parquet(f"{root}/traces"), ["n"]).count() == 6
    assert storage.register(spark, root, "acme") == ["traces"]
    answer = sqlapi.search(spark, root, sqlapi.SearchQuery("SELECT n, v FROM traces ORDER BY n", limit=2, offset=2, client_id="acme"))
    assert answer.rows == [{"n": 3, "v": None}, {"n": 4, "v": 2.0}] and (answer.total_count, answer.has_more, answer.columns) == (5, True, ["n", "v"])
    assert sqlapi.search(spark, root, sqlapi.SearchQuery("SELECT count(*) AS limit_free FROM traces", limit=9, client_id="other")).rows == [{"limit_free": 1}]
    last = sqlapi.search(spark, root, sqlapi.SearchQuery("SELECT n FROM traces ORDER BY n", limit=3, offset=4, client_id="acme"))
    assert (last.rows, last.total_count, last.has_more) == ([{"n": 5}], 5, False)
    whole = sqlapi.search(spark, root, sqlapi.SearchQuery("SELECT n FROM traces ORDER BY n", client_id="acme"))
    assert (whole.rows, whole.total_count) == ([], None) and [json.loads(r[0])["n"] for r in whole.results.collect()] == [1, 2, 3, 4, 5]
    other = sqlapi.search(spark, root, sqlapi.SearchQuery("SELECT n FROM traces", client_id="other"))  # its views don't replace the other search's
    assert other.results.count() == 1 and whole.results.count() == 5
    for query in (f"SELECT * FROM parquet.`{root}/traces`", f"SELECT 1 WHERE EXISTS (SELECT 1 FROM json.`{root}`)", "SELECT reflect('java.lang.System', 'nanoTime')"):
        with pytest.raises(ValueError, match="only"):
            sqlapi.search(spark, root, sqlapi.SearchQuery(query, limit=1, client_id="acme"))
    assert storage.project(df, ["n", "absent"]).columns == ["n"]
    maintenance.compact(spark, f"{root}/traces", f"{root}/compact", "timestamp", 1)
    assert spark.read.parquet(f"{root}/compact").count() == 6
    assert len(maintenance.apply_retention(spark, f"{root}/traces", datetime(2024, 1, 3))) == 3
    assert spark.read.parquet(f"{root}/traces").count() == 3


def test_only_reading_sql(spark, tmp_path):
    spark.range(3).createOrReplaceTempView("three")
    for writes in ("DROP TABLE x", "WITH q AS (SELECT 1 AS id) INSERT INTO t SELECT id FROM q", "FROM three INSERT INTO t SELECT id", "CREATE VIEW v AS SELECT 1", "SET a = 1", "CACHE TABLE three", f"INSERT OVERWRITE DIRECTORY '{tmp_path}/x' USING parquet SELECT 1"):
        with pytest.raises(ValueError, match="read"):
            sqlapi.sql(spark, writes)
    with pytest.raises(ValueError, match="one SQL statement"):
        sqlapi.sql(spark, "SELECT 1; SELECT 2")
    for reads in ("SELECT id FROM three", "FROM three SELECT id", "(SELECT id FROM three);", "WITH q AS (SELECT * FROM three) SELECT id FROM q", "TABLE three"):
        assert sqlapi.sql(spark, reads).count() == 3
    assert sqlapi.sql(spark, "SHOW TABLES").count() > 0 and sqlapi.sql(spark, "EXPLAIN SELECT 1").count() == 1 and sqlapi.sql(spark, "DESCRIBE three").count() == 1


def test_index_store(spark, tmp_path):
    """Built for new files alone, published, combined, withdrawn, and used to read fewer files with the same rows."""
    root, at = str(tmp_path / "lake"), datetime(2024, 5, 1)
    rows = lambda days: spark.createDataFrame([(f"c{i % 2}", at + timedelta(days=d, hours=i % 24), d * 100 + i, float(i), "x" if i % 7 else "rare", f"word{i % 5} text") for d in days for i in range(40)], "client_name string, timestamp timestamp, n long, v double, kind string, body string")
    plan = index_store.Plan(zones=("n", "v"), blooms=("n", "v"), bitmaps=("kind",), texts=("body",), rows=200)
    storage.write(rows(range(3)), root, "logs", "timestamp")
    files = lambda condition, **more: index_store.paths_for(spark, root, "logs", condition, **more)
    assert index_store.files(spark, root) is None and len(files(Equals("n", 5))) == 6
    assert index_store.build(spark, root, "logs", plan) == 6 and index_store.build(spark, root, "logs", plan) == 0
    assert len(files(Equals("n", 105))) == 1 and len(files(Equals("v", 7))) == 3 and len(files(Equals("v", 7), tenant="c0")) == 0
    assert len(files(Between("n", 90, 110))) == 2 and len(files(Or([Equals("n", 1), Equals("n", 201)]))) == 2 and len(files(GreaterThan("n", 10), until=at + timedelta(hours=30))) == 4
    storage.write(rows([3]), root, "logs", "timestamp")
    assert len(files(Equals("n", 105))) == 3  # the two new ones might hold it
    assert index_store.build(spark, root, "logs", plan) == 2 and len(files(Equals("n", 105))) == 1

    def same(*conditions):
        data = storage.read(spark, root, "logs")
        for condition in conditions or (And([Equals("kind", "rare"), Or([Between("n", 100, 130), Equals("n", 7)])]),):
            got = index_store.read(spark, root, "logs", condition)
            assert sorted(r["n"] for r in got.collect()) == sorted(r["n"] for r in data.where(condition.column()).collect())

    same(Equals("kind", "rare"), In("n", [3, 303]), Or([Between("n", 10, 12), GreaterThan("n", 330)]), Not(Equals("n", 5)), Equals("v", 7))
    by_level = lambda: {(r["level"], r["partition"]): r["files"] for r in index_store.coverage(spark, root, "logs", "c0").collect()}
    assert set(by_level()) == {("hour", f"2024-05-0{d}-00") for d in range(1, 5)}
    assert index_store.combine_day(spark, root, "logs", "2024-05-02") == 2 and index_store.combine_day(spark, root, "logs", "2024-06-01") == 0
    assert ("day", "2024-05-02") in by_level() and ("hour", "2024-05-02-00") not in by_level()
    kinds = index_store.index_rows(spark, root, "zone", "logs", "c0").where("column = 'n'").select("level", "partition").distinct().collect()
    assert sorted(tuple(r) for r in kinds) == [("day", "2024-05-02"), ("hour", "2024-05-01-00"), ("hour", "2024-05-03-00"), ("hour", "2024-05-04-00")]
    assert index_store.index_rows(spark, root, "postings", "logs").where("token = 'word3'").count() == 32
    same()
    index_store.combine_day(spark, root, "logs", "2024-05-02")  # again: the later one counts
    assert by_level()["day", "2024-05-02"] == 1
    same()
    index_store.withdraw(spark, root, [r["snapshot_id"] for r in index_store.snapshots(spark, root).collect()])
    assert ("hour", "2024-05-02-00") in by_level()
    same()
    # a run that broke off before its last step
    index_store._append(index_store._stored(spark, root, "bloom", "logs").withColumn("run", F.lit("broken")), f"{root}/_index/bloom", "tenant", "signal", "level", "partition")
    same()


def test_index_values_of_any_type(spark):
    """Values are looked up as the column's type writes them, whatever type they are given in."""
    df = spark.createDataFrame([("f", 0, 7.0, True, datetime(2024, 1, 1)), ("g", 1, 8.5, False, datetime(2024, 1, 2, 3))], "file string, row long, d double, b boolean, t timestamp")
    bits, hashes = indexes.bloom_size(10)
    for name, kind, value, file in (("d", "double", 7, "f"), ("b", "boolean", True, "f"), ("t", "timestamp", datetime(2024, 1, 2, 3), "g"), ("t", "timestamp", datetime(2024, 1, 1), "f")):
        filters = indexes.bloom(df, F.col("file"), name, bits, hashes)
        assert [r[0] for r in indexes.bloom_files(filters, value, bits, hashes, kind).collect()] == [file]
        maps = indexes.bitmap(df, F.col("file"), F.col("row"), name)
        files = df.select("file")
        assert [r[0] for r in indexes.prune(files, Equals(name, value), None, {name: (filters, bits, hashes)}, {name: maps}, {name: kind}).collect()] == [file]
        assert [(r["file"], r["row_index"]) for r in indexes.bitmap_rows(maps, value, kind).collect()] == [(file, "fg".index(file))]
    blocks = indexes.zone_map(df.unionByName(df.withColumn("row", F.col("row") + 100)), F.lit("x"), ["d"], F.floor(F.col("row") / 100))
    assert sorted((r["block"], r["min_number"], r["max_number"]) for r in blocks.collect()) == [(0, 7.0, 8.5), (1, 7.0, 8.5)]
    assert indexes.prune(spark.createDataFrame([("x",)], "file string"), Between("d", 9, 10), blocks).count() == 0
    many = spark.range(70_000).select(F.lit("f").alias("file"), F.col("id").alias("row"), (F.col("id") % 1000).alias("v"))
    rows = indexes.bitmap_rows(indexes.bitmap(many, F.col("file"), F.col("row"), "v"), 999)
    assert sorted(r["row_index"] for r in rows.collect()) == list(range(999, 70_000, 1000))


def test_catalog(spark):
    t = datetime(2024, 1, 1)
    files = spark.createDataFrame([("a", "acme", "logs", t, t + timedelta(hours=1), t, t), ("b", "acme", "logs", t + timedelta(hours=2), t + timedelta(hours=3), None, t + timedelta(hours=1))], "file_ulid string, tenant string, signal string, min_ts timestamp, max_ts timestamp, indexed_at timestamp, created_at timestamp")
    assert [r["file_ulid"] for r in catalog.files_between(files, "acme", "logs", t, t + timedelta(hours=5)).collect()] == ["a"]
    snapshots = spark.createDataFrame([(1, "hour", ["a"], t), (2, "day", ["a"], t), (3, "day", ["b"], None)], "snapshot_id long, level string, file_ulids array<string>, published_at timestamp")
    assert [tuple(r) for r in catalog.coverage(files, snapshots).collect()] == [("snapshot", "day", "2"), ("snapshot", "hour", "1"), ("file", "delta", "b")]
    spans = spark.createDataFrame([("t", "1", None, "root"), ("t", "2", "1", "child"), ("t", "3", "1", "child2"), ("t", "4", "9", "orphan")], "trace_id string, span_id string, parent_span_id string, span_name string")
    assert {r["span_id"]: (r["parent_name"], r["siblings"]) for r in catalog.trace_tree(spans).collect()} == {"1": (None, 0), "2": ("root", 1), "3": ("root", 1), "4": (None, 0)}
    assert catalog.partition_counters(spark.createDataFrame([(1, 2, 3), (1, 5, 7)], "partition_id int, row_count long, size_bytes long")).first()["bytes"] == 10


def test_monitor_and_maintenance(spark, tmp_path):
    now = datetime(2024, 1, 1, 12)
    data = [(i, f"c{i % 2}", "n1", "logs", 10, 1 << 20, now - timedelta(minutes=30 * i), "pending" if i else "failed", i == 0) for i in range(4)]
    batches = spark.createDataFrame(data, "batch_id long, client_id string, node_id string, index_name string, message_count long, size_bytes long, created_at timestamp, status string, janitor_pip boolean")
    assert {r["kind"]: r["value"] for r in monitor.alerts(batches, now).collect()} == {"oldest_pending_minutes": 90.0, "failed_batches": 1.0}
    assert monitor.health(batches, now) == "unhealthy" and monitor.health(batches.limit(0), now) == "healthy"
    assert [r["batch_id"] for r in monitor.pending(batches, now).collect()] == [3, 2, 1]
    assert tuple(monitor.status(batches).first())[:3] == (4, 3, 1) and monitor.status(batches).first()["megabytes"] == 4.0
    assert [r["batch_id"] for r in monitor.search(batches, min_age_minutes=45, now=now).collect()] == [3, 2]
    for kind in ("csv", "json"):
        monitor.export(batches, str(tmp_path / kind), kind)
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == spark.read.json(str(tmp_path / "json")).count() == 4
    files = spark.createDataFrame([("t", "logs", "2024-01-01-10", 5, now)] * 2 + [("t", "logs", "2024-01-01-12", 5, now)], "tenant string, signal string, partition_key string, size_bytes long, created_at timestamp")
    assert [(r["partition_key"], r["reason"]) for r in maintenance.to_combine(files, now).collect()] == [("2024-01-01-10", "sealed")]
    parts = spark.createDataFrame([(1, now - timedelta(days=9), 8, 100), (2, None, 3, 40)], "partition_id int, end_time timestamp, segment_count long, size_bytes long")
    stay, go = maintenance.split_by_retention(parts, now)
    assert [r[0] for r in stay.collect()] == [2] and [r[0] for r in go.collect()] == [1]
    assert {r[0]: (r[1], r[2]) for r in maintenance.compaction_estimate(parts, 3).collect()} == {1: (3, 75.0), 2: (1, 30.0)}
    assert maintenance.needs_compaction([1] * 20, [1.0]) and not maintenance.needs_compaction([1 << 30], [1e9])
    wal = spark.createDataFrame([(1, now - timedelta(days=2)), (9, now - timedelta(days=2)), (2, now)], "sequence long, created_at timestamp")
    assert [r[0] for r in maintenance.wal_removable(wal, 5, now - timedelta(days=1)).collect()] == [1]


def test_reasons_to_combine(spark):
    """What is overdue is named so even where it holds many files or bytes; the others by number, size and end of their hour."""
    now = datetime(2024, 1, 1, 12)
    unit = lambda hour, n, size, minutes: [("t", "logs", f"2024-01-01-{hour}", size, now - timedelta(minutes=minutes))] * n
    rows = unit("08", 60, 5, 120) + unit("09", 2, 5 << 30, 16) + unit("10", 60, 5, 10) + unit("11", 2, 5 << 30, 10) + unit("12", 3, 5, 10) + unit("07", 1, 5, 1)
    files = spark.createDataFrame(rows, "tenant string, signal string, partition_key string, size_bytes long, created_at timestamp")
    found = {r["partition_key"][-2:]: (r["files"], r["reason"]) for r in maintenance.to_combine(files, now).collect()}
    assert found == {"07": (1, "sealed"), "08": (60, "age"), "09": (2, "age"), "10": (60, "files"), "11": (2, "bytes")}


def test_streaming(spark, tmp_path):
    source, sink = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    for i in range(3):
        (source / f"{i}.jsonl").write_text("\n".join([json.dumps(trace(startTimeUnixNano=str((1700000000 + 60 * i) * 10**9)))] * 2) + "\n\n")
    spans = otlp.spans(pipelines.json_lines(spark, str(source), 1))
    pipelines.start(spans, pipelines.once_per_batch(sink, "timestamp"), str(tmp_path / "checkpoint")).awaitTermination()
    pipelines.start(spans, pipelines.once_per_batch(sink, "timestamp"), str(tmp_path / "checkpoint")).awaitTermination()
    assert spark.read.parquet(sink).count() == 6

    events = spark.createDataFrame([(1, "a", datetime(2024, 1, 1, 0, m), 1.0) for m in (0, 1, 10, 40)], "id long, k string, ts timestamp, v double")
    events.write.parquet(str(tmp_path / "events"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "events"))
    query = pipelines.windows(stream, "ts", "10 minutes", ["k"], "v", late="1 minute").writeStream.outputMode("complete").format("memory").queryName("w").trigger(availableNow=True).start()
    query.awaitTermination()
    batch = pipelines.windows(events, "ts", "10 minutes", ["k"], "v")
    assert sorted(map(tuple, spark.sql("SELECT * FROM w").collect())) == sorted(map(tuple, batch.collect()))
    query = pipelines.deduplicated(stream, ["id"], "ts", "1 hour").writeStream.format("memory").queryName("d").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.sql("SELECT * FROM d").count() == 1
    assert pipelines.sessions(events, "ts", "15 minutes", ["k"]).count() == 2


def test_indexed_stream(spark, tmp_path):
    """Micro-batches are written and indexed as they come; one that comes again leaves its rows once."""
    root, source = str(tmp_path / "lake"), str(tmp_path / "in")
    schema = "client_name string, timestamp timestamp, service_name string, severity_text string, body string, trace_id string, span_id string"
    rows = lambda k: spark.createDataFrame([("c", datetime(2024, 1, 1, i), f"s{k}", "INFO", f"word{i}", f"t{k}{i}", "s") for i in range(5)], schema)
    for k in range(2):
        rows(k).coalesce(1).write.mode("append").parquet(source)
    plan = index_store.plan_of(index_store.LOG_INDEX, rows=100)
    assert plan.blooms == ("trace_id", "span_id", "service_name") and plan.texts == ("body",) and plan.zones == ("timestamp",)
    sink = pipelines.indexed_once_per_batch(root, "logs", "timestamp", plan)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    pipelines.start(stream, sink, str(tmp_path / "checkpoint")).awaitTermination()
    found = lambda: [r["body"] for r in index_store.read(spark, root, "logs", Equals("trace_id", "t13")).collect()]
    assert found() == ["word3"] and len(index_store.paths_for(spark, root, "logs", Equals("trace_id", "t13"))) == 1
    sink(rows(1), 1)
    sink(rows(1).limit(0), 7)
    assert found() == ["word3"] and spark.read.parquet(f"{root}/logs").count() == 10


def test_ingest(spark, tmp_path):
    log = {"resourceLogs": [{"scopeLogs": [{"logRecords": [{"timeUnixNano": "1700000000000000000", "severityText": s} for s in ("warning", "odd")]}]}]}
    batch, root = messages(spark, trace(), trace(spanId="no"), log), str(tmp_path / "lake")
    for _ in range(2):
        pipelines.ingest_once_per_batch(root)(batch, 3)
    count = lambda path: spark.read.parquet(f"{root}/{path}").count()
    assert [count(p) for p in ("traces", "logs", "metrics", "_quarantine/traces", "_quarantine/logs")] == [1, 1, 0, 1, 1]
    assert spark.read.parquet(f"{root}/_quarantine/logs").first()["errors"] == ["log: unknown severity"]


def test_catalog_states(spark, tmp_path):
    path = str(tmp_path / "partitions")
    catalog.record(spark.createDataFrame([(1, "pending"), (2, "pending")], "id int, status string"), path)
    catalog.record(spark.createDataFrame([(1, "stored")], "id int, status string"), path)
    assert sorted(map(tuple, catalog.current(spark, path, ["id"]).collect())) == [(1, "stored"), (2, "pending")]


def test_batches(spark):
    df = spark.createDataFrame([("a", i, "t", "x" * 10) for i in range(5)] + [("b", 9, "t", "y")], "client string, offset long, topic string, payload string")
    records = pipelines.batch_records(pipelines.tenant_batches(df, "client", 2, 1_000), "client")
    assert sorted((r["client_id"], r["message_count"], r["first_offset"], r["last_offset"]) for r in records.collect()) == [("a", 1, 4, 4), ("a", 2, 0, 1), ("a", 2, 2, 3), ("b", 1, 9, 9)]
    headers = "array<struct<key:string,value:binary>>"
    kafka = spark.createDataFrame([("v1.acme.logs", b"{}", [("client_name", b"old"), ("client_name", b"shop"), ("index_name", b"")]), ("v1.acme.traces", b"", None), ("v1.acme.metrics", b"{}", None)], f"topic string, value binary, headers {headers}")
    assert [(r["client_name"], r["index_name"], r["payload_type"]) for r in pipelines.with_topic(kafka).collect()] == [("shop", "v1", "logs"), ("acme", "v1", "metrics")]
    assert [r["client_name"] for r in pipelines.with_topic(kafka.drop("headers")).collect()] == ["acme", "acme"]


def test_batches_start_anew_at_each_flush(spark):
    """A message far over the limit ends its own batch; those behind it fill theirs as if it had not been."""
    sizes = [3, 1000] + [1] * 250
    rows = spark.createDataFrame([(c, p, i, "x" * n) for c in ("a", None) for p in (0, 1) for i, n in enumerate(sizes)], "client string, part int, offset long, payload string")
    got = pipelines.tenant_batches(rows, "client", 100, 100, buffers=("part",)).collect()
    assert len(got) == len(rows.collect())
    want, number, count, size = [], 0, 0, 0
    for n in sizes:
        want.append(number)
        count, size = count + 1, size + n
        if count >= 100 or size >= 100:
            number, count, size = number + 1, 0, 0
    for c in ("a", None):
        for p in (0, 1):
            assert [r["batch_no"] for r in sorted((r for r in got if r["client"] == c and r["part"] == p), key=lambda r: r["offset"])] == want


def test_bronze(spark, tmp_path):
    kept = storage.bronze(spark.createDataFrame([("a",), (None,), ("b",)], "payload string"))
    kept.withColumn("payload", F.when(F.col("payload") == "b", "c").otherwise(F.col("payload"))).write.parquet(str(tmp_path / "b"))
    good, damaged = storage.replay(spark, str(tmp_path / "b"))
    assert sorted(str(r[0]) for r in good.collect()) == ["None", "a"] and [r["payload"] for r in damaged.collect()] == ["c"]
    assert storage.spread(kept).rdd.getNumPartitions() >= 4


def test_nested_values(spark):
    nested = {"arrayValue": {"values": [{"arrayValue": {"values": [{"arrayValue": {"values": [{"arrayValue": {"values": [text("deep")]}}]}}, text('q"')]}}, {"kvlistValue": {"values": [{"key": "a", "value": number(1)}, {"key": "b"}]}}, {"bytesValue": "eA=="}, {}]}}
    rows = spark.createDataFrame([(json.dumps({"v": v}),) for v in (nested, {"boolValue": True}, {"doubleValue": 1.5}, {})], "j string")
    from spanlake.sources.schemas import VALUE

    got = rows.select(attributes.value_text(F.from_json("j", f"v {VALUE}")["v"]).alias("t"), attributes.value_json(F.from_json("j", f"v {VALUE}")["v"]).alias("j")).collect()
    assert got[0]["t"] == '[[[{"values":[{"stringValue":"deep"}]}],q"],kvlist,eA==,]'
    assert json.loads(got[0]["j"]) == [[[{"values": [{"stringValue": "deep"}]}], 'q"'], {"a": 1, "b": None}, "eA==", None]
    assert [r["j"] for r in got[1:]] == ["true", "1.5", None]


def test_attribute_maps_with_repeats(spark):
    spark.conf.set("spark.sql.mapKeyDedupPolicy", "EXCEPTION")
    pairs = [{"key": f"k{i % 90}", "value": text(str(i))} for i in range(300)] + [{"key": "k1", "value": text("")}, {"value": text("no key")}]
    (row,) = otlp.spans(messages(spark, trace(attributes=pairs))).select("span_attributes").collect()
    assert row[0] == {f"k{i % 90}": str(i) for i in range(300)}
