"""Registered queries of the document query language and of text search."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from spanlake.operators import query as q
from spanlake.operators.filters import Between, Contains, Equals, GreaterThan, In, LessThan, Not, NotEquals, NotIn, Regex, TimeRange
from spanlake.operators.search import search
from spanlake.plans.registry import query
from spanlake.sources.storage import spread

EVENT = ["event_id", "event_type", "value"]
EVENT_SQL = "SELECT event_id, event_type, value FROM events WHERE "


def hits(df, *filters, **more):
    return q.run(df, q.Query(list(filters), **more)).hits


@query("SELECT event_id, ts, event_type FROM events")
def scan_project(t):
    return t.events.select("event_id", "ts", "event_type")


@query(EVENT_SQL + "event_type = 'click'")
def filter_equals(t):
    return hits(t.events, Equals("event_type", "click")).select(EVENT)


@query(EVENT_SQL + "event_type <> 'click'")
def filter_not_equals(t):
    return hits(t.events, NotEquals("event_type", "click")).select(EVENT)


@query(EVENT_SQL + "event_type IN ('click', 'view')")
def filter_in(t):
    return hits(t.events, In("event_type", ["click", "view"])).select(EVENT)


@query(EVENT_SQL + "event_type NOT IN ('click', 'view')")
def filter_not_in(t):
    return hits(t.events, NotIn("event_type", ["click", "view"])).select(EVENT)


@query(EVENT_SQL + "value > 50")
def filter_gt(t):
    return hits(t.events, GreaterThan("value", 50.0)).select(EVENT)


@query(EVENT_SQL + "value < 10")
def filter_lt(t):
    return hits(t.events, LessThan("value", 10.0)).select(EVENT)


@query("SELECT doc_id, lang FROM documents WHERE contains(lower(text), 'tion')")
def filter_contains(t):
    return hits(t.documents, Contains("text", "tion", mode="substring")).select("doc_id", "lang")


@query(r"SELECT doc_id, lang FROM documents WHERE list_contains(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'), 'with')")
def filter_token(t):
    return hits(spread(t.documents), Contains("text", "with")).select("doc_id", "lang")


@query("SELECT doc_id, lang FROM documents WHERE regexp_matches(text, '[0-9]{4}')")
def filter_regex(t):
    return hits(spread(t.documents), Regex("text", "[0-9]{4}")).select("doc_id", "lang")


@query(EVENT_SQL + "(event_type = 'click' AND value > 20) OR NOT (event_type IN ('view', 'click') OR value < 5)")
def filter_bool(t):
    both = (Equals("event_type", "click") & GreaterThan("value", 20.0)) | Not(In("event_type", ["view", "click"]) | LessThan("value", 5.0))
    return hits(t.events, both).select(EVENT)


@query(EVENT_SQL + "value BETWEEN 20 AND 30")
def filter_between(t):
    return hits(t.events, Between("value", 20.0, 30.0)).select(EVENT)


@query("SELECT event_id, ts FROM events WHERE ts > TIMESTAMP '2024-01-05 00:00:00' AND ts < TIMESTAMP '2024-01-12 12:00:00'")
def filter_time_range(t):
    return hits(t.events, time_range=TimeRange(datetime(2024, 1, 5), datetime(2024, 1, 12, 12), "ts")).select("event_id", "ts")


@query("SELECT count(*) AS n FROM events WHERE value > 10")
def agg_count(t):
    return q.run(t.events, q.Query([GreaterThan("value", 10.0)], aggregations={"n": q.Count("n")})).aggregations["n"]


@query("SELECT round(sum(value), 4) AS sum, round(avg(value), 6) AS avg, min(value) AS min, max(value) AS max FROM events")
def agg_sum_avg_min_max(t):
    found = q.metrics(t.events, q.Sum("value", "sum"), q.Avg("value", "avg"), q.Min("value", "min"), q.Max("value", "max"))
    return found.select(F.round("sum", 4).alias("sum"), F.round("avg", 6).alias("avg"), "min", "max")


@query("SELECT event_type, count(*) AS doc_count, round(sum(value), 2) AS total FROM events GROUP BY event_type")
def agg_group_by(t):
    return q.aggregate(t.events, q.GroupBy("event_type", aggregations=[q.Sum("value", "total")])).withColumn("total", F.round("total", 2))


@query("SELECT event_type, user_id, count(*) AS doc_count, max(value) AS most FROM events GROUP BY event_type, user_id")
def agg_group_by_nested(t):
    return q.aggregate(t.events, q.GroupBy("event_type", aggregations=[q.GroupBy("user_id", aggregations=[q.Max("value", "most")])]))


@query("SELECT floor(value / 50.0) * 50.0 AS bucket, count(*) AS doc_count FROM events GROUP BY 1")
def agg_histogram(t):
    return q.aggregate(t.events, q.Histogram("value", 50, name="bucket"))


@query("SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS doc_count, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")
def agg_date_histogram(t):
    nested = q.DateHistogram("ts", "hour", name="hour", aggregations=[q.GroupBy("event_type", aggregations=[q.Sum("value", "total")])])
    return q.aggregate(t.events, nested).withColumn("total", F.round("total", 2))


@query("SELECT time_bucket(INTERVAL '15 minutes', ts, TIMESTAMP '1970-01-01') AS slot, count(*) AS doc_count FROM events GROUP BY 1")
def agg_date_histogram_fixed(t):
    return q.aggregate(t.events, q.DateHistogram("ts", "15 minutes", name="slot"))


@query("SELECT event_id, value FROM events ORDER BY value DESC, event_id LIMIT 100")
def sort_limit(t):
    return hits(t.events, sort=[q.Sort("value", False), q.Sort("event_id")], limit=100).select("event_id", "value")


@query("SELECT event_id, value FROM events ORDER BY value DESC, event_id LIMIT 50 OFFSET 200")
def offset_page(t):
    return hits(t.events, sort=[q.Sort("value", False), q.Sort("event_id")], limit=50, offset=200).select("event_id", "value")


@query(
    r"""
    WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS words FROM documents),
    corpus AS (SELECT count(*) AS n, avg(len(words)) AS mean FROM w WHERE len(words) > 0),
    tf AS (
        SELECT doc_id, len(words) AS length, term, len(list_filter(words, lambda x: x = term)) AS tf
        FROM w, (SELECT unnest(['with', 'that']) AS term) WHERE list_contains(words, term)),
    df AS (SELECT term, count(*) AS df FROM tf GROUP BY term)
    SELECT doc_id AS id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))), 6) AS score
    FROM tf JOIN df USING (term), corpus GROUP BY doc_id HAVING count(*) = 2 ORDER BY score DESC, id LIMIT 20"""
)
def text_topk(t):
    return search(spread(t.documents), "with that", "doc_id", "text", 20).withColumn("score", F.round("score", 6))
