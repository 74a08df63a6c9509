"""Tenant, client, index and topic names."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def topic_part(topic: Column, position: int) -> Column:
    """The part of a dotted topic at a place from 0; the first part if there is none."""
    parts = F.split(topic, r"\.")
    return F.coalesce(F.nullif(F.get(parts, F.lit(position)), F.lit("")), F.get(parts, F.lit(0)))


def topic_matches(topic: Column, pattern: str) -> Column:
    """Segment by segment: `*` stands for one segment; further segments of the topic are allowed."""
    parts = [r"[^.]*" if p == "*" else re.escape(p) for p in pattern.split(".")]
    return topic.rlike("^" + r"\.".join(parts) + r"(\.|$)")


def topic_like(topic: Column, pattern: str) -> Column:
    """The whole topic, `*` standing for any text."""
    return topic.rlike("^" + ".*".join(map(re.escape, pattern.split("*"))) + "$")


def payload_type(topic: Column) -> Column:
    return F.when(F.contains(topic, F.lit("trace")), "traces").when(F.contains(topic, F.lit("log")), "logs").when(F.contains(topic, F.lit("metric")), "metrics").otherwise("unknown")


def normalize_client(name: Column) -> Column:
    """Lower case, and `_` for all but letters, digits, `_` and `-`."""
    return F.regexp_replace(F.lower(name), "[^a-z0-9_-]", "_")


def index_name(topic: Column, position: int | None = None, prefix: str = "", default_position: int | None = None, generate: bool = False) -> Column:
    """From the topic's part at position, behind prefix; else at default_position; else a hash if generate; else the first part."""
    parts = F.split(topic, r"\.")
    at = lambda i: F.nullif(F.get(parts, F.lit(i)), F.lit(""))
    options = []
    if position is not None:
        options.append(F.concat(F.lit(prefix), at(position)))
    if default_position is not None:
        options.append(at(default_position))
    options.append(F.concat(F.lit("auto_"), F.lower(F.hex(F.xxhash64(topic)))) if generate else F.get(parts, F.lit(0)))
    return F.coalesce(*options)


def tenant(*candidates: Column, default: str = "default") -> Column:
    """The first candidate that is neither null nor empty."""
    return F.coalesce(*(F.nullif(F.trim(c), F.lit("")) for c in candidates), F.lit(default))


# The forms of topics and of node names that hold a client, and first parts of topics that are none.
TOPIC_CLIENTS = (r"^opentelemetry-traces-(.*)$", r"^traces-(.*)$", r"^(.*)-traces$", r"^(?!(?:v6|opentelemetry|otel|traces|metrics|logs)\.)([^.]*)\.")
NODE_CLIENTS = (r"^ingest(?:ion)?-([^-]*)-.+$", r"^(.*)$")


def _first_match(text: Column, patterns: tuple[str, ...]) -> Column:
    return F.coalesce(*(F.nullif(F.regexp_extract(text, p, 1), F.lit("")) for p in patterns))


def tenant_cascade(metadata: Column, positions: tuple[tuple[str, int], ...] = (), default: str = "default") -> Column:
    """A message's tenant from its metadata, a map, the first that is not empty: client_name as a header or by itself; tenant, unless it is `default`;
    account_key; what the topic tells, by (pattern, position) as in topic_matches() first and then by TOPIC_CLIENTS; index_name; the
    client in source_node, or all of it; else the default."""
    entry = lambda name: F.nullif(F.trim(F.try_element_at(metadata, F.lit(name))), F.lit(""))
    topic = F.coalesce(*map(entry, ("topic", "kafka_topic", "header.topic", "header.kafka_topic")))
    placed = [F.when(topic_matches(topic, pattern), F.get(F.split(topic, r"\."), F.lit(position))) for pattern, position in positions]
    return tenant(entry("header.client_name"), entry("client_name"), F.nullif(entry("tenant"), F.lit("default")), entry("account_key"), *placed, _first_match(topic, TOPIC_CLIENTS), entry("index_name"), _first_match(entry("source_node"), NODE_CLIENTS), default=default)


#: Resource attributes that name an index, in this order.
INDEX_ATTRIBUTES = ("index.name", "service.namespace", "customer.name", "service.name")


def index_cascade(named: Column, resource: Column, default: str = "default") -> Column:
    """The index of a payload: the name that it gives itself, else the first of INDEX_ATTRIBUTES that its resource has, else the default."""
    return tenant(named, *(F.try_element_at(resource, F.lit(k)) for k in INDEX_ATTRIBUTES), default=default)


def severity(text: Column) -> Column:
    """Upper case; WARNING is WARN, CRITICAL is FATAL."""
    up = F.upper(text)
    return F.when(up == "WARNING", "WARN").when(up == "CRITICAL", "FATAL").otherwise(up)


def tenant_from_sql(sql: str) -> str | None:
    """The tenant that a query names in FROM: the schema of schema.table, or what follows `logs_`, `traces_` or `metrics_`; a doubled name counts once."""
    found = re.search(r"\bfrom\s+([A-Za-z0-9_\-]+)(?:\.([A-Za-z0-9_\-]+))?", sql, re.IGNORECASE)
    if not found:
        return None
    schema, table = found.groups()
    if table and (named := re.fullmatch(r"(?:logs|traces|metrics)_(.+)", table)):
        name = named[1]
    elif table:
        name = schema
    elif named := re.fullmatch(r"(?:logs|traces|metrics)_(.+)", schema):
        name = named[1]
    else:
        return None
    half = re.fullmatch(r"(.+)_\1", name)
    return half[1] if half else name


def hour_path(at: Column) -> Column:
    return F.date_format(at, "'year='yyyy'/month='MM'/day='dd'/hour='HH")


def partition_key(at: Column, level: str = "hour") -> Column:
    """The partition of a time: its hour or its day; `unknown` without one."""
    return F.coalesce(F.date_format(at, "yyyy-MM-dd-HH" if level == "hour" else "yyyy-MM-dd"), F.lit("unknown"))


def day_of(key: Column) -> Column:
    """The day's partition that an hour's belongs to; a day's own is itself."""
    return F.regexp_replace(key, r"^(\d{4}-\d{2}-\d{2})-\d{2}$", "$1")


def level_of(key: Column) -> Column:
    """hour or day, by a partition's key; null for neither."""
    return F.when(key.rlike(r"^\d{4}-\d{2}-\d{2}-\d{2}$"), "hour").when(key.rlike(r"^\d{4}-\d{2}-\d{2}$"), "day")
