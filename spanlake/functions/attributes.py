"""Attribute lists as maps of text, and what is derived from them."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, StringType

from spanlake.sources.schemas import DEPTH


def _number(text: Column) -> Column:
    """Doubles as short text: a trailing .0 goes."""
    return F.regexp_replace(text, r"\.0$", "")


def scalar_text(value: Column) -> Column:
    """A scalar attribute value as text, the first kind that is set; null if none is."""
    return F.coalesce(value["stringValue"], value["boolValue"], value["intValue"], _number(value["doubleValue"]), value["bytesValue"])


def bound(value: Column, f) -> Column:
    """f(value), value being computed once however often f names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def value_text(value: Column, depth: int = DEPTH) -> Column:
    """An attribute value as text: arrays as [a,b] without quotes, lists of pairs as `kvlist`, nothing as empty text. Below DEPTH arrays are as they came."""
    if depth:
        items = value["arrayValue"]["values"]
        array = F.when(items.isNotNull(), F.concat(F.lit("["), F.array_join(F.transform(items, lambda v: value_text(v, depth - 1)), ","), F.lit("]")))
    else:
        array = value["arrayValue"]
    kvlist = F.when(value["kvlistValue"].isNotNull(), "kvlist")
    return F.coalesce(scalar_text(value), array, kvlist, F.lit(""))


def _quoted(text: Column) -> Column:
    """Text as a JSON string."""
    inside = F.to_json(F.array(text))
    return F.substring(inside, F.lit(2), F.length(inside) - 2)


def value_json(value: Column, depth: int = DEPTH) -> Column:
    """An attribute value as JSON text: numbers and booleans bare, bytes as the base64 they came in, arrays and objects nested; null if nothing is set."""
    if depth:
        items, pairs = value["arrayValue"]["values"], value["kvlistValue"]["values"]
        none = F.lit("null")
        array = F.when(items.isNotNull(), F.concat(F.lit("["), F.array_join(F.transform(items, lambda v: F.coalesce(value_json(v, depth - 1), none)), ","), F.lit("]")))
        member = lambda p: F.concat(_quoted(p["key"]), F.lit(":"), F.coalesce(value_json(p["value"], depth - 1), none))
        pairs = F.when(pairs.isNotNull(), F.concat(F.lit("{"), F.array_join(F.transform(pairs, member), ","), F.lit("}")))
    else:
        array, pairs = value["arrayValue"], value["kvlistValue"]
    text = lambda name: F.when(value[name].isNotNull(), _quoted(value[name]))
    return F.coalesce(text("stringValue"), F.lower(value["boolValue"]), value["intValue"], value["doubleValue"], array, pairs, text("bytesValue"))


def last_of_each(pairs: Column) -> Column:
    """Pairs without those whose key comes again; by key, sorted."""
    placed = F.array_sort(F.transform(pairs, lambda p, i: F.named_struct(F.lit("key"), p["key"], F.lit("at"), i, F.lit("value"), p["value"])))
    last = lambda s: F.filter(s, lambda p, i: F.coalesce(F.get(s, i + 1)["key"] != p["key"], F.lit(True)))
    return F.transform(bound(placed, last), lambda p: F.named_struct(F.lit("key"), p["key"], F.lit("value"), p["value"]))


def attribute_map(attributes: Column) -> Column:
    """Attributes with text as a map; the last of repeated keys counts, entries with empty text are dropped, no entries give null."""
    pairs = F.filter(F.transform(attributes, lambda a: F.named_struct(F.lit("key"), a["key"], F.lit("value"), value_text(a["value"]))), lambda p: (p["value"] != "") & p["key"].isNotNull())
    keys = lambda p: F.transform(p, lambda x: x["key"])
    # whatever the session's policy for repeated keys
    unique = lambda p: F.when(F.size(F.array_distinct(keys(p))) == F.size(p), p).otherwise(last_of_each(p))
    return bound(pairs, lambda p: F.when(F.size(p) > 0, F.map_from_entries(unique(p))))


def nanos(value: Column) -> Column:
    """Nanoseconds from text; what is no number counts as 0."""
    return F.coalesce(value.try_cast("bigint"), F.lit(0).cast("bigint"))


def event_time(unix_nano: Column) -> Column:
    """Nanoseconds since the epoch as a timestamp, to the microsecond."""
    return F.timestamp_micros(F.call_function("div", unix_nano, F.lit(1000)))  # / would go through doubles, which don't hold nanoseconds


def rfc3339(unix_nano: Column) -> Column:
    """Nanoseconds as RFC 3339 text in UTC, to the microsecond; 0 is now."""
    at = F.when(unix_nano == 0, F.current_timestamp()).otherwise(event_time(unix_nano))
    return F.date_format(F.convert_timezone(None, F.lit("UTC"), at.cast("timestamp_ntz")), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def duration(start: Column, end: Column) -> Column:
    return F.when(end > start, end - start).otherwise(F.lit(0).cast("bigint"))


def is_error(status_code: Column, http_status_code: Column, exception_type: Column) -> Column:
    return F.coalesce(status_code == 2, F.lit(False)) | F.coalesce(http_status_code >= 400, F.lit(False)) | exception_type.isNotNull()


def sanitize_key(key: Column) -> Column:
    """All but letters, digits, `_` and `-` become `_`."""
    return F.regexp_replace(key, r"[^\p{L}\p{N}_-]", "_")


#: Limits of a flattened record.
MAX_DEPTH, MAX_FIELDS, MAX_ITEMS, MAX_BYTES, KEPT_CHARS = 50, 10_000, 1_000, 10_000, 1_000


def flatten(text: str | None) -> dict[str, str] | None:
    """A JSON document as {path: text}: dots for members, [i] for items, the length of an array at path_length.

    Empty objects and arrays are {} and [], null is null. What lies deeper than MAX_DEPTH, comes after MAX_FIELDS entries or after an array's first
    MAX_ITEMS is named as truncated, as are texts over MAX_BYTES, whose length is told. Text that is no JSON is None.
    """
    try:
        root = json.loads(text)
    except (TypeError, ValueError):
        return None
    out: dict[str, str] = {}
    waiting = [("", root, 0)]
    while waiting:
        path, value, depth = waiting.pop()
        if len(out) >= MAX_FIELDS:
            out["_TRUNCATED_MAX_FIELDS"] = "true"
            break
        if depth > MAX_DEPTH:
            out[f"{path}_TRUNCATED_MAX_DEPTH" if path else "_TRUNCATED_MAX_DEPTH"] = "true"
        elif isinstance(value, dict) and value:
            waiting += [(f"{path}.{k}" if path else k, v, depth + 1) for k, v in reversed(value.items())]
        elif isinstance(value, list) and value:
            out[f"{path}_length"] = str(len(value))
            if len(value) > MAX_ITEMS:
                out[f"{path}[{MAX_ITEMS}]"] = "[TRUNCATED]"
            waiting += [(f"{path}[{i}]", v, depth + 1) for i, v in reversed(list(enumerate(value[:MAX_ITEMS])))]
        elif isinstance(value, str):
            if (size := len(value.encode(errors="replace"))) > MAX_BYTES:
                out[path], out[f"{path}_full_length"] = value[:KEPT_CHARS] + "..._TRUNCATED", str(size)
            else:
                out[path] = value
        else:
            out[path] = "null" if value is None else json.dumps(value)
    return out


@F.pandas_udf(MapType(StringType(), StringType()))
def json_flatten(texts: pd.Series) -> pd.Series:
    """flatten() for a column of JSON documents."""
    return texts.map(flatten)


#: Parts of keys that name what a record is about, and the field they fill; the first that a key holds counts.
SERVICE_FIELDS = (("service.name", "service_name"), ("service.version", "service_version"), ("host.name", "host_name"), ("deployment.environment", "environment"))


def service_metadata(record: Column) -> Column:
    """A struct of SERVICE_FIELDS from a flat record: for each the value of the least key that holds its part."""

    def value(part: str, before: list[str]):
        fits = F.map_filter(record, lambda k, _: F.contains(k, F.lit(part)) & (F.array_size(F.filter(F.array(*map(F.lit, before)), lambda b: F.contains(k, b))) == 0 if before else F.lit(True)))
        return F.try_element_at(fits, F.array_min(F.map_keys(fits)))

    parts = [p for p, _ in SERVICE_FIELDS]
    return F.struct(*(value(part, parts[:i]).alias(name) for i, (part, name) in enumerate(SERVICE_FIELDS)))


def prefixed(headers: Column, telemetry: Column) -> Column:
    """One flat record of a message: its headers under `header.`, its telemetry under `telemetry.`."""
    none = F.create_map().cast("map<string,string>")

    def under(record: Column, prefix: str) -> Column:
        return F.transform_keys(F.coalesce(record, none), lambda k, _: F.concat(F.lit(prefix), k))

    return F.map_concat(under(headers, "header."), under(telemetry, "telemetry."))
