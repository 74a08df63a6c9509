"""Document queries: filters, time range, sort, page and nested aggregations over any DataFrame."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanlake.operators.filters import And, Contains, Equals, Filter, In, Regex, TimeRange


class Aggregation:
    """A metric, or buckets with aggregations inside."""


@dataclass
class Count(Aggregation):
    name: str = "count"

    def column(self) -> Column:
        return F.count("*").alias(self.name)


@dataclass
class _Metric(Aggregation):
    field: str
    name: str | None = None
    function = ""

    def column(self) -> Column:
        return getattr(F, self.function)(F.col(self.field).cast("double")).alias(self.name or f"{self.function}_{self.field}")


class Sum(_Metric):
    function = "sum"


class Avg(_Metric):
    function = "avg"


class Min(_Metric):
    function = "min"


class Max(_Metric):
    function = "max"


@dataclass
class Buckets(Aggregation):
    aggregations: list[Aggregation] = field(default_factory=list, kw_only=True)
    name: str | None = field(default=None, kw_only=True)

    def key(self) -> Column:
        raise NotImplementedError


@dataclass
class GroupBy(Buckets):
    field: str

    def key(self) -> Column:
        return F.col(self.field).alias(self.name or self.field)


@dataclass
class Histogram(Buckets):
    """Buckets of a fixed width; the key is a bucket's lower end."""

    field: str
    interval: float

    def key(self) -> Column:
        width = F.lit(float(self.interval))
        return (F.floor(F.col(self.field) / width) * width).alias(self.name or self.field)


#: Intervals that follow the calendar; all others are fixed, such as "15 minutes".
CALENDAR = ("second", "minute", "hour", "day", "week", "month", "quarter", "year")


@dataclass
class DateHistogram(Buckets):
    """Buckets of a calendar unit or a fixed interval; the key is a bucket's start."""

    field: str
    interval: str

    def key(self) -> Column:
        unit = self.interval.lower().removeprefix("1 ").rstrip("s")
        out = F.date_trunc(unit, self.field) if unit in CALENDAR else F.window(self.field, self.interval)["start"]
        return out.alias(self.name or self.field)


@dataclass
class Sort:
    field: str
    ascending: bool = True

    def column(self) -> Column:
        """Nulls come last either way."""
        return F.col(self.field).asc_nulls_last() if self.ascending else F.col(self.field).desc_nulls_last()


@dataclass
class Query:
    filters: list[Filter] = field(default_factory=list)
    time_range: TimeRange | None = None
    sort: list[Sort] = field(default_factory=list)
    limit: int | None = None
    offset: int = 0
    aggregations: dict[str, Aggregation] = field(default_factory=dict)


@dataclass
class Result:
    """hits is sorted and paged; total_hits counts all matches; aggregations are over all matches."""

    hits: DataFrame
    matches: DataFrame
    aggregations: dict[str, DataFrame]

    @property
    def total_hits(self) -> int:
        return self.matches.count()


def aggregate(df: DataFrame, aggregation: Aggregation) -> DataFrame:
    """One row a bucket, nested keys side by side: doc_count and the metrics of the innermost level.

    Every level of buckets becomes a grouping column, so a nested query is one shuffle.
    """
    keys, level = [], aggregation
    while isinstance(level, Buckets):
        keys.append(level.key())
        inner = [a for a in level.aggregations if isinstance(a, Buckets)]
        if len(inner) > 1:
            raise ValueError("a level holds one kind of buckets at most; ask for the others apart")
        metrics = [a.column() for a in level.aggregations if not isinstance(a, Buckets)]
        if not inner:
            return df.groupBy(*keys).agg(F.count("*").alias("doc_count"), *metrics)
        level = inner[0]
    return df.agg(level.column())


def metrics(df: DataFrame, *wanted: Aggregation) -> DataFrame:
    """One row with several metrics over all rows, in one pass."""
    return df.agg(*(m.column() for m in wanted))


def levels(df: DataFrame, aggregation: Buckets) -> list[DataFrame]:
    """A DataFrame for each level of nested buckets, outermost first, each with its own doc_count and metrics."""
    out, keys, level = [], [], aggregation
    while isinstance(level, Buckets):
        keys.append(level.key())
        out.append(df.groupBy(*keys).agg(F.count("*").alias("doc_count"), *(a.column() for a in level.aggregations if not isinstance(a, Buckets))))
        level = next((a for a in level.aggregations if isinstance(a, Buckets)), None)
    return out


def run(df: DataFrame, query: Query) -> Result:
    """Applies the whole query: every filter and the time range, then sort and page for hits."""
    conditions = query.filters + ([query.time_range] if query.time_range else [])
    matches = df.where(And(conditions).column()) if conditions else df
    hits = matches.orderBy(*(s.column() for s in query.sort)) if query.sort else matches
    if query.offset:
        hits = hits.offset(query.offset)
    if query.limit:
        hits = hits.limit(query.limit)
    return Result(hits, matches, {name: aggregate(matches, a) for name, a in query.aggregations.items()})


def plan_kind(query: Query) -> str:
    """Which index a query would favour, the first that applies: time_series, full_text, inverted, columnar or several."""
    kinds = [type(f) for f in query.filters]
    text = any(k in (Contains, Regex) for k in kinds)
    if query.time_range and not text:
        return "time_series"
    if text:
        return "full_text"
    if any(k in (Equals, In) for k in kinds) and not query.aggregations:
        return "inverted"
    return "columnar" if query.aggregations else "several"
