"""Filters and time ranges of the document query language, compiled to Spark columns."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from spanlake.functions.text import tokens


class Filter:
    """A condition; `column()` gives it as a Spark column. Nulls follow SQL: a row whose condition is null is not kept."""

    def column(self) -> Column:
        raise NotImplementedError

    #: Static cost rank: cheaper conditions are listed first.
    rank = 50

    def __and__(self, other: Filter) -> Filter:
        return And([self, other])

    def __or__(self, other: Filter) -> Filter:
        return Or([self, other])

    def __invert__(self) -> Filter:
        return Not(self)


@dataclass
class Equals(Filter):
    field: str
    value: Any
    rank = 1

    def column(self) -> Column:
        return F.col(self.field) == F.lit(self.value)


@dataclass
class NotEquals(Filter):
    """Rows whose field is null are not kept."""

    field: str
    value: Any

    def column(self) -> Column:
        return F.col(self.field) != F.lit(self.value)


@dataclass
class In(Filter):
    field: str
    values: list

    @property
    def rank(self) -> int:
        return 2 + len(self.values)

    def column(self) -> Column:
        return F.col(self.field).isin(self.values)


@dataclass
class NotIn(Filter):
    """Rows whose field is null are not kept."""

    field: str
    values: list

    def column(self) -> Column:
        return ~F.col(self.field).isin(self.values)


@dataclass
class GreaterThan(Filter):
    field: str
    value: Any
    rank = 10

    def column(self) -> Column:
        return F.col(self.field) > F.lit(self.value)


@dataclass
class LessThan(Filter):
    field: str
    value: Any
    rank = 10

    def column(self) -> Column:
        return F.col(self.field) < F.lit(self.value)


@dataclass
class Between(Filter):
    """From low to high, ends included."""

    field: str
    low: Any
    high: Any
    rank = 9

    def column(self) -> Column:
        return F.col(self.field).between(F.lit(self.low), F.lit(self.high))


@dataclass
class Contains(Filter):
    """mode token: every token of the value is a token of the field; mode substring: the value occurs, case ignored."""

    field: str
    value: str
    mode: str = "token"
    rank = 20

    def column(self) -> Column:
        if self.mode == "substring":
            return F.contains(F.lower(self.field), F.lit(self.value.lower()))
        return F.size(F.array_except(tokens(F.lit(self.value)), tokens(F.col(self.field)))) == 0


@dataclass
class Regex(Filter):
    """The pattern matches anywhere in the field; anchor it to match the whole."""

    field: str
    pattern: str
    rank = 30

    def column(self) -> Column:
        return F.col(self.field).rlike(self.pattern)


@dataclass
class And(Filter):
    filters: list[Filter]
    rank = 5

    def column(self) -> Column:
        out = F.lit(True)
        for f in sorted(self.filters, key=lambda f: f.rank):
            out = out & f.column()
        return out


@dataclass
class Or(Filter):
    filters: list[Filter]
    rank = 15

    def column(self) -> Column:
        out = F.lit(False)
        for f in self.filters:
            out = out | f.column()
        return out


@dataclass
class Not(Filter):
    filter: Filter
    rank = 25

    def column(self) -> Column:
        return ~self.filter.column()


@dataclass
class TimeRange(Filter):
    """Strictly after start and strictly before end."""

    start: datetime
    end: datetime
    field: str = "timestamp"
    rank = 0

    def column(self) -> Column:
        return (F.col(self.field) > F.lit(self.start)) & (F.col(self.field) < F.lit(self.end))


def overlaps(start: str, end: str, since: Any, until: Any) -> Column:
    """Rows whose [start, end] meets [since, until], ends included."""
    return (F.col(start) <= F.lit(until)) & (F.col(end) >= F.lit(since))
