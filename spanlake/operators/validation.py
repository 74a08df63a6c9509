"""Validation of telemetry rows: every rule's message in one array, and a split into good rows and quarantine."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanlake.functions.names import severity

SEVERITIES = ("TRACE", "DEBUG", "INFO", "WARN", "ERROR", "FATAL")


@dataclass
class Rule:
    """A message and the condition under which it is reported; a null condition reports nothing."""

    message: str
    broken: Column


@dataclass
class FieldRules:
    """What a field must be. kind: string, uint64, int32, hex, enum or any."""

    name: str
    kind: str = "any"
    required: bool = False
    least: float | None = None
    most: float | None = None
    max_length: int | None = None
    length: int | None = None
    pattern: str | None = None
    values: list = field(default_factory=list)

    def rules(self) -> list[Rule]:
        c = F.col(self.name)
        text = c.cast("string")
        out = []
        if self.required:
            out.append(Rule(f"{self.name}: missing", c.isNull() | (text == "")))
        if self.kind == "uint64":
            out.append(Rule(f"{self.name}: not an unsigned integer", c.isNotNull() & text.try_cast("decimal(20,0)").isNull() | (text.try_cast("decimal(20,0)") < 0)))
        if self.kind == "int32":
            out.append(Rule(f"{self.name}: not an integer", c.isNotNull() & text.try_cast("int").isNull()))
        if self.kind == "hex":
            out.append(Rule(f"{self.name}: not hexadecimal", ~text.rlike("^[0-9a-fA-F]*$")))
        if self.kind == "enum" or self.values:
            out.append(Rule(f"{self.name}: not one of the values", ~c.isin(self.values)))
        if self.least is not None:
            out.append(Rule(f"{self.name}: below {self.least}", text.try_cast("double") < self.least))
        if self.most is not None:
            out.append(Rule(f"{self.name}: above {self.most}", text.try_cast("double") > self.most))
        if self.length is not None:
            out.append(Rule(f"{self.name}: length is not {self.length}", F.length(text) != self.length))
        if self.max_length is not None:
            out.append(Rule(f"{self.name}: longer than {self.max_length}", F.length(text) > self.max_length))
        if self.pattern is not None:
            out.append(Rule(f"{self.name}: does not match", ~text.rlike(self.pattern)))
        return out


def attribute_rules(keys: Column, most: int = 128, required: tuple = (), allowed: tuple | None = None) -> list[Rule]:
    """Rules for the keys of an attribute list, an array."""
    out = [
        Rule("attributes: too many", F.size(keys) > most),
        Rule("attributes: key missing", F.exists(keys, lambda k: k.isNull() | (k == ""))),
        Rule("attributes: key repeated", F.size(keys) != F.size(F.array_distinct(keys))),
    ]
    if required:
        out.append(Rule("attributes: required key missing", F.size(F.array_except(F.array(*map(F.lit, required)), keys)) > 0))
    if allowed is not None:
        out.append(Rule("attributes: unknown key", F.size(F.array_except(keys, F.array(*map(F.lit, allowed)))) > 0))
    return out


def span_rules(max_duration_nanos: int | None = None) -> list[Rule]:
    """Rules for rows of the span table."""
    fields = [FieldRules("trace_id", "hex", True, length=32), FieldRules("span_id", "hex", True, length=16), FieldRules("span_name", required=True)]
    out = [r for f in fields for r in f.rules()]
    out.append(Rule("span: ends before it starts", F.col("end_time_unix_nano") < F.col("start_time_unix_nano")))
    if max_duration_nanos is not None:
        out.append(Rule("span: too long", F.col("end_time_unix_nano") - F.col("start_time_unix_nano") > max_duration_nanos))
    return out


def log_rules(now: Column | None = None) -> list[Rule]:
    """Rules for log rows after prepare_logs()."""
    now = F.current_timestamp() if now is None else now
    return [Rule("log: unknown severity", ~F.upper("severity_text").isin(*SEVERITIES)), Rule("log: more than a day ahead", F.col("timestamp") > now + F.expr("INTERVAL 24 HOURS"))]


def metric_rules() -> list[Rule]:
    """Rules for parsed metrics, a struct `x` as in spanlake.sources.schemas.METRIC."""
    kinds = ["gauge", "sum", "histogram", "exponentialHistogram", "summary"]
    n = sum((F.col(f"x.{k}").isNotNull().cast("int") for k in kinds[1:]), F.col("x.gauge").isNotNull().cast("int"))
    bare = lambda p: p["timeUnixNano"].isNull() | (p["asDouble"].isNull() & p["asInt"].isNull())
    lacks = lambda p: p["timeUnixNano"].isNull() | p["count"].isNull() | p["bucketCounts"].isNull()
    return [
        Rule("metric: name missing", F.coalesce(F.col("x.name"), F.lit("")) == ""),
        Rule("metric: not exactly one kind", n != 1),
        Rule("metric: point without value or time", F.exists(F.coalesce("x.gauge.dataPoints", "x.sum.dataPoints"), bare)),
        Rule("sum: temporality must be 0, 1 or 2", F.col("x.sum").isNotNull() & ~F.coalesce(F.col("x.sum.aggregationTemporality").try_cast("int").isin(0, 1, 2), F.lit(False))),
        Rule("sum: isMonotonic missing", F.col("x.sum").isNotNull() & F.col("x.sum.isMonotonic").isNull()),
        Rule("histogram: point lacks fields", F.exists("x.histogram.dataPoints", lacks)),
        Rule("histogram: buckets and bounds don't agree", F.exists("x.histogram.dataPoints", lambda p: F.size(p["bucketCounts"]) != F.size(p["explicitBounds"]) + 1)),
    ]


def prepare_logs(logs: DataFrame) -> DataFrame:
    """Missing times are now, severities are normalised; validation comes after this."""
    return logs.withColumns({"timestamp": F.coalesce("timestamp", F.current_timestamp().cast(logs.schema["timestamp"].dataType)), "severity_text": severity(F.col("severity_text"))})


def validate(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """The rows with `errors`: the message of every rule that is broken, in the rules' order."""
    return df.withColumn("errors", F.array_compact(F.array(*(F.when(r.broken, r.message) for r in rules))))


def split(validated: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Good rows without `errors`, and the quarantine with it."""
    return validated.where(F.size("errors") == 0).drop("errors"), validated.where(F.size("errors") > 0)


def oversized_batches(df: DataFrame, batch_col: str, most: int) -> DataFrame:
    """(batch, n): batches of more rows than allowed."""
    return df.groupBy(batch_col).agg(F.count("*").alias("n")).where(F.col("n") > most)
