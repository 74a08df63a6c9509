"""Pipeline monitoring over a table of batches, one row a batch.

Columns: batch_id, client_id, node_id, index_name, message_count, size_bytes, created_at, status, error, and a flag a stage.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Stage flags, in order.
STAGES = ("kafka_pip", "wal_pip", "ingest_pip", "storage_pip", "index_pip", "janitor_pip")
PENDING_MINUTES, PENDING_BATCHES = 60, 100


def client_throughput(batches: DataFrame, since: datetime | None = None, until: datetime | None = None) -> DataFrame:
    """(client_id, batches, messages, per_second), most messages first; per_second is over the period, or null without one."""
    if since is not None:
        batches = batches.where(F.col("created_at") >= F.lit(since))
    if until is not None:
        batches = batches.where(F.col("created_at") < F.lit(until))
    seconds = (until - since).total_seconds() if since and until else None
    out = batches.groupBy("client_id").agg(F.count("*").alias("batches"), F.sum("message_count").alias("messages"))
    return out.withColumn("per_second", F.col("messages") / F.lit(seconds).cast("double")).orderBy(F.desc("messages"), "client_id")


def funnel(batches: DataFrame, stages: tuple = STAGES) -> DataFrame:
    """One row: how many batches passed each stage."""
    return batches.agg(F.count("*").alias("total"), *(F.count_if(F.col(s)).alias(s) for s in stages))


def stuck(batches: DataFrame, now: datetime, minutes: int, done: str = "janitor_pip") -> DataFrame:
    """Batches older than so many minutes that haven't passed the last stage, oldest first."""
    return batches.where(~F.col(done) & (F.col("created_at") < F.lit(now - timedelta(minutes=minutes)))).orderBy("created_at", "batch_id")


def search(batches: DataFrame, status: str | None = None, index_name: str | None = None, node_id: str | None = None, min_age_minutes: float | None = None, now: datetime | None = None, limit: int | None = None) -> DataFrame:
    """Batches by exact status and node, part of the index name and least age; oldest first."""
    if status is not None:
        batches = batches.where(F.col("status") == status)
    if node_id is not None:
        batches = batches.where(F.col("node_id") == node_id)
    if index_name is not None:
        batches = batches.where(F.contains("index_name", F.lit(index_name)))
    if min_age_minutes is not None:
        batches = batches.where(age_minutes(now) >= min_age_minutes)
    out = batches.orderBy("created_at", "batch_id")
    return out.limit(limit) if limit else out


def age_minutes(now: datetime | None) -> Column:
    at = F.lit(now) if now is not None else F.current_timestamp()
    return (F.unix_micros(at.cast("timestamp")) - F.unix_micros(F.col("created_at").cast("timestamp"))) / F.lit(60e6)


def status(batches: DataFrame) -> DataFrame:
    """One row over all nodes: batches by status, messages, megabytes."""
    return batches.agg(F.count("*").alias("batches"), F.count_if(F.col("status") == "pending").alias("pending"), F.count_if(F.col("status") == "failed").alias("failed"), F.count_if(F.col("status") == "completed").alias("completed"), F.coalesce(F.sum("message_count"), F.lit(0)).alias("messages"), (F.coalesce(F.sum("size_bytes"), F.lit(0)) / F.lit(1048576.0)).alias("megabytes"))


def nodes(batches: DataFrame) -> DataFrame:
    """The status of each node."""
    return batches.groupBy("node_id").agg(F.count("*").alias("batches"), F.count_if(F.col("status") == "pending").alias("pending"), F.count_if(F.col("status") == "failed").alias("failed"), F.max("created_at").alias("newest")).orderBy("node_id")


def pending(batches: DataFrame, now: datetime | None = None) -> DataFrame:
    """Pending batches with their age, oldest first."""
    return batches.where(F.col("status") == "pending").withColumn("age_minutes", age_minutes(now)).orderBy(F.desc("age_minutes"), "batch_id")


def alerts(batches: DataFrame, now: datetime | None = None) -> DataFrame:
    """(severity, kind, value): the oldest pending batch is too old, too many are pending, or some failed."""
    facts = batches.agg(F.max(F.when(F.col("status") == "pending", age_minutes(now))).alias("oldest"), F.count_if(F.col("status") == "pending").alias("pending"), F.count_if(F.col("status") == "failed").alias("failed"))
    alert = lambda condition, severity, kind, value: F.when(condition, F.struct(F.lit(severity).alias("severity"), F.lit(kind).alias("kind"), value.cast("double").alias("value")))
    found = F.array_compact(F.array(alert(F.col("oldest") > PENDING_MINUTES, "warning", "oldest_pending_minutes", F.col("oldest")), alert(F.col("pending") > PENDING_BATCHES, "warning", "pending_batches", F.col("pending")), alert(F.col("failed") > 0, "error", "failed_batches", F.col("failed"))))
    return facts.select(F.inline(found))


def health(batches: DataFrame, now: datetime | None = None) -> str:
    """unhealthy after an error, degraded after a warning, else healthy."""
    found = {r["severity"] for r in alerts(batches, now).collect()}  # three rows at most
    return "unhealthy" if "error" in found else "degraded" if found else "healthy"


def export(batches: DataFrame, path: str, kind: str = "json") -> None:
    """Writes the batches as CSV with a header, or as JSON lines."""
    writer = batches.write.mode("overwrite")
    writer.option("header", True).csv(path) if kind == "csv" else writer.json(path)
