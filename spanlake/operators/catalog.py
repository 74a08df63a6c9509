"""Catalog tables as DataFrames: partitions, segments, files, artifacts, snapshots, and reports over them."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanlake.operators.filters import overlaps


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Upsert: of each key the row that is last by order, compared column by column."""
    others = [c for c in rows.columns if c not in keys and c not in order]
    best = rows.groupBy(*keys).agg(F.max(F.struct(*order, *others)).alias("best"))
    return best.select(*keys, *(F.col(f"best.{c}") for c in rows.columns if c not in keys)).select(rows.columns)


def record(rows: DataFrame, path: str) -> None:
    """Inserts or updates catalog rows: each is a new state, appended with the time of the change."""
    rows.withColumn("changed_at", F.current_timestamp()).write.mode("append").parquet(path)


def current(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """The last state of each of a catalog's rows."""
    return latest(spark.read.parquet(path), keys, ["changed_at"]).drop("changed_at")


def partitions_between(partitions: DataFrame, since: datetime, until: datetime) -> DataFrame:
    """Partitions that meet [since, until], oldest first."""
    return partitions.where(overlaps("start_time", "end_time", since, until)).orderBy("start_time")


def files_between(files: DataFrame, tenant: str, signal: str, since: datetime, until: datetime) -> DataFrame:
    """Indexed files that meet [since, until]."""
    return files.where((F.col("tenant") == tenant) & (F.col("signal") == signal) & F.col("indexed_at").isNotNull() & overlaps("min_ts", "max_ts", since, until))


def artifacts_by_type(files: DataFrame, artifacts: DataFrame, kinds: list[str]) -> DataFrame:
    """A row a file with the URL of each kind of artifact, null where it has none."""
    urls = artifacts.groupBy("file_ulid").pivot("artifact_type", kinds).agg(F.min("artifact_url"))
    return files.join(urls.select("file_ulid", *(F.col(k).alias(f"{k}_url") for k in kinds)), "file_ulid", "left")


def snapshot_files(snapshots: DataFrame, files: DataFrame) -> DataFrame:
    """(snapshot_id, and the file's columns): the files that each snapshot covers."""
    each = snapshots.select("snapshot_id", F.explode("file_ulids").alias("file_ulid")).distinct()
    return each.join(files, "file_ulid")


def unindexed(files: DataFrame, artifacts: DataFrame, limit: int = 100) -> DataFrame:
    """Files without any artifact, oldest first."""
    return files.join(artifacts.select("file_ulid").distinct(), "file_ulid", "left_anti").orderBy("created_at", "file_ulid").limit(limit)


def not_indexed(files: DataFrame, tenant: str, signal: str, limit: int = 100) -> DataFrame:
    """A tenant's files of a signal that no index run has marked, oldest first."""
    return files.where((F.col("tenant") == tenant) & (F.col("signal") == signal) & F.col("indexed_at").isNull()).orderBy("created_at", "file_ulid").limit(limit)


def index_stats(artifacts: DataFrame) -> DataFrame:
    """(artifact_type, artifacts, files, documents, bytes, mean_build_seconds) of artifacts (artifact_type, file_ulid, document_count, size_bytes, build_seconds)."""
    by = artifacts.groupBy("artifact_type", "file_ulid").agg(F.count("*").alias("n"), F.sum("document_count").alias("d"), F.sum("size_bytes").alias("b"), F.sum("build_seconds").alias("s"))
    return by.groupBy("artifact_type").agg(F.sum("n").alias("artifacts"), F.count("*").alias("files"), F.sum("d").alias("documents"), F.sum("b").alias("bytes"), (F.sum("s") / F.sum("n")).alias("mean_build_seconds"))


def coverage(files: DataFrame, snapshots: DataFrame) -> DataFrame:
    """(kind, level, id): published snapshots, day before hour before delta and newest first, then files that none of them covers."""
    published = snapshots.where("published_at IS NOT NULL")
    covered = published.select(F.explode("file_ulids").alias("file_ulid")).distinct()
    rank = F.when(F.col("level") == "day", 0).when(F.col("level") == "hour", 1).otherwise(2)
    combined = published.select(F.lit("snapshot").alias("kind"), "level", F.col("snapshot_id").cast("string").alias("id"), rank.alias("r"), F.col("published_at").alias("at"))
    deltas = files.join(covered, "file_ulid", "left_anti").select(F.lit("file").alias("kind"), F.lit("delta").alias("level"), F.col("file_ulid").cast("string").alias("id"), F.lit(3).alias("r"), F.col("created_at").alias("at"))
    return combined.unionByName(deltas).orderBy("r", F.desc("at"), "id").select("kind", "level", "id")


def storage_stats(partitions: DataFrame, segments: DataFrame) -> DataFrame:
    """One row: partitions, segments of these, their rows and bytes; partitions without segments count. Segment ids are unique within a partition's."""
    kept = partitions.select("partition_id").distinct()
    sums = segments.groupBy("partition_id").agg(F.count_distinct("segment_id").alias("segments"), F.sum("row_count").alias("rows"), F.sum("size_bytes").alias("bytes"))
    total = lambda name: F.coalesce(F.sum(name), F.lit(0)).alias(name)
    return kept.join(sums, "partition_id", "left").agg(F.count("*").alias("partitions"), total("segments"), total("rows"), total("bytes"))


def partition_counters(segments: DataFrame) -> DataFrame:
    """What upkeep on every insert and delete would have counted, a row a partition."""
    return segments.groupBy("partition_id").agg(F.count("*").alias("segments"), F.sum("row_count").alias("rows"), F.sum("size_bytes").alias("bytes"))


def segment_lifecycle(segments: DataFrame) -> DataFrame:
    """One row of counts by ingestion, storage and index state. orphaned: indexed, not stored; missing: stored, index failed."""
    is_ = lambda c, v: F.col(c) == v
    return segments.agg(
        F.count("*").alias("total"),
        F.count_if(is_("storage_status", "pending")).alias("storage_pending"),
        F.count_if(is_("storage_status", "stored")).alias("stored"),
        F.count_if(is_("storage_status", "failed")).alias("storage_failed"),
        F.count_if(is_("index_status", "pending")).alias("index_pending"),
        F.count_if(is_("index_status", "indexed")).alias("indexed"),
        F.count_if(is_("index_status", "failed")).alias("index_failed"),
        F.count_if(is_("index_status", "indexed") & (F.col("storage_status") != "stored")).alias("orphaned"),
        F.count_if(is_("storage_status", "stored") & is_("index_status", "failed")).alias("missing"),
    )


def next_offsets(messages: DataFrame) -> DataFrame:
    """(topic, partition, next_offset): what a consumer would commit."""
    return messages.groupBy("topic", "partition").agg((F.max("offset") + 1).alias("next_offset"))


def field_stats(df: DataFrame, columns: list[str], exact: bool = False) -> DataFrame:
    """(field, cardinality, null_count, min, max, avg_size), values as text; cardinality is approximate unless exact."""
    each = df.select(F.inline(F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("v")) for c in columns))))
    if not exact:
        return each.groupBy("field").agg(F.approx_count_distinct("v").alias("cardinality"), F.count_if(F.col("v").isNull()).alias("null_count"), F.min("v").alias("min"), F.max("v").alias("max"), F.avg(F.length("v")).alias("avg_size"))
    values = each.groupBy("field", "v").agg(F.count("*").alias("n"))
    known = F.when(F.col("v").isNotNull(), F.col("n"))
    sizes = F.try_divide(F.sum(F.length("v") * F.col("n")), F.sum(known)).cast("double")
    return values.groupBy("field").agg(F.count("v").alias("cardinality"), F.coalesce(F.sum(F.when(F.col("v").isNull(), F.col("n"))), F.lit(0)).alias("null_count"), F.min("v").alias("min"), F.max("v").alias("max"), sizes.alias("avg_size"))


def trace_tree(spans: DataFrame) -> DataFrame:
    """Each span with its parent's id and name, and how many siblings it has; root and orphan spans have no parent name."""
    child = spans.alias("c")
    parent = spans.select(F.col("trace_id").alias("t"), F.col("span_id").alias("p"), F.col("span_name").alias("parent_name"))
    joined = child.join(parent, (F.col("c.trace_id") == F.col("t")) & (F.col("c.parent_span_id") == F.col("p")), "left").drop("t", "p")
    return joined.withColumn("siblings", F.count("*").over(Window.partitionBy("trace_id", "parent_span_id")) - 1)
