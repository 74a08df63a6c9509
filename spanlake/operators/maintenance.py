"""Retention and compaction of partitioned Parquet tables, and when to do them."""

from __future__ import annotations

import math
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

INDEX_OVERHEAD, COMPACTED_SHARE = 1.2, 0.75
#: Deltas of a partition are combined at so many files, bytes or seconds.
COMBINE_FILES, COMBINE_BYTES, COMBINE_SECONDS = 50, 8 << 30, 900


def expired(partitions: DataFrame, cutoff: datetime) -> DataFrame:
    """Partitions that ended before the cut-off."""
    return partitions.where(F.col("end_time") < F.lit(cutoff))


def split_by_retention(partitions: DataFrame, cutoff: datetime) -> tuple[DataFrame, DataFrame]:
    """What stays and what goes; a partition without an end stays."""
    gone = F.coalesce(F.col("end_time") < F.lit(cutoff), F.lit(False))
    return partitions.where(~gone), partitions.where(gone)


def retention_estimate(partitions: DataFrame, cutoff: datetime) -> DataFrame:
    """One row: partitions, files and bytes that retention would free, indexes included."""
    return expired(partitions, cutoff).agg(F.count("*").alias("partitions"), F.coalesce(F.sum("file_count"), F.lit(0)).alias("files"), (F.coalesce(F.sum("size_bytes"), F.lit(0)) * F.lit(INDEX_OVERHEAD)).alias("bytes"))


def apply_retention(spark: SparkSession, root: str, cutoff: datetime, column: str = "date") -> list[str]:
    """Deletes the partition folders root/…/column=… of days before the cut-off's; returns them."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    path = hadoop.Path(f"{root}/*/{column}=*")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    gone = []
    for found in fs.globStatus(path) or []:
        name = found.getPath().toString()
        if name.rpartition("=")[2] < cutoff.date().isoformat() and fs.delete(found.getPath(), True):
            gone.append(name)
    return sorted(gone)


def compaction_estimate(partitions: DataFrame, max_segments: int) -> DataFrame:
    """Each partition's segments and bytes after compaction."""
    return partitions.select("partition_id", F.least(F.lit(max_segments), F.floor(F.col("segment_count") / 2)).cast("bigint").alias("segments"), (F.col("size_bytes") * F.lit(COMPACTED_SHARE)).alias("bytes"))


def to_combine(files: DataFrame, now: datetime) -> DataFrame:
    """(tenant, signal, partition_key, files, bytes, reason): partitions whose deltas are to be combined; sealed: their hour is over.

    reason is the first that holds of age, files, bytes and sealed, so that what is overdue is named so whatever its size.
    """
    units = files.groupBy("tenant", "signal", "partition_key").agg(F.count("*").alias("files"), F.sum("size_bytes").alias("bytes"), F.min("created_at").alias("oldest"))
    start = F.try_to_timestamp("partition_key", F.lit("yyyy-MM-dd-HH"))
    age = F.unix_seconds(F.lit(now).cast("timestamp")) - F.unix_seconds(F.col("oldest").cast("timestamp"))
    sealed = F.unix_seconds(F.lit(now).cast("timestamp")) - F.unix_seconds(start) > 3600
    reason = F.when(age > COMBINE_SECONDS, "age").when(F.col("files") >= COMBINE_FILES, "files").when(F.col("bytes") >= COMBINE_BYTES, "bytes").when(sealed, "sealed")
    return units.withColumn("reason", reason).where("reason IS NOT NULL").drop("oldest")


def needs_compaction(sizes: list[int], ages: list[float], max_files: int = 10, small: int = 16 << 20, max_age: float = 86_400) -> bool:
    """By number of small files, or by the age of the oldest of several, in seconds."""
    return sum(s < small for s in sizes) > max_files or len(ages) > 1 and max(ages) > max_age


def compact(spark: SparkSession, source: str, target: str, sort_by: str, size_bytes: int, file_bytes: int = 256 << 20) -> None:
    """Rewrites a folder of small files as files of about file_bytes, sorted within; readers switch to the target when it is whole."""
    df = spark.read.parquet(source)
    df.repartition(max(1, math.ceil(size_bytes / file_bytes))).sortWithinPartitions(sort_by).write.mode("errorifexists").option("compression", "zstd").parquet(target)


def wal_removable(entries: DataFrame, last_indexed: int, cutoff: datetime) -> DataFrame:
    """Log entries that are both indexed and older than the cut-off."""
    return entries.where((F.col("sequence") <= last_indexed) & (F.col("created_at") < F.lit(cutoff)))
