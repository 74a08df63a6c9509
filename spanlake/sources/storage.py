"""Tables of a tenant: layout, readers, writers and JSON results."""

from __future__ import annotations

import tempfile
import uuid
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SIGNALS = ("traces", "metrics", "logs")


def write(df: DataFrame, root: str, signal: str, time_col: str, tenant_col: str = "client_name", max_records: int = 1_000_000, mode: str = "append") -> None:
    """Appends Parquet under root/signal/tenant=/date=, sorted by time within files, so that row groups can be skipped.

    Rows are clustered by the partition columns first; adaptive execution splits a large tenant's day over several tasks.
    """
    out = df.withColumns({"tenant": F.coalesce(F.col(tenant_col), F.lit("default")), "date": F.to_date(time_col)})
    out = out.hint("rebalance", "tenant", "date").sortWithinPartitions("tenant", "date", time_col)
    out.write.mode(mode).partitionBy("tenant", "date").option("compression", "zstd").option("maxRecordsPerFile", max_records).parquet(f"{root}/{signal}")


def read(spark: SparkSession, root: str, signal: str, tenant: str | None = None, since: datetime | None = None, until: datetime | None = None, time_col: str = "timestamp") -> DataFrame:
    """A signal's rows, of one tenant and from since to before until where given: partitions are pruned, and the exact times kept."""
    df = spark.read.parquet(f"{root}/{signal}")
    if tenant is not None:
        df = df.where(F.col("tenant") == tenant)
    if since is not None:
        df = df.where((F.col("date") >= F.lit(since.date())) & (F.col(time_col) >= F.lit(since)))
    if until is not None:
        df = df.where((F.col("date") <= F.lit(until.date())) & (F.col(time_col) < F.lit(until)))
    return df


def scratch(spark: SparkSession) -> str:
    """A new folder below the shared one that the session names in spark.checkpoint.dir; a local session that names none, as in tests, gets a temporary one."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return f"{shared or tempfile.mkdtemp()}/lake-{uuid.uuid4().hex}"


def exists(spark: SparkSession, folder: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def register(spark: SparkSession, root: str, tenant: str, signals: tuple = SIGNALS) -> list[str]:
    """Temporary views named as the signals, over all files of a tenant; returns those that exist."""
    found = []
    for signal in signals:
        if exists(spark, f"{root}/{signal}"):
            read(spark, root, signal, tenant).createOrReplaceTempView(signal)
            found.append(signal)
    return found


def spread(df: DataFrame) -> DataFrame:
    """df over all cores where its files give fewer partitions; for work on rows that costs far more than moving them. Streams stay as they are."""
    if df.isStreaming:
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def project(df: DataFrame, columns: list[str]) -> DataFrame:
    """Those of the columns that there are."""
    return df.select([c for c in columns if c in df.columns])


def file_stats(df: DataFrame, columns: list[str]) -> DataFrame:
    """A row a file: path, rows, and least, largest and number of nulls of each column."""
    every = [x for c in columns for x in (F.min(c).alias(f"{c}_min"), F.max(c).alias(f"{c}_max"), F.count_if(F.col(c).isNull()).alias(f"{c}_nulls"))]
    return df.groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count("*").alias("row_count"), *every)


def json_rows(df: DataFrame) -> DataFrame:
    """One column `json`, a document a row; nulls are written, NaN and infinite numbers are null."""
    plain = [F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(F.col(c)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes]
    return df.select(F.to_json(F.struct(*plain), {"ignoreNullFields": "false"}).alias("json"))


def bronze(messages: DataFrame, payload_col: str = "payload") -> DataFrame:
    """Raw messages with the CRC-32 of their payload, to be kept before they are parsed."""
    return messages.withColumn("crc32", F.crc32(F.col(payload_col).cast("binary")))


def replay(spark: SparkSession, path: str, payload_col: str = "payload") -> tuple[DataFrame, DataFrame]:
    """Messages kept by bronze(), read back: the intact ones, and those whose payload no longer has its CRC-32."""
    kept = spark.read.parquet(path)
    intact = F.coalesce(F.crc32(F.col(payload_col).cast("binary")) == F.col("crc32"), F.col(payload_col).isNull())
    return kept.where(intact).drop("crc32"), kept.where(~intact)
