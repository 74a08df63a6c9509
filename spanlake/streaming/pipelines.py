"""Structured Streaming: sources, batching by tenant, de-duplication, windows and sinks."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from spanlake.functions.attributes import last_of_each
from spanlake.functions.names import index_name, payload_type, topic_part
from spanlake.operators import index_store, otlp, validation
from spanlake.sources import storage


def json_lines(spark: SparkSession, path: str, max_files: int = 100) -> DataFrame:
    """Messages (payload, file) from a folder of text files, one JSON document a line."""
    return spark.readStream.option("maxFilesPerTrigger", max_files).text(path).select(F.col("value").alias("payload"), F.col("_metadata.file_path").alias("file")).where("payload <> ''")


def kafka(spark: SparkSession, servers: str, pattern: str, max_offsets: int = 1_000_000, **options: str) -> DataFrame:
    """Messages from topics that match a pattern; offsets live in the query's checkpoint. Needs Spark's Kafka package."""
    reader = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribePattern", pattern)
    return with_topic(reader.option("includeHeaders", True).option("maxOffsetsPerTrigger", max_offsets).options(**options).load())


def with_topic(messages: DataFrame) -> DataFrame:
    """Kafka rows with payload, headers as a map of text, client_name, index_name and payload_type; empty payloads are dropped.

    Headers name the client and the index where they have them, else the topic does.
    """
    topic = F.col("topic")
    if "headers" in messages.columns:
        text = F.transform("headers", lambda h: F.named_struct(F.lit("key"), h["key"], F.lit("value"), h["value"].cast("string")))
        messages = messages.withColumn("headers", F.map_from_entries(last_of_each(text)))
        named = lambda key, other: F.coalesce(F.nullif(F.try_element_at("headers", F.lit(key)), F.lit("")), other)
    else:
        named = lambda key, other: other
    return messages.withColumns({"payload": F.col("value").cast("string"), "client_name": named("client_name", topic_part(topic, 1)), "index_name": named("index_name", index_name(topic)), "payload_type": payload_type(topic)}).where("payload <> ''")


def windows(events: DataFrame, time_col: str, length: str, keys: list[str], value_col: str, slide: str | None = None, late: str | None = None) -> DataFrame:
    """Count and sum by time window and keys; works on batches and streams. Streams need late, the watermark's delay."""
    if late is not None:
        events = events.withWatermark(time_col, late)
    window = F.window(time_col, length, slide) if slide else F.window(time_col, length)
    grouped = events.groupBy(window.alias("w"), *keys).agg(F.count("*").alias("n"), F.sum(value_col).alias("total"))
    return grouped.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, "n", "total")


def sessions(events: DataFrame, time_col: str, gap: str, keys: list[str], late: str | None = None) -> DataFrame:
    """(start, end, keys, n): events of a key less than gap apart; end is the last event plus gap."""
    if late is not None:
        events = events.withWatermark(time_col, late)
    grouped = events.groupBy(F.session_window(time_col, gap).alias("w"), *keys).agg(F.count("*").alias("n"))
    return grouped.select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), *keys, "n")


def deduplicated(events: DataFrame, keys: list[str], time_col: str, late: str = "60 seconds") -> DataFrame:
    """Drops repeats of keys; on a stream, those within the watermark's delay."""
    return events.withWatermark(time_col, late).dropDuplicatesWithinWatermark(keys) if events.isStreaming else events.dropDuplicates(keys)


def _numbered(n_keys: int, max_messages: int, max_bytes: int):
    """Adds batch_no to Arrow batches (keys, ..., size) that come key by key, in order; what a key's open batch holds is carried from one Arrow batch on to the next."""

    def numbered(batches):
        key, number, count, size = None, 0, 0, 0
        for part in batches:
            out = []
            for *own, n in zip(*(part.column(k).to_pylist() for k in (*range(n_keys), part.num_columns - 1))):
                if own != key:
                    key, number, count, size = own, 0, 0, 0
                out.append(number)
                count, size = count + 1, size + (n or 0)
                if count >= max_messages or size >= max_bytes:
                    number, count, size = number + 1, 0, 0
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(out, pa.int64())], names=[*part.schema.names[:-1], "batch_no"])

    return numbered


def tenant_batches(messages: DataFrame, tenant_col: str, max_messages: int, max_bytes: int, payload_col: str = "payload", order_col: str = "offset", buffers: tuple = ()) -> DataFrame:
    """Messages with batch_no: a tenant's messages in order fill a batch until it holds max_messages, or max_bytes or more; then both counts start anew.

    Within a micro-batch; time cuts come from the trigger. buffers names further columns, such as the Kafka partition, whose values fill batches of their
    own: so one large tenant is spread over tasks. A task passes over its messages once and holds none of them.
    """
    keys = [tenant_col, *buffers]
    rest = [c for c in messages.columns if c not in keys]
    rows = messages.select(*keys, *rest, F.octet_length(F.col(payload_col)).alias("__size"))
    rows = rows.repartition(*keys).sortWithinPartitions(*keys, order_col)
    schema = StructType([*(rows.schema[c] for c in (*keys, *rest)), StructField("batch_no", LongType())])
    return rows.mapInArrow(_numbered(len(keys), max_messages, max_bytes), schema).select(*messages.columns, "batch_no")


def merged_messages(*parts: DataFrame) -> DataFrame:
    """Messages of several sources, each row with the id of the message that it came in, as _source_message_id; columns that a source lacks are null."""
    out = None
    for part in parts:
        one = part.withColumn("_source_message_id", F.col("message_id").cast("string"))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


def batch_records(batched: DataFrame, tenant_col: str, payload_col: str = "payload") -> DataFrame:
    """A row a batch: messages, bytes, first and last offset, topics."""
    return batched.groupBy(F.col(tenant_col).alias("client_id"), "batch_no").agg(F.count("*").alias("message_count"), F.sum(F.octet_length(F.col(payload_col))).alias("size_bytes"), F.min("offset").alias("first_offset"), F.max("offset").alias("last_offset"), F.sort_array(F.collect_set("topic")).alias("topics"))


def start(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, every: str | None = None):
    """Runs write(batch, number) on every micro-batch: all there is, then ends; or forever, at an interval.

    Spark hands over a batch again with its number if a run broke off, so write should replace what it wrote under that number.
    """
    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return writer.trigger(processingTime=every).start() if every else writer.trigger(availableNow=True).start()


def once_per_batch(root: str, time_col: str) -> Callable[[DataFrame, int], None]:
    """A sink: each micro-batch is a folder of its own, replaced if it comes again; so every row is written once."""

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("date", F.to_date(time_col)).write.mode("overwrite").partitionBy("date").parquet(f"{root}/batch={number}")

    return write


def indexed_once_per_batch(root: str, signal: str, time_col: str, plan: index_store.Plan, tenant_col: str = "client_name") -> Callable[[DataFrame, int], None]:
    """A sink: each micro-batch becomes files of its signal's table, by tenant and day, and their indexes; a batch that comes again replaces its own files."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        folder = f"{root}/{signal}/batch={number}"
        storage.write(batch, f"{root}/{signal}", f"batch={number}", time_col, tenant_col, mode="overwrite")
        if storage.exists(spark, folder):
            index_store.build(spark, root, signal, plan)

    return write


def ingest_once_per_batch(root: str, payload_col: str = "payload", rules: dict[str, list] | None = None) -> Callable[[DataFrame, int], None]:
    """A sink for OTLP messages: each micro-batch's spans, logs and metric points are validated and written as root/<signal>/batch=, the rows that break rules as
    root/_quarantine/<signal>/batch= with their errors. rules: by signal, in place of the usual ones. A batch that comes again replaces what it wrote."""

    def write(batch: DataFrame, number: int) -> None:
        asked = rules or {}
        spans, logs, points = otlp.spans(batch, payload_col), otlp.logs(batch, payload_col), otlp.metric_points(batch, payload_col)
        for signal, rows, usual in (("traces", spans, validation.span_rules), ("logs", validation.prepare_logs(logs), validation.log_rules), ("metrics", points, list)):
            good, bad = validation.split(validation.validate(rows, asked[signal] if signal in asked else usual()))
            good.write.mode("overwrite").parquet(f"{root}/{signal}/batch={number}")
            bad.write.mode("overwrite").parquet(f"{root}/_quarantine/{signal}/batch={number}")

    return write
