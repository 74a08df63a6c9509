"""Indexes of a lake's files that are built once, kept, published, combined, and used to read only files that can match.

Under root: the signals' tables as storage.write() lays them out; `_index/<kind>` with zone maps, Bloom filters, bitmaps and postings, by tenant, signal, level
and partition; `_catalog/files` and `_catalog/snapshots`. Tables only grow. A run's index rows count once the run has entered its files
in the catalog, which is its last step: a run that broke off leaves rows that nobody reads, and its files are new to the next one.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from datetime import datetime
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, StringType, StructField, StructType, TimestampType

from spanlake.functions.names import day_of, partition_key
from spanlake.operators import indexes
from spanlake.operators.filters import Filter, overlaps
from spanlake.operators.search import postings
from spanlake.sources.storage import exists

KINDS = ("zone", "bloom", "bitmap", "postings")
#: Rows of a file that share a zone.
BLOCK_ROWS = 100_000


@dataclass
class Plan:
    """Which columns get which index; rows is how many values a file's Bloom filter is made for at least; it is larger for a file that holds more."""

    zones: tuple = ()
    blooms: tuple = ()
    bitmaps: tuple = ()
    texts: tuple = ()
    rows: int = 100_000
    time_col: str = "timestamp"


#: What is kept of a log in an index: times by range, names by value, the message by its words; resource and attributes are only stored.
LOG_INDEX = StructType(
    [
        StructField("timestamp", TimestampType(), True, {"index": "range"}),
        *(StructField(n, StringType(), True, {"index": "keyword"}) for n in ("trace_id", "span_id", "service_name")),
        StructField("severity_text", StringType(), True, {"index": "few"}),
        StructField("body", StringType(), True, {"index": "text"}),
        *(StructField(n, MapType(StringType(), StringType())) for n in ("resource", "attributes")),
    ]
)


def plan_of(schema: StructType, rows: int = 100_000, time_col: str = "timestamp") -> Plan:
    """The plan that a schema's fields ask for in their metadata: {"index": "range"}, "keyword" for values in a Bloom filter, "few" for a bitmap of each value, "text"."""
    asked = lambda kind: tuple(f.name for f in schema if f.metadata.get("index") == kind)
    return Plan(zones=asked("range"), blooms=asked("keyword"), bitmaps=asked("few"), texts=asked("text"), rows=rows, time_col=time_col)


def _append(df: DataFrame, path: str, *by: str) -> None:
    df.write.mode("append").partitionBy(*by).parquet(path)


def files(spark: SparkSession, root: str) -> DataFrame | None:
    """(file, file_ulid, tenant, signal, partition, min_ts, max_ts, row_count, created_at, indexed_at, run), a row an indexed file; None before the first run."""
    path = f"{root}/_catalog/files"
    return spark.read.parquet(path) if exists(spark, path) else None


def snapshots(spark: SparkSession, root: str) -> DataFrame | None:
    """(snapshot_id, tenant, signal, level, partition, file_ulids, published_at), the last state of each; None before the first."""
    path = f"{root}/_catalog/snapshots"
    if not exists(spark, path):
        return None
    last = F.max(F.struct("changed_at", "tenant", "signal", "level", "partition", "file_ulids", "published_at")).alias("s")
    return spark.read.parquet(path).groupBy("snapshot_id").agg(last).select("snapshot_id", *(f"s.{c}" for c in ("tenant", "signal", "level", "partition", "file_ulids", "published_at")))


def _path(name: str) -> Column:
    """A file's path in one form; Spark writes file:/ and file:///."""
    return F.regexp_replace(name, "^file:/+", "file:/")


def _located(df: DataFrame) -> DataFrame:
    return df.select("*", _path("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__row"))


def _read(spark: SparkSession, root: str, signal: str, paths: list[str]) -> DataFrame:
    return spark.read.option("basePath", f"{root}/{signal}").parquet(*map(unquote, paths))


def _listed(spark: SparkSession, root: str, signal: str) -> DataFrame:
    """(file,): a signal's files. The driver lists them anyway when it reads a table."""
    return spark.createDataFrame([(p,) for p in spark.read.parquet(f"{root}/{signal}").inputFiles()], "file string").select(_path("file").alias("file"))


def new_paths(spark: SparkSession, root: str, signal: str) -> list[str]:
    """A signal's files that the catalog doesn't have."""
    every, known = _listed(spark, root, signal), files(spark, root)
    left = every if known is None else every.join(known.select("file"), "file", "left_anti")
    return sorted(r["file"] for r in left.collect())


def build(spark: SparkSession, root: str, signal: str, plan: Plan, now: datetime | None = None) -> int:
    """Indexes a signal's new files, those alone being read; returns how many there were."""
    paths = new_paths(spark, root, signal)
    if not paths:
        return 0
    run, at = uuid.uuid4().hex, F.lit(now) if now else F.current_timestamp()
    data = _located(_read(spark, root, signal, paths))
    file, row = F.col("__file"), F.col("__row")
    entered = data.groupBy(file.alias("file"), F.col("tenant").cast("string").alias("tenant")).agg(F.min(plan.time_col).alias("min_ts"), F.max(plan.time_col).alias("max_ts"), F.count("*").alias("row_count"))
    ulid = F.substring(F.sha2("file", 256), 1, 26)
    entered = entered.select("file", ulid.alias("file_ulid"), "tenant", F.lit(signal).alias("signal"), partition_key(F.col("min_ts")).alias("partition"), "min_ts", "max_ts", "row_count", at.alias("created_at"), at.alias("indexed_at"), F.lit(run).alias("run"))
    pending = f"{root}/_catalog/pending/{run}"
    entered.write.parquet(pending)
    entered = spark.read.parquet(pending)
    place = entered.select("file", "tenant", "partition")

    def keep(kind: str, rows: DataFrame) -> None:
        placed = rows.join(place, "file").withColumns({"signal": F.lit(signal), "level": F.lit("hour"), "run": F.lit(run), "batch": F.lit(run)})
        _append(placed, f"{root}/_index/{kind}", "tenant", "signal", "level", "partition")

    if plan.zones:
        keep("zone", indexes.zone_map(data, file, list(plan.zones), F.floor(row / BLOCK_ROWS)))
    for name in plan.blooms:
        keep("bloom", indexes.bloom_by_size(data, file, name, plan.rows).withColumns({"column": F.lit(name), "bits": F.col("bits").cast("int")}))
    for name in plan.bitmaps:
        keep("bitmap", indexes.bitmap(data, file, row, name).withColumn("column", F.lit(name)))
    for name in plan.texts:
        each = postings(data.withColumn("__at", F.struct(file.alias("file"), row.alias("row"))), "__at", name)
        keep("postings", each.select(F.col("id.file").alias("file"), F.col("id.row").alias("row_index"), "token", "tf", "length", F.lit(name).alias("column")))
    _append(entered, f"{root}/_catalog/files", "signal")
    return len(paths)


def index_rows(spark: SparkSession, root: str, kind: str, signal: str, tenant: str | None = None) -> DataFrame | None:
    """A signal's index rows of committed runs: a combined day's where there is one, else its hours'. None if there are none."""
    known = files(spark, root)
    if known is None or not exists(spark, f"{root}/_index/{kind}"):
        return None
    rows = _stored(spark, root, kind, signal)
    rows = rows if tenant is None else rows.where(F.col("tenant") == tenant)
    rows = rows.join(F.broadcast(known.select("run").distinct()), "run", "left_semi")  # a row a run
    taken = snapshots(spark, root)
    if taken is None:
        return rows.where("level = 'hour'")
    marked = rows.join(_days(taken, signal).join(known.select("file", "file_ulid"), "file_ulid").select("file", "day_batch"), "file", "left")
    return marked.where("level = 'hour' AND day_batch IS NULL OR level = 'day' AND batch = day_batch").drop("day_batch")


def _stored(spark: SparkSession, root: str, kind: str, signal: str) -> DataFrame:
    """All index rows of a kind; partition columns are text, whatever their values look like."""
    rows = spark.read.parquet(f"{root}/_index/{kind}").where(F.col("signal") == signal)
    return rows.withColumns({"tenant": F.col("tenant").cast("string"), "partition": F.col("partition").cast("string")})


def _days(taken: DataFrame, signal: str) -> DataFrame:
    """(file_ulid, day, day_batch): the last published day that covers a file, and the batch that its index rows came in."""
    days = taken.where(F.col("published_at").isNotNull() & (F.col("level") == "day") & (F.col("signal") == signal))
    each = days.select(F.explode("file_ulids").alias("file_ulid"), F.struct("published_at", F.substring_index("snapshot_id", "-", 1).alias("batch"), "partition").alias("by"))
    return each.groupBy("file_ulid").agg(F.max("by").alias("by")).select("file_ulid", F.col("by.partition").alias("day"), F.col("by.batch").alias("day_batch"))


def publish(spark: SparkSession, root: str, snapshot: DataFrame, now: datetime | None = None) -> None:
    """Makes a snapshot's rows (snapshot_id, tenant, signal, level, partition, file_ulids) visible at once, by one append."""
    at = F.lit(now) if now else F.current_timestamp()
    rows = snapshot.select("snapshot_id", "tenant", "signal", "level", "partition", "file_ulids", at.alias("published_at"), F.current_timestamp().alias("changed_at"))
    rows.write.mode("append").parquet(f"{root}/_catalog/snapshots")


def withdraw(spark: SparkSession, root: str, snapshot_ids: list[str]) -> None:
    """Hides published snapshots again; readers go back to what they covered."""
    rows = snapshots(spark, root).where(F.col("snapshot_id").isin(snapshot_ids))
    rows.withColumns({"published_at": F.lit(None).cast("timestamp"), "changed_at": F.current_timestamp()}).write.mode("append").parquet(f"{root}/_catalog/snapshots")


def combine_day(spark: SparkSession, root: str, signal: str, day: str, now: datetime | None = None) -> int:
    """Writes the index rows of a day's hours anew as the day's, in few files, then publishes them, a snapshot a tenant; returns how many.

    Zones of one file and column become one; bitmaps of one file and value are put together; Bloom filters and postings stay as they are, a file's
    own. Hours that come later, or again, are for the next call; a file is looked up in the last published day that covers it.
    """
    known = files(spark, root)
    if known is None:
        return 0
    own = known.where((F.col("signal") == signal) & (day_of(F.col("partition")) == day))
    tenants = own.groupBy("tenant").agg(F.array_sort(F.collect_list("file_ulid")).alias("file_ulids")).collect()  # a tenant's files of a day
    if not tenants:
        return 0
    by = uuid.uuid4().hex
    for kind in KINDS:
        path = f"{root}/_index/{kind}"
        if not exists(spark, path):
            continue
        rows = _stored(spark, root, kind, signal).where("level = 'hour'").join(own.select("file", "run"), ["file", "run"], "left_semi")
        if kind == "zone":
            rows = indexes.merge_zone_maps(rows, ["file", "column", "tenant", "signal", "run"])
        if kind == "bitmap":
            rows = rows.groupBy("file", "column", "value", "bucket", "tenant", "signal", "run").agg(F.bitmap_or_agg("bitmap").alias("bitmap"))
        rows = rows.withColumns({"level": F.lit("day"), "partition": F.lit(day), "batch": F.lit(by)})
        _append(rows.hint("rebalance", "tenant"), path, "tenant", "signal", "level", "partition")
    published = spark.createDataFrame([(by, r["tenant"], signal, "day", day, r["file_ulids"]) for r in tenants], "snapshot_id string, tenant string, signal string, level string, partition string, file_ulids array<string>")
    publish(spark, root, published.withColumn("snapshot_id", F.concat_ws("-", "snapshot_id", "tenant")), now)
    return len(tenants)


def coverage(spark: SparkSession, root: str, signal: str, tenant: str) -> DataFrame:
    """(level, partition, files): what a tenant's lookups use: days, then the hours that no day covers."""
    own = files(spark, root).where((F.col("signal") == signal) & (F.col("tenant") == tenant))
    taken = snapshots(spark, root)
    if taken is None:
        return own.groupBy(F.lit("hour").alias("level"), "partition").agg(F.count("*").alias("files"))
    marked = own.join(_days(taken, signal), "file_ulid", "left")
    return marked.groupBy(F.when(F.col("day").isNull(), "hour").otherwise("day").alias("level"), F.coalesce("day", "partition").alias("partition")).agg(F.count("*").alias("files"))


def paths_for(spark: SparkSession, root: str, signal: str, condition: Filter, tenant: str | None = None, since: datetime | None = None, until: datetime | None = None) -> list[str]:
    """A signal's files that can hold a match of the condition, of a tenant and a time where given; files that aren't indexed yet are among them.

    The list goes to the driver, which is to read them. Values are looked up as the columns' types write them.
    """
    kinds = dict(spark.read.parquet(f"{root}/{signal}").dtypes)
    known = files(spark, root)
    unknown = new_paths(spark, root, signal)
    if known is None:
        return unknown
    own = known.where(F.col("signal") == signal).join(_listed(spark, root, signal), "file", "left_semi")  # replaced files are gone
    own = own if tenant is None else own.where(F.col("tenant") == tenant)
    if since is not None or until is not None:
        own = own.where(overlaps("min_ts", "max_ts", since or datetime.min.replace(year=1900), until or datetime.max.replace(year=9000)))
    found = {kind: index_rows(spark, root, kind, signal, tenant) for kind in ("zone", "bloom", "bitmap")}
    blooms, bitmaps = {}, {}
    if found["bloom"] is not None:
        for r in found["bloom"].select("column").distinct().collect():  # a row a column
            blooms[r["column"]] = found["bloom"].where(F.col("column") == r["column"])
    if found["bitmap"] is not None:
        for r in found["bitmap"].select("column").distinct().collect():
            bitmaps[r["column"]] = found["bitmap"].where(F.col("column") == r["column"])
    kept = indexes.prune(own.select("file"), condition, found["zone"], blooms, bitmaps, kinds)
    return sorted(r["file"] for r in kept.collect()) + unknown


def read(spark: SparkSession, root: str, signal: str, condition: Filter, tenant: str | None = None, since: datetime | None = None, until: datetime | None = None) -> DataFrame:
    """The matching rows, from those files alone that can hold any."""
    paths = paths_for(spark, root, signal, condition, tenant, since, until)
    df = _read(spark, root, signal, paths) if paths else spark.read.parquet(f"{root}/{signal}").limit(0)
    df = df if tenant is None else df.where(F.col("tenant") == tenant)
    return df.where(condition.column())
