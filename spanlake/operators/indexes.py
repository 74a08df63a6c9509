"""Side indexes as tables: zone maps, Bloom filters, bitmaps; and file pruning by them.

A file that an index doesn't cover is kept, and callers apply the exact predicate to what remains.
"""

from __future__ import annotations

import math
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanlake.operators.filters import And, Between, Equals, Filter, GreaterThan, In, LessThan, Or

BLOOM_FPR = 0.005


def zone_map(df: DataFrame, file: Column, columns: list[str], block: Column | None = None) -> DataFrame:
    """(file, column, min, max, null_count, row_count); numbers and times as doubles in *_number, texts in *_text.

    With block, such as a row's place in its file by some number of rows, there is a row for each block and column, with `block`.
    """
    parts = []
    kinds = dict(df.dtypes)
    for name in columns:
        kind = kinds[name]
        number = F.unix_micros(F.col(name).cast("timestamp")).cast("double") if kind.startswith("timestamp") or kind == "date" else F.col(name).try_cast("double")
        number, text = (F.lit(None).cast("double"), F.col(name)) if kind == "string" else (number, F.lit(None).cast("string"))
        parts.append(F.struct(F.lit(name).alias("column"), number.alias("number"), text.alias("text"), F.col(name).isNull().alias("none")))
    blocks = [block.alias("block")] if block is not None else []
    each = df.select(file.alias("file"), *blocks, F.inline(F.array(*parts)))
    by = ["file", "block", "column"] if blocks else ["file", "column"]
    return each.groupBy(*by).agg(F.min("number").alias("min_number"), F.max("number").alias("max_number"), F.min("text").alias("min_text"), F.max("text").alias("max_text"), F.count_if("none").alias("null_count"), F.count("*").alias("row_count"))


def merge_zone_maps(zones: DataFrame, by: list[str]) -> DataFrame:
    """Zone maps of larger units: least of least, largest of largest, sums of counts."""
    return zones.groupBy(*by).agg(F.min("min_number").alias("min_number"), F.max("max_number").alias("max_number"), F.min("min_text").alias("min_text"), F.max("max_text").alias("max_text"), F.sum("null_count").alias("null_count"), F.sum("row_count").alias("row_count"))


def bloom_size(n: int, fpr: float = BLOOM_FPR) -> tuple[int, int]:
    """(bits, hashes) for n values."""
    bits = max(64, math.ceil(-max(1, n) * math.log(fpr) / math.log(2) ** 2))
    return bits, max(1, round(bits / max(1, n) * math.log(2)))


def _bloom_positions(value: Column, bits: Column, hashes: int | Column) -> Column:
    """Bit positions of a value, from 1; arithmetic stays far below overflow."""
    h1, h2 = F.pmod(F.xxhash64(value), F.lit(2147483647)), F.pmod(F.xxhash64(value, F.lit("s")), F.lit(2147483647))
    at = lambda i: F.pmod(h1 + i * h2.bitwiseOR(F.lit(1)), bits) + 1
    return F.array(*(at(F.lit(i)) for i in range(hashes))) if isinstance(hashes, int) else F.transform(F.sequence(F.lit(0), hashes - 1), at)


def _bloom(each: DataFrame, bits: Column, hashes: int, *by: str) -> DataFrame:
    each = each.select("file", *by, F.explode(_bloom_positions(F.col("v"), bits, hashes)).alias("p"))
    return each.groupBy("file", *by, F.bitmap_bucket_number("p").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bitmap"))


def bloom(df: DataFrame, file: Column, name: str, bits: int, hashes: int) -> DataFrame:
    """(file, bucket, bitmap): a Bloom filter a file, all of one size, in buckets of 32768 bits; nulls are left out."""
    each = df.select(file.alias("file"), F.col(name).cast("string").alias("v")).where("v IS NOT NULL").distinct()
    return _bloom(each, F.lit(bits), hashes)


def bloom_by_size(df: DataFrame, file: Column, name: str, least: int = 1_000, fpr: float = BLOOM_FPR) -> DataFrame:
    """(file, bits, bucket, bitmap, hashes): Bloom filters as bloom() makes them, each for as many values as its file holds, for `least` at least.

    A file's values are estimated to some 2%, and a filter is made for the next power of two behind a tenth more. Rows without a file are left out.
    """
    each = df.select(file.alias("file"), F.col(name).cast("string").alias("v")).where("file IS NOT NULL AND v IS NOT NULL")
    values = F.pow(F.lit(2.0), F.ceil(F.log2(F.approx_count_distinct("v", 0.02) * 1.1)))
    size = bloom_size(1_000_000, fpr)[0] / 1e6
    bits = F.when(values > least, F.ceil(values * size)).otherwise(bloom_size(least, fpr)[0]).cast("bigint")
    hashes = max(1, round(-math.log2(fpr)))
    made = _bloom(each.distinct().join(each.groupBy("file").agg(bits.alias("bits")), "file"), F.col("bits"), hashes, "bits")
    return made.withColumn("hashes", F.lit(hashes))


def _as_indexed(value: Any, kind: str | None) -> Column:
    """A value as the text that an index of a column of a type holds for it; kind None: as Spark writes the value itself."""
    return (F.lit(value).cast(kind) if kind else F.lit(value)).cast("string")


def bloom_hits(filters: DataFrame, values: list, kind: str | None = None) -> DataFrame:
    """(value, file): files whose filter may hold a value, which is given as text, for a column of type kind; filters tell their bits and hashes."""
    value = F.explode(F.array_distinct(F.array(*(_as_indexed(v, kind) for v in values))))
    each = filters.select("file", "bucket", "bitmap", "bits", "hashes", value.alias("value")).where("value IS NOT NULL")
    each = each.withColumn("wanted", F.array_distinct(_bloom_positions(F.col("value"), F.col("bits"), F.col("hashes"))))
    bit = F.bitmap_bit_position
    byte = lambda p: F.conv(F.hex(F.substring("bitmap", (F.floor(bit(p) / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("bigint")
    found = F.size(F.filter("wanted", lambda p: (F.bitmap_bucket_number(p) == F.col("bucket")) & (F.getbit(byte(p), (bit(p) % 8).cast("int")) == 1)))
    return each.groupBy("value", "file").agg(F.sum(found).alias("found"), F.max(F.size("wanted")).alias("needed")).where("found = needed").select("value", "file")


def bloom_files(filters: DataFrame, value: Any, bits: int, hashes: int, kind: str | None = None) -> DataFrame:
    """(file,): files whose filter, all of one size, may hold the value, for a column of type kind."""
    return bloom_hits(filters.withColumns({"bits": F.lit(bits), "hashes": F.lit(hashes)}), [value], kind).select("file")


def bitmap(df: DataFrame, file: Column, row_index: Column, name: str) -> DataFrame:
    """(file, value, bucket, bitmap): the rows of each value of a file, row i at bit i + 1; nulls are left out."""
    rows = df.select(file.alias("file"), F.col(name).cast("string").alias("value"), (row_index + 1).alias("r")).where("value IS NOT NULL")
    return rows.groupBy("file", "value", F.bitmap_bucket_number("r").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("r")).alias("bitmap"))


def merge_bitmaps(bitmaps: DataFrame) -> DataFrame:
    """Bitmaps of the same file, value and bucket, put together; rows of different files stay apart."""
    return bitmaps.groupBy("file", "value", "bucket").agg(F.bitmap_or_agg("bitmap").alias("bitmap"))


def bitmap_counts(bitmaps: DataFrame) -> DataFrame:
    """(value, n): rows of each value."""
    return bitmaps.groupBy("value").agg(F.sum(F.bitmap_count("bitmap")).alias("n"))


def bitmap_rows(bitmaps: DataFrame, value: Any, kind: str | None = None) -> DataFrame:
    """(file, row_index): the rows that hold a value."""
    own = bitmaps.where(F.col("value") == _as_indexed(value, kind))
    byte = lambda i: F.conv(F.hex(F.substring("bitmap", i + 1, F.lit(1))), 16, 10).cast("bigint")
    places = F.sequence(F.lit(0), F.octet_length("bitmap") - 1)
    each = own.select("file", "bucket", F.explode(F.filter(F.transform(places, lambda i: F.named_struct(F.lit("at"), i, F.lit("byte"), byte(i))), lambda b: b["byte"] > 0)).alias("b"))
    bits = F.filter(F.sequence(F.lit(0), F.lit(7)), lambda k: F.getbit(F.col("b.byte"), k) == 1)
    rows = each.select("file", "bucket", F.col("b.at").alias("at"), F.explode(bits).alias("bit"))
    # bit 0 of bucket k is number (k - 1) * 32768 + 1, and row i has number i + 1
    return rows.select("file", ((F.col("bucket") - 1) * 32768 + F.col("at") * 8 + F.col("bit")).alias("row_index"))


def _number(value: Any) -> Column:
    return F.unix_micros(F.lit(value).cast("timestamp")).cast("double") if hasattr(value, "isoformat") else F.lit(float(value))


def _within(low: Any, high: Any) -> Column:
    """Whether a zone can hold a value from low to high; None is no bound."""
    text = isinstance(low if low is not None else high, str)
    least, most = (F.col("min_text"), F.col("max_text")) if text else (F.col("min_number"), F.col("max_number"))
    as_column = F.lit if text else _number
    out = F.lit(True)
    if low is not None:
        out = out & (most >= as_column(low))
    return out & (least <= as_column(high)) if high is not None else out


def _zone_condition(f: Filter) -> tuple[str, Column] | None:
    """(field, condition on the zone map) under which a file can hold a match; None if zones can't tell."""
    if isinstance(f, Equals):
        return f.field, _within(f.value, f.value)
    if isinstance(f, In) and f.values:
        out = F.lit(False)
        for v in f.values:
            out = out | _within(v, v)
        return f.field, out
    if isinstance(f, Between):
        return f.field, _within(f.low, f.high)
    if isinstance(f, GreaterThan):  # a zone that ends at the value is kept, which only costs time
        return f.field, _within(f.value, None)
    if isinstance(f, LessThan):
        return f.field, _within(None, f.value)
    return None


def prune(
    files: DataFrame,
    query: Filter,
    zones: DataFrame | None = None,
    blooms: dict[str, DataFrame | tuple[DataFrame, int, int]] | None = None,
    bitmaps: dict[str, DataFrame] | None = None,
    kinds: dict[str, str] | None = None,
) -> DataFrame:
    """Those of files (file,) that can hold a match of the query, by all indexes there are; what no index covers stays.

    blooms: by field, filters that tell their bits and hashes, or (filters, bits, hashes) where all are of one size; bitmaps: by field; kinds: the types of fields whose values are given in another type.
    """
    if isinstance(query, And):
        for f in query.filters:
            files = prune(files, f, zones, blooms, bitmaps, kinds)
        return files
    if isinstance(query, Or) and query.filters:
        parts = [prune(files, f, zones, blooms, bitmaps, kinds) for f in query.filters]
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return out.distinct()
    kind = (kinds or {}).get(getattr(query, "field", None))
    if zones is not None and (condition := _zone_condition(query)):
        own = zones.where(F.col("column") == condition[0])
        # a file goes if none of its zones can hold a match
        possible = own.groupBy("file").agg(F.max(F.coalesce(condition[1], F.lit(False))).alias("possible"))
        files = files.join(possible.where("NOT possible").select("file"), "file", "left_anti")
    if isinstance(query, (Equals, In)) and blooms and query.field in blooms:
        filters, values = blooms[query.field], query.values if isinstance(query, In) else [query.value]
        if isinstance(filters, tuple):
            filters, bits, hashes = filters
            filters = filters.withColumns({"bits": F.lit(bits), "hashes": F.lit(hashes)})
        if values:
            found = bloom_hits(filters, values, kind).select("file")
            files = files.join(filters.select("file").distinct().join(found, "file", "left_anti"), "file", "left_anti")
    if isinstance(query, (Equals, In)) and bitmaps and query.field in bitmaps:
        values = [_as_indexed(v, kind) for v in (query.values if isinstance(query, In) else [query.value])]
        own = bitmaps[query.field]
        out = own.select("file").distinct().join(own.where(F.col("value").isin(*values)).select("file").distinct(), "file", "left_anti")
        files = files.join(out, "file", "left_anti")
    return files
