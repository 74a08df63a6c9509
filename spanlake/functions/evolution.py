"""Schemas that change from batch to batch."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType


def merge_schemas(first: StructType, second: StructType) -> StructType:
    """All columns by name, sorted. On a conflict the second's type counts and the column is nullable, as is each that one side lacks."""
    a, b = {f.name: f for f in first}, {f.name: f for f in second}
    out = []
    for name in sorted(a.keys() | b.keys()):
        if name in a and name in b:
            same = a[name].dataType == b[name].dataType
            out.append(StructField(name, b[name].dataType, not same or a[name].nullable or b[name].nullable))
        else:
            out.append(StructField(name, (a.get(name) or b[name]).dataType, True))
    return StructType(out)


def adapt(df: DataFrame, schema: StructType) -> DataFrame:
    """df in the form of schema: columns that it lacks, or has in another type, are null."""
    have = {f.name: f.dataType for f in df.schema}
    return df.select(*((F.col(f"`{f.name}`") if have.get(f.name) == f.dataType else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema))


def union_evolving(*dfs: DataFrame) -> DataFrame:
    """All rows under the schema that merging from first to last gives."""
    schema = reduce(merge_schemas, (df.schema for df in dfs))
    return reduce(DataFrame.unionByName, (adapt(df, schema) for df in dfs))


def normalize_field_name(name: str) -> str:
    """Indices become [*]."""
    return re.sub(r"\[\d+\]", "[*]", name)


def schemas_compatible(first: StructType, second: StructType) -> bool:
    """The same number of columns and, place by place, the same normalised name and type."""
    return len(first) == len(second) and all(normalize_field_name(a.name) == normalize_field_name(b.name) and a.dataType == b.dataType for a, b in zip(first, second))
