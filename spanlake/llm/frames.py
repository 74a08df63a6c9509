"""Small DataFrame helpers of this subpackage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The separators of `[^\x20\x09-\x0D]+`, as characters and as a Java pattern.
SPACES = " \t\n\x0b\f\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"


def scratch(spark: SparkSession) -> str:
    """The shared folder for intermediate tables, as the session names it in spark.checkpoint.dir.

    A local session, as in tests, that names none gets a temporary folder; on a cluster that is an error, as executors don't share one.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder is None:
        if not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp())
        folder = context.getCheckpointDir()
    return folder


def drop(spark: SparkSession, folder: str) -> None:
    """Deletes a folder that nothing reads any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame, instead_of: list[str] | None = None) -> DataFrame:
    """The rows as a table written to the shared folder, so that lost executors cost no recomputing beyond it.

    instead_of holds the folder of the table that this one supersedes, if any: it is deleted, and the new one's is kept there.
    """
    spark = df.sparkSession
    folder = f"{scratch(spark)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    if instead_of is not None:
        for old in instead_of:
            drop(spark, old)
        instead_of[:] = [folder]
    return spark.read.schema(df.schema).parquet(folder)


def column(name: str) -> Column:
    """A top-level column by its exact name."""
    return F.col("`" + name.replace("`", "``") + "`")


def words(text: Column) -> Column:
    """The words `[^\\x20\\x09-\\x0D]+` of a text; none for null or a text without words."""
    bare = F.btrim(text, F.lit(SPACES))
    return F.when(F.coalesce(F.length(bare), F.lit(0)) == 0, F.array().cast("array<string>")).otherwise(F.split(bare, SPACE_RUN))


def shingle_hashes(words: str, width: int) -> Column:
    """xxhash64 of each run of `width` words, in order; none if there are fewer. Takes a column's name: an expression would be computed anew for each word."""
    return _shingles(words, width, lambda each: F.xxhash64(*each))


def shingles(words: str, width: int) -> Column:
    """Each run of `width` words joined by one space, in order; none if there are fewer."""
    return _shingles(words, width, lambda each: F.concat_ws(" ", *each))


def _shingles(words: str, width: int, of) -> Column:
    last = F.size(words) - width
    each = F.transform(F.sequence(F.lit(0), last), lambda i: of([F.get(F.col(words), i + k) for k in range(width)]))
    return F.coalesce(F.when(last >= 0, each), F.array())
