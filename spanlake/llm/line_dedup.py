"""Removal of repeated three-line windows, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanlake.llm.frames import column, cut


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """The input's rows and columns, the text without repeated line windows, plus n_lines and n_removed.

    Lines are split at line feeds. Each run of `width` consecutive lines of a document is a window; a window whose lines
    also stand at a smaller (id, line) goes, and with it each line it covers, overlaps included. Windows are judged on
    the input. Windows of blank lines alone are left.

    Null text: it stays null and has 0 lines. Empty text: one empty line, which stays. Fewer lines than a window: nothing
    goes. Null id: the row stays as it is and is compared with nothing. Rows that share an id count as one document:
    windows at the same line are not later than each other, and a line found in one goes from each. Input columns
    called n_lines or n_removed are replaced; others may have any names. An empty table gives no rows.

    Windows travel as 16-byte hashes. A first place for each repeated hash is found with partial sums before the shuffle,
    so a window that a third of the documents share is one row a task there; the join that follows it is one that
    adaptive execution can split.
    """
    rest = [c for c in docs.columns if c not in (text_col, "n_lines", "n_removed")]
    rows = docs.select(column(id_col).cast("long").alias("id"), column(text_col).alias("text"), F.struct(F.lit(0).alias(""), *map(column, rest)).alias("row"))
    lines = rows.where(F.col("id").isNotNull()).select("id", F.split("text", "\n").alias("lines"))
    starts = F.when(F.size("lines") >= width, F.sequence(F.lit(0), F.size("lines") - width))
    windows = F.transform(starts, lambda i: F.concat_ws("\n", *(F.get("lines", i + k) for k in range(width))))
    # posexplode's own filter on size would be pushed below and split the text for each line; posexplode_outer has none
    windows = lines.select("id", F.posexplode_outer(windows).alias("line", "window")).where(F.col("window").rlike(r"\S"))
    windows = windows.select(F.unhex(F.md5("window")).alias("key"), "id", "line")
    repeated = windows.groupBy("key").agg(F.min(F.struct("id", "line")).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    later = windows.join(cut(repeated), "key").where(F.struct("id", "line") > F.col("first"))
    gone = later.groupBy("id").agg(F.collect_set("line").alias("starts"))

    covered = F.flatten(F.transform("starts", lambda s: F.sequence(s, s + (width - 1))))
    each = F.split("text", "\n")
    kept = F.array_except(F.sequence(F.lit(0), F.size(each) - 1), covered)
    text = F.when(F.col("starts").isNull() | F.col("text").isNull(), F.col("text")).otherwise(F.array_join(F.transform(kept, lambda i: F.get(F.col("lines"), i)), "\n"))
    out = rows.join(gone, "id", "left").withColumn("lines", each)
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.size("lines"))
    n_removed = F.when(F.col("starts").isNull() | F.col("text").isNull(), 0).otherwise(F.size("lines") - F.size(kept))
    columns = [text.alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in docs.columns if c == text_col or c in rest]
    return out.select(*columns, n_lines.cast("long").alias("n_lines"), n_removed.cast("long").alias("n_removed"))
