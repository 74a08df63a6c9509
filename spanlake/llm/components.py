"""Connected components of a link table, as rounds of DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanlake.llm.frames import cut


def _all_stars(edges: DataFrame) -> bool:
    """Whether each upper end u has one edge and is no edge's lower end v; an id is a partial sum a task."""
    ends = edges.select(F.col("u").alias("id"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("v").alias("id"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return ends.groupBy("id").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 OR up > 0 AND down > 0").isEmpty()


def connected_components(links: DataFrame) -> DataFrame:
    """(id, component_id) for each id in links (a, b), longs: the smallest id reachable, itself included.

    Null ends and loops are dropped; repeats and direction don't matter. Two star steps alternate: each id hands its least
    neighbour to its larger neighbours, then to its smaller ones and itself, until every component is a star; that takes about
    the logarithm of the longest path. Least neighbours are partial minima, so an id with many links is a row a task; its edges meet it in a join that adaptive execution splits. Each round
    is a table in the shared folder that replaces the last one's; only whether another is due comes back to the driver.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("a IS NOT NULL AND b IS NOT NULL AND a <> b").distinct()
    table: list[str] = []
    edges = cut(edges, table)
    while not _all_stars(edges):
        # large star: neighbours above an id join its least neighbour
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct()
        # small star: neighbours below an id, and itself, join its least neighbour
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        edges = cut(small, table)
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component_id")).unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("component_id")).distinct())
