"""Documents that contain benchmark items, by size-partitioned MinHash containment search, with DataFrame functions only.

Items are partitioned by the size n of their shingle set, at powers of two. Each partition has a hash limit, and a sketch of an item or a document
there is the MinHash sample of its shingles: those that hash to the limit or less. A document with the threshold's share of an item
lacks floor((1 - threshold) * n) of its shingles at most; the limit is the least at which every item of the partition has more than
that in its sketch. So a document that contains an item shares at least (size of the item's sketch) - floor((1 - threshold) * n)
hashes, one or more, with the item's sketch, and this bound, with that on the document's size, finds candidates. None is missed, however long the
document is; exact containment of the words follows. Signatures of a fixed length can't do this: a short item in a long
document has a Jaccard similarity near 0.001.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanlake.llm.frames import column, cut, shingle_hashes, shingles, words

#: Rows of sketches, of 24 bytes or so, up to which they are broadcast; above it the join shuffles.
BROADCAST_ROWS = 500_000


def item_sketches(items: DataFrame, width: int, threshold: float) -> DataFrame:
    """(item_id, n, hash, limit, needed) of items (item_id, words): each hash of an item's sketch, the partition's limit and how many of the sketch a document must share."""
    hashes = items.select("item_id", F.array_sort(F.array_distinct(shingle_hashes("words", width))).alias("hashes")).where("size(hashes) > 0")
    lacking = F.floor(F.size("hashes") * F.lit(1 - threshold) + F.lit(1e-9)).cast("int")
    sized = hashes.select("item_id", "hashes", F.size("hashes").alias("n"), lacking.alias("lacking"), F.floor(F.log2(F.size("hashes"))).alias("band"))
    limits = sized.groupBy("band").agg(F.max(F.get("hashes", F.col("lacking"))).alias("limit"))  # a row a power of two
    sketch = F.filter("hashes", lambda h: h <= F.col("limit"))
    sized = sized.join(F.broadcast(limits), "band").withColumn("sketch", sketch)
    return sized.select("item_id", "n", "limit", (F.size("sketch") - F.col("lacking")).alias("needed"), F.explode_outer("sketch").alias("hash"))


def contaminated(docs: DataFrame, items: DataFrame, width: int = 5, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, n_shingles, n_found, containment), a row for each document and item it contains.

    Sets are distinct runs of `width` lower-cased words. A document contains an item if it holds `threshold` or more of the
    item's set. Items and documents with fewer words, null texts and null ids match nothing. Rows that share a doc_id are
    judged as one document, if any of them alone contains the item; so are items that share an item_id. Only id and text
    are read, so other columns may have any names. Empty tables give no rows.
    """
    docs = docs.select(column(id_col).cast("long").alias("doc_id"), F.lower(column(text_col)).alias("text")).where("doc_id IS NOT NULL")
    split = docs.select("doc_id", words(F.col("text")).alias("words"))
    items = items.select(F.col("item_id").cast("long").alias("item_id"), words(F.lower("text")).alias("words")).where("item_id IS NOT NULL")
    sketches = cut(item_sketches(items, width, threshold))  # repeated ids have a sketch each; the least of their bounds counts
    if sketches.count() <= BROADCAST_ROWS:
        sketches = F.broadcast(sketches)
    # a document's sketch under the largest of the limits; its hashes beyond an item's own limit meet no hash of the item's sketch
    limit = sketches.agg(F.max("limit")).first()[0]
    hashes = split.select("doc_id", F.array_distinct(shingle_hashes("words", width)).alias("hashes"))
    sampled = hashes.select("doc_id", F.size("hashes").alias("m"), F.filter("hashes", lambda h: h <= F.lit(limit).cast("long")).alias("hashes"))
    # explode_outer, here and above: explode's own filter on size would be pushed below and compute the words for each shingle
    each = sampled.select("doc_id", "m", F.explode_outer("hashes").alias("hash"))
    shared = each.join(sketches, "hash").where(F.col("m") >= F.col("n") * F.lit(threshold) - F.lit(1e-9))
    # rows that share an id count together here, which only adds candidates
    pairs = shared.groupBy("doc_id", "item_id").agg(F.count("*").alias("shared"), F.min("needed").alias("needed")).where("shared >= needed").select("doc_id", "item_id")

    own = items.select("item_id", F.array_distinct(shingles("words", width)).alias("item"))
    found = docs.join(pairs, "doc_id").select("doc_id", "item_id", words(F.col("text")).alias("words")).join(own, "item_id")
    found = found.select("doc_id", "item_id", F.size("item").alias("n"), F.size(F.array_intersect("item", shingles("words", width))).alias("k"))
    best = found.where(F.col("k") >= F.col("n") * F.lit(threshold) - F.lit(1e-9)).groupBy("doc_id", "item_id").agg(F.max(F.struct(F.col("k") / F.col("n"), "n", "k")).alias("best"))
    return best.select("doc_id", "item_id", F.col("best.n").cast("long").alias("n_shingles"), F.col("best.k").cast("long").alias("n_found"), (F.col("best.k") / F.col("best.n")).alias("containment"))


def decontaminate(docs: DataFrame, items: DataFrame, width: int = 5, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input's rows, all columns unchanged, without those whose id contaminated() reports; null ids stay."""
    hit = contaminated(docs, items, width, threshold, id_col, text_col).select("doc_id").distinct()
    hit = hit.select(F.col("doc_id").alias("__hit"))
    return docs.join(hit, column(id_col).cast("long") == F.col("__hit"), "left_anti")
