"""Mixing sources to target weights in fixed-length token blocks, with DataFrame functions only.

Each source's documents, in a pseudorandom order, are one long row of words cut into blocks of `block` words (the last can
be shorter). A source's target fixes how many slots it gets in all; on which output shard each of them falls is an independent
uniform draw by hash. So the counts of a source over the shards are multinomial, and a shard's counts over the sources are a multinomial draw
conditioned on the sources' totals: the mix is random by shard, and still meets its targets. A source's slots, numbered over all
shards, go through a pseudorandom permutation of its block indices, a new one each time round; blocks are joined by index.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanlake.llm.frames import column, cut, words

#: Documents in one group whose running sum of sizes is one window.
GROUP_ROWS = 10_000
MAX_SHARDS = 1 << 16
STRETCH = 1024
#: Slots that a task deals out.
TASK_SLOTS = 1 << 18
#: Stands for a null id where ids are compared.
NO_ID = -(1 << 63)
ROUNDS = 8


def source_targets(sizes: DataFrame, weights: tuple = (1, 2, 3), most: int = 3) -> DataFrame:
    """(rank, source, source_size, target) from (source, size): sources by code point, null last, weigh `weights`, repeating.

    Together they get all sizes' sum. A target stops at `most` times its source's size, the excess shared anew by weight
    until none is above. In order of most * size / weight, the sources that stop come first, so running sums find them.
    The table has a row a source.
    """
    sums = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = sums.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    ranked = ranked.withColumn("w", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), F.col("rank") % len(weights) + 1))
    cap = F.col("source_size") * F.lit(float(most))
    before = Window.orderBy(cap / F.col("w"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum(cap).over(before), F.lit(0.0))
    share = left / (F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    ranked = ranked.withColumn("share", share).withColumn("stops", F.col("share") * F.col("w") > cap)
    level = F.first(F.when(~F.col("stops"), F.col("share")), ignorenulls=True).over(Window.orderBy(cap / F.col("w"), "rank").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return ranked.select("rank", "source", "source_size", F.when(F.col("stops"), cap).otherwise(level * F.col("w")).alias("target"))


def _permuted(index: str, n: str, key: str) -> str:
    """SQL for a pseudorandom permutation of 0 to n - 1: a Feistel network over the least power of two, walked until it ends below n."""
    bits = f"greatest(2, cast(ceil(log2({n})) as int))"
    low, high = f"({bits} div 2)", f"({bits} - {bits} div 2)"
    turn = (
        f"(y, r) -> if(r % 2 = 0, y ^ shiftleft(xxhash64(y & (shiftleft(1L, cast({low} as int)) - 1), {key}, r) & (shiftleft(1L, cast({high} as int)) - 1), cast({low} as int)),"
        f" y ^ (xxhash64(shiftright(y, cast({low} as int)), {key}, r) & (shiftleft(1L, cast({low} as int)) - 1)))"
    )
    feistel = f"aggregate(sequence(1, {ROUNDS}), x, {turn})"
    return f"aggregate(sequence(0, 64), cast({index} as bigint), (x, i) -> if(i = 0 or x >= {n}, {feistel}, x))"


def _hash(text_col: str) -> Column:
    """MD5 of a text, 16 bytes: tells rows of one id and size apart."""
    return F.unhex(F.md5(column(text_col).cast("binary")))


class Mixture:
    """The parts of one mix; each is a DataFrame.

    A text's size is its number of words; null and empty texts have 0 and are never taken. Null is a source of its own, the last by order. Null and
    repeated ids are rows like others, and repeated rows are each a row: all of them have places of their own in their source. Ties in the
    pseudorandom order go by id, size and text. Only the id, text and source columns are read, so others may have any names. An empty table
    has no rows in any part.

    documents: (doc_id, rank, source, source_size, target, size, hash, begin), hash being the text's and begin the row's place in its source;
    slots: (shard, slot, rank, index), a block index for each slot of the output.
    """

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple = (1, 2, 3), most: int = 3, block: int = 128, shard_slots: int = 4096, seed: int = 17):
        self.block, self.most = block, most
        sized = docs.select(column(id_col).cast("long").alias("doc_id"), column(source_col).cast("string").alias("source"), F.coalesce(F.regexp_count(column(text_col), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long").alias("size"), _hash(text_col).alias("hash"))
        sized = cut(sized)
        sources = cut(source_targets(sized, weights, most))
        n_rows = sized.count()

        groups = max(64, math.ceil(n_rows / GROUP_ROWS))
        placed = sized.withColumn("group", F.pmod(F.xxhash64("doc_id", "hash", F.lit(seed)), F.lit(groups)))
        sums = placed.groupBy("source", "group").agg(F.sum("size").alias("sum"))
        over = Window.partitionBy("source").orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
        sums = sums.select("source", "group", F.coalesce(F.sum("sum").over(over), F.lit(0)).alias("base"))
        sums = sums.join(sources, sums["source"].eqNullSafe(sources["source"])).drop(sources["source"])
        running = F.sum("size").over(Window.partitionBy("source", "group").orderBy(F.xxhash64("doc_id", "hash", F.lit(seed + 1)), "doc_id", "size", "hash").rowsBetween(Window.unboundedPreceding, 0))
        placed = placed.withColumn("end", running)
        same = placed["source"].eqNullSafe(sums["source"]) & (placed["group"] == sums["group"])
        self.documents = placed.join(sums, same).select("doc_id", "rank", placed["source"], "source_size", "target", "size", "hash", (F.col("base") + F.col("end") - F.col("size")).alias("begin"))

        blocks = F.ceil(F.col("source_size") / block)
        drawn = sources.where("source_size > 0").select("rank", blocks.alias("blocks"), (F.col("target") * blocks / F.col("source_size")).alias("slots"))
        total = drawn.agg(F.sum("slots")).first()[0] or 0.0
        n_slots = max(1, round(total))
        per_shard = max(shard_slots, math.ceil(n_slots / MAX_SHARDS))
        shards = math.ceil(n_slots / per_shard)
        # a few rows stand for all slots: they are dealt out in stretches before each slot gets its row, over a number of tasks that goes by the slots
        tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(n_slots / TASK_SLOTS))
        drawn = drawn.withColumn("slots", F.least(F.round("slots").cast("long"), F.col("blocks") * most)).where("slots > 0")
        balls = drawn.withColumn("since", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slots") - 1, F.lit(STRETCH).cast("long")))).repartition(tasks, "rank", "since")
        balls = balls.select("rank", "blocks", F.explode(F.sequence("since", F.least("slots", F.col("since") + STRETCH) - 1)).alias("ball"))
        counts = balls.groupBy("rank", "blocks", F.pmod(F.xxhash64("rank", "ball", F.lit(seed + 2)), F.lit(shards)).cast("int").alias("shard")).agg(F.count("*").alias("n"))
        counts = counts.withColumn("first", F.coalesce(F.sum("n").over(Window.partitionBy("rank").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        #: How many slots of each shard each source gets, and how many it has in the shards before.
        self.counts = counts.select("shard", "rank", "n", "first", "blocks")
        stretch = self.counts.withColumn("since", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(STRETCH).cast("long"))))
        stretch = stretch.repartition(tasks, "shard", "rank", "since")
        upto = F.least(F.col("n"), F.col("since") + STRETCH) - 1
        each = stretch.select("*", F.explode(F.sequence("since", upto)).alias("k"))
        each = each.withColumn("j", F.col("first") + F.col("k"))
        index = F.expr(_permuted("(j % blocks)", "blocks", f"rank, j div blocks, {seed}"))
        self.slots = each.select("shard", "rank", F.xxhash64("rank", "j", F.lit(seed + 3)).alias("slot"), index.alias("index"))

    def _pieces(self, docs: DataFrame) -> DataFrame:
        """Each row's parts of blocks: index, first (its first word there, of the row) and n_words."""
        b, end = self.block, F.col("begin") + F.col("size")
        docs = docs.withColumn("index", F.explode(F.when(F.col("size") > 0, F.sequence(F.floor(F.col("begin") / b), F.floor((end - 1) / b))).otherwise(F.array(F.lit(-1).cast("long")))))
        first = F.greatest(F.col("index") * b - F.col("begin"), F.lit(0))
        return docs.withColumn("first", first).withColumn("n_words", F.least(F.col("size"), (F.col("index") + 1) * b - F.col("begin")) - first)

    def taken(self) -> DataFrame:
        """(doc_id, source, size, source_size, target, taken), a row per input row; taken counts the words that the mix takes, repeats too."""
        uses = self.slots.groupBy("rank", "index").agg(F.count("*").alias("uses"))
        # merge: the planner takes the slots for as few as the rows they come from, and would broadcast them
        pieces = self._pieces(self.documents).join(uses.hint("merge"), ["rank", "index"], "left")
        n = F.when(F.col("index") >= 0, F.coalesce(F.col("n_words") * F.col("uses"), F.lit(0))).otherwise(0)
        key = ["doc_id", "source", "size", "source_size", "target", "begin"]
        # repeated rows without words share the key; each of them is one piece
        rows = pieces.select(*key, n.alias("n"), (F.col("index") < 0).cast("long").alias("bare")).groupBy(*key).agg(F.sum("n").alias("taken"), F.greatest(F.sum("bare"), F.lit(1)).alias("rows"))
        return rows.select("doc_id", "source", "size", "source_size", "target", "taken", F.explode(F.sequence(F.lit(1), F.col("rows")))).drop("col")

    def blocks(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """The mixed words: (shard, slot, source, index, begin, doc_id, first, n_words, text), a row for each document's part of each slot; docs are those of the mix.

        Slots of a shard are read in order of slot, a slot's parts in order of begin. Each row gives its own text, with a null or repeated id too.
        """
        n = F.coalesce(F.regexp_count(column(text_col), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
        texts = docs.select(F.coalesce(column(id_col).cast("long"), F.lit(NO_ID)).alias("id"), n.alias("length"), _hash(text_col).alias("digest"), column(text_col).alias("text")).where("length > 0").dropDuplicates(["id", "length", "digest"])
        rows = self.documents.where("size > 0").withColumn("id", F.coalesce("doc_id", F.lit(NO_ID)))
        rows = rows.join(texts, (rows["id"] == texts["id"]) & (rows["size"] == texts["length"]) & (rows["hash"] == texts["digest"])).select("doc_id", "rank", "source", "begin", "size", words(F.col("text")).alias("words"))
        b, begin = self.block, F.col("begin")

        def piece(index):
            first = F.greatest(index * b - begin, F.lit(0))
            # size(words) is the row's size; naming the words twice also keeps the planner from splitting the text for each piece
            n = F.least(F.size("words").cast("long"), (index + 1) * b - begin) - first
            return F.struct(index.alias("index"), first.alias("first"), n.alias("n_words"), F.array_join(F.slice("words", first.cast("int") + 1, n.cast("int")), " ").alias("text"))

        cut_up = F.transform(F.sequence(F.floor(begin / b), F.floor((begin + F.col("size") - 1) / b)), piece)
        pieces = rows.select("doc_id", "rank", "source", "begin", F.inline_outer(cut_up))
        return self.slots.hint("merge").join(pieces, ["rank", "index"]).select("shard", "slot", "source", "index", "begin", "doc_id", "first", "n_words", "text")
