"""Full text search: postings and BM25 ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanlake.functions.text import TOKEN, tokens

K1, B = 1.2, 0.75
#: A query of so many characters at most has few enough tokens to broadcast what is known of each.
BROADCAST_CHARS = 100_000


def postings(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(token, id, tf, length), a row for each distinct token of a document."""
    words = docs.select(F.col(id_col).alias("id"), tokens(F.col(text_col)).alias("words")).where("size(words) > 0")
    each = words.select("id", F.size("words").alias("length"), F.explode_outer("words").alias("token"))
    return each.groupBy("token", "id", "length").agg(F.count("*").alias("tf"))


def search(docs: DataFrame, query: str, id_col: str, text_col: str, k: int | None = 100) -> DataFrame:
    """(id, score): documents that hold every token of the query, by BM25, best first, ties by id; all of them if k is None.

    Only the query's tokens are exploded, so the text is read once for the corpus statistics and once for the matches.
    """
    wanted = F.array_distinct(tokens(F.lit(query)))
    length = F.regexp_count(F.lower(F.col(text_col)), F.lit(TOKEN))
    corpus = docs.select(F.nullif(length, F.lit(0)).alias("length")).agg(F.count("length").alias("n"), F.avg("length").alias("mean"))
    words = docs.select(F.col(id_col).alias("id"), tokens(F.col(text_col)).alias("words"))
    hits = words.select("id", F.size("words").alias("length"), F.explode_outer(F.filter("words", lambda w: F.array_contains(wanted, w))).alias("token")).where("token IS NOT NULL")
    return _ranked(hits.groupBy("id", "length", "token").agg(F.count("*").alias("tf")), corpus, query, k)


def search_postings(posts: DataFrame, query: str, k: int | None = 100) -> DataFrame:
    """Like search(), from postings (token, id, tf, length) and not from texts: only the query's tokens are read, and lengths for the corpus statistics."""
    wanted = F.array_distinct(tokens(F.lit(query)))
    lengths = posts.groupBy("id").agg(F.first("length").alias("length"))
    corpus = lengths.agg(F.count("*").alias("n"), F.avg("length").alias("mean"))
    return _ranked(posts.where(F.array_contains(wanted, F.col("token"))).select("id", "length", "token", "tf"), corpus, query, k)


def _ranked(tf: DataFrame, corpus: DataFrame, query: str, k: int | None) -> DataFrame:
    """(id, score) from (id, length, token, tf) of the query's tokens and the corpus's size and mean length, one row."""
    df = tf.groupBy("token").agg(F.count("*").alias("df"))  # a row a query token
    df = F.broadcast(df) if len(query) <= BROADCAST_CHARS else df
    scored = tf.join(df, "token").join(F.broadcast(corpus))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("mean")))
    terms = F.size(F.array_distinct(tokens(F.lit(query))))
    out = scored.groupBy("id").agg(F.sum(weight).alias("score"), F.count("*").alias("found")).where(F.col("found") == terms).select("id", "score")
    out = out.orderBy(F.desc("score"), "id")
    return out if k is None else out.limit(k)
