"""The registered query of each operator, and its SQL where DuckDB can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanlake.llm.decontamination import contaminated
from spanlake.llm.embeddings import embedding_components
from spanlake.llm.jaccard_join import jaccard_components
from spanlake.llm.line_dedup import line_dedup
from spanlake.llm.mixing import Mixture
from spanlake.llm.quality import score, train
from spanlake.llm.secrets import secret_spans
from spanlake.llm.substring_dedup import substring_dedup
from spanlake.llm.suffix_dedup import suffix_dedup
from spanlake.llm.url_filter import judge_urls


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring_dedup(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    machine = train(docs, table(spark, sf_dir, "labels"))
    return score(docs.select("doc_id", "text", "n_chars"), machine).select("doc_id", "held_out", "score", "predicted")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Mixture(table(spark, sf_dir, "documents")).taken().select("doc_id", "size", "source_size", "target", "taken", "source")


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_spans(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = suffix_dedup(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_components(table(spark, sf_dir, "embeddings"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_removed", "text")


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_substring_dedup,
        op2_quality_classifier,
        op3_mixing,
        op4_secret_scan,
        op5_decontamination,
        op6_suffix_dedup,
        op7_embedding_dedup,
        op8_url_filter,
        op9_line_dedup,
        op10_jaccard_join,
    )
}

SQL = {
    "op1_substring_dedup": r"""
        WITH split AS (
            SELECT doc_id, [x FOR x IN string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+') IF x <> ''] AS w FROM documents),
        windows AS (
            SELECT doc_id, p, array_to_string(w[p:p + 19], ' ') AS words
            FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS p FROM split WHERE len(w) >= 20)),
        later AS (
            SELECT doc_id, p FROM (
                SELECT doc_id, p, row_number() OVER (PARTITION BY words ORDER BY doc_id, p) AS k FROM windows) WHERE k > 1),
        gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + 20)) AS p FROM later),
        each AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM split WHERE len(w) > 0),
        kept AS (
            SELECT e.doc_id, string_agg(e.word, ' ' ORDER BY e.p) FILTER (WHERE g.p IS NULL) AS text, count(g.p) AS n_removed
            FROM each e LEFT JOIN gone g ON e.doc_id = g.doc_id AND e.p = g.p GROUP BY e.doc_id)
        SELECT s.doc_id, CAST(len(s.w) AS BIGINT) AS n_words, CAST(coalesce(k.n_removed, 0) AS BIGINT) AS n_removed,
               sha256(coalesce(k.text, '')) AS kept_sha256
        FROM split s LEFT JOIN kept k ON s.doc_id = k.doc_id""",
    "op5_decontamination": r"""
        WITH doc_words AS (
            SELECT doc_id, [x FOR x IN string_split_regex(lower(coalesce(text, '')), '[\x20\x09-\x0D]+') IF x <> ''] AS w FROM documents),
        item_words AS (
            SELECT item_id, [x FOR x IN string_split_regex(lower(coalesce(text, '')), '[\x20\x09-\x0D]+') IF x <> ''] AS w FROM benchmark),
        doc AS (
            SELECT DISTINCT doc_id, array_to_string(w[p:p + 4], ' ') AS s
            FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS p FROM doc_words WHERE len(w) >= 5)),
        item AS (
            SELECT DISTINCT item_id, array_to_string(w[p:p + 4], ' ') AS s
            FROM (SELECT item_id, w, unnest(range(1, len(w) - 3)) AS p FROM item_words WHERE len(w) >= 5)),
        sizes AS (SELECT item_id, count(*) AS n FROM item GROUP BY item_id),
        found AS (SELECT doc_id, item_id, count(*) AS k FROM doc JOIN item USING (s) GROUP BY doc_id, item_id)
        SELECT doc_id, item_id, n AS n_shingles, k AS n_found, k / n AS containment
        FROM found JOIN sizes USING (item_id) WHERE 10 * k >= 8 * n""",
    "op9_line_dedup": r"""
        WITH split AS (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents),
        windows AS (
            SELECT doc_id, p, array_to_string(l[p:p + 2], chr(10)) AS window3
            FROM (SELECT doc_id, l, unnest(range(1, len(l) - 1)) AS p FROM split WHERE len(l) >= 3)),
        later AS (
            SELECT doc_id, p FROM (
                SELECT doc_id, p, row_number() OVER (PARTITION BY window3 ORDER BY doc_id, p) AS k
                FROM windows WHERE regexp_matches(window3, '\S')) WHERE k > 1),
        gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + 3)) AS p FROM later),
        each AS (SELECT doc_id, unnest(l) AS line, unnest(range(1, len(l) + 1)) AS p FROM split),
        kept AS (
            SELECT e.doc_id, string_agg(e.line, chr(10) ORDER BY e.p) FILTER (WHERE g.p IS NULL) AS text, count(g.p) AS n_removed
            FROM each e LEFT JOIN gone g ON e.doc_id = g.doc_id AND e.p = g.p GROUP BY e.doc_id)
        SELECT s.doc_id, CAST(coalesce(len(s.l), 0) AS BIGINT) AS n_lines, CAST(coalesce(k.n_removed, 0) AS BIGINT) AS n_removed,
               CASE WHEN s.text IS NOT NULL THEN coalesce(k.text, '') END AS text
        FROM split s LEFT JOIN kept k ON s.doc_id = k.doc_id""",
}
